"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import binascii
import hashlib
import itertools
import json
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from assetloom.llm import bpe, fingerprints, jaccard, langid, media, packing, quality, registry, secrets, tables, toolcalls, urls
from assetloom.llm.words import shingle_hashes

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\t", "a", "Zürich é 漢字 \x1c\x85 \u200b", "x" * 50_000, "word " * 20_000, "a", "b a b a"]


@pytest.fixture(scope="module")
def texts():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """Tables with nulls, empty and long texts, repeated rows and clashing extra columns."""
    d = tmp_path_factory.mktemp("odd")
    docs = [(i, t, "en" if i % 3 else None, None, 0, "x") for i, t in enumerate(ODD)] + [(3, ODD[3], "de", "s", 1, "y")]
    good = pd.read_parquet(f"{SF}/documents.parquet").head(40)
    docs += [(100 + i, t, lang, "s", 1, "z") for i, (t, lang) in enumerate(zip(good.text, good.lang, strict=True))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(100 + i, int(i % 2), None) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    pages = [(1, None, None), (2, "no scheme", "<p>hi</p>"), (3, "http://", ""), (3, "http://", ""), (4, "HTTP://A.Example.ORG/es/x?y#z", "<p>casino bets</p>"), (5, "x://freebets.example.net/a", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    vectors = [(0, [1.0, 0.5], 1), (1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 0.0], 1), (4, [1.0, 0.25], None), (5, [], 2), (6, [0.9, 0.5], 1), (7, [0.9, 0.45], 1), (8, [0.85, 0.5], 2), (8, [0.85, 0.5], 2), (None, [1.0, 1.0], 1)]
    spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<float>, label int, id int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", None), (2, 0, "user", "hi there you"), (2, 0, "user", "hi there you"), (None, None, None, None)], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return str(d)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_odd_rows(spark, odd_dir, name):
    got = registry.QUERIES[name](spark, odd_dir).toPandas()
    assert len(got)
    if name not in ("op1_tool_calls", "op3_url_filters", "op9_best_fit_packing", "op12_hard_negatives", "pipeline"):
        assert sorted(got.doc_id) == sorted(spark.read.parquet(f"{odd_dir}/documents.parquet").toPandas().doc_id)


@pytest.mark.parametrize("name", ["op2_byte_bpe", "op4_media_columns", "op5_document_fingerprints", "op6_secret_scan", "op8_jaccard_join", "op9_best_fit_packing", "op1_tool_calls", "op11_substring_dedup", "op12_hard_negatives", "op13_fill_in_middle"])
def test_empty_tables(spark, tmp_path, name):
    for t, ddl in {"documents": "doc_id long, text string, lang string", "conversations": "conv_id long, turn long, role string, text string", "embeddings": "vec_id long, embedding array<float>, label int"}.items():
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{t}.parquet")
    assert registry.QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op3_url_filters", "op7_language_id", "op10_quality_classifier", "pipeline"])
def test_empty_tables_of_the_others(spark, tmp_path, name):
    for t, ddl in {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string"}.items():
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{t}.parquet")
    assert registry.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    model = langid.fit_languages(docs, F.lit(True))
    assert model.languages == [] and model.predict(["some text", None]) == (["und", "und"], [0.0, 0.0])
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    assert (quality.fit_quality(docs, labels, F.lit(True)).scores(np.array([quality.statistics("some text")])) == 0.5).all()


@pytest.mark.parametrize("name", list(registry.SQL))
def test_same_as_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rows = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).values.tolist()))
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(c.execute(registry.SQL[name]).df())


# 1


def test_levels_by_brute_force(spark):
    """Chains, joints and cycles, against the longest chain by plain recursion."""
    r = random.Random(4)
    needs = {f"c{i}": [f"c{i - 1}"] for i in range(1, 70)} | {"c0": [], "x": ["y"], "y": ["z"], "z": ["x"], "w": ["x"], "self": ["self"], "ends": ["w", "c3"]}
    needs |= {f"d{i}": [f"d{j}" for j in {r.randrange(max(0, i - 6), i) for _ in range(r.randrange(0, 4))}] if i else [] for i in range(60)}
    calls = spark.createDataFrame([(k, v) for k, v in needs.items()], "call_id string, after array<string>")

    def level(k, above=()):
        below = [None if n in (*above, k) else level(n, (*above, k)) for n in needs[k]]
        return None if None in below else max([x + 1 for x in below], default=0)

    # repeated work is kept small: the d-graph is narrow
    from functools import lru_cache

    @lru_cache(None)
    def of_d(k):
        return max([of_d(n) + 1 for n in needs[k]], default=0)

    want = {k: of_d(k) if k[0] == "d" else level(k) for k in needs}
    got = {x.call_id: x.level for x in toolcalls.levels(calls).collect()}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch):
    chain = spark.createDataFrame([(f"c{i}", f"c{i - 1}") for i in range(1, 400)], "call_id string, to string")
    n, real = [], toolcalls.stored
    monkeypatch.setattr(toolcalls, "stored", lambda df: n.append(1) or real(df))
    got = {x.call_id: (x.to, x.far) for x in toolcalls.chain_ends(chain).collect()}
    assert got == {f"c{i}": ("c0", i) for i in range(1, 400)} and len(n) < 3 * 12


def test_arguments_that_are_hard_to_parse(spark):
    deep = "[" * 100_000 + "]" * 100_000
    texts = [deep, '{"a":' * 5_000 + "1" + "}" * 5_000, '{"x":"\\ud800"}', '{"x":NaN}', '{"x":1}', '{"x":true}', '{"x":null}', None]
    calls = spark.createDataFrame([(1, i, str(i), "f", t, []) for i, t in enumerate(texts)], "conv_id long, turn long, call_id string, name string, arguments string, after array<string>")
    results = spark.createDataFrame([], "call_id string, turn long, content string")
    schema = {"f": {"type": "object", "properties": {"x": {"type": ["string", "null", "integer", "boolean"], "enum": ["\ud800", 1, None]}}}}
    got = {r.turn: r for r in toolcalls.link_tool_calls(calls, results, schema).collect()}
    assert [got[i].errors for i in (0, 3, 7)] == ["$: not an object"] * 3
    assert [got[i].valid for i in (2, 4, 5, 6)] == [True, True, False, True]
    assert got[5].errors == "$.x: not one of enum" and '"x":"\\ud800"' in got[2].json and json.loads(got[2].json)


def test_tool_calls_levels_links_and_schemas(spark):
    calls = spark.createDataFrame([(1, 0, "a", "f", '{"y":1,"x":"é"}', []), (1, 1, "b", "f", "{}", ["a", "zz"]), (1, 2, "c", "f", "[1", ["b", "a"]), (1, 3, "d", "g", "{}", ["e"]), (1, 4, "e", "g", "{}", ["d"]), (1, 5, None, "g", "{}", [])], "conv_id long, turn long, call_id string, name string, arguments string, after array<string>")
    results = spark.createDataFrame([("a", 2, "late"), ("a", 1, "now")], "call_id string, turn long, content string")
    schema = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "string"}, "y": {"type": "integer", "maximum": 0}}}}
    got = {r.turn: r for r in toolcalls.link_tool_calls(calls, results, schema).collect()}
    assert [got[i].level for i in range(6)] == [0, 1, 2, None, None, None]
    assert got[0].linked and json.loads(got[0].json)["result"] == "now" and got[0].json.startswith('{"arguments":{"x":"é","y":1},')
    assert got[0].errors == "$.y: too large" and got[1].errors == "$.x: missing" and got[2].errors == "$: not an object" and got[3].errors == "name: unknown"
    assert got[1].needs_missing == 1 and not got[1].linked


# 2


def test_bpe_as_the_library(texts):
    import tiktoken

    c = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    r = random.Random(5)
    made = ["".join(r.choice("aab  \n\t\xa0é'sst12,!漢\x1c" + chr(r.randrange(32, 3000))) for _ in range(r.randrange(1, 40))) for _ in range(3000)]
    for t in [*texts.text, *made, *(x or "" for x in ODD), "ab" * 20_000 + "\n" * 900 + "é" * 700]:
        ids = c.encode(t)
        assert ids == own.encode_ordinary(t) and c.decode(ids) == t.encode()


def test_bpe_query(spark, texts):
    import tiktoken

    c = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    got = registry.QUERIES["op2_byte_bpe"](spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(texts.doc_id, texts.text, strict=True):
        ids = own.encode_ordinary(t)
        assert got.n_tokens[i] == len(ids) and got.ids_sha256[i] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and got.decoded_sha256[i] == hashlib.sha256(t.encode()).hexdigest()


# 3


def test_urls(spark):
    rows = [(1, "http://m.casino-win.EXAMPLE.com/en/1?x"), (2, "https://a.example.org/es/9"), (3, "https://example.org/en/12"), (4, "https://b.org"), (5, "q://x.com/de/"), (6, None), (7, "http://notorg/x"), (8, "u://a.net#://b")]
    d = urls.split_url(spark.createDataFrame(rows, "id int, url string"))
    got = {r.id: r for r in d.withColumn("r", urls.longest_rule(F.col("host"), F.col("path"), urls.RULES)).collect()}
    assert (got[1].host, got[1].path) == ("m.casino-win.example.com", "/en/1") and got[1].r is None
    assert got[2].r.rule == "example.org/es/" and got[2].r.verdict == "block" and got[3].r.rule == "example.org/en/1"
    assert got[4].r is None and got[4].path == "" and got[5].r.rule == "com/de/" and got[6].host == "" and got[7].r is None and got[8].host == "a.net"


def test_words_written_together():
    u = urls.Unigrams({w: math.log(0.01) for w in ("free", "bets", "casino", "win", "the")}, 1e6)
    assert u.split("freebets") == ["free", "bets"] and u.split("casinowin") == ["casino", "win"] and u.split("zzz") == ["zzz"]

    def brute(s):
        cuts = (c for n in range(len(s)) for c in itertools.combinations(range(1, len(s)), n))
        return max(sum(map(u._log, [s[a:b] for a, b in zip((0, *c), (*c, len(s)), strict=True)])) for c in cuts)

    for s in ("freewin", "thebets", "xfree"):
        assert sum(map(u._log, u.split(s))) == pytest.approx(brute(s))


def test_spam_hosts_blocked_and_clean_ones_not(spark):
    got = registry.QUERIES["op3_url_filters"](spark, SF).toPandas()
    free = got[got.rule.isna()]
    spam = free.host.str.contains("adult-x|spam-farm|casino|bets|pills|ads-track")
    assert (free.verdict[spam] == "block").all() and (free.verdict[~spam] == "allow").all()


def test_adult_and_spam_hosts_blocked(spark):
    got = registry.QUERIES["op3_url_filters"](spark, "/root/testdata/sf0.1").toPandas()
    free = got[got.rule.isna()]
    spam = free.host.str.contains("adult-x|spam-farm|casino|bets|pills|ads-track")
    assert {"adult", "spam"} <= set(" ".join(free.host_words[spam]).split())
    assert (free.verdict[spam] == "block").all() and (free.verdict[~spam] == "allow").all()


def test_last_label_single_label_and_path_give_labels(spark, tmp_path):
    pages = [(i, f"http://shop{i}.example.net/en/{i}", "<p>the shop has a royal example</p>") for i in range(20)]
    pages += [(100, "http://royal.casino/en/1", ""), (101, "http://xxx/en/1", ""), (102, "http://royal.example.net/porn/1", ""), (103, "http://royal.example.net/en/1", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.QUERIES["op3_url_filters"](spark, str(tmp_path)).toPandas().set_index("page_id")
    assert (got.verdict[[100, 101, 102]] == "block").all() and (got.verdict[range(20)] == "allow").all()
    assert got.host_words[100] == "royal casino" and got.host_words[101] == "xxx"


def test_every_word_of_the_corpus_is_known(spark):
    common = "".join(f" w{a}{b}{c}{d}" for a, b, c, d in itertools.product("abcdefghijklmnop", repeat=4)).replace(" w", " q")
    pages = spark.createDataFrame([(1, common * 2 + " zebra quilt")], "page_id long, html string")
    counts = urls.count_unigrams(pages)
    assert counts.count() == 16**4 + 2
    hosts = spark.createDataFrame([("zebraquilt.example.net",), ("zebraquilt.example.net",), ("freebets-7.casino",)], "host string")
    got = {r.host: r.words for r in urls.split_hosts(hosts, counts).collect()}
    assert got == {"zebraquilt.example.net": ["zebra", "quilt", "example"], "freebets-7.casino": ["free", "bets", "0", "casino"]}


def test_bayes_weighs_every_word_of_path(spark):
    rows = [("a.net", [f"/{w}"], 1, [], [f"/{w}"], w == "casino") for w in ("casino", *(f"p{i}" for i in range(60_000)))]
    kinds = spark.createDataFrame(pd.DataFrame(rows, columns=["host", "path_words", "n", "host_words", "words", "label"]), "host string, path_words array<string>, n long, host_words array<string>, words array<string>, label boolean")
    got = {r.w: r.weight for r in urls.fit_bayes(kinds).collect()}
    assert len(got) == 60_001
    assert got["/casino"] == pytest.approx(math.log(2 / 60_003) - math.log(1 / 120_002)) and got["/p59999"] == pytest.approx(math.log(1 / 60_003) - math.log(2 / 120_002))


def test_split_bayes_and_verdict_by_brute_force(spark):
    """Counts, splits, weights and verdicts of all pages in plain Python."""
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    counts: dict = {}
    for h in pages.html:
        for w in re.split(r"[^a-z]+", re.sub(r"<[^>]*>", " ", h or "").lower()):
            if len(w) > 1:
                counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    seeds = urls.STRONG | urls.WEAK
    for w in seeds:
        counts[w] = counts.get(w, 0) + total * urls.SEED_SHARE
    total += len(seeds) * total * urls.SEED_SHARE
    known = urls.Unigrams({w: math.log(n / total) for w, n in counts.items()}, total)
    kinds, of = {}, {}
    for i, u in zip(pages.page_id, pages.url, strict=True):
        rest = u.split("://", 1)[1] if "://" in (u or "") else ""
        host, path = re.match(r"[^/?#]*", rest)[0].lower(), re.match(r"[^/?#]*([^?#]*)", rest)[1]
        words = tuple("/" + (p if p[0] > "9" else "0") for p in re.findall(r"[a-z]+|[0-9]+", path.lower()))
        of[i] = (host, words)
        kinds[of[i]] = kinds.get(of[i], 0) + 1
    words = {k: [*urls.host_words(k[0], known), *k[1]] for k in kinds}
    spam = lambda k: bool({w.strip("/") for w in words[k]} & urls.STRONG) or len({w.strip("/") for w in words[k]} & urls.WEAK) > 1
    per = [{}, {}]
    for k, n in kinds.items():
        for w in words[k]:
            per[spam(k)][w] = per[spam(k)].get(w, 0) + n
    vocabulary = {w for x in words.values() for w in x}
    sums = [sum(p.values()) + len(vocabulary) + 1 for p in per]
    odds = {k: sum(math.log((per[1].get(w, 0) + 1) / sums[1]) - math.log((per[0].get(w, 0) + 1) / sums[0]) for w in x) for k, x in words.items()}
    got = registry.QUERIES["op3_url_filters"](spark, SF).toPandas().set_index("page_id")
    for i, k in of.items():
        assert got.block_odds[i] == pytest.approx(odds[k], abs=1e-9) and got.host_words[i] == " ".join(urls.host_words(k[0], known))
        if got.rule[i] is None:
            assert got.verdict[i] == ("block" if odds[k] > 0 else "allow")


# 4


def test_images_round_trip():
    r = np.random.default_rng(3)
    for w, h in ((1, 1), (5, 3), (64, 2)):
        for form, channels in (("ppm", 3), ("pgm", 1), ("bmp", 3)):
            p = r.integers(0, 256, (h, w, channels)).astype(np.uint8)
            assert (media.decode_image(media.encode_image(p, form)) == p).all()
    with pytest.raises(ValueError):
        media.decode_image(b"GIF89a")


def test_area_resize_by_brute_force():
    p = np.random.default_rng(4).integers(0, 256, (5, 7, 2)).astype(np.uint8)
    big = np.repeat(np.repeat(p, 6, axis=0), 6, axis=1).astype(float)  # 30 x 42 cells: multiples of 3 x 6
    want = big.reshape(3, 10, 6, 7, 2).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(p, 3, 6), want)


def test_media_query(spark, texts):
    got = registry.QUERIES["op4_media_columns"](spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(texts.doc_id, texts.text, strict=True):
        b = t.encode()
        p = b + b" " * (-len(b) % 192 or (0 if b else 192))
        assert (got.n_bytes[i], got.payload_bytes[i], got.payload_sha256[i], got.tail_crc32[i]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))


# 5


def test_likeness_near_jaccard():
    r, errors = random.Random(9), []
    for share in (0.2, 0.5, 0.8, 0.95):
        for _ in range(8):
            a = [str(r.random()) for _ in range(400)]
            b = a[: int(share * 400)] + [str(r.random()) for _ in range(400 - int(share * 400))]
            x, y = (set(shingle_hashes(" ".join(w), 5).tolist()) for w in (a, b))
            errors.append(fingerprints.likeness(*(fingerprints.fingerprint(" ".join(w)) for w in (a, b))) - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.15


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_fingerprint_bits(bits):
    a, b = (fingerprints.fingerprint(t, bits=bits) for t in ("a b c d e f g", "q r s t u v w"))
    assert len(a) == 256 * bits // 8 and fingerprints.likeness(a, a, bits) == 1.0 and fingerprints.likeness(a, b, bits) < 0.35
    assert fingerprints.fingerprint("") == b"" and fingerprints.likeness(b"", b"") == 1.0 and fingerprints.likeness(b"", a) == 0.0


def test_edited_pairs_query(spark, texts):
    got = registry.QUERIES["op5_document_fingerprints"](spark, SF).toPandas().set_index("doc_id")
    d = texts.sort_values("doc_id", ascending=False)
    nexts = [*d.text[1:], d.text.iloc[0]]
    for i, t, n in zip(d.doc_id, d.text, nexts, strict=True):
        k = len(t) // 3
        edited = t[: len(t) - k] + n[:k]
        assert got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest() and got.n_chars[i] == len(t)
        assert got.fingerprint[i] == fingerprints.fingerprint(t).hex() and got.near_next[i] == fingerprints.likeness(fingerprints.fingerprint(t), fingerprints.fingerprint(n))


# 6


def base_spans(text):
    out = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_base_spans(texts):
    made = ["secret=token:abcdefgh", "TOKEN = 'abc' password: \"x.y=z-1/2\"", "AKIA" + "A" * 16 + "b" + "AKIAX", "x" + "0af" * 20 + "g", "api_key=" + "é" * 9 + "apikey:abcdef", "ſecret=abcdefg to\u212aen=abcdefg"]
    for t in [*texts.text, *made]:
        assert secrets.scan(t)[0] == base_spans(t)


def test_entropy_windows_by_brute_force():
    r = random.Random(2)
    for _ in range(60):
        run = "".join(r.choice("abcdef0123456789ABCXYZ"[: r.randrange(3, 22)]) for _ in range(r.randrange(20, 60)))
        entropy = lambda w: -sum(c / len(w) * math.log2(c / len(w)) for c in (w.count(x) for x in set(w)))
        inside = set()
        for i in range(len(run) - 19):
            if entropy(run[i : i + 20]) >= 3.2 - 1e-9:
                inside.update(range(i, i + 20))
        got = {x for a, b in secrets.window_spans(run, 20, 3.2, secrets.PLOGS) for x in range(a, b)}
        assert got == inside


def test_secrets_masked_and_words_left_alone():
    run = secrets._masker.__wrapped__()
    key = "aB3dE5fG7hJ9kL1mN2pQ4rS6"
    assert run(f"see {key} now") == "see [SECRET] now" and run("token = 'abcdef1' ok") == "[SECRET]' ok"
    for t in ("internationalizationisation", "123e4567-e89b-12d3-a456-426614174000", "1234-5678-9012-3456-7890-1234", "some-words-joined-by-hyphens-are-fine"):
        assert run(t) == t


def test_random_tokens_of_each_alphabet_are_found():
    r = random.Random(11)
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    for alphabet in (low + digits, up + digits, up + "234567", low + up + digits, low + up + digits + "+/", low, up, low + up):
        for n in (20, 32, 40):
            tokens = ["".join(r.choice(alphabet) for _ in range(n)) for _ in range(400)]
            assert sum(bool(secrets.scan(f"see {t} now")[1]) for t in tokens) >= 0.97 * 400, (alphabet, n)


def test_allow_list_holds_for_parts_only():
    key = "aB3dE5fG7hJ9kL1mN2pQ4rS6"
    for joined in (f"example/{key}", f"{key}_xxxx", f"my-placeholder={key}", f"{key}-0123456789"):
        assert any(a <= joined.index(key) and b >= joined.index(key) + len(key) for _, a, b in secrets.scan(joined)[1]), joined
    for t in (f"example{key}", "id=123e4567-e89b-12d3-a456-426614174000", "AbstractSingletonProxyFactoryBean", "path/to/some-long-file-name", "Donaudampfschifffahrtsgesellschaft"):
        assert not secrets.scan(t)[1], t


# 7, 10


def test_language_held_out(spark, texts):
    got = registry.QUERIES["op7_language_id"](spark, SF).toPandas().merge(texts, on="doc_id")
    held = got[got.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in held.doc_id]).all()
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_kernel_is_the_presence_kernel():
    a, b = "Hello there", "hello world"
    grams = lambda t: set(langid.cells(t).tolist())
    k = float(langid.presence([a])[0] @ langid.presence([b])[0])
    assert k == pytest.approx(len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b))), rel=1e-5)
    assert len(langid.cells("")) == 0 and langid.LanguageModel(["en"], np.zeros((langid.CELLS, 1), np.float32), np.zeros((1, 1), np.float32), 1.0).predict([None, "12", ""]) == (["und"] * 3, [0.0] * 3)


def test_letters_are_letters():
    assert not any(any(map(str.isalpha, t)) for t in ("½", "²", "12 ٣"))
    model = langid.LanguageModel(["en"], np.zeros((langid.CELLS, 1), np.float32), np.zeros((1, 1), np.float32), 1.0)
    assert model.predict(["½²", "_1", "é", "漢"])[0] == ["und", "und", "en", "en"]


def test_statistics_by_hand():
    got = dict(zip(quality.STATS, quality.statistics("Ab cd. Ab cd.\nx1|"), strict=True))
    logit = lambda p, n: math.log((p * n + 0.5) / (n + 1) / (1 - (p * n + 0.5) / (n + 1)))
    want = {"log_chars": math.log(18), "log_words": math.log(6), "word_length": math.log(14 / 6), "upper": logit(2 / 9, 9), "digit": logit(1 / 17, 17), "symbol": logit(0, 17), "pipe": logit(1 / 17, 17), "stop": logit(2 / 17, 17)}
    want |= {"space": logit(4 / 17, 17), "distinct_words": math.log(4 / 6**0.8), "repeated_neighbours": logit(0, 4), "distinct_lines": logit(1, 2), "top_word": logit(2 / 5, 5), "letters_in_words": logit(9 / 17, 17), "sentence_ends": logit(2 / 5, 5), "plain_word_ends": logit(4 / 5, 5)}
    assert got == pytest.approx(want)


def test_repeated_and_contradicting_labels(spark):
    good = pd.read_parquet(f"{SF}/documents.parquet").head(40)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good.text)] * 3, "doc_id long, text string")
    labels = [(i, i % 2) for i in range(40)]
    once = quality.fit_quality(docs.distinct(), spark.createDataFrame(labels[2:], "doc_id long, quality int"), F.lit(True))
    more = quality.fit_quality(docs, spark.createDataFrame(labels + labels + [(0, 1), (1, 0)], "doc_id long, quality int"), F.lit(True))
    assert np.allclose(once.centre, more.centre) and np.allclose(once.means, more.means)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.QUERIES["op10_quality_classifier"](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_discriminant_is_a_density_ratio():
    r = np.random.default_rng(1)
    n = len(quality.STATS)
    x = np.concatenate((r.normal(0, 1, (400, n)), r.normal(1, 2, (400, n))))
    m = quality.fit_discriminant(x, np.repeat([0, 1], 400))
    z = (x[:5] - m.centre) / m.spread
    for i, inverse in enumerate(m.inverse_factors):
        cov = np.linalg.inv(inverse) @ np.linalg.inv(inverse).T
        want = -0.5 * np.einsum("ij,jk,ik->i", z - m.means[i], np.linalg.inv(cov), z - m.means[i]) - 0.5 * np.linalg.slogdet(cov)[1]
        assert np.allclose(m.constants[i] - 0.5 * np.square((z - m.means[i]) @ inverse.T).sum(axis=1), want)


# 8


def word_set(t, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_components(docs, width, percent):
    sets = {i: word_set(t, width) for i, t in docs}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "percent", "tile"), [(4, 85, 1024), (5, 80, 8)])
def test_components_by_brute_force(spark, monkeypatch, width, percent, tile):
    """Families of copies with ever more edits, so that links chain and many stand at the threshold."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    r, docs = random.Random(width), [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, " two words ")]
    for family in range(14):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice([5, 8, 12, 20, 40, 90, 200]))]
        for copy in range(r.choice([2, 5, 14])):
            docs.append((family * 50 + copy, " ".join(words).upper() if copy % 3 == 1 else " ".join(words)))
            for _ in range(r.randrange(0, 3)):
                words[r.randrange(len(words))] = f"x{r.randrange(3000)}"
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, shingle=width, percent=percent).collect()}
    assert got == brute_components(docs, width, percent)


@pytest.mark.parametrize(("width", "percent", "tile"), [(4, 85, 1024), (4, 60, 6)])
def test_links_by_brute_force(spark, monkeypatch, width, percent, tile):
    """Every link between rows is counted once, whatever the blocks and tiles in which sets meet."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    r, docs = random.Random(percent), [(900, None), (901, ""), (None, "one two three four")]
    for family in range(8):
        words = [f"w{r.randrange(90)}" for _ in range(r.choice([5, 12, 40, 90]))]
        for copy in range(r.choice([2, 5, 30])):
            docs += [(family * 50 + copy, " ".join(words))] * r.choice([1, 1, 2])
            for _ in range(r.randrange(0, 3)):
                words[r.randrange(len(words))] = f"x{r.randrange(90)}"
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = jaccard.jaccard_classes(df, shingle=width, percent=percent, count_links=True).collect()
    sets = [(i, word_set(t, width)) for i, t in docs]
    linked = lambda a, b: bool(a) and 100 * len(a & b) >= percent * len(a | b)
    want = sorted((-1 if i is None else i, len(s), 0 if i is None else sum(j is not None and linked(s, t) for j, t in sets) - bool(s)) for i, s in sets)
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_shingles, x.n_links) for x in got) == want


def test_a_large_group_is_joined_in_tiles(spark, monkeypatch):
    """Near copies of one text that are cut into many tiles, a shared passage and a far branch."""
    monkeypatch.setattr(jaccard, "TILE", 5)
    r, base = random.Random(1), [f"w{i}" for i in range(120)]
    docs = []
    for i in range(60):
        words = list(base)
        for _ in range(r.randrange(0, 3)):
            words[r.randrange(120)] = f"x{r.randrange(10_000)}"
        docs.append((i, " ".join(words)))
    docs += [(100 + i, " ".join(base[:60] + [f"y{i}_{k}" for k in range(60)])) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, shingle=5, percent=80).collect()}
    assert got == brute_components(docs, 5, 80)


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    t, u, v = ("a b c d e f g h i j", "q r s t u v w x y z", "k l m n o p q r s t")
    docs = [(1, t, "p"), (5, t, "q"), (5, u, "r"), (7, v, "s"), (7, v, "s"), (7, "", "t"), (8, v.upper(), "u"), (None, t, "v"), (None, None, "w"), (9, "", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = sorted(map(repr, jaccard.first_of_classes(df, shingle=5, percent=80).collect()))
    want = spark.createDataFrame([docs[i] for i in (0, 2, 3, 5, 7, 8, 9)], df.schema).collect()
    assert got == sorted(map(repr, want))


def test_rtree_gives_what_all_pairs_give():
    r = np.random.default_rng(2)
    for n, m in ((1, 1), (5, 40), (300, 1), (120, 90)):
        base = r.integers(0, 2**64, 80, dtype=np.uint64)
        sets = [np.unique(np.where(r.random(80) < 0.08, r.integers(0, 2**64, 80, dtype=np.uint64), base)) for _ in range(n + m)]
        vectors, sizes, firsts = [jaccard.count_vector(h) for h in sets], np.array([len(h) for h in sets]), np.array([h[0] for h in sets])
        ok = lambda i, j: np.minimum(vectors[i], vectors[j]).sum() >= jaccard.needed(sizes[i], sizes[j], 85)
        sides = np.repeat([1, 2], [n, m])
        assert sorted(map(tuple, jaccard.tile_pairs(vectors, sizes, firsts, sides, 85).tolist())) == [(i, n + j) for i in range(n) for j in range(m) if ok(i, n + j)]
        got = jaccard.tile_pairs(vectors[:n], sizes[:n], firsts[:n], sides[:n] * 0, 85)
        assert sorted(tuple(sorted(p)) for p in got.tolist()) == [(i, j) for i in range(n) for j in range(i + 1, n) if ok(i, j)]


def test_vectors_of_all_lengths_miss_no_pair():
    r, sets = np.random.default_rng(6), []
    for n in (1, 3, 30, 62, 63, 64, 66, 255, 256, 300, 2000, 60_000):
        base = r.integers(0, 2**64, n, dtype=np.uint64)
        sets += [np.unique(base), np.unique(base[: n - n // 12]), np.unique(np.concatenate((base, r.integers(0, 2**64, n // 14, dtype=np.uint64))))]
    sets = [h for h in sets if len(h)]
    links = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - k)}
    first, vectors = zip(*(jaccard.unpacked(jaccard.packed(h)) for h in sets), strict=True)
    got = jaccard.tile_pairs(vectors, np.array([len(h) for h in sets]), np.array(first, np.uint64), np.zeros(len(sets), np.int64), 80)
    assert len(links) > 30 and links <= {tuple(sorted(p)) for p in got.tolist()}


def test_meetings_whatever_the_batches():
    import pyarrow as pa

    r = np.random.default_rng(8)
    rows = sorted({(int(k), int(n), int(n) * 1000 + int(s)) for k, n, s in zip(r.integers(0, 60, 400), r.choice([10, 11, 12, 30, 33, 90], 400), r.integers(0, 6, 400), strict=True)})
    rows = sorted(rows + rows[::7])
    want = set()
    for _, group in itertools.groupby(rows, key=lambda x: x[0]):
        runs = []
        for _, n, s in group:
            if not runs or runs[-1][-1][0] * 100 < 85 * n:
                runs.append([])
            runs[-1].append((n, s))
        want |= {(x[0][1], s) for x in runs for _, s in x if len(set(x)) > 1}
    for size in (1, 2, 3, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + size], strict=True)], names=["key", "n", "sig"]) for at in range(0, len(rows), size)]
        got = [p for b in jaccard._meetings(85)(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert set(got) == want


def test_sets_that_link_share_a_key():
    r = np.random.default_rng(0)
    for percent in (80, 85, 95):
        for _ in range(300):
            n = int(r.integers(1, 400))
            a = r.integers(0, 2**64, n, dtype=np.uint64)
            cut = int(r.integers(0, max(1, n * (100 - percent) // 100) + 1))
            b = np.concatenate((a[cut:], r.integers(0, 2**64, int(r.integers(0, cut + 1)), dtype=np.uint64)))
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= percent * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                assert len(np.intersect1d(jaccard.meeting_keys(a, percent), jaccard.meeting_keys(b, percent)))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in tables.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# 9


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    got = registry.QUERIES["op9_best_fit_packing"](spark, SF).toPandas()
    pieces = {(r.doc_id, r.piece): r for r in got.itertuples()}
    for i, text in zip(texts.doc_id, texts.text, strict=True):
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        for k, start in enumerate(range(0, len(ids), 4096)):
            p = pieces.pop((i, k))
            part = ids[start : start + 4096]
            assert (p.start, p.length, p.ids_crc32) == (start, len(part), binascii.crc32(np.array(part, "<u4").tobytes()))
    assert not pieces
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.concatenate(([0], s.length.cumsum()[:-1]))).all() and s.length.sum() <= 4096
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 4096) * 1.1 + 1


def test_words_as_the_tokenizer():
    w, r = packing.WordIds(public_tokenizers.path("word_bpe_49k.json")), random.Random(3)
    for _ in range(2000):
        s = "".join(r.choice("aab  \n\t\xa0éÉ'sstS12,!漢\x1c\x85zİßΣ|<|endoftext|>") for _ in range(r.randrange(1, 40)))
        assert w.text(s).tolist() == w.tokenizer.encode(s, add_special_tokens=False).ids


def test_added_tokens_as_the_library():
    from tokenizers import Tokenizer

    plain, w = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for s in ("a <|endoftext|> b", "x<|startoftext|>y<|endoftext|>", "<|ENDOFTEXT|>", "é<|endoftext|>É", "<|endoftext|", "<|endof text|>"):
        assert w.text(s).tolist() == plain.encode(s, add_special_tokens=False).ids
    assert w.text("a <|endoftext|> b").tolist() == [320, 49407, 321]


def test_best_fit_keeps_few_bins_open():
    fit, r = packing.BestFit(100, 4), random.Random(1)
    used: dict = {}
    for _ in range(500):
        n = r.randrange(1, 101)
        which, offset = fit.place(n)
        assert used.get(which, 0) == offset and offset + n <= 100
        used[which] = offset + n
        assert sum(map(len, fit.by_free.values())) == fit.n_open <= 4


# the pipeline


def test_pipeline_by_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF).toPandas()
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert sorted(kept.doc_id) == sorted(i for i, (_, c) in want.items() if c == i)
    masked = corpus_pipeline.secret_stage(spark, docs, SF).toPandas()
    assert list(masked.columns) == corpus_pipeline.COLUMNS and not any(secrets.scan(t)[0] for t in masked.text)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
