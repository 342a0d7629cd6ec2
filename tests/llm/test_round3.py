"""Substring dedup, hard negatives and fill-in-middle against brute force; runs that are long."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assetloom.llm import fim, negatives, repeats, secrets

# 6


@pytest.mark.parametrize("kind", ["placeholder", "dashes", "dashed placeholders", "one letter"])
def test_long_runs_cost_as_much_as_they_are_long(kind):
    r = random.Random(2)
    letters = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(1_000_000))
    run = {"placeholder": letters + "xxxx" + letters[:9], "dashes": letters[:400_000] + "-" * 600_000, "dashed placeholders": "ab-xxxx-" * 125_000, "one letter": "x" * 1_000_000}[kind]
    began = time.time()
    secrets.candidates(run)
    assert time.time() - began < 1.5


def test_allow_list_takes_whole_parts():
    uuid = "0123abcd-0123-4567-89ab-0123456789ab"
    left = lambda run: [part for _, part in secrets.candidates(run) if part]
    assert left(f"{uuid}") == [] and left(f"{uuid}-tail") == ["-tail"] and left(f"a{uuid}") == ["a0123abcd-0123-4567-89ab-"]
    assert left("keyExample/other") == ["/other"] and left("abc-XXXX9-def") == ["abc-", "-def"] and left("abc") == ["abc"]


# 11


def brute_repeats(texts, window):
    words = [(t or "").encode().split() for t in texts]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out)


def made_texts(seed):
    r = random.Random(seed)
    out = []
    for _ in range(250):
        own = r.choice(["a", "ab", "abc", "abcdefghijklmnopqrstuvwxyz0123456789"])
        out.append(" ".join(r.choice(own) for _ in range(r.randrange(0, 150))))
    for i in range(100):  # near copies
        words = r.choice(out).split()
        at = r.randrange(0, len(words) + 1)
        out.append("  ".join([*words[:at], f"new{i}", *words[at:]]) + "\n")
    odd = [None, "", " \t", "x " * 36, "y " * 35, "z\x0b" * 37, "é 漢 \x1c\x85 \xa0 " * 30]
    return out + odd + ["said again " * 20] * 4 + [" ".join(map(str, range(60)))] * 3 + ["few words"] * 5


@pytest.mark.parametrize(("window", "batch"), [(2, 1 << 19), (5, 300), (35, 1 << 19), (35, 100)])
def test_repeats_by_brute_force(spark, monkeypatch, window, batch):
    monkeypatch.setattr(repeats, "BATCH", batch)
    monkeypatch.setattr(repeats, "BUCKET_CHARS", 5_000)
    texts = made_texts(window + batch)
    docs = spark.createDataFrame([(None if i % 7 == 0 else i % 200, t, i) for i, t in enumerate(texts)], "doc_id long, text string, tag long").repartition(5)
    rows, partly = repeats.repeated_words(docs, window=window)
    kept = partly.select("tag", repeats.kept_words(F.col("text"), F.col("spans")).alias("k"))
    whole = {hashlib.sha256(t.encode()).hexdigest(): t for t in (" ".join(w.decode() for w in (x or "").encode().split()) for x in texts)}
    got = []
    for x in rows.join(kept, "tag", "left").collect():
        got.append((x.words, "" if (x.copies or 1) > 1 else x.k.text if x.k else whole[x.digest]))
        assert x.k is None or x.k.words == len(x.k.text.encode().split())
    assert sorted(got) == brute_repeats(texts, window)


def test_equal_words_have_equal_symbols_inside():
    r = np.random.default_rng(1)
    words = r.integers(0, 50, 400).astype(np.uint64)
    other = np.concatenate((r.integers(0, 50, 77).astype(np.uint64), words[100:300], r.integers(0, 50, 31).astype(np.uint64)))
    found = repeats.anchors_of([words, other], 35)
    one, two = ({(n, b - at, e - at) for n, b, e in zip(found.names[found.of == k].tolist(), found.begins[found.of == k].tolist(), found.ends[found.of == k].tolist(), strict=True) if b >= at and e <= at + 200} for k, at in ((0, 100), (1, 77)))
    assert one == two and len(one) > 15


def test_windows_of_equal_words_have_equal_names():
    r = np.random.default_rng(2)
    words = r.integers(0, 1 << 60, 300).astype(np.uint64)
    twice = np.concatenate((words, words[50:]))
    a, b = repeats.window_names(words, np.arange(50, 266), 35), repeats.window_names(twice, np.arange(300, 516), 35)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and len(set(a[0].tolist())) == 216


# 12


@pytest.mark.parametrize("size", [3, 1_000, 10**6, 10**12])
def test_residue_products_are_exact(size):
    r = np.random.default_rng(size)
    a, b = (np.floor(r.normal(size=(n, 100)) * size) for n in (7, 9))
    primes = negatives.primes_for(100 * (int(max(np.abs(a).max(), np.abs(b).max())) + 1) ** 2)
    got = negatives.residue_product(negatives.residues(a, primes), negatives.residues(b, primes), primes)
    assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]


def brute_negatives(rows, n_pos=5, n_neg=5):
    """(anchor, positive, rank, negative, scores) of rows (id, quantised vector, label)."""
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=False))
    out = []
    for i, x, label in rows:
        if i % 100:
            continue
        scored = sorted((-dot(x, y), j, m) for j, y, m in rows if j != i)
        for s, p, _ in [t for t in scored if t[2] == label][:n_pos]:
            near = [t for t in scored if t[2] != label and 80 * -s <= 100 * -t[0] <= 100 * -s][:n_neg]
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("size", [0.02, 1.0, 1e9])
def test_negatives_by_brute_force(spark, monkeypatch, size):
    """With ties, small blocks and tiles, and scores beyond a long."""
    monkeypatch.setattr(negatives, "BLOCK", 60)
    r = np.random.default_rng(3)
    rows = [(i, (np.round(r.normal(size=r.integers(1, 6)) * 3) * size).tolist(), int(r.integers(0, 3))) for i in range(0, 1000, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("x")).withColumn("rns", F.lit(1))
    got = sorted(tuple(x) for x in negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).collect())
    want = brute_negatives([(i, [int(np.floor(256 * x)) for x in v], m) for i, v, m in rows])
    top = (1 << 63) - 1
    assert got == [(*x[:4], min(x[4], top), min(x[5], top)) for x in want] and got


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.5], 2), (2, [1.0, 0.5], 2), (3, [1.0, None], 2), (4, [float("inf"), 0.0], 2), (5, None, 2), (6, [1.0, 0.5], None), (None, [1.0, 0.5], 2), (7, [], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert [tuple(x) for x in negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 2, 81920, 81920)]


# 13


def brute_fim(i, t):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    n, digest = len(units), hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return i, n, "plain", None, None, t, t
    form = "spm" if h[3] % 100 < 80 else "psm"
    return i, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", t


def test_fill_in_middle_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fim, "STEP_BYTES", 500)
    r = random.Random(1)
    texts = [None, "", " ", "\n\t a", "é 漢  x\x1c\x85 \xa0y \n", "<P> a b", "a<", "a < b", "x" * 3000, "word " * 2000]
    texts += ["".join(r.choice("ab <PSM>\n\té\x00") for _ in range(r.randrange(60))) for _ in range(1500)]
    rows = [(None if k == 3 else k % 1000, t, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = sorted(map(tuple, fim.fill_in_middle(docs).collect()), key=repr)
    assert got == sorted((brute_fim(i, t or "") for i, t, _ in rows), key=repr)
    assert {x[2] for x in got} == {"plain", "spm", "psm"}


def test_restoring_outputs_of_all_forms():
    out = pa.array([b"<S>c<P>a<M>b", b"<P>a<S>c<M>b", b"", b"<", b"<P>x"], pa.large_binary())
    assert fim.restore(out, pa.array(["spm", "psm", "plain", "plain", "plain"])).to_pylist() == [b"abc", b"abc", b"", b"<", b"<P>x"]
