"""Large tables: what is never broadcast, and what is settled for all that ask the same."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from assetloom.operators import code as K
from assetloom.operators import lookup as L
from assetloom.operators import search_text as S


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_class_index_is_never_broadcast(spark):
    names = spark.range(20).select(F.concat(F.lit("Hero"), F.col("id").cast("string")).alias("name"))
    index = names.select(F.concat(F.lit("U"), "name").alias("class_name"), F.lit("a.h").alias("source_path"))
    out = K.resolve_classes(names, index)
    assert "Broadcast" not in plan_of(out)
    assert out.filter("class_name = concat('U', name)").count() == 20


def test_tokens_that_ask_the_same_are_ranked_once(spark, monkeypatch):
    """Of 400 ids that ask for a part of 3,000 names, no more than a task's best five of each token leave a task."""
    sizes, stored = [], L.stored
    monkeypatch.setattr(L, "stored", lambda df: sizes.append(stored(df)) or sizes[-1])
    tokens = spark.range(400).select(F.col("id").alias("token_id"), F.concat(F.lit("rock_"), (F.col("id") % 2).cast("string")).alias("token"))
    name = F.concat(F.lit("big_Rock_"), (F.col("id") % 2).cast("string"), F.lit("_"), F.col("id").cast("string"))
    assets = spark.range(3000).select(F.concat(F.lit("/Game/"), name).alias("path"), name.alias("name"), F.lit("Mesh").alias("asset_type"))
    got = {}
    for r in L.resolve_tokens(tokens, assets).collect():
        got.setdefault(r.token_id, []).append((r["rank"], r.name))
    want = [sorted((f"big_Rock_{i % 2}_{i}" for i in range(k, 3000, 2)), key=str.lower, reverse=True)[:5] for k in (0, 1)]
    assert len(got) == 400
    assert all([n for _, n in sorted(v)] == want[t % 2] for t, v in got.items())
    assert max(t.count() for t in sizes) == 400


def test_names_by_brute_force(spark):
    """Names, classes and hits that stand behind the first of their part are found as among all."""
    rng = random.Random(4)
    row = lambda t: ("/Game/" + rng.choice("ab"), rng.choice(["BP_", "B_", "x_", ""]) + rng.choice(["Gun", "gun", "Gunner", "Bow"]) + rng.choice(["", "_1", "_2"]), rng.choice(t))
    schema = "path string, name string, asset_type string"
    docs, light = [row(["Mesh", "Asset", None]) for _ in range(40)], [row(["Mesh", "CppClass", "Aa"]) for _ in range(60)]
    queries = list(enumerate(["BP_", "b_", "gun", "GUN_1", "Gunner", "bow", "ow", "x_", "Nope", "bp_gun", "", None]))
    hits = [(q, *rng.choice(docs)[:2], rng.choice([0.4, 3.0])) for q in range(12) for _ in range(5)]
    classes = [("UNope", "n.h"), ("Uow", "/Game/a"), ("ABP_", "b.h"), ("Ubp_gun", "p.h")]
    kind = lambda t: t or "Unknown"

    def expected(with_hits: bool, limit: int):
        for q, text in queries:
            found = []
            if text and text.endswith("_"):
                starts = {"BP_": ["BP_", "B_"], "B_": ["B_", "BP_"]}.get(text.upper(), [text.upper()])
                found += [(p, n, kind(t), 1.0) for p, n, t in docs + light if any(n.upper().startswith(s) for s in starts)]
            elif text:
                part = text.lower()
                if with_hits:
                    types = {p: min(kind(t) for x, _, t in docs if x == p) for p, _, _ in docs}
                    found += [(p, n, types[p], s) for i, p, n, s in hits if i == q and part in n.lower()]
                else:
                    found += [(p, n, kind(t), 1.0 if n.lower() == part else 0.9) for p, n, t in docs if part in n.lower()]
                found += [(p, n, kind(t), 0.9) for p, n, t in light if part in n.lower()]
            if text and not any(t == "CppClass" for _, _, t, _ in found):
                found += [(next((p, c, "CppClass", 1.0) for c, p in classes if c == f + text) ) for f in "UA" if any(c == f + text for c, _ in classes)][:1]
            groups = {}
            for p, n, t, s in found:
                was = groups.get((p, n), (s, t))
                groups[p, n] = (max(s, was[0]), min(t, was[1]))
            ranked = sorted(groups.items(), key=lambda g: (-g[1][0], g[0][1], g[0][0]))[:limit]
            yield from ((q, p, n, t, s, k + 1) for k, ((p, n), (s, t)) in enumerate(ranked))

    frames = [spark.createDataFrame(x, s) for x, s in ((queries, "query_id int, query string"), (docs, schema), (light, schema), (hits, "query_id int, path string, name string, score double"), (classes, "class_name string, source_path string"))]
    for with_hits in (False, True):
        for limit in (2, 3, 20):
            got = L.search_name(*frames[:3], hits=frames[3] if with_hits else None, classes=frames[4], limit=limit)
            assert sorted(map(tuple, got.collect())) == sorted(expected(with_hits, limit))


def _block(texts):
    ids = [f"d{i:04}" for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array(["/game/" + i for i in ids]), pa.array(texts)], names=["doc_id", "_name", "_path", "_text"])
    return list(S._blocks_of_docs(iter([batch])))


def test_blocks_are_of_few_bytes():
    """A place takes no more bytes than it needs, and a block no more text than it may have."""
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(200)) for _ in range(1000)]
    (block,) = _block(texts)
    assert block.nbytes < 4 * sum(block.column("dl")[0].as_py())
    assert [b.column("ids")[0].as_py() for b in _block(["x " * (3 << 20), "a b", "y " * (3 << 20), None, "z"])] == [["d0000"], ["d0001"], ["d0002"], ["d0003", "d0004"]]


class Sent:
    """Lists of queries as a task gets them."""

    def __init__(self, lists):
        table, sink = pa.table({"rows": lists}), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.value = sink.getvalue().to_pybytes()


def test_a_block_meets_all_lists_of_queries_as_one_row():
    """Counts and best documents of many lists, ties by id, also where a task holds fewer of the best than there are."""
    texts = ["of all " + ("rare " if i == 7 else "") + f"w{i % 3}" for i in range(40)]
    block = _block(texts)
    unit = lambda u: {"unit": u, "tokens": [u], "exact": False, "idf": 1.0}
    counts = S._count_units(Sent([[unit("of")], [unit("w1"), unit("none")], [unit("rare")]]))
    assert dict(zip(*[c.to_pylist() for c in next(counts(iter(block))).columns], strict=True)) == {"of": 40, "w1": 13, "rare": 1}
    lists = [[{"query_id": 3 * k + j, "units": [unit("of"), *([unit("rare")] if j == 1 else [])]} for j in range(3)] for k in range(4)]
    found = {}
    for out in S._best_docs(Sent(lists), 5, 10.0, [], pa.int64())(iter(block)):
        for q, d, s in zip(*[c.to_pylist() for c in out.columns], strict=True):
            found.setdefault(q, []).append((-s, d))
    ids = [f"d{i:04}" for i in range(40) if i != 7]
    assert all([d for _, d in sorted(v)] == (["d0007", *ids[:4]] if q % 3 == 1 else ids[:5]) for q, v in found.items()) and len(found) == 12
