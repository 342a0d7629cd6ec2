"""Hard-negative mining by exact integer products in a residue number system.

1. Each component x becomes floor(scale * x), and each vector its remainders by several small primes,
   centred around 0. The primes are few enough below 2^10 that a product over 64 dimensions stays below
   2^24, where float32 is exact; together they exceed twice the greatest score that the table allows.
2. Vectors are dealt into blocks by the hash of their ids. Anchors go to every block of rows, rows to every
   block of anchors, and each pair of blocks is one group: their matrices are multiplied prime by prime, in
   tiles, and signed scores are put together by Chinese remainders.
3. Every group keeps the best rows of the same label for each anchor; a window over the groups' few rows
   gives the positives. A second pass keeps, for each anchor and positive, the best rows of other labels
   whose scores are in the positive's range, and a window over those gives the negatives.

Both passes keep a few rows for each anchor and group, so what is shuffled after a pass doesn't grow with the
number of products.

Defined results: rows without id, label or vector, or with a null or non-finite component, take no part. Of
rows that share an id the least by (label, components) counts. Shorter vectors are filled with zeros. Scores
beyond a long are exact (to 38 digits) in the order and in the ranges and given as the nearest long.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.llm.common import table
from assetloom.sources.scratch import stored

#: Dimensions that are summed in float32 at once, and the greatest prime's bound: (p / 2)^2 * DIMS < 2^24.
DIMS, PRIME_BOUND = 64, 1 << 10
#: Vectors of a block, and anchors and rows of a tile.
BLOCK, TILE = 1 << 14, (512, 4096)
LONG = (1 << 63) - 1
MOST = 10**38 - 1


def primes_for(bound: int) -> list[int]:
    """The greatest primes below PRIME_BOUND whose product is more than 2 * bound."""
    out, product, p = [], 1, PRIME_BOUND
    while product <= 2 * bound:
        p -= 1
        if p < 3:
            raise ValueError("components are too large")
        if all(p % d for d in range(2, math.isqrt(p) + 1)):
            out.append(p)
            product *= p
    return out


def residues(values: np.ndarray, primes: list[int]) -> np.ndarray:
    """Integral float64 values (n, d) to centred remainders (n, primes, d) as int16."""
    out = np.empty((len(values), len(primes), values.shape[1]), np.int16)
    for k, p in enumerate(primes):
        r = np.fmod(values, p)
        r[r > p // 2] -= p
        r[r < -(p // 2)] += p
        out[:, k] = r
    return out


def residue_product(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """Exact products of residue matrices (n, primes, d) and (m, primes, d): (n, m) of int64, or of Python
    integers where the primes' product doesn't fit."""
    wide = math.prod(primes) >= 1 << 62
    kind = object if wide else np.int64
    total, base = np.zeros((len(a), len(b)), kind), 1
    for k, p in enumerate(primes):
        r = np.zeros(total.shape, np.int64)
        for at in range(0, a.shape[2], DIMS):
            r += (a[:, k, at : at + DIMS].astype(np.float32) @ b[:, k, at : at + DIMS].astype(np.float32).T).astype(np.int64)
        # the next digit in mixed radix: what is missing to the remainder by p, in units of the primes before
        digit = (r - (total % p).astype(np.int64)) % p * pow(base, -1, p) % p
        total += digit.astype(kind) * base
        base *= p
    total[total > base // 2] -= base
    return total


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k greatest allowed scores of each row; of equal ones the first columns."""
    m = scores.shape[1]
    if scores.dtype == object:
        low = min(scores.min(initial=0), 0) - 1
        order = np.argsort(np.where(allowed, -scores, -low), axis=1, kind="stable")[:, :k]
    else:
        top = np.abs(scores).max(initial=0)
        if int(top) * (m + 1) < LONG // 2:
            keyed = np.where(allowed, scores * m + np.arange(m - 1, -1, -1), -LONG)
            order = np.argpartition(keyed, max(0, m - k), axis=1)[:, -k:] if m > k else np.broadcast_to(np.arange(m), scores.shape)
        else:
            order = np.argsort(np.where(allowed, -scores, LONG), axis=1, kind="stable")[:, :k]
    i, j = np.repeat(np.arange(len(order)), order.shape[1]), order.ravel()
    keep = allowed[i, j]
    return i[keep], j[keep]


def _packed(scale: int, primes: list[int], dims: int) -> Callable:
    """(id, label, vector) to (id, label, rns), of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            if not batch.num_rows:
                continue
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lists.value_lengths().to_numpy())
            lengths = lists.value_lengths().to_numpy()
            values = np.zeros((len(lists), dims))
            row = np.repeat(np.arange(len(lists)), lengths)
            values[row, np.arange(len(flat)) - np.repeat(ends - lengths, lengths)] = np.floor(scale * flat)
            packed = residues(values, primes)
            data = pa.array([x.tobytes() for x in packed], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data], names=["id", "label", "rns"])

    return run


def _matrix(rows: pa.Table, n_primes: int) -> np.ndarray:
    data = b"".join(rows.column("rns").to_pylist())
    return np.frombuffer(data, np.int16).reshape(len(rows), n_primes, -1)


def _decimals(scores: np.ndarray) -> pa.Array:
    """Scores as text, as they may not fit a long; at most of 38 digits."""
    return pa.array([str(max(-MOST, min(MOST, x))) for x in scores.tolist()], pa.string())


FOUND = "anchor long, place int, id long, exact string"


def _group(primes: list[int], k: int, low: int, high: int) -> Callable:
    """(anchors, rows) of a group to FOUND: the best rows of the same label, as place -1; or, where anchors have
    positives (an array of exact scores), of other labels in the range of each positive, by its place."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = {"anchor": [], "place": [], "id": [], "exact": []}
        rows = rows.sort_by("id")
        if len(anchors) and len(rows):
            own, row_ids, row_labels = _matrix(anchors, len(primes)), rows.column("id").to_numpy(), rows.column("label").to_numpy()
            every = _matrix(rows, len(primes))
            ids, labels = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
            positives = anchors.column("positives").to_pylist()
            for a in range(0, len(anchors), TILE[0]):
                here = slice(a, a + TILE[0])
                for b in range(0, len(rows), TILE[1]):
                    there = slice(b, b + TILE[1])
                    scores = residue_product(own[here], every[there], primes)
                    same = labels[here, None] == row_labels[None, there]
                    if positives[a] is None:
                        wanted = [(-1, same & (ids[here, None] != row_ids[None, there]))]
                    else:
                        wanted = []
                        for place in range(max(map(len, positives[here]))):
                            p = [int(x[place]) if place < len(x) else None for x in positives[here]]
                            # low * p <= 100 * score <= high * p; an empty range where there is no positive
                            limits = np.array([(1, 0) if x is None else (-(-low * x // 100), high * x // 100) for x in p], dtype=object)
                            if scores.dtype != object:
                                limits = np.clip(limits, -LONG, LONG).astype(np.int64)
                            wanted.append((place, ~same & (scores >= limits[:, :1]) & (scores <= limits[:, 1:])))
                    for place, allowed in wanted:
                        i, j = best(scores, allowed, k)
                        out["anchor"].append(ids[here][i])
                        out["place"].append(np.full(len(i), place, np.int32))
                        out["id"].append(row_ids[there][j])
                        out["exact"].append(_decimals(scores[i, j]))
        arrays = [np.concatenate(out[c]) if out[c] else [] for c in ("anchor", "place", "id")]
        exact = pa.concat_arrays(out["exact"]) if out["exact"] else pa.array([], pa.string())
        return pa.table([pa.array(arrays[0], pa.int64()), pa.array(arrays[1], pa.int32()), pa.array(arrays[2], pa.int64()), exact], names=["anchor", "place", "id", "exact"])

    return run


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k of each key by score and id, with rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.col("exact").cast("decimal(38,0)")), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which
    ``anchors`` holds: their best ``positives`` rows of the same label, and for each of these the best
    ``negatives`` rows of other labels that score from low to high hundredths of it."""
    label = F.col(label) if isinstance(label, str) else label
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(finite)
    size = rows.agg(F.max(F.size("v")).alias("dims"), F.max(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))).alias("most"), F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).first()
    dims = max(1, size.dims or 1)
    primes = primes_for(dims * (math.ceil(scale * (size.most or 0.0)) + 1) ** 2)

    packed = rows.select("id", "label", "v").mapInArrow(_packed(scale, primes, dims), "id long, label long, rns binary")
    once = packed.groupBy("id").agg(F.min(F.struct("label", "rns")).alias("r")).select("id", "r.label", "r.rns")
    blocks, of_anchors = -(-size.n // BLOCK) or 1, -(-size.anchors // BLOCK) or 1
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    once = stored(once)
    dealt = once.select("id", "label", "rns", block(blocks).alias("low"), every(of_anchors).alias("high")).groupBy("low", "high")
    asked = once.join(rows.filter("anchor").select("id").distinct(), "id", "left_semi")

    def found(own: DataFrame) -> DataFrame:
        groups = own.select("id", "label", "rns", "positives", block(of_anchors).alias("high"), every(blocks).alias("low"))
        groups = groups.toDF("id", "label", "rns", "positives", "high", "low").groupBy("low", "high")  # names of their own, as both sides come from one table
        return groups.cogroup(dealt).applyInArrow(_group(primes, max(positives, negatives), low, high), FOUND)

    first = stored(_ranked(found(asked.withColumn("positives", F.lit(None).cast("array<string>"))), ["anchor"], positives).select("anchor", F.col("id").alias("positive_id"), "exact", (F.col("rank") - 1).alias("place")))
    lists = first.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "exact"))), lambda x: x["exact"]).alias("positives"))
    second = _ranked(found(asked.join(lists.withColumnRenamed("anchor", "id"), "id")), ["anchor", "place"], negatives)
    score = lambda c: F.greatest(F.least(F.col(c).cast("decimal(38,0)"), F.lit(LONG).cast("decimal(38,0)")), F.lit(-LONG - 1).cast("decimal(38,0)")).cast("long")
    out = second.withColumnRenamed("exact", "other").join(first, ["anchor", "place"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), score("exact").alias("positive_score"), score("other").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir):
    """The hard negatives of every hundredth vector, with every seventh label moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)
