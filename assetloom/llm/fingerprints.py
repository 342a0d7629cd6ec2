"""Document fingerprints by one-permutation MinHash.

Every shingle of five words is hashed once. The top bits of the hash choose its bin; a bin keeps the
least hash that falls into it. An empty bin takes the value of the first bin in its own random order
that is not empty (optimal densification: each borrows independently of the others). The fingerprint
is the low bits of the bins' values, packed. The likeness of two fingerprints is the share of equal
bins, corrected for those that are equal by chance.

Defined results: a null text is empty; an empty text, or one of white space alone, has the empty
fingerprint, which is like itself (1) and unlike any other (0). Equal texts have equal fingerprints.
In an edited pair the next document of the smallest id is that of the largest; of equal ids the
smaller text comes first; a table of one document has itself as next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm.common import per_text, table
from assetloom.llm.words import shingle_hashes

SHINGLE, BINS, BITS = 5, 256, 8
_ORDERS: dict[int, np.ndarray] = {}


def _orders(bins: int) -> np.ndarray:
    """For each bin, the order in which it looks for a value to borrow."""
    if bins not in _ORDERS:
        _ORDERS[bins] = np.argsort(np.random.default_rng(20_17).random((bins, bins)), axis=1)
    return _ORDERS[bins]


def fingerprint(text: str, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> bytes:
    """Packed low bits of the densified bins; bins is a power of two, bits 1, 2, 4 or 8."""
    h = np.sort(shingle_hashes(text, shingle))
    if not len(h):
        return b""
    which, first = np.unique(h >> np.uint64(64 - (bins - 1).bit_length()), return_index=True)
    values, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    which = which.astype(np.int64)
    values[which], full[which] = h[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _orders(bins)[empty]
        values[empty] = values[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    low = (values & np.uint64((1 << bits) - 1)).astype(np.uint8)
    if bits == 8:
        return low.tobytes()
    return np.packbits(np.unpackbits(low[:, None], axis=1)[:, 8 - bits :].ravel()).tobytes()


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """Jaccard similarity of the shingle sets of two fingerprints, corrected for chance: 0 to 1."""
    if not a or not b:
        return float(a == b)
    x, y = (np.unpackbits(np.frombuffer(f, np.uint8)).reshape(-1, bits) for f in (a, b))
    equal, chance = float((x == y).all(axis=1).mean()), 2.0**-bits
    return min(1.0, max(0.0, (equal - chance) / (1 - chance)))


def _maker():
    return fingerprint


def fingerprints(text: Column) -> Column:
    """binary fingerprint of a text column."""
    return per_text(_maker, T.BinaryType())(text)


EDITED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("edited", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)
ARROW = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
#: Ranges of ids for each shuffle partition.
RANGES = 2


def _ranged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents in ranges of ids, descending, each followed by the first of the next range.

    Bounds are approximate quantiles of the ids, one for each range, so what the driver holds grows
    with the number of partitions alone. The text is shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.array(sorted(set(rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)))), dtype=np.float64)

    def bucket(ids: pa.Array) -> pa.Array:
        return pa.array(-np.searchsorted(bounds, ids.to_numpy(zero_copy_only=False).astype(np.float64)), type=pa.int64())

    bucket.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    rows = rows.withColumn("bucket", F.arrow_udf(bucket, returnType=T.LongType())(F.col("doc_id")))
    firsts = sorted(rows.groupBy("bucket").agg(F.max("doc_id").alias("first")).collect())
    if not firsts:
        return rows.withColumn("carried", F.lit(False))
    # the first document of each range also ends the range before; the first range's ends the last
    ends = spark.createDataFrame([(f.first, firsts[k - 1].bucket) for k, f in enumerate(firsts)], "doc_id long, bucket long")
    again = rows.drop("bucket").join(F.broadcast(ends), "doc_id").select("doc_id", "text", "bucket").withColumn("carried", F.lit(True))
    both = rows.withColumn("carried", F.lit(False)).unionByName(again)
    return both.repartition("bucket").sortWithinPartitions("bucket", "carried", F.desc("doc_id"), "text")


def edited_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with a text edited towards the next one, descending by id.

    The last third of its code points gives way to the first as many of the next document. Columns:
    doc_id, edited, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, id, text, fingerprint of the row whose next one comes
        for batch in batches:
            out = []
            for doc, text, bucket, carried in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                print_ = fingerprint(text)
                if held is not None and held[0] == bucket:
                    _, own, mine, my_print = held
                    k = len(mine) // 3
                    edited = mine[: len(mine) - k] + text[:k]
                    its_print = fingerprint(edited)
                    out.append((own, edited, len(mine), hashlib.sha256(edited.encode()).hexdigest(), my_print.hex(), its_print.hex(), likeness(my_print, its_print), likeness(my_print, print_)))
                held = None if carried else (bucket, doc, text, print_)
            columns = zip(*out, strict=True) if out else [[]] * len(ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, ARROW, strict=True)], names=EDITED.names)

    pairs = _ranged(docs, id_col, text_col).select("doc_id", "text", "bucket", "carried").mapInArrow(run, EDITED)
    return pairs.withColumn("doc_id", F.nullif("doc_id", F.lit(-(2**63))))


def op5_document_fingerprints(spark, sf_dir):
    """Fingerprint every document and its edited text; how like these and the next document are."""
    return edited_pairs(table(spark, sf_dir, "documents")).drop("edited")
