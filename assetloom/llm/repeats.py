"""Substring dedup by recompression: word windows that stand twice, in one document or in several.

1. Recompression. The words of a text are symbols. A round replaces each run of one symbol, then each pair
   of a left and a right symbol (a bit of its hash tells which a symbol is), by a new one. A new symbol is
   named by a hash of what it replaces, so equal runs and pairs have equal names in all texts. Each symbol
   has a context: the words that settle that it is cut out as it is. Wherever these words stand again, so
   does the symbol, whatever is around them.
2. After the rounds, the symbols whose names are least among their neighbours, named with both neighbours,
   are the anchors of a text: one in some seven words. A Spark round brings equal anchors of all texts
   together. A window that holds the context of an anchor that stands nowhere else stands nowhere else
   itself. Shared anchors leave the windows that may be repeated.
3. A second round brings the names of these windows together: 96 bits of a polynomial of their words. Those that
   stand twice are the repeats; their words are covered.

Texts are worked on in batches of about BATCH words. An anchor or window that a batch has several times
counts there and then, and is sent once, so one that all documents share costs one entry a batch. Entries go to
buckets by name as packed arrays; the number of buckets grows with the texts. Of documents of the same words the
first stands for all: these are covered whole.

Defined results: a null text has no words. Texts of fewer words than a window have no windows. Rows that share an id,
and repeated rows, are documents of their own. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm.common import release, table
from assetloom.llm.tables import sized_side, small_side
from assetloom.llm.words import HASHES, mix
from assetloom.sources.scratch import dropped, stored

#: Words of a window.
WINDOW = 35
#: About the most words of a batch, and the characters of all texts that make a bucket.
BATCH, BUCKET_CHARS = 1 << 19, 1 << 24
#: Fixed odd multipliers of names.
PAIR, RUN, CHECK = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0x94D049BB133111EB))
LEVEL = 0xBF58476D1CE4E5B9
#: Place of an entry that stands several times in its batch and needs no answer.
NO_PLACE = 0xFFFFFFFF


def rounds_for(window: int) -> int:
    """Rounds after which an anchor's context fills about half a window; contexts grow by half a round."""
    return max(1, round(math.log(max(window, 10) / 10) / math.log(1.5)))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


class Symbols:
    """The symbols of several texts in a row: names, the text's number, and where the context begins and ends."""

    def __init__(self, names: np.ndarray, of: np.ndarray, begins: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.names, self.of, self.begins, self.ends = names, of, begins, ends
        # what stands beyond a text's first and last word, for contexts that reach there
        self.first, self.last = first, last

    def _with_neighbours(self, low: np.ndarray, high: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts widened by those of the symbols low and high, which may be beyond the text."""
        n = len(self.names)
        before, after = np.maximum(low, 0), np.minimum(high, n - 1)
        begins = np.where((low >= 0) & (self.of[before] == of), self.begins[before], self.first[of])
        ends = np.where((high < n) & (self.of[after] == of), self.ends[after], self.last[of])
        return begins, ends

    def runs(self) -> Symbols:
        """Each run of one symbol becomes a symbol."""
        if not len(self.names):
            return self
        new = np.concatenate(([True], (self.names[1:] != self.names[:-1]) | (self.of[1:] != self.of[:-1])))
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(self.names))
        names, length = self.names[at], end - at
        long = length > 1
        names[long] = mix(names[long] + length[long].astype(np.uint64) * RUN)
        return Symbols(names, self.of[at], *self._with_neighbours(at - 1, end, self.of[at]), self.first, self.last)

    def pairs(self, level: int) -> Symbols:
        """Each left symbol before a right one makes a symbol with it; a pair needs no more context than both
        have, a symbol alone that of the neighbour it does not go with."""
        if not len(self.names):
            return self
        right = (mix(self.names + np.uint64((level + 1) * LEVEL % (1 << 64))) >> np.uint64(63)).astype(bool)
        at = np.flatnonzero(~right[:-1] & right[1:] & (self.of[1:] == self.of[:-1]))
        alone = np.ones(len(right), bool)
        alone[at], alone[at + 1] = False, False
        names, places = self.names.copy(), np.arange(len(right))
        names[at] = mix(self.names[at] * PAIR + self.names[at + 1] + np.uint64(1))
        begins, ends = self._with_neighbours(np.where(alone & right, places - 1, places), np.where(alone & ~right, places + 1, places), self.of)
        ends[at] = self.ends[at + 1]
        kept = np.ones(len(right), bool)
        kept[at + 1] = False
        return Symbols(names[kept], self.of[kept], begins[kept], ends[kept], self.first, self.last)

    def anchors(self) -> Symbols:
        """The symbols of a lesser name than both neighbours, named with them."""
        n = self.names
        if len(n) < 3:
            return Symbols(n[:0], self.of[:0], self.begins[:0], self.ends[:0], self.first, self.last)
        at = np.flatnonzero((n[1:-1] < n[:-2]) & (n[1:-1] < n[2:]) & (self.of[:-2] == self.of[2:])) + 1
        names = mix((n[at - 1] * PAIR + n[at]) * PAIR + n[at + 1])
        return Symbols(names, self.of[at], self.begins[at - 1], self.ends[at + 1], self.first, self.last)


def anchors_of(texts: list[np.ndarray], window: int) -> Symbols:
    """The anchors of texts, given as hashes of words, whose contexts fit a window; contexts count from 0 in
    each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(texts)), sizes)
    names = np.concatenate([*texts, np.zeros(0, np.uint64)])
    places = np.arange(len(names)) - starts[of] if len(names) else np.zeros(0, np.int64)
    symbols = Symbols(names, of, places, places + 1, np.full(len(texts), -1), sizes + 1)
    for level in range(rounds_for(window)):
        symbols = symbols.runs().pairs(level)
    found = symbols.anchors()
    fits = (found.begins >= 0) & (found.ends <= sizes[found.of]) & (found.ends - found.begins <= window)
    return Symbols(found.names[fits], found.of[fits], found.begins[fits], found.ends[fits], found.first, found.last)


def window_names(hashes: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of the names of the windows of a text that begin at ``starts``."""
    out = []
    for factor in (PAIR, CHECK):
        powers = np.full(len(hashes), factor, np.uint64)
        powers[:1] = 1
        powers = np.multiply.accumulate(powers)
        sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(hashes * powers)))
        inverse = np.full(len(hashes), pow(int(factor), -1, 1 << 64), np.uint64)
        inverse[:1] = 1
        inverse = np.multiply.accumulate(inverse)
        out.append(mix((sums[starts + window] - sums[starts]) * inverse[starts]))
    return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)


def spans_of(flags: np.ndarray) -> np.ndarray:
    """Begins and ends (int32, in turn) of the runs of true flags."""
    return np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))).astype(np.int32)


def flags_of(spans: np.ndarray, n: int) -> np.ndarray:
    """The inverse of ``spans_of``; spans may overlap."""
    change = np.bincount(spans[::2], minlength=n + 1) - np.bincount(spans[1::2], minlength=n + 1)
    return np.cumsum(change[:-1]) > 0


# what batches give: rows of documents (tag not null), and rows of entries (bucket not null)
FIELDS = {"batch": pa.string(), "tag": pa.int64(), "doc_id": pa.int64(), "key": pa.int64(), "words": pa.int64(), "digest": pa.string(), "first": pa.int64(), "entries": pa.int64(), "spans": pa.binary(), "known": pa.binary(), "bucket": pa.int32(), "names": pa.binary(), "checks": pa.binary(), "places": pa.binary()}
SCHEMA = "batch string, tag long, doc_id long, key long, words long, digest string, first long, entries long, spans binary, known binary, bucket int, names binary, checks binary, places binary"


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], type=t) for c, t in FIELDS.items()], names=list(FIELDS))


def _entries(batch: str, names: np.ndarray, checks: np.ndarray, buckets: int) -> tuple[list[dict], np.ndarray]:
    """Rows of the distinct entries of a batch by bucket, and which entries the batch has several times."""
    if not len(names):
        return [], np.zeros(0, bool)
    order = np.lexsort((checks, names))
    n, c = names[order], checks[order]
    begin = np.flatnonzero(np.concatenate(([True], (n[1:] != n[:-1]) | (c[1:] != c[:-1]))))
    several = np.diff(np.append(begin, len(n))) > 1
    known = np.zeros(len(n), bool)
    known[order] = np.repeat(several, np.diff(np.append(begin, len(n))))
    places = np.where(several, NO_PLACE, order[begin]).astype(np.uint32)
    n, c = n[begin], c[begin]
    bucket = (n >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)  # ascending, as the names are
    which, starts = np.unique(bucket, return_index=True)
    cut = zip(which.tolist(), starts.tolist(), np.append(starts[1:], len(n)).tolist(), strict=True)
    return [{"batch": batch, "bucket": b, "names": n[i:j].tobytes(), "checks": c[i:j].tobytes(), "places": places[i:j].tobytes()} for b, i, j in cut], known


def _texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[list]]:
    """Rows, in lists of about ``most`` words; the second column is the text, which becomes its words."""
    held, n = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            row = [c[i].as_py() for c in batch.columns]
            row[1] = (row[1] or "").encode().split()
            if held and n + len(row[1]) > most:
                yield held
                held, n = [], 0
            held.append(row)
            n += len(row[1])
    if held:
        yield held


def _anchored(window: int, buckets: int, most: int) -> Callable:
    """(tag, text, doc_id, key) to SCHEMA: each document with the contexts of its anchors, and the anchors as entries.
    ``batch`` is named by the tag of its first document, which no other has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("assetloom.llm.words")
        for rows in _texts(batches, most):
            batch, docs, texts, seen = str(rows[0][0]), [], [], set()
            for tag, words, doc_id, key in rows:
                digest = hashlib.sha256(b" ".join(words)).hexdigest()
                new = len(words) >= window and digest not in seen
                seen.add(digest)
                docs.append({"batch": batch, "tag": tag, "doc_id": doc_id, "key": key, "words": len(words), "digest": digest, "_text": len(texts) if new else None})
                if new:
                    texts.append(word_hashes(words))
            found = anchors_of(texts, window)
            entries, known = _entries(batch, found.names, np.zeros(len(found.names), np.uint32), buckets)
            ends = np.searchsorted(found.of, np.arange(len(texts) + 1))
            for doc in docs:
                if (k := doc.pop("_text")) is not None:
                    i, j = ends[k], ends[k + 1]
                    spans = np.stack((found.begins[i:j], found.ends[i:j]), axis=1).astype(np.int32)
                    doc |= {"first": int(i), "entries": int(j - i), "spans": spans.tobytes(), "known": np.packbits(known[i:j]).tobytes()}
            yield _rows(docs)
            yield _rows(entries)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by bucket to (batch, places) of those that another batch, or their own, has again."""

    def shared(rows: list[tuple]) -> pa.RecordBatch:
        names, checks, places = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in ((2, np.uint64), (3, np.uint32), (4, np.uint32)))
        owner = np.repeat(np.arange(len(rows)), [len(r[4]) // 4 for r in rows])
        order = np.lexsort((checks, names))
        n, c = names[order], checks[order]
        begin = np.flatnonzero(np.concatenate(([True], (n[1:] != n[:-1]) | (c[1:] != c[:-1]))))
        sizes = np.diff(np.append(begin, len(n)))
        several = np.repeat((sizes > 1) | np.logical_or.reduceat(places[order] == NO_PLACE, begin), sizes)
        found = order[several & (places[order] != NO_PLACE)]
        found = found[np.argsort(owner[found], kind="stable")]
        ends = np.searchsorted(owner[found], np.arange(len(rows) + 1))
        out = [(r[0], places[found[i:j]].tobytes()) for r, i, j in zip(rows, ends[:-1].tolist(), ends[1:].tolist(), strict=True) if i < j]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.string()), pa.array([p for _, p in out], pa.binary())], names=["batch", "places"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][1] != row[1]:
                yield shared(held)
                held = []
            held.append(row)
    if held:
        yield shared(held)


def _shared(entries: DataFrame) -> DataFrame:
    """(batch, places) of the entries that stand several times."""
    sent = entries.filter("bucket is not null").select("batch", "bucket", "names", "checks", "places")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_met, "batch string, places binary")


def _answers(docs: pa.Table, places: pa.Table) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Each document of a batch, its spans (one row each), and which of its entries are shared."""
    every = np.sort(np.frombuffer(b"".join(places.column("places").to_pylist()), np.uint32).astype(np.int64))
    for doc in docs.to_pylist():
        spans = np.frombuffer(doc["spans"], np.int32).reshape(-1, 2).astype(np.int64)
        n = doc["entries"]
        flags = np.unpackbits(np.frombuffer(doc["known"], np.uint8), count=n).astype(bool)
        i, j = np.searchsorted(every, (doc["first"], doc["first"] + n))
        flags[every[i:j] - doc["first"]] = True
        yield doc, spans, flags


def _out(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["tag", "doc_id", "key", "spans"])


def _candidates(window: int) -> Callable:
    """(documents, shared anchors) of a batch to (tag, doc_id, key, spans): runs of windows that hold no anchor of their own."""

    def run(docs: pa.Table, places: pa.Table) -> pa.Table:
        out = []
        for doc, spans, shared in _answers(docs, places):
            n, own = doc["words"] - window + 1, spans[~shared]
            alone = flags_of(np.stack((np.maximum(own[:, 1] - window, 0), np.minimum(own[:, 0] + 1, n)), axis=1).ravel(), n)
            if not alone.all():
                out.append((doc["tag"], doc["doc_id"], doc["key"], spans_of(~alone).tobytes()))
        return _out(out)

    return run


def _windows(window: int, buckets: int, most: int) -> Callable:
    """(tag, text, doc_id, key, spans) to SCHEMA: the windows in these spans as entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("assetloom.llm.words")
        for rows in _texts(batches, most):
            docs, names, checks, first, seen = [], [], [], 0, set()
            for tag, words, doc_id, key, data in rows:
                if tag in seen:  # a repeated row
                    continue
                seen.add(tag)
                starts = np.flatnonzero(flags_of(np.frombuffer(data, np.int32).astype(np.int64), len(words) - window + 1))
                n, c = window_names(word_hashes(words), starts, window)
                names.append(n)
                checks.append(c)
                docs.append({"batch": str(rows[0][0]), "tag": tag, "doc_id": doc_id, "key": key, "words": len(words), "first": first, "entries": len(n), "spans": data})
                first += len(n)
            entries, known = _entries(str(rows[0][0]), np.concatenate(names), np.concatenate(checks), buckets)
            for doc in docs:
                doc["known"] = np.packbits(known[doc["first"] : doc["first"] + doc["entries"]]).tobytes()
            yield _rows(docs)
            yield _rows(entries)

    return run


def _covered(window: int) -> Callable:
    """(documents, shared windows) of a batch to (tag, doc_id, key, spans): runs of covered words."""

    def run(docs: pa.Table, places: pa.Table) -> pa.Table:
        out = []
        for doc, spans, shared in _answers(docs, places):
            n = doc["words"]
            starts = np.flatnonzero(flags_of(spans.ravel(), n - window + 1))[shared]
            if len(starts):
                out.append((doc["tag"], doc["doc_id"], doc["key"], spans_of(flags_of(np.stack((starts, starts + window), axis=1).ravel(), n)).tobytes()))
        return _out(out)

    return run


def _by_batch(docs: DataFrame, shared: DataFrame, f: Callable) -> DataFrame:
    own = docs.select("batch", "tag", "doc_id", "key", "words", "first", "entries", "spans", "known")
    return own.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(f, "tag long, doc_id long, key long, spans binary")


def _with_text(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(tag, text, doc_id, key, spans) of the rows of ``texts`` that have spans."""
    spans = sized_side(spans.select("tag", F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "spans"), F.length("spans"))
    found = texts.join(spans, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return found.select("tag", "text", "doc_id", "key", "spans")


def repeated_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(tag, doc_id, words, digest, copies), a row for each of ``docs``, and (tag, text, spans) for those that windows
    cover in part. words: their number; digest: the SHA-256 of the words joined by spaces; copies: how many rows
    have these words, if there are as many as a window's, so that with two or more all are covered.
    spans: starts and ends (int32, little-endian, in turn) of what is covered, counted in words."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    buckets = -(-chars // BUCKET_CHARS) or 1

    tagged = texts.select(F.monotonically_increasing_id().alias("tag"), "text", "doc_id", "key")
    parsed = stored(tagged.mapInArrow(_anchored(window, buckets, BATCH), SCHEMA))
    rows = stored(parsed.filter("tag is not null").select("tag", "doc_id", "words", "digest"))
    firsts = stored(rows.filter(F.col("words") >= window).groupBy("digest").agg(F.min("tag").alias("tag"), F.count("*").alias("copies")))
    own = parsed.filter("first is not null").join(small_side(firsts.select("tag")), "tag", "left_semi")
    near = stored(_by_batch(own, _shared(parsed), _candidates(window)))
    dropped(parsed)
    windows = stored(_with_text(texts, near).mapInArrow(_windows(window, buckets, BATCH), SCHEMA))
    covered = stored(_by_batch(windows.filter("tag is not null"), _shared(windows), _covered(window)))
    dropped(near, windows)
    every = rows.join(small_side(firsts.select("digest", "copies")), "digest", "left")
    partly = covered.join(small_side(firsts.filter("copies > 1").select("tag")), "tag", "left_anti")
    return every.select("tag", "doc_id", "words", "digest", "copies"), _with_text(texts, stored(partly)).select("tag", "text", "spans")


KEPT = T.StructType([T.StructField("words", T.LongType()), T.StructField("text", T.StringType())])


def kept_words(text: Column, spans: Column) -> Column:
    """struct(words, text): how many words of a text the spans leave, and these, joined by spaces."""

    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, data in zip(texts, spans, strict=True):
            words = (t.as_py() or "").encode().split()
            gone = flags_of(np.frombuffer(data.as_py() or b"", np.int32).astype(np.int64), len(words))
            kept = [words[k] for k in np.flatnonzero(~gone).tolist()]
            out.append({"words": len(kept), "text": b" ".join(kept).decode()})
        return pa.array(out, pa.struct([("words", pa.int64()), ("text", pa.string())]))

    run.__annotations__ = {"texts": pa.Array, "spans": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returnType=KEPT)(text, spans)


def op11_substring_dedup(spark, sf_dir):
    """Every document without the words of windows of 35 that stand again anywhere."""
    rows, partly = repeated_words(table(spark, sf_dir, "documents"))
    partly = partly.select("tag", kept_words(F.col("text"), F.col("spans")).alias("k")).select("tag", F.col("k.words").alias("left"), F.sha2("k.text", 256).alias("sha"))
    whole = F.coalesce("copies", F.lit(1)) > 1
    removed = F.when(whole, F.col("words")).otherwise(F.col("words") - F.coalesce("left", "words"))
    sha = F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "digest"))
    return rows.join(partly, "tag", "left").select("doc_id", F.col("words").alias("n_words"), removed.alias("n_removed"), sha.alias("kept_sha256"))
