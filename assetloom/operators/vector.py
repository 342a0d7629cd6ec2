"""Vector search, exact and by an inverted-file index, and embedding.

Vectors are packed into blocks of some thousand, each a row with a matrix as bytes. Blocks of queries meet
blocks of documents by an equi-join on the query block's number, which is a broadcast as long as all
queries together are small. Each task multiplies the pairs that it gets and keeps the k best of each query
over all of them, so an exchange of k rows a query and task is left to rank."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetloom.operators.filters import FILTERS, attributes, groups, passing, used_filters
from assetloom.sources.scratch import stored

#: Vectors of a block; bytes of all queries that are broadcast; query blocks whose best a task holds at once.
BLOCK, BROADCAST_BYTES, HELD = 4096, 32 << 20, 32


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of numbers as rows of unit length, or 0; shorter ones are filled with zeros."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(vectors), int(lengths.max(initial=0))))
    rows = np.repeat(np.arange(len(vectors)), lengths)
    flat = pc.fill_null(vectors.flatten(), 0.0).to_numpy(zero_copy_only=False)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1, norms)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, embedding, more...) sorted by key to one row a block: key, ids, n, data, more as lists."""
    held: list[pa.RecordBatch] = []

    def packed(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.sort_by("id").combine_chunks()
        one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column(c).combine_chunks())
        matrix = _matrix(rows.column("embedding").combine_chunks())
        more = rows.schema.names[3:]
        columns = [rows.column("key").combine_chunks().slice(0, 1), one("id"), pa.array([matrix.shape[1]], pa.int32()), pa.array([matrix.tobytes()], pa.binary()), *map(one, more)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "ids", "dims", "data", *more])

    def full(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        rows = pa.Table.from_batches(held)
        keys = rows.column("key").to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
        at = 0
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            whole = last or j < len(keys)  # the last key may go on in the next batch
            for at in range(i, j, BLOCK):
                if at + BLOCK <= j or whole:
                    yield packed(rows.slice(at, min(BLOCK, j - at)))
                else:
                    break
            else:
                at = j
        held = rows.slice(at).to_batches()

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK:
            yield from full(False)
    if sum(b.num_rows for b in held):
        yield from full(True)


def packed(vectors: DataFrame) -> DataFrame:
    """Blocks (key, ids, dims, data, more...) of ``vectors`` (key, id, embedding, more...), as they are partitioned and sorted."""
    kinds = dict(vectors.dtypes)
    more = "".join(f", {c} array<{kinds[c]}>" for c in vectors.columns[3:])
    return vectors.mapInArrow(_pack, f"key {kinds['key']}, ids array<{kinds['id']}>, dims int, data binary{more}")


def _best_of_pairs(k: int, min_score: float) -> Callable:
    """Pairs of blocks (q_..., d_...) to (query_id, doc_id, score): the k best of each query in all pairs of a task."""

    def top(scores: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = scores.shape[1]
        keyed = np.where(allowed & (scores >= min_score), np.rint(scores * 1e6).astype(np.int64) * n + np.arange(n - 1, -1, -1), -(1 << 62))
        order = np.argpartition(keyed, n - k, axis=1)[:, -k:] if n > k else np.broadcast_to(np.arange(n), scores.shape)
        i, j = np.repeat(np.arange(len(order)), order.shape[1]), order.ravel()
        keep = keyed[i, j] > -(1 << 62)
        return i[keep], j[keep]

    def batch(parts: list[pa.Table]) -> pa.Table:
        """Of each query the k best rows so far."""
        rows = pa.concat_tables(parts).sort_by([("q", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
        q = rows.column("q").to_numpy()
        begins = np.concatenate(([True], q[1:] != q[:-1]))
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(begins, np.arange(len(q)), 0))
        return rows.filter(pa.array(place < k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, tuple] = {}

        def given(key) -> Iterator[pa.RecordBatch]:
            ids, parts = held.pop(key)
            rows = batch(parts)
            query_ids = ids.take(rows.column("q").combine_chunks())
            yield pa.RecordBatch.from_arrays([query_ids, rows.column("doc_id").combine_chunks(), rows.column("score").combine_chunks()], names=["query_id", "doc_id", "score"])

        for b in batches:
            names = b.schema.names
            for r in range(b.num_rows):
                own = {c: b.column(c)[r] for c in names}
                ids, docs = own["q_ids"].values, own["d_ids"].values
                q = np.frombuffer(own["q_data"].as_buffer(), np.float64).reshape(len(ids), -1)
                d = np.frombuffer(own["d_data"].as_buffer(), np.float64).reshape(len(docs), -1)
                dims = min(q.shape[1], d.shape[1])
                scores = np.round(q[:, :dims] @ d[:, :dims].T, 6)
                filters = {c.removeprefix("q_"): own[c].values.to_pylist() for c in names if c.startswith("q_filter_")}
                values = {c.removeprefix("d_"): own[c].values for c in names if c.startswith("d_") and c[2:] in FILTERS.values()}
                masks = [(np.array(of), passing(wanted, list(filters), values, len(docs))) for wanted, of in groups(filters)] or [(np.arange(len(ids)), np.ones(len(docs), bool))]
                key = (own["q_key"].as_py(), own["q_part"].as_py())
                parts = held.setdefault(key, (ids, []))[1]
                for of, mask in masks:
                    i, j = top(scores[of], mask[None, :])
                    parts.append(pa.table({"q": of[i], "doc_id": docs.take(pa.array(j)), "score": scores[of[i], j]}))
                if len(parts) > 16:
                    parts[:] = [batch(parts)]
            while len(held) > HELD:
                yield from given(next(iter(held)))
        for key in list(held):
            yield from given(key)

    return run


def _met(blocks: DataFrame, asked: DataFrame, k: int, min_score: float) -> DataFrame:
    """(query_id, doc_id, score, rank) of packed documents and packed queries that have a key in common."""
    size = asked.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    of = lambda df, side: df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])
    asked = of(asked.withColumn("part", F.monotonically_increasing_id()), "q")
    pairs = of(blocks, "d").join(F.broadcast(asked) if size <= BROADCAST_BYTES else asked, F.col("d_key") == F.col("q_key")).drop("d_key")
    kinds = dict(pairs.dtypes)
    item = lambda c: kinds[c].removeprefix("array<").removesuffix(">")
    best = pairs.mapInArrow(_best_of_pairs(k, min_score), f"query_id {item('q_ids')}, doc_id {item('d_ids')}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def _dealt(df: DataFrame, column: str = "key") -> DataFrame:
    return df.repartition(column).sortWithinPartitions(column)


def search_vector(queries: DataFrame, embeddings: DataFrame, *, k: int = 10, min_score: float = 0.0, docs: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k nearest by cosine that reach ``min_score``, 0 if a norm is 0; ties
    by doc_id. Queries (query_id, embedding, filter_...) with filters are answered among the documents that pass
    them: ``docs`` has doc_id and what is filtered by (type, module: equal; asset_type: equal in either case;
    path: its prefix, in either case). The filters are settled before a block's best are chosen."""
    used = used_filters(queries) if docs is not None else []
    if used:
        embeddings = embeddings.select("doc_id", "embedding").join(docs.select("doc_id", *attributes(docs, used)), "doc_id")
    queries = stored(queries.select(F.col("query_id").alias("id"), "embedding", *used))
    n = -(-queries.count() // BLOCK) or 1
    key = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("key")
    asked = stored(packed(_dealt(queries.select(key, "id", "embedding", *used))))
    more = [c for c in embeddings.columns if c not in ("doc_id", "embedding")] if used else []
    blocks = packed(embeddings.select(F.lit(0).alias("key"), F.col("doc_id").alias("id"), "embedding", *more))
    every = blocks.withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return _met(every, asked, k, min_score)


@dataclass
class VectorIndex:
    """Documents packed by list, the centre of each list, and how many lists a query looks into."""

    blocks: DataFrame
    centres: np.ndarray
    probes: int


#: Vectors that an index is fitted on at most, and its lists at most.
SAMPLE, LISTS = 8192, 512


def _centres(vectors: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """Unit centres of n lists by k-means under cosine, from evenly spaced starts; an empty list keeps its centre."""
    centres = vectors[np.linspace(0, len(vectors) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms == 0, 1, norms), centres)
    return centres


def _probes(vectors: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The least number of lists with which every eighth sampled vector finds this share of its k nearest."""
    own = (vectors @ centres.T).argmax(axis=1)
    asked = vectors[::8]
    nearest = np.argsort(-(asked @ vectors.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, own[nearest], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def _nearest_lists(centres: np.ndarray, n: int) -> Callable:
    """(id, embedding, more...) to (key, id, embedding, more...), a row for each of the n nearest lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column("embedding"))
            dims = min(m.shape[1], centres.shape[1])
            scores = m[:, :dims] @ centres[:, :dims].T
            lists = np.argpartition(-scores, n - 1, axis=1)[:, :n] if n < len(centres) else np.broadcast_to(np.arange(len(centres)), scores.shape)
            rows = pa.array(np.repeat(np.arange(len(m)), lists.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), *(c.take(rows) for c in b.columns)], names=["key", *b.schema.names])

    return run


def _listed(df: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.mapInArrow(_nearest_lists(centres, n), "key int, " + ", ".join(f"{c} {kinds[c]}" for c in df.columns))


def build_vector_index(embeddings: DataFrame, *, k: int = 10, recall: float = 0.97, sample: int = SAMPLE) -> VectorIndex:
    """An inverted-file index over all of ``embeddings`` (doc_id, embedding, and columns to filter by).

    The lists' centres are fitted on at most ``sample`` vectors, those of the least hashes of their ids, and so is
    the number of lists that a query looks into: that with which sampled vectors find the share ``recall`` of
    their k nearest. Every row is indexed: lists are packed into blocks, so a long one is several."""
    hashed = embeddings.select(F.xxhash64("doc_id", F.lit(1)).alias("h"), "embedding").filter("embedding is not null")
    chosen = hashed.orderBy("h").limit(sample).select("embedding").toArrow().column("embedding").combine_chunks()
    vectors = _matrix(chosen) if len(chosen) else np.zeros((1, 1))
    n = max(1, min(LISTS, int(len(vectors) ** 0.5)))
    centres = _centres(vectors, n)
    rows = embeddings.select(F.col("doc_id").alias("id"), "embedding", *attributes(embeddings))
    # a long list is spread over partitions, so that none is one task
    keyed = _listed(rows, centres, 1).withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(64)))
    return VectorIndex(stored(packed(keyed.repartition("key", "_part").sortWithinPartitions("key").drop("_part"))), centres, _probes(vectors, centres, k, recall))


def search_vector_index(queries: DataFrame, index: VectorIndex, *, k: int = 10, min_score: float = 0.0) -> DataFrame:
    """As ``search_vector``, of what the index's nearest lists hold for each query."""
    used = [f for f in used_filters(queries) if FILTERS[f] in index.blocks.columns]
    rows = queries.select(F.col("query_id").alias("id"), "embedding", *used)
    asked = stored(packed(_dealt(_listed(rows, index.centres, min(index.probes, len(index.centres))))))
    return _met(index.blocks, asked, k, min_score)


def _mean(vectors: list, pieces: list[str]) -> list[float]:
    """The mean of the vectors of a text's pieces, each weighing as much as it is long."""
    if len(vectors) == 1:
        return [float(x) for x in vectors[0]]
    return np.average(np.array(vectors, np.float64), axis=0, weights=[len(p) for p in pieces]).tolist()


def embed_docs(docs: DataFrame, make: Callable[[], Callable[[list[str]], list]], *, max_chars: int = 4000) -> DataFrame:
    """(doc_id, embedding, failed): ``make()`` runs once a task and gives a function from texts to
    vectors. Texts longer than ``max_chars`` are embedded in pieces of that length, whose vectors are
    averaged by length. A text that fails alone is counted, without a vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = make()
        for d in frames:
            texts = [t or "" for t in d["text"]]
            pieces = [[t[at : at + max_chars] for at in range(0, max(len(t), 1), max_chars)] for t in texts]
            try:
                flat = list(f([p for own in pieces for p in own]))
                ends = np.cumsum([len(own) for own in pieces])
                vectors = [_mean(flat[end - len(own) : end], own) for own, end in zip(pieces, ends, strict=True)]
            except Exception:
                vectors = []
                for own in pieces:
                    try:
                        vectors.append(_mean(list(f(own)), own))
                    except Exception:
                        vectors.append(None)
            yield pd.DataFrame({"doc_id": d["doc_id"], "embedding": vectors, "failed": [v is None for v in vectors]})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, embedding array<float>, failed boolean")
