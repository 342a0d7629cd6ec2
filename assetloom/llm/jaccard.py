"""N-gram Jaccard join: exact links between word-shingle sets, by R-trees of count vectors.

1. Tokens, the hashes of a text's shingles, are dealt into groups by hash, and the groups are ranked
   by how often their tokens stand in all texts. Each set is ordered by these ranks, rare groups first.
2. Of two sets that link, the first token that both have is among the first of either, as no more
   can be missing than the threshold allows. So sets meet at these tokens, and no pair that links is
   missed. Equal sets are one from here on. Of the sets that meet at a token and are near enough in
   size, the smallest is the hub; a hub and the sets that meet it are a block. A passage that many documents share makes no
   large blocks: its tokens are frequent and stand at the end.
3. The sets of a block are points, their counts by group, in an R-tree. Nodes keep the greatest count
   of each group; the sum of coordinate minima bounds the overlap of nodes as of points. The trees of
   all blocks are joined on the counts alone, which are some twentieth of a text; only the sets that
   the bound leaves with a partner are fetched, and pairs that pass are verified on them, in batches.
   Large blocks are cut into tiles, and pairs of tiles are joined by as many tasks.
4. Components of the links give the classes.

With ``count_links`` every pair that passes is verified, and each document has the number of its
links. A pair that meets in several blocks counts in the block of its least hub. Without, a pair
whose sets are joined already is not verified: the tiles of a block are joined in themselves first,
and then only the sets outside a block's largest class with all others, so that a large group of near
copies costs about as much as it has members.

Defined results: a text without words is empty and links with nothing; fewer words than a shingle
are one shingle; a document without id has no component and no links; repeated rows get equal results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.llm.common import table
from assetloom.llm.tables import components, small_side
from assetloom.llm.words import shingle_hashes
from assetloom.sources.scratch import dropped, stored

#: Words of a shingle, and the threshold in hundredths.
SHINGLE, PERCENT = 4, 85
#: Groups of tokens whose corpus counts are kept, by the top bits of the hash: the same at any size.
GROUP_BITS, CHUNK_BITS = 18, 13
#: Most sets, and about the most tokens, of a tile.
TILE, TILE_TOKENS = 1024, 1_500_000
#: Texts that are worked on at once, points of a leaf and children of a node, pairs bounded at once.
SLICE, LEAF, STEP = 512, 16, 1 << 21


def shingle_set(text: str, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def signature(h: np.ndarray) -> int:
    """One number for a set, as a signed 64-bit integer."""
    return xxhash.xxh3_64_intdigest(h.tobytes()) - 2**63


def needed(a, b, percent: int):
    """The least overlap of sets of sizes a and b that link."""
    return -(-percent * (a + b) // (100 + percent))


def meeting_keys(h: np.ndarray, percent: int, ranks: np.ndarray | None = None) -> np.ndarray:
    """The first tokens of a set by the rank of their group: two sets that link share one at least.

    Any partner has percent / 100 of the set's tokens at least, so at most the rest is missing, and
    the first token in common has no more before it.
    """
    k = len(h) - -(-percent * len(h) // 100) + 1
    if k >= len(h) or ranks is None:
        return h[:k]
    rank = ranks[h >> np.uint64(64 - GROUP_BITS)]
    return h[np.lexsort((h, rank))[:k]]


def _batch(columns: dict[str, object], schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], type=t) for k, t in schema.items()], names=list(schema))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few texts, as what is made of them is larger than the texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _count_groups(width: int) -> Callable:
    """(text) to (chunk, counts): how many tokens of a partition are in each group of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << GROUP_BITS, np.int64)
        for batch in _sliced(batches):
            found = [shingle_hashes(t.as_py() or "", width) for t in batch.column(0)]
            if found:
                counts += np.bincount((np.concatenate(found) >> np.uint64(64 - GROUP_BITS)).astype(np.int64), minlength=len(counts))
        chunks = counts.astype("<u4" if counts.max() < 1 << 32 else "<u8").reshape(-1, 1 << CHUNK_BITS)
        if counts.any():
            yield _batch({"chunk": range(len(chunks)), "counts": [c.tobytes() for c in chunks]}, {"chunk": pa.int32(), "counts": pa.binary()})

    return run


def _chunk(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8" if len(data) == 8 << CHUNK_BITS else "<u4").astype(np.int64)


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, counts) to their sums, one row a chunk."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sums[chunk] = sums.get(chunk, 0) + _chunk(counts.as_py())
    yield _batch({"chunk": list(sums), "counts": [v.astype("<u8").tobytes() for v in sums.values()]}, {"chunk": pa.int32(), "counts": pa.binary()})


def group_ranks(texts: DataFrame, width: int) -> np.ndarray:
    """The rank of each group of tokens by its count over all texts; 2 MB at most reach the driver."""
    parts = texts.select("text").mapInArrow(_count_groups(width), "chunk int, counts binary")
    sums = parts.repartition("chunk").mapInArrow(_add_chunks, "chunk int, counts binary").collect()
    counts = np.zeros((1 << GROUP_BITS - CHUNK_BITS, 1 << CHUNK_BITS), np.int64)
    for r in sums:
        counts[r.chunk] = _chunk(r.counts)
    ranks = np.empty(1 << GROUP_BITS, np.uint16)
    ranks[np.argsort(counts.ravel(), kind="stable")] = np.arange(1 << GROUP_BITS) >> max(0, GROUP_BITS - 16)
    return ranks


def _profiles(width: int, percent: int, ranks: np.ndarray) -> Callable:
    """(doc_id, text) to (doc_id, n, sig, counts, keys); of equal sets of a partition the first has keys."""
    schema = {"doc_id": pa.int64(), "n": pa.int64(), "sig": pa.int64(), "counts": pa.binary(), "keys": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _sliced(batches):
            sizes, sigs, counts, keys, ends = [], [], [], [], [0]
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                h = shingle_set(text.as_py() or "", width)
                sig = signature(h)
                new = len(h) and doc.is_valid and sig not in seen
                if new:
                    seen.add(sig)
                    keys.append(meeting_keys(h, percent, ranks))
                sizes.append(len(h))
                sigs.append(sig)
                counts.append(packed(h) if len(h) and doc.is_valid else None)
                ends.append(ends[-1] + (len(keys[-1]) if new else 0))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield _batch({"doc_id": batch.column(0), "n": sizes, "sig": sigs, "counts": counts, "keys": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))}, schema)

    return run


def _meetings(percent: int) -> Callable:
    """Sorted (key, n, sig) to (block, sig): of the sets of a key, runs whose sizes are near enough for
    each to link with the one before; the first set names the block. Runs of one set are left out.

    Rows are three numbers and none is kept but the last, so a frequent key costs no memory.
    """
    schema = {"block": pa.int64(), "sig": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # key, n, sig and block of the last row, and whether it is out already
        for batch in batches:
            k, n, s = (c.to_numpy() for c in batch.columns)
            if held is not None:
                k, n, s = (np.concatenate(([x], y)) for x, y in zip(held, (k, n, s), strict=False))
            if not len(k):
                continue
            new = np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])))
            k, n, s = k[new], n[new], s[new]
            begins = np.concatenate(([True], (k[1:] != k[:-1]) | (100 * n[:-1] < percent * n[1:])))
            which = np.cumsum(begins) - 1
            blocks, out = s[begins][which], np.bincount(which)[which] > 1
            if held is not None:
                blocks[which == 0] = held[3]
                if held[4]:
                    out[which == 0] = True
            last = (k[-1], n[-1], s[-1], blocks[-1], out[-1])
            if held is not None and held[4]:
                out[0] = False
            held = last
            yield _batch({"block": blocks[out], "sig": s[out]}, schema)

    return run


def _sets(width: int) -> Callable:
    """(sig, text) to (sig, hashes), of the texts that have this sig."""
    schema = {"sig": pa.int64(), "hashes": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            rows = [(sig, h.tobytes()) for sig, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if signature(h := shingle_set(text.as_py() or "", width)) == sig]
            yield _batch({"sig": [s for s, _ in rows], "hashes": [h for _, h in rows]}, schema)

    return run


class Ragged:
    """Lists of numbers, to be intersected one with many."""

    def __init__(self, lists: list[np.ndarray]):
        self.lengths = np.array([len(x) for x in lists], np.int64)
        self.ends = np.cumsum(self.lengths)
        flat = np.concatenate([*lists, np.zeros(0, np.uint64)])
        self.n_values, self.flat = 0, np.zeros(0, np.int64)
        if len(flat):
            values, self.flat = np.unique(flat, return_inverse=True)
            self.n_values = len(values)
        self.marked = np.zeros(self.n_values, np.int32)

    def overlaps(self, i: int, js: np.ndarray) -> np.ndarray:
        """How many numbers list i has in common with each of the lists js."""
        own = self.flat[self.ends[i] - self.lengths[i] : self.ends[i]]
        self.marked[own] = 1
        lengths = self.lengths[js]
        ends = np.cumsum(lengths)
        places = np.arange(ends[-1]) + np.repeat(self.ends[js] - ends, lengths)
        sums = np.concatenate(([0], np.cumsum(self.marked[self.flat[places]])))
        self.marked[own] = 0
        return sums[ends] - sums[ends - lengths]


def count_vector(h: np.ndarray) -> np.ndarray:
    """The tokens of a set by group: two to four tokens a group on average, from 16 to 4096 groups."""
    bits = min(12, max(4, len(h).bit_length() - 2))
    return np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def packed(h: np.ndarray) -> bytes:
    """The least token of a set and its count vector, in the fewest bytes a count."""
    v = count_vector(h)
    width = 1 if v.max() < 1 << 8 else 2 if v.max() < 1 << 16 else 4
    return h[:1].tobytes() + bytes([width]) + v.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> tuple[int, np.ndarray]:
    return int.from_bytes(data[:8], "little"), np.frombuffer(data, f"<u{data[8]}", offset=9)


class RTree:
    """Points packed into leaves, leaves into nodes; a node keeps the greatest coordinates and the
    least size below it. Sets with the same least token, mostly near copies, stand together."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, firsts: np.ndarray):
        self.order = np.lexsort((sizes, firsts))
        self.levels = [(points[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > 1:
            tops, least = self.levels[-1]
            starts = np.arange(0, len(least), LEAF)
            self.levels.append((np.maximum.reduceat(tops, starts, axis=0), np.minimum.reduceat(least, starts)))

    def level(self, height: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of a height; above the root stands the root."""
        return self.levels[min(height, len(self.levels) - 1)]


def rtree_pairs(a: RTree, b: RTree, percent: int) -> np.ndarray:
    """Pairs of points of two trees that may link, as rows (i, j); of a tree with itself, each once.

    Pairs of nodes go down together, as long as the sum of their coordinate minima reaches the
    overlap needed.
    """
    top = max(len(a.levels), len(b.levels)) - 1
    pairs = np.zeros((1, 2), np.int64)
    for height in range(top, -1, -1):
        (x, n), (y, m) = a.level(height), b.level(height)
        if height < top:
            i, j = (np.minimum(p[:, None] * LEAF + np.arange(LEAF), len(s)) for p, s in zip(pairs.T, (n, m), strict=True))  # the length stands for none
            pairs = np.stack((np.repeat(i, LEAF, axis=1).ravel(), np.tile(j, LEAF).ravel()), axis=1)
            pairs = pairs[(pairs[:, 0] < len(n)) & (pairs[:, 1] < len(m))]
        if a is b:
            pairs = pairs[pairs[:, 0] <= pairs[:, 1] if height else pairs[:, 0] < pairs[:, 1]]
        step = max(1, STEP // x.shape[1])
        kept = [np.minimum(x[i], y[j]).sum(axis=1, dtype=np.int64) >= needed(n[i], m[j], percent) for i, j in (pairs[at : at + step].T for at in range(0, len(pairs), step))]
        if not kept:
            return pairs
        pairs = pairs[np.concatenate(kept)]
    return np.stack((a.order[pairs[:, 0]], b.order[pairs[:, 1]]), axis=1)


def tile_pairs(vectors: list[np.ndarray], sizes: np.ndarray, firsts: np.ndarray, sides: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of sets of a tile (side 0), or of two tiles (sides 1 and 2), that may link, as rows (i, j).

    Sets with equally long vectors make a tree. Trees whose sizes are near enough are joined, the
    longer vectors being added up to the length of the shorter.
    """
    lengths, out = np.array([len(v) for v in vectors]), [np.zeros((0, 2), np.int64)]
    kinds = [(g, s, np.flatnonzero((lengths == g) & (sides == s))) for g in np.unique(lengths) for s in np.unique(sides)]

    def tree(own: np.ndarray, groups: int) -> RTree:
        return RTree(np.array([vectors[k].reshape(groups, -1).sum(axis=1, dtype=np.uint32) for k in own]), sizes[own], firsts[own])

    for at, (g, s, x) in enumerate(kinds):
        for h, t, y in kinds[at:]:
            same = (g, s) == (h, t)
            if not len(x) or not len(y) or (s == t) == bool(s) or sizes[x].max() * 100 < percent * sizes[y].min() or sizes[y].max() * 100 < percent * sizes[x].min():
                continue
            a = tree(x, min(g, h))
            pairs = rtree_pairs(a, a if same else tree(y, min(g, h)), percent)
            out.append(np.stack((x[pairs[:, 0]], y[pairs[:, 1]]), axis=1))
    return np.concatenate(out)


def join_tile(sets: list[np.ndarray], labels: np.ndarray, sides: np.ndarray, hubs: list[np.ndarray], weights: np.ndarray, percent: int, count_links: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each set of a tile (side 0), or of a pair of tiles (sides 1 and 2): the label of its class
    here, and the weights of those that it links with, as far as they have no hub in common."""
    sizes = np.array([len(h) for h in sets])
    pairs = tile_pairs([count_vector(h) for h in sets], sizes, np.array([h[0] for h in sets]), sides, percent)
    root, links = labels.copy(), np.zeros(len(sets), np.int64)
    if not len(pairs):
        return root, links
    tokens, earlier = Ragged(sets), Ragged(hubs)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    starts = np.flatnonzero(np.concatenate(([True], pairs[1:, 0] != pairs[:-1, 0])))
    for i, js in zip(pairs[starts, 0].tolist(), np.split(pairs[:, 1], starts[1:]), strict=True):
        if not count_links:
            js = js[root[js] != root[i]]
            if not len(js):
                continue
        js = js[tokens.overlaps(i, js) >= needed(sizes[i], sizes[js], percent)]
        if not len(js):
            continue
        joined = np.unique(root[js])
        root[np.isin(root, joined)] = root[i]
        if count_links:
            once = js[earlier.overlaps(i, js) == 0]
            links[i] += weights[once].sum()
            links[once] += weights[i]
    return root, links


def _joined(percent: int, count_links: bool) -> Callable:
    """Sorted (block, low, high, side, sig, label, weight, earlier, hashes) to (sig, other, links):
    each set that is joined with another, one such, and the weights of its links here."""
    schema = {"sig": pa.int64(), "other": pa.int64(), "links": pa.int64()}

    def found(rows: list[tuple]) -> list[tuple[int, int, int]]:
        rows = [next(g) for _, g in groupby(rows, key=itemgetter(3, 4))]  # a set comes once, its document may not
        if len(rows) < 2:
            return []
        _, _, _, sides, sigs, labels, weights, hubs, hashes = zip(*rows, strict=True)
        labels = np.array(labels, np.int64)
        root, links = join_tile([np.frombuffer(h, np.uint64) for h in hashes], labels, np.array(sides), [np.array(x, np.int64).view(np.uint64) for x in hubs], np.array(weights, np.int64), percent, count_links)
        first = dict(zip(root[::-1].tolist(), sigs[::-1], strict=True))  # of each class
        changed = set(root[root != labels].tolist())
        return [(s, first[r], n) for s, r, n in zip(sigs, root.tolist(), links.tolist(), strict=True) if r in changed or n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for _, rows in _by_tile(batches):
            out += found(rows)
            if len(out) >= 10_000:
                yield _batch(dict(zip(schema, zip(*out, strict=True), strict=True)), schema)
                out = []
        if out:
            yield _batch(dict(zip(schema, zip(*out, strict=True), strict=True)), schema)

    return run


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of each (block, low, high), the first three columns, by which the batches are sorted."""
    each = (row for batch in batches for at in range(0, batch.num_rows, SLICE) for row in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns), strict=True))
    return ((key, list(rows)) for key, rows in groupby(each, key=itemgetter(0, 1, 2)))


PLACE = {"block": pa.int64(), "low": pa.int64(), "high": pa.int64(), "side": pa.int32(), "sig": pa.int64(), "label": pa.int64(), "weight": pa.int64(), "doc_id": pa.int64(), "earlier": pa.list_(pa.int64())}


def _partnered(percent: int) -> Callable:
    """Sorted places and counts to the places of the sets that may link with another of other label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, rows in _by_tile(batches):
            if len(rows) < 2:
                continue
            firsts, vectors = zip(*(unpacked(r[9]) for r in rows), strict=True)
            pairs = tile_pairs(vectors, np.array([int(v.sum()) for v in vectors]), np.array(firsts, np.uint64), np.array([r[3] for r in rows]), percent)
            labels = np.array([r[5] for r in rows])
            pairs = pairs[labels[pairs[:, 0]] != labels[pairs[:, 1]]]
            out += [rows[k][:9] for k in np.unique(pairs).tolist()]
            if len(out) >= 10_000:
                yield _batch(dict(zip(PLACE, zip(*out, strict=True), strict=True)), PLACE)
                out = []
        if out:
            yield _batch(dict(zip(PLACE, zip(*out, strict=True), strict=True)), PLACE)

    return run


WIDE = ["block", "low", "high", "side", "sig", "label", "weight", "earlier", "hashes"]


def _join_placed(placed: DataFrame, met: DataFrame, texts: DataFrame, shingle: int, percent: int, count_links: bool) -> DataFrame:
    """(sig, other, links), stored; ``placed``: the sets' places in tiles; ``met``: their counts."""

    def tiled(df: DataFrame) -> DataFrame:
        return df.repartition("block", "low", "high").sortWithinPartitions("block", "low", "high", "side", "sig")

    dealt = tiled(placed.join(met.select("sig", "counts"), "sig").select(*PLACE, "counts"))
    near = stored(dealt.mapInArrow(_partnered(percent), "block long, low long, high long, side int, sig long, label long, weight long, doc_id long, earlier array<long>"))
    wanted = small_side(stored(near.select("sig", "doc_id").distinct()))
    sets = stored(texts.join(wanted, "doc_id").select("sig", "text").mapInArrow(_sets(shingle), "sig long, hashes binary"))
    out = stored(tiled(near.join(sets, "sig").select(WIDE)).mapInArrow(_joined(percent, count_links), "sig long, other long, links long"))
    dropped(near, sets)
    return out


def _in_tiles(members: DataFrame, tiles: Column) -> DataFrame:
    """Members with their tile, by a hash of the set."""
    return members.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("sig"), F.col("tiles")))


def _tiles_for(size: Column, tokens: Column) -> Column:
    return F.greatest(F.ceil(size / TILE), F.ceil(tokens / TILE_TOKENS))


def set_links(texts: DataFrame, profiles: DataFrame, shingle: int, percent: int, count_links: bool) -> DataFrame:
    """(sig, other, links): pairs of sets that join all classes, and the weights of links."""
    keys = profiles.select(F.explode("keys").alias("key"), "n", "sig").repartition("key").sortWithinPartitions("key", "n", "sig")
    stars = stored(keys.mapInArrow(_meetings(percent), "block long, sig long").distinct())
    info = profiles.filter("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("weight"), F.first("n").alias("n"), F.first("counts").alias("counts"))
    met = stored(info.join(stars.select("sig").distinct(), "sig"))

    members = stars.join(met.select("sig", "doc_id", "n", "weight"), "sig")
    if count_links:
        members = members.join(stars.groupBy("sig").agg(F.collect_list("block").alias("_all")), "sig").withColumn("earlier", F.filter("_all", lambda b: b < F.col("block"))).drop("_all")
    else:
        members = members.withColumn("earlier", F.array().cast("array<long>"))
    sizes = members.groupBy("block").agg(F.count("*").alias("_size"), F.sum("n").alias("_tokens"))
    large = stored(sizes.select("block", _tiles_for(F.col("_size"), F.col("_tokens")).alias("_tiles")).filter("_tiles > 1"))
    members = members.withColumn("label", F.col("sig")).join(small_side(large), "block", "left")
    members = stored(_in_tiles(members, F.coalesce("_tiles", F.lit(1))).drop("_tiles"))

    inside = members.withColumns({"low": F.col("tile"), "high": F.col("tile"), "side": F.lit(0)})
    if count_links:
        other = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: t != F.col("tile")))
        across = members.filter("tiles > 1").withColumn("other", other)
        across = across.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other"), "side": F.when(F.col("tile") < F.col("other"), 1).otherwise(2)})
        out = _join_placed(inside.unionByName(across, allowMissingColumns=True), met, texts, shingle, percent, True)
    else:
        out = _join_placed(inside, met, texts, shingle, percent, False)
        if not large.isEmpty():
            mixed = _rest(members.filter("tiles > 1"), out)
            out = out.union(_join_placed(mixed, met, texts, shingle, percent, False))
    dropped(stars, met, large, members)
    return out


def _rest(members: DataFrame, links: DataFrame) -> DataFrame:
    """Places, to join the sets outside the largest class of each block of several tiles with all others."""
    known = components(links.select(F.col("sig").alias("a"), F.col("other").alias("b")))
    members = stored(members.drop("label", "tile").join(known.select(F.col("node").alias("sig"), F.col("component").alias("label")), "sig", "left").withColumn("label", F.coalesce("label", "sig")))
    classes = members.groupBy("block", "label").agg(F.count("*").alias("_size"), F.sum("n").alias("_tokens"))
    whole = classes.groupBy("block").agg(F.max(F.struct("_size", "label")).alias("top"), F.sum("_size").alias("s"), F.sum("_tokens").alias("t"))
    mixed = classes.join(whole, "block").filter("label <> top.label").groupBy("block").agg(F.first("top.label").alias("top"), _tiles_for(F.sum("_size"), F.sum("_tokens")).alias("lows"))
    members = members.join(small_side(stored(mixed)), "block")
    tile = F.pmod(F.xxhash64("sig"), F.col("lows"))
    low = members.filter("label <> top").withColumns({"low": tile, "high": F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)), "side": F.lit(1)})
    high = members.withColumns({"low": F.explode(F.sequence(F.lit(0).cast("long"), F.col("lows") - 1)), "high": F.pmod(F.xxhash64("sig"), F.col("tiles")), "side": F.lit(2)})
    return low.unionByName(high)


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, count_links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, sig, component_id, first_sig, n_links), a row for each row of ``docs``.

    component_id: the least id that the document reaches by links; first_sig: the set of the document
    that stands for the class, the least set of that id; n_links: the rows that it links with, those
    of equal texts too, null without ``count_links``. Only the two named columns are read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranks = group_ranks(texts, shingle)
    profiles = stored(texts.mapInArrow(_profiles(shingle, percent, ranks), "doc_id long, n long, sig long, counts binary, keys array<long>"))
    joined = set_links(texts, profiles, shingle, percent, count_links)
    root = components(joined.select(F.col("sig").alias("a"), F.col("other").alias("b"))).toDF("sig", "root")
    counts = joined.groupBy("sig").agg(F.sum("links").alias("links"))

    sets = profiles.filter("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("owner"), F.count("*").alias("copies"))
    sets = sets.join(root, "sig", "left").join(counts, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    heads = sets.groupBy("root").agg(F.min(F.struct("owner", "sig")).alias("head"))
    of_set = sets.join(heads, "root").select("sig", "head", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    known = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return profiles.join(of_set, "sig", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "sig",
        F.when(known, F.col("head.owner")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(known, F.col("head.sig")).otherwise(F.col("sig")).alias("first_sig"),
        F.when(F.lit(count_links), F.when(known, F.col("links")).otherwise(0)).cast("long").alias("n_links"),
    )


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): the size of each document's set, and the least id that
    it reaches by links."""
    return jaccard_classes(docs, id_col=id_col, text_col=text_col, shingle=shingle, percent=percent).select("doc_id", "n_shingles", "component_id")


def set_signature(text: Column, shingle: int) -> Column:
    """The number of each text's shingle set, as ``sig`` of ``jaccard_classes``."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([signature(shingle_set(t.as_py() or "", shingle)) for t in texts], type=pa.int64())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returnType="long")(text)


def first_of_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay if of each class of near duplicates one document does: that of
    the least id, then of the least set. Of rows with this id and set one stays. Texts without words,
    and rows without id, are in no class and all stay. ``docs`` may have other columns of any name."""
    mark = f"_{uuid.uuid4().hex}"  # begins names that no column of docs has
    gone_id, set_of, first_set, alone = (f"{mark}{k}" for k in range(4))
    classes = stored(jaccard_classes(docs, id_col=id_col, text_col=text_col, shingle=shingle, percent=percent).filter("doc_id is not null"))
    first = (F.col("doc_id") == F.col("component_id")) & (F.col("sig") == F.col("first_sig"))
    ids = classes.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(first).alias("stays"))
    gone = stored(ids.filter("n = 1 and not stays").select(F.col("doc_id").alias(gone_id)))
    again = stored(ids.filter("n > 1").select(F.col("doc_id").alias(gone_id)))
    own = F.col(id_col).cast("long") == F.col(gone_id)
    plain = docs.join(small_side(gone), own, "left_anti").join(small_side(again), own, "left_anti")
    repeated = docs.join(small_side(again), own, "left_semi").withColumn(set_of, set_signature(F.col(text_col), shingle))
    firsts = classes.filter(first & (F.col("n_shingles") > 0)).select(F.col("doc_id").alias(gone_id), F.col("sig").alias(first_set)).distinct()
    empty = signature(shingle_set("", shingle))
    one = F.row_number().over(Window.partitionBy(id_col, set_of).orderBy(text_col)) == 1
    kept = repeated.join(firsts, own & (F.col(set_of) == F.col(first_set)), "left_semi").withColumn(alone, one).filter(F.col(alone))
    return plain.unionByName(kept.drop(set_of, alone)).unionByName(repeated.filter(F.col(set_of) == empty).drop(set_of))


def op8_jaccard_join(spark, sf_dir):
    """The near-duplicate class of every document and its links, by 4-word shingles at 85 hundredths."""
    return jaccard_classes(table(spark, sf_dir, "documents"), count_links=True).select("doc_id", "n_shingles", "component_id", "n_links")
