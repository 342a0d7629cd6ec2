"""Fill-in-middle transformation: texts cut into prefix, middle and suffix, and put together in another order.

Whole batches go through pyarrow.compute: a mark after each unit splits texts into lists of units; the
lists are flattened with their parents' indices; a unit's ordinal is its place less that of its list's
first; units are filtered by role, put back into lists, and the lists are joined into pieces. The mark
is a byte that UTF-8 never has, and units are cut at ASCII white space, so bytes serve as well as code points.

Defined results: a null or empty text has no units and stays plain; so does one that holds a marker
already. Cuts that leave a piece empty are as good as any. A null id is drawn like an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import table

#: Units: a word with the white space before it, or what white space is left at the end.
UNIT = rb"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
MARK = b"\xff"
EMPTY = pa.scalar(b"", pa.large_binary())
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The seed, and the shares in hundredths of texts that are changed, and of these that are spm.
SEED, RATE, SPM = 42, 50, 80
#: About the most bytes of texts that are cut at once; units take some five times as much.
STEP_BYTES = 8 << 20

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string"


def _units(texts: pa.Array) -> pa.Array:
    """Lists of units; each ends with one empty piece more."""
    return pc.split_pattern(pc.replace_substring_regex(texts, UNIT, rb"\1" + MARK), MARK)


def _chars(pieces: pa.Array) -> pa.Array:
    return pc.cast(pc.utf8_length(pc.cast(pieces, pa.large_string())), pa.int64())


def _offsets(counts: pa.Array) -> pa.Array:
    """Where lists of so many items begin, and where the last one ends."""
    return pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(pc.cast(counts, pa.int64()))])


def cut(texts: pa.Array, first: pa.Array, second: pa.Array) -> tuple[pa.Array, dict[str, pa.Array]]:
    """The number of units of each text, and its pieces by role; the prefix ends after
    first % (n + 1) or second % (n + 1) units, whichever is less, the middle after the greater."""
    lists = _units(texts)
    n = pc.cast(pc.subtract(pc.list_value_length(lists), 1), pa.int64())
    modulo = lambda h: pc.subtract(h, pc.multiply(pc.divide(h, pc.add(n, 1)), pc.add(n, 1)))
    a, b = modulo(first), modulo(second)
    low, high = pc.min_element_wise(a, b), pc.max_element_wise(a, b)
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    starts = pc.take(_offsets(pc.list_value_length(lists)), parents)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), starts)
    before, after = pc.less(ordinal, pc.take(low, parents)), pc.greater_equal(ordinal, pc.take(high, parents))
    roles = {
        "prefix": (before, low),
        "middle": (pc.invert(pc.or_(before, after)), pc.subtract(high, low)),
        "suffix": (after, pc.subtract(pc.list_value_length(lists), high)),
    }

    def piece(role: pa.Array, counts: pa.Array) -> pa.Array:
        return pc.binary_join(pa.ListArray.from_arrays(pc.cast(_offsets(counts), pa.int32()), pc.filter(flat, role)), EMPTY)

    return n, {name: piece(*role) for name, role in roles.items()}


def _joined(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*[pa.scalar(p.encode(), pa.large_binary()) if isinstance(p, str) else p for p in parts], EMPTY)


def restore(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts (large binary) that outputs were made of; no piece holds a marker, so the first one ends it."""

    def halves(texts: pa.Array, marker: str) -> tuple[pa.Array, pa.Array]:
        # a text without the marker, which is of another form, gives itself twice
        parts = pc.split_pattern(texts, marker.encode(), max_splits=1)
        last = pc.subtract(pc.list_value_length(parts), 1)
        ends = pc.subtract(pc.cumulative_sum(pc.list_value_length(parts)), 1)
        flat = pc.list_flatten(parts)
        return pc.take(flat, pc.subtract(ends, last)), pc.take(flat, ends)

    suffix, tail = halves(halves(output, SUFFIX)[1], PREFIX)
    spm = _joined(*halves(tail, MIDDLE), suffix)
    prefix, tail = halves(halves(output, PREFIX)[1], SUFFIX)
    suffix, middle = halves(tail, MIDDLE)
    psm = _joined(prefix, middle, suffix)
    return pc.case_when(pc.make_struct(pc.equal(form, "spm"), pc.equal(form, "psm")), spm, psm, output)


def _transform(rate: int, spm: int, step_bytes: int):
    """(doc_id, text, h) to SCHEMA; h: four numbers below 2^32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(pc.cast(pc.cast(batch.column(1), pa.large_string()), pa.large_binary()), b"")
            step = pc.divide(pc.cumulative_sum(pc.cast(pc.binary_length(texts), pa.int64())), step_bytes).to_numpy()
            places = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(texts)]
            for at, end in pairwise(places):
                yield _changed(*(x.slice(at, end - at) for x in (batch.column(0), texts, batch.column(2))), rate, spm)

    return run


def _changed(ids: pa.Array, texts: pa.Array, h: pa.Array, rate: int, spm: int) -> pa.RecordBatch:
    texts = pa.concat_arrays([texts])  # without an offset
    h1, h2, h3, h4 = (pc.list_element(h, k) for k in range(4))
    hundredths = lambda x: pc.subtract(x, pc.multiply(pc.divide(x, 100), 100))
    n, piece = cut(texts, h1, h2)
    plain = pc.or_(pc.equal(n, 0), pc.greater_equal(hundredths(h3), rate))
    for marker in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(texts, marker.encode()))
    form = pc.if_else(plain, "plain", pc.if_else(pc.less(hundredths(h4), spm), "spm", "psm"))
    as_spm = _joined(SUFFIX, piece["suffix"], PREFIX, piece["prefix"], MIDDLE, piece["middle"])
    as_psm = _joined(PREFIX, piece["prefix"], SUFFIX, piece["suffix"], MIDDLE, piece["middle"])
    output = pc.case_when(pc.make_struct(pc.equal(form, "spm"), pc.equal(form, "psm")), as_spm, as_psm, texts)
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), _chars(piece[name])) for name in ("prefix", "middle")]
    text = lambda x: pc.cast(pc.cast(x, pa.large_string()), pa.string())
    return pa.RecordBatch.from_arrays([pc.cast(ids, pa.int64()), n, form, *chars, text(output), text(restore(output, form))], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])


def draws(doc_id: Column, seed: int) -> Column:
    """Four numbers below 2^32, by seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, restored), a row for each of ``docs``; only the two
    named columns are read."""
    ids = F.col(id_col).cast("long")
    return docs.select(ids.alias("doc_id"), F.col(text_col).alias("text"), draws(ids, seed).alias("h")).mapInArrow(_transform(rate, spm, STEP_BYTES), SCHEMA)


def op13_fill_in_middle(spark, sf_dir):
    """Every document transformed, with digests of the output and of the text restored from it."""
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256).alias(f"{c}_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))
