"""The first rows of each key, of streams of rows that are too many to be sorted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows that a task holds before it leaves out what can't be among the first, and rows left with which it starts anew.
HELD_ROWS, LEFT_ROWS = 65_536, 262_144


def _sorted(rows: pa.Table, order: list[tuple[str, str]]) -> pa.Table:
    """Rows in Spark's order: nulls are the least."""
    keys, table = [], rows
    for c, way in order:
        if way == "ascending" and rows.column(c).null_count:
            table = table.append_column(f"_is_{c}", pc.is_valid(rows.column(c)))
            keys.append((f"_is_{c}", way))
        keys.append((c, way))
    return rows.take(pc.sort_indices(table, sort_keys=keys))


def _begins(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """Which rows differ from the one before in these columns."""
    out = np.zeros(len(rows), bool)
    out[:1] = True
    for c in columns:
        col = rows.column(c)
        a, b = col.slice(1), col.slice(0, max(0, len(col) - 1))
        unlike = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        out[1:] |= unlike.to_numpy()
    return out


def _firsts(k: int, by: list[str], once: list[str], within: list, order: list) -> Callable:
    ascending = lambda columns: [(c, "ascending") for c in columns]

    def cut(parts: list[pa.Table]) -> pa.Table:
        rows = _sorted(pa.concat_tables(parts), ascending([*by, *once]) + within)
        rows = rows.filter(pa.array(_begins(rows, [*by, *once])))
        rows = _sorted(rows, ascending(by) + order)
        at, begins = np.arange(len(rows)), _begins(rows, by)
        return rows.filter(pa.array(at - np.maximum.accumulate(np.where(begins, at, 0)) < k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, least = [], 0, HELD_ROWS
        for batch in batches:
            parts.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n >= least:
                parts = [cut(parts).combine_chunks()]
                n = parts[0].num_rows
                if n > LEFT_ROWS:
                    yield from parts.pop().to_batches()
                    n = 0
                least = max(HELD_ROWS, 2 * n)
        if n:
            yield from cut(parts).to_batches()

    return run


def first_rows(rows: DataFrame, k: int, *, by: list[str], once: list[str], within: list[tuple[str, str]], order: list[tuple[str, str]]) -> DataFrame:
    """What each task has of ``rows`` that can be among the k first of its key ``by``: of rows that are alike in ``by`` and ``once``
    the first by ``within``, of those the first k by ``order``. A row that is the first by ``within`` mustn't come later by
    ``order`` than the others, and ``order`` must tell all rows of a key apart. A task that has
    very many keys sends more than that, and holds no more than LEFT_ROWS and what came with them."""
    return rows.mapInArrow(_firsts(k, by, once, within, order), rows.schema)
