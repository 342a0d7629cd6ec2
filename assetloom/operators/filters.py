"""Filters of queries, held against the documents of a block in one go."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of queries that filter, the column of documents that each is held against, and how: equal, equal in
#: either case, or by prefix in either case, in which ``_`` stands for any character and ``%`` for any. Null lets all pass; a document without the value passes no other.
FILTERS = {"filter_type": "type", "filter_module": "module", "filter_asset_type": "asset_type", "filter_path_prefix": "path"}
FOLDED = ("asset_type", "path")


def used_filters(queries: DataFrame) -> list[str]:
    return [c for c in FILTERS if c in queries.columns]


def attributes(docs: DataFrame, filters: list[str] | None = None) -> list:
    """The columns of documents that these filters, or all, are held against, as far as there are any."""
    wanted = [FILTERS[f] for f in (FILTERS if filters is None else filters)]
    return [(F.lower(c) if c in FOLDED else F.col(c)).alias(c) for c in wanted if c in docs.columns]


def passing(values: tuple, filters: list[str], documents: dict[str, pa.Array], n: int) -> np.ndarray:
    """Which of n documents pass filters of these values."""
    mask = np.ones(n, bool)
    for f, value in zip(filters, values, strict=True):
        if value is None:
            continue
        column = FILTERS[f]
        value = value.lower() if column in FOLDED else value
        if f == "filter_path_prefix":
            hit = pc.match_like(documents[column], value.replace("\\", "\\\\") + "%")
        else:
            hit = pc.equal(documents[column], value)
        mask &= pc.fill_null(hit, False).to_numpy(zero_copy_only=False)
    return mask


def groups(queries: dict[str, list]) -> Iterator[tuple[tuple, list[int]]]:
    """The values of filters that queries have, each with the places of the queries."""
    found: dict[tuple, list[int]] = {}
    for i, values in enumerate(zip(*queries.values(), strict=True)):
        found.setdefault(values, []).append(i)
    yield from found.items()
