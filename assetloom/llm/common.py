"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_text(make: Callable[..., Callable[[str], object]], returns: T.DataType, *args) -> Callable[[Column], Column]:
    """A column function that maps each text by ``make(*args)``.

    ``make`` is a module-level function; it runs once in each Python worker, so a vocabulary is
    loaded once and its caches live as long as the worker. Null texts are passed as ``""``.
    """
    made = lru_cache(make) if not hasattr(make, "cache_info") else make
    arrow = to_arrow_type(returns)

    owner = make.__module__

    def run(texts: pa.Array) -> pa.Array:
        release(owner)
        f = made(*args)
        return pa.array([f(x.as_py() or "") for x in texts], type=arrow)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returnType=returns)


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of a value's decimal text, modulo ``m``."""
    return F.crc32(col.cast("string").cast("binary")) % m


def crc_mod_py(value: int, m: int) -> int:
    return zlib.crc32(str(value).encode()) % m


#: (owner, cache) of a worker.
CACHES: list = []


#: The operator that this worker served last.
SERVED: list = [None]


def release(owner: str) -> None:
    """When a worker comes to another operator, empty the caches of those before and give their memory back to the
    machine."""
    if SERVED[0] == owner:
        return
    SERVED[0] = owner
    for other, cache in CACHES:
        if other != owner:
            cache.clear()
            cache.old = {}
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


class Recent(dict):
    """Values computed when first asked for, in bounded memory.

    Two generations of ``size`` entries are kept: a full one becomes the old one, from which entries
    that are asked for again move on. Keys longer than ``longest`` are not kept.
    """

    def __init__(self, compute: Callable, size: int, longest: int, owner: str):
        super().__init__()
        self.compute, self.size, self.longest = compute, size, longest
        self.old: dict = {}
        CACHES.append((owner, self))

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
