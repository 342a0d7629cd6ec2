"""Texts, fingerprints and nested JSON as column expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTER = " \t\n\r\x0b\x0c"
FIRST_PATH = re.compile(r"/[A-Za-z0-9_]+(?:/[A-Za-z0-9_]+)+(?:\.[A-Za-z0-9_]+)?")
TAG_DEPTH = 10


def fingerprint(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the lower-cased text without outer white space."""
    return F.substring(F.sha2(F.lower(F.btrim(text, F.lit(OUTER))), 256), 1, 16)


def wide_fingerprint(df: DataFrame, columns: list[str]) -> Column:
    """A fingerprint of a text and of other columns of ``df``: that of the text where there are no others. Null, and
    what is written alike in two columns, are told apart; the order of a map's entries doesn't count."""
    if not columns:
        return fingerprint(F.col("text"))
    kinds = dict(df.dtypes)
    plain = [(F.array_sort(F.map_entries(c)) if kinds[c].startswith("map") else F.col(c)).alias(c) for c in columns]
    whole = F.concat_ws("\n", F.coalesce(F.lower(F.btrim("text", F.lit(OUTER))), F.lit("\0")), F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}))
    return F.substring(F.sha2(whole, 256), 1, 16)


def snippet(text: Column, n: int = 180) -> Column:
    """The text with white space collapsed, cut to n characters."""
    return F.substring(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r\x0B\f]+", " ")), 1, n)


def estimate_tokens(*texts: Column) -> Column:
    """A quarter of the characters of all texts, rounded down."""
    chars = sum((F.coalesce(F.length(t), F.lit(0)) for t in texts), F.lit(0))
    return F.floor(chars / 4).cast("long")


def _refs(value, out: dict) -> None:
    todo = [value]  # the next value comes last
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if m := FIRST_PATH.search(x):
                out.setdefault(m.group())
        elif isinstance(x, dict):
            todo += reversed(x.values())
        elif isinstance(x, list):
            todo += reversed(x)


def _tags(value, out: set, depth: int = 0) -> None:
    if depth > TAG_DEPTH:
        return
    if isinstance(value, list):
        for x in value:
            _tags(x, out, depth + 1)
    elif isinstance(value, dict):
        kind = value.get("_type")
        found = [value.get("TagName")] if kind == "GameplayTag" else value.get("tags") or [] if kind == "GameplayTagContainer" else []
        out.update(t for t in found if isinstance(t, str) and t not in ("", "None"))
        for x in value.values():
            _tags(x, out, depth + 1)


def _parsed(text: str | None):
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):  # no JSON, or nested deeper than the parser goes
        return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def _collect_refs(texts: pd.Series) -> pd.Series:
    def one(text):
        out: dict = {}
        _refs(_parsed(text), out)
        return list(out)

    return texts.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _collect_tags(texts: pd.Series) -> pd.Series:
    def one(text):
        out: set = set()
        _tags(_parsed(text), out)
        return sorted(out)

    return texts.map(one)


def collect_refs(text: Column) -> Column:
    """The first path of each string in a JSON text, in the order of the walk, each once."""
    return _collect_refs(text)


def collect_tags(text: Column) -> Column:
    """The gameplay tags in a JSON text, sorted, each once; bad JSON has none."""
    return _collect_tags(text)
