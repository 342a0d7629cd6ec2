"""C++ headers and decoded instructions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetloom.functions.headers import Declarations
from assetloom.functions.paths import class_name_candidates
from assetloom.sources.scratch import stored, uncounted

NESTED = r"\((?:[^()]|\([^()]*\))*\)"
CLASS_PATTERN = r"UCLASS\s*" + NESTED + r"\s*class\s+(?:[A-Z0-9_]+_API\s+)?(\w+)"
STRUCT_PATTERN = r"USTRUCT\s*" + NESTED + r"\s*struct\s+(?:[A-Z0-9_]+_API\s+)?(\w+)"
MEMBERS = "path string, line long, kind string, name string, type string, specifiers string, params string, default_value string, is_virtual boolean, is_const boolean, is_override boolean, owner string, specifier_list array<string>, param_list array<string>"
FLAGS = ("is_virtual", "is_const", "is_override")


def without_comments(text):
    return F.regexp_replace(F.regexp_replace(text, r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")


def scan_classes(headers: DataFrame) -> DataFrame:
    """(class_name, source_path): declared classes and structs; of several files the least path."""
    clean = headers.select("path", without_comments(F.col("text")).alias("t"))
    names = F.concat(F.regexp_extract_all("t", F.lit(CLASS_PATTERN), F.lit(1)), F.regexp_extract_all("t", F.lit(STRUCT_PATTERN), F.lit(1)))
    return clean.select("path", F.explode(names).alias("class_name")).groupBy("class_name").agg(F.min("path").alias("source_path"))


def scan_members(headers: DataFrame) -> DataFrame:
    """Functions and properties with specifiers, type, name, parameters, default, flags and line, and the class in
    whose braces they stand. Lists are given as such (specifier_list, param_list) and joined by commas. Lines
    are those of the text without comments; what looks like a comment in a string is none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in MEMBERS.split(", ")]
        for f in frames:
            rows = []
            for path, text in zip(f["path"], f["text"], strict=True):
                for m in Declarations(text or "").members():
                    params = m.get("param_list")
                    joined = {"path": path, "specifiers": ", ".join(m["specifier_list"]), "params": None if params is None else ", ".join(params)}
                    rows.append(dict.fromkeys(columns) | dict.fromkeys(FLAGS, False) | m | joined)
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return headers.select("path", "text").mapInPandas(run, MEMBERS)


def resolve_classes(names: DataFrame, class_index: DataFrame) -> DataFrame:
    """(name, class_name, source_path): the first candidate of each name that is declared."""
    candidates = names.select("name", F.posexplode(class_name_candidates(F.col("name"))).alias("pos", "class_name"))
    return candidates.join(uncounted(class_index), "class_name").groupBy("name").agg(F.min_by(F.struct("class_name", "source_path"), "pos").alias("c")).select("name", "c.*")


def control_flow_metrics(instructions: DataFrame) -> DataFrame:
    """Per function: branches, switches, and complexity none, low (to 2), medium (to 5) or high."""
    out = instructions.groupBy("fn").agg(F.count_if(F.col("op") == "JumpIfNot").alias("branches"), F.count_if(F.col("op") == "Switch").alias("switches"))
    n = F.col("branches") + F.col("switches")
    return out.withColumn("has_branches", n > 0).withColumn("complexity", F.when(n == 0, "none").when(n <= 2, "low").when(n <= 5, "medium").otherwise("high"))


def control_flow_graph(instructions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """blocks (fn, block, first, last, loop_target) and edges (fn, block, successor) of instructions
    (fn, pos, op, target). Blocks start at the first position, at jump targets and after jumps;
    targets without an instruction are ignored; a block is numbered by the order of its start.

    Instructions and the places that jumps go to are dealt by function once; blocks and falls come from one
    window over them, and only the first instructions of blocks are joined again, with the jumps."""
    jumps = F.col("op").isin("Jump", "JumpIfNot", "Switch")
    own = instructions.select("fn", "pos", "op", "target", F.lit(False).alias("_at"))
    marks = instructions.filter(jumps & F.col("target").isNotNull()).select("fn", F.col("target").alias("pos"), F.lit(None).cast("string").alias("op"), F.lit(None).cast("long").alias("target"), F.lit(True).alias("_at"))
    once = own.union(marks).repartition("fn").groupBy("fn", "pos").agg(F.max("op").alias("op"), F.max("target").alias("target"), F.max("_at").alias("_at")).filter("op is not null")
    per = Window.partitionBy("fn").orderBy("pos")
    after = F.coalesce(F.lag(jumps | (F.col("op") == "Return")).over(per), F.lit(False))
    i = once.withColumn("_s", ((F.col("pos") == 0) | F.col("_at") | after).cast("int"))
    i = stored(i.withColumns({"block": F.sum("_s").over(per) - 1, "_next": F.lead("_s").over(per)}).drop("_at"))
    starts = i.filter("_s = 1").select("fn", F.col("pos").alias("target"), F.col("block").alias("successor"))
    jumped = i.filter(jumps & F.col("target").isNotNull()).select("fn", "block", "target").join(starts, ["fn", "target"]).select("fn", "block", "successor")
    falls = i.filter((F.col("_next") == 1) & ~F.col("op").isin("Jump", "Return")).select("fn", "block", (F.col("block") + 1).alias("successor"))
    edges = jumped.union(falls).distinct()
    loops = edges.filter("successor <= block").select("fn", F.col("successor").alias("block")).distinct().withColumn("loop_target", F.lit(True))
    blocks = i.groupBy("fn", "block").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return blocks.join(loops, ["fn", "block"], "left").withColumn("loop_target", F.coalesce("loop_target", F.lit(False))), edges
