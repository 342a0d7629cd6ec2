"""Status, distributions, folders and pages of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetloom.config import SEMANTIC_TYPES

#: Assets a second, of the time estimate.
SEMANTIC_RATE, LIGHT_RATE = 2.0, 50.0


def index_status(docs: DataFrame, light: DataFrame, edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(metric, key, value): documents and light assets, in all and by type, edges, classes, and, where
    ``docs`` has indexed_at and embed_model, when it was last indexed and a model, as keys."""

    def counted(df: DataFrame, metric: str, key: str | None) -> DataFrame:
        by = df.groupBy(F.coalesce(F.col(key), F.lit("Unknown")).alias("key")) if key else df.groupBy(F.lit("").alias("key"))
        return by.agg(F.count("*").alias("value")).select(F.lit(metric).alias("metric"), "key", "value")

    out = counted(docs, "docs", "type").union(counted(light, "light", "asset_type"))
    for df, metric in ((docs, "total_docs"), (light, "total_light"), (edges, "edges"), (classes, "classes")):
        out = out.union(counted(df, metric, None))
    for column, metric in (("indexed_at", "last_indexed"), ("embed_model", "embed_model")):
        if column in docs.columns:
            out = out.union(docs.agg(F.max(column).cast("string").alias("key")).filter("key is not null").select(F.lit(metric).alias("metric"), "key", F.lit(1).cast("long").alias("value")))
    return out


def type_distribution(df: DataFrame) -> DataFrame:
    """Count and percent of each asset type, whether it is indexed in full, and seconds to do so."""
    kind = F.coalesce("asset_type", F.lit("Unknown"))
    out = df.groupBy(kind.alias("asset_type")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_t"))
    semantic = F.col("asset_type").isin(SEMANTIC_TYPES)
    return out.join(F.broadcast(total)).select(
        "asset_type", "n", F.round(100.0 * F.col("n") / F.col("_t"), 6).alias("percent"), semantic.alias("semantic"), F.round(F.col("n") / F.when(semantic, SEMANTIC_RATE).otherwise(LIGHT_RATE), 6).alias("seconds")
    )


def tag_stats(tags: DataFrame, *, prefix: str = "", limit: int = 50) -> DataFrame:
    """Distinct paths of each tag that starts with ``prefix``, the most used first."""
    counted = tags.filter(F.col("tag").ilike(prefix + "%")).groupBy("tag").agg(F.countDistinct("path").alias("n"))
    return counted.orderBy(F.desc("n"), "tag").limit(limit)


def tag_level_stats(tags: DataFrame) -> DataFrame:
    """Distinct paths at each level of tags: ``A.B.C`` counts for ``A``, ``A.B`` and ``A.B.C``."""
    parts = F.split("tag", r"\.")
    levels = tags.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("level"), F.array_join(F.slice(parts, 1, n), ".").alias("tag")))).alias("x"))
    return levels.groupBy("x.level", "x.tag").agg(F.countDistinct("path").alias("n"))


def folder_counts(df: DataFrame, folder: str) -> DataFrame:
    """(subfolder, n): assets below each direct subfolder; '' stands for those in the folder itself."""
    root = folder.rstrip("/") + "/"
    rest = F.substr("path", F.lit(len(root) + 1))
    sub = F.when(F.instr(rest, "/") > 0, F.substring_index(rest, "/", 1)).otherwise("")
    return df.filter(F.col("path").startswith(root)).groupBy(sub.alias("subfolder")).agg(F.count("*").alias("n"))


def list_assets(df: DataFrame, folder: str, kind: str | None = None) -> DataFrame:
    """Assets below a folder, of a type if one is given; ``asset_type`` null where undecided. ``undecided``
    counts these in the whole folder."""
    out = df.filter(F.col("path").startswith(folder.rstrip("/") + "/"))
    unknown = out.agg(F.count_if(F.col("asset_type").isNull()).alias("undecided"))
    return (out.filter(F.col("asset_type") == kind) if kind else out).join(F.broadcast(unknown))


def paginate(df: DataFrame, order: list[str], *, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page with total, and whether more follow; the limit is kept between 1 and 100."""
    limit = max(1, min(100, limit))
    total = df.agg(F.count("*").alias("total"))
    page = df.orderBy(*order).offset(offset).limit(limit)
    return page.join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def profile_data_table(rows: DataFrame) -> DataFrame:
    """Per table (tbl, struct, row_key, columns): struct and columns of the first row, row count, first ten keys."""
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy("tbl").orderBy("row_key")))
    first = ranked.filter("_k <= 10").groupBy("tbl").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "row_key"))), lambda x: x["row_key"]), ",").alias("sample_keys"))
    return rows.groupBy("tbl").agg(F.min_by("struct", "row_key").alias("struct"), F.count("*").alias("row_count"), F.min_by("columns", "row_key").alias("columns")).join(first, "tbl")
