"""Files, records and index tables."""

from __future__ import annotations

import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.sources.scratch import deleted

#: Folders whose headers are generated.
GENERATED = r"/(Intermediate|Binaries|\.vs|DerivedDataCache)/"


def list_asset_files(spark: SparkSession, roots: list[str], *, exclude: list[str] = (), recursive: bool = True, max_assets: int | None = None) -> DataFrame:
    """(path, size, mtime) of asset and map files below the roots, without paths that have a folder
    named like one of ``exclude``; with ``max_assets`` the first so many by path. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{uasset,umap}").load(list(roots))
    out = files.select("path", F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"))
    for name in exclude:
        out = out.filter(~F.lower("path").rlike(r"/[^/]*\Q" + name.lower() + r"\E[^/]*/"))
    return out if max_assets is None else out.orderBy("path").limit(max_assets)


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of JSON lines; errors are lines that are no JSON or have an ``error``."""
    wide = T.StructType([*schema.fields, *([] if "error" in schema.names else [T.StructField("error", T.StringType())]), T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    bad = F.col("_corrupt").isNotNull() | F.col("error").isNotNull()
    return lines.filter(~bad).drop("_corrupt"), lines.filter(bad).select(F.coalesce("error", F.lit("bad json")).alias("error"), "_corrupt", *[c for c in ("path",) if c in schema.names])


REFERENCES = T.StructType([T.StructField(f"{kind}-refs", T.StructType([T.StructField("ref", T.ArrayType(T.StringType()))])) for kind in ("asset", "class", "script")])


def read_reference_xml(df: DataFrame, xml_col: str = "xml") -> DataFrame:
    """``df`` with an array ``references``: asset, class (as ``/Script/…``) and script references, in
    this order; malformed text has none."""
    x = df.withColumn("_x", F.from_xml(F.col(xml_col), _ddl(REFERENCES), {"mode": "PERMISSIVE"}))
    part = lambda k: F.coalesce(F.col(f"_x.`{k}-refs`.ref"), F.array().cast("array<string>"))
    classes = F.transform(part("class"), lambda c: F.when(c.startswith("/Script/"), c).otherwise(F.concat(F.lit("/Script/"), c)))
    return x.withColumn("references", F.concat(part("asset"), classes, part("script"))).drop("_x")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` STRUCT<ref: ARRAY<STRING>>" for f in schema.fields)


def read_headers(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of headers below ``Source`` and ``Plugins``, without generated ones."""
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.h").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return texts.filter(F.col("path").rlike("/(Source|Plugins)/") & ~F.col("path").rlike(GENERATED) & ~F.col("path").rlike(r"\.(generated|gen)\.h$"))


#: Columns by which index tables are partitioned.
PARTITIONS = {"docs": ["type"], "edges": ["edge_type"]}


#: One line for each version of an index, in a file named by its number. A version counts as soon as its line
#: stands there. It is a whole index, or what has changed since the versions ``onto``, the newest first.
POINTER = "number long, version string, tables string, onto string"
#: The table and column that hold what a version's rows of a table replace, and that column's name in the table: a
#: later version replaces all rows of its documents, or of the paths that it names.
OWNERS = {"docs": ("docs", "doc_id", "doc_id"), "edges": ("docs", "doc_id", "from_id"), "tags": ("paths", "path", "path"), "paths": ("paths", "path", "path"), "blocks": ("docs", "doc_id", "doc_id")}
#: Seconds after which a number without a line is taken for what a crashed writer left.
PATIENCE = 10.0


class VersionTaken(Exception):
    """Another writer has written the version that was to follow the one read."""


def _pointers(spark: SparkSession, folder: str) -> list:
    """The lines of all versions, the newest first; none for a folder that has never held an index."""
    try:
        return spark.read.schema(POINTER).json(f"{folder}/pointers").filter("version is not null").orderBy(F.desc("number"), F.desc("version")).collect()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return []
        raise


def _parts(line) -> list[str]:
    """The versions that a line's index is read from, the newest first."""
    return [line.version, *[v for v in (line.onto or "").split(",") if v]]


def index_parts(spark: SparkSession, folder: str) -> list[str]:
    """The versions that the index is read from, the newest first."""
    found = _pointers(spark, folder)
    return _parts(found[0]) if found else []


def index_number(spark: SparkSession, folder: str) -> int:
    """The number of the newest version, 0 where there is none."""
    found = _pointers(spark, folder)
    return found[0].number if found else 0


def _claim(spark: SparkSession, folder: str, number: int, line: str) -> bool:
    """Write the line of a version, unless the number is taken."""
    name = f"{folder}/pointers/{number:012d}.json"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":
        local = path.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            with open(local, "x") as f:
                f.write(line)
        except FileExistsError:
            return False
        return True
    if fs.exists(path):
        return False
    try:
        out = fs.create(path, False)  # fails if another writer was faster
    except Py4JJavaError:
        if fs.exists(path):
            return False
        raise
    out.write(bytearray(line.encode()))
    out.close()
    return True


def _settled(spark: SparkSession, folder: str, number: int) -> bool:
    """Whether the line of a taken number is there, or comes within PATIENCE."""
    until = time.monotonic() + PATIENCE
    while not any(p.number == number for p in _pointers(spark, folder)):
        if time.monotonic() > until:
            return False
        time.sleep(0.2)
    return True


def write_index(tables: dict[str, DataFrame], folder: str, *, keep: int = 2, onto: list[str] = (), after: int | None = None) -> str:
    """Write a new version of the tables, then a line that points to it; readers see the version before
    until then, and nothing that a reader needs is ever overwritten, so a crash at any point leaves
    the last whole version. With ``onto`` the tables (docs among them) hold changed documents and what is
    theirs, to be read over these versions. Versions that the last ``keep`` don't need are removed.

    Of writers at the same time one gets the next number. With ``after``, the number of the version that the
    tables were made from, the others fail with VersionTaken, having changed nothing; without, they come next."""
    spark = next(iter(tables.values())).sparkSession
    version, before = uuid.uuid4().hex, _pointers(spark, folder)
    for name, df in tables.items():
        path = f"{folder}/{version}/{name}"
        df.write.partitionBy(*([] if onto else PARTITIONS.get(name, []))).parquet(path)
        try:
            spark.read.parquet(path)
        except AnalysisException as error:  # an empty table leaves no partition
            if "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            df.limit(0).write.mode("append").parquet(path)
    number = (after if after is not None else before[0].number if before else 0) + 1
    while True:
        line = spark.createDataFrame([(number, version, ",".join(sorted(tables)), ",".join(onto))], POINTER).toJSON().first()
        if _claim(spark, folder, number, line):
            break
        if _settled(spark, folder, number) and after is not None:
            deleted(spark, f"{folder}/{version}")
            raise VersionTaken(f"version {number} of {folder} is another writer's")
        number += 1
    old = max(0, keep - 1)
    needed = {version, *onto}.union(*map(_parts, before[:old]))
    for line in before[old:]:
        if line.version not in needed:
            deleted(spark, f"{folder}/{line.version}")
    return version


def _masked(blocks: DataFrame, newer: DataFrame) -> DataFrame:
    """Posting blocks with the places of the documents that newer versions hold, as ``gone``."""
    each = blocks.select("part", F.posexplode("ids").alias("at", "doc_id")).join(newer, "doc_id", "left_semi")
    return blocks.drop("gone").join(each.groupBy("part").agg(F.sort_array(F.collect_list("at")).alias("gone")), "part", "left")


def read_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the newest version; FileNotFoundError where there has never been one."""
    found = _pointers(spark, folder)
    if not found:
        raise FileNotFoundError(f"no index in {folder}")
    newest, *older = _parts(found[0])

    def table(name: str) -> DataFrame:
        out = spark.read.parquet(f"{folder}/{newest}/{name}")
        if not older or name not in OWNERS:  # what tells of the version itself
            return out
        holder, owner, column = OWNERS[name]
        owners = lambda version: spark.read.parquet(f"{folder}/{version}/{holder}").select(F.col(owner).alias(column))
        newer = owners(newest)
        for version in older:
            rows = spark.read.parquet(f"{folder}/{version}/{name}")
            out = out.unionByName(_masked(rows, newer) if name == "blocks" else rows.join(newer, column, "left_anti"), allowMissingColumns=True)
            newer = newer.union(owners(version))
        return out

    return {name: table(name) for name in found[0].tables.split(",")}
