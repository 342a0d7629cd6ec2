"""Record files that arrive one after the other, upserted into an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from assetloom.operators.search_text import build_blocks
from assetloom.operators.upsert import build_edges, changed_docs, clean_tags, edge_changes, replace_edges, replace_tags
from assetloom.sources.files import VersionTaken, index_number, index_parts, read_index, write_index
from assetloom.sources.scratch import dropped, stored

#: Documents as records: what a parser's later steps hand over, one JSON line each.
RECORD = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("doc_id", "type", "path", "text")],
        T.StructField("references_out", T.ArrayType(T.StringType())),
        T.StructField("typed_references_out", T.MapType(T.StringType(), T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)
COLUMNS = RECORD.names


def search_blocks(docs: DataFrame) -> DataFrame:
    """Posting blocks of documents, each with a name of its own; a document is named by its path's last part."""
    named = docs.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return build_blocks(named.select("doc_id", "name", "path", "text", "type")).withColumn("part", F.expr("uuid()"))


def apply_batch(spark: SparkSession, batch: DataFrame, folder: str, *, most_parts: int = 16, tries: int = 8, fingerprint_cols: list[str] = ()) -> None:
    """Upsert one batch of documents, their edges, the tags of their paths and their postings; a batch that comes
    again changes nothing. What has changed is written by itself, over the versions before, as a segment: of a
    document the newest segment's rows and postings count. The whole index is written anew when it would be read
    from more than ``most_parts``. Of the index a batch reads ids, fingerprints, paths and tags. If another writer
    comes in between, the batch is applied to what that one has left. With ``fingerprint_cols``, the same for all
    batches, a change of these columns counts like one of the text. The edges that a version adds and removes are its
    table ``edge_changes``."""
    incoming = batch.filter("doc_id is not null").select(*COLUMNS)
    for left in reversed(range(tries)):
        try:
            return _apply(spark, incoming, folder, most_parts, fingerprint_cols)
        except VersionTaken:
            if not left:
                raise


def _apply(spark: SparkSession, incoming: DataFrame, folder: str, most_parts: int, more: list[str]) -> None:
    number, parts = index_number(spark, folder), index_parts(spark, folder)
    if parts:
        index = read_index(spark, folder)
    else:  # the first batch of all
        index = {"docs": incoming.limit(0).withColumn("fingerprint", F.lit("")), "edges": spark.createDataFrame([], "from_id string, to_id string, edge_type string"), "tags": spark.createDataFrame([], "path string, tag string")}
    changed = stored(changed_docs(index["docs"].select("doc_id", "fingerprint"), incoming, fingerprint_cols=more).select(*COLUMNS, "fingerprint"))
    if parts and changed.isEmpty():
        return dropped(changed)
    ids = changed.select("doc_id")
    # where documents are and where they were
    paths = stored(changed.select("path").union(index["docs"].join(ids, "doc_id", "left_semi").select("path")).distinct())
    stays = index["docs"].select(*COLUMNS, "fingerprint").join(ids, "doc_id", "left_anti")
    changes = edge_changes(index["edges"], changed)
    # the tags of a path are those of all its documents
    tagged = stays.select("path", "tags").join(paths, "path", "left_semi").union(changed.select("path", "tags")).select("path", F.explode("tags").alias("tag"))
    if parts and len(parts) < most_parts:
        write_index({"docs": changed, "edges": build_edges(changed), "tags": clean_tags(tagged), "paths": paths, "blocks": search_blocks(changed), "edge_changes": changes}, folder, onto=parts, after=number)
    else:
        edges, tags = index["edges"].select("from_id", "to_id", "edge_type"), index["tags"].select("path", "tag")
        every = stays.unionByName(changed)
        write_index({"docs": every, "edges": replace_edges(edges, changed), "tags": replace_tags(tags, tagged, paths), "paths": paths, "blocks": search_blocks(every), "edge_changes": changes}, folder, after=number)
    dropped(changed, paths)


def stream_upsert(spark: SparkSession, records: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Upsert all record files of a folder that have come since the last run, then stop."""
    stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 64).json(records)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: apply_batch(batch.sparkSession, batch, folder)).start()
