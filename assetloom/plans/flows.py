"""Queries that go through files: records, index tables, references in XML, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.operators.graph import where_used
from assetloom.operators.search_text import search_text
from assetloom.operators.upsert import detect_changes
from assetloom.plans import catalog, questions
from assetloom.plans.views import view, with_views
from assetloom.sources.buckets import write_buckets
from assetloom.sources.files import read_index, read_records, read_reference_xml, write_index
from assetloom.sources.scratch import shared_dir
from assetloom.streaming.upserts import stream_upsert

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return register


def folder(spark) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@query("read_records", with_views("v_assets") + " SELECT CASE WHEN id % 7 = 0 THEN 'bad json' WHEN id % 5 = 0 THEN 'no file' ELSE 'ok' END AS outcome, count(*) AS n FROM v_assets GROUP BY 1")
def _read_records(spark, d):
    line = F.when(F.col("id") % 7 == 0, F.lit("{not json")).otherwise(F.to_json(F.struct("path", "name", F.when(F.col("id") % 5 == 0, "no file").alias("error"))))
    view(spark, d, "v_assets").select(line.alias("value")).write.text(out := folder(spark))
    ok, errors = read_records(spark, out, T.StructType.fromDDL("path string, name string"))
    return ok.select(F.lit("ok").alias("outcome")).union(errors.select("error")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("read_reference_xml", with_views("v_assets") + " SELECT id, CASE WHEN id % 9 = 0 THEN '' ELSE path || ',/Script/Game.' || name || ',/Script/Engine.Actor' END AS refs FROM v_assets")
def _read_reference_xml(spark, d):
    xml = F.concat(F.lit("<references><asset-refs><ref>"), "path", F.lit("</ref></asset-refs><class-refs><ref>Game."), "name", F.lit("</ref></class-refs><script-refs><ref>/Script/Engine.Actor</ref></script-refs></references>"))
    df = view(spark, d, "v_assets").select("id", F.when(F.col("id") % 9 == 0, F.lit("<references><asset-")).otherwise(xml).alias("xml"))
    return read_reference_xml(df).select("id", F.array_join("references", ",").alias("refs"))


@query("write_index", with_views("v_inherits") + " SELECT from_id, to_id, edge_type FROM v_inherits")
def _write_index(spark, d):
    write_index({"edges": view(spark, d, "v_inherits"), "docs": view(spark, d, "v_docs")}, out := folder(spark))
    return read_index(spark, out)["edges"].select("from_id", "to_id", "edge_type")


@query("stream_upsert", with_views("v_docs") + " SELECT doc_id, substr(sha256(lower(trim(text || CASE WHEN n % 4 = 0 THEN ' more' ELSE '' END, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)))), 1, 16) AS fingerprint, CASE WHEN n % 4 = 0 THEN 'New.' || module WHEN n % 3 = 0 THEN 'Old.A,Old.B' ELSE '' END AS tags FROM v_docs")
def _stream_upsert(spark, d):
    typed = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    old = F.when(F.col("n") % 3 == 0, F.array(F.lit("Old.B"), F.lit(" Old.A"), F.lit(""))).otherwise(F.array(F.lit(None).cast("string")))
    docs = view(spark, d, "v_docs").select("doc_id", "type", "path", "text", F.array(F.lit("/Game/X")).alias("references_out"), typed.alias("typed_references_out"), old.alias("tags"), "n", "module")
    changed = docs.filter("n % 4 = 0").withColumn("text", F.concat("text", F.lit(" more"))).withColumn("tags", F.array(F.concat(F.lit("New."), "module")))
    records, index, checkpoint = folder(spark), folder(spark), folder(spark)
    for batch in (docs, changed):
        batch.drop("n", "module").write.mode("append").json(records)
        stream_upsert(spark, records, index, checkpoint).awaitTermination()
    tables = read_index(spark, index)
    tags = tables["tags"].groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))
    return tables["docs"].select("doc_id", "path", "fingerprint").join(tags, "path", "left").select("doc_id", "fingerprint", F.coalesce("tags", F.lit("")).alias("tags"))


# every third document is there, then every second comes with another text; each is asked for by its path and first words
@query("stream_search", with_views("v_docs") + """, old AS (SELECT * FROM v_docs WHERE n % 3 <> 1), d AS (SELECT n, doc_id, path, CASE WHEN n % 2 = 0 THEN 'fresh w' || CAST(n AS VARCHAR) || ' words of ' || module ELSE text END AS text FROM v_docs WHERE n % 3 <> 1 OR n % 2 = 0),
  t AS (SELECT n, doc_id, regexp_extract_all(lower(path), '[\\p{L}\\p{N}]+') AS p, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS x, regexp_extract_all(lower(regexp_extract(path, '[^/]*$')), '[\\p{L}\\p{N}]+') AS m FROM d),
  w AS (SELECT doc_id, 10.0::DOUBLE AS w, unnest(m) AS tok FROM t UNION ALL SELECT doc_id, 5.0, unnest(p) FROM t UNION ALL SELECT doc_id, 1.0, unnest(x) FROM t),
  dl AS (SELECT doc_id, len(m) + len(p) + len(x) AS dl FROM t), tot AS (SELECT count(*) AS nd, avg(dl) AS av FROM dl),
  q AS (SELECT DISTINCT n AS query_id, unnest(['fresh', 'w' || CAST(n AS VARCHAR), 'src']) AS unit FROM v_docs WHERE n % 20 = 0),
  h AS (SELECT unit, doc_id, sum(w) AS tf FROM (SELECT DISTINCT unit FROM q) JOIN w ON starts_with(tok, unit) GROUP BY 1, 2), f AS (SELECT unit, count(*) AS df FROM h GROUP BY 1),
  s AS (SELECT query_id, h.doc_id, round(sum(greatest(ln((nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / av))), 6) AS score FROM q JOIN h USING (unit) JOIN f USING (unit) JOIN dl USING (doc_id), tot GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 5""")
def _stream_search(spark, d):
    typed = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    docs = view(spark, d, "v_docs").select("doc_id", "type", "path", "text", none.alias("references_out"), typed.alias("typed_references_out"), none.alias("tags"), "n", "module")
    fresh = F.concat(F.lit("fresh w"), F.col("n").cast("string"), F.lit(" words of "), "module")
    records, index, checkpoint = folder(spark), folder(spark), folder(spark)
    for batch in (docs.filter("n % 3 <> 1"), docs.filter("n % 2 = 0").withColumn("text", fresh)):
        batch.drop("n", "module").write.mode("append").json(records)
        stream_upsert(spark, records, index, checkpoint).awaitTermination()
    words = F.concat(F.lit("fresh w"), F.col("n").cast("string"), F.lit(" src"))
    return search_text(docs.filter("n % 20 = 0").select(F.col("n").alias("query_id"), words.alias("query")), read_index(spark, index)["blocks"], k=5)


@query("where_used_in_buckets", questions.SQL["where_used"])
def _where_used_in_buckets(spark, d):
    """References by target and edges by target stand in buckets; only the targets are dealt."""
    targets, refs, edges, docs = (view(spark, d, v) for v in ("v_targets", "v_light_refs", "v_inherits", "v_asset_docs"))
    return where_used(targets, write_buckets(refs, folder(spark), "ref_path"), write_buckets(edges, folder(spark), "to_id"), docs)


@query("detect_changes_in_buckets", catalog.SQL["detect_changes"])
def _detect_changes_in_buckets(spark, d):
    """What was and what is stand in buckets by path, as the index keeps the one and a scan writes the other."""
    now, was = (write_buckets(view(spark, d, v), folder(spark), "path") for v in ("v_snapshot", "v_file_meta"))
    return detect_changes(now, was)
