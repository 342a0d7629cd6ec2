"""Queries on names, paths, types, changes and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetloom.config import CLASS_TYPES, GUESSES, NAME_PREFIXES, NO_REFERENCE_TYPES, SEMANTIC_TYPES, Profile
from assetloom.functions import paths as P
from assetloom.functions import text as X
from assetloom.operators import classify as C
from assetloom.operators import report as R
from assetloom.operators import upsert as U
from assetloom.plans.views import view, with_views

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _values(pairs, columns: str) -> str:
    quoted = ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in p) + ")" for p in pairs)
    return f"(VALUES {quoted}) AS t({columns})"


@query("to_asset_path", with_views("v_assets") + """, f AS (SELECT path, CASE WHEN id % 3 = 0 THEN 'D:\\Proj\\Plugins\\Kit\\Content\\' WHEN id % 3 = 1 THEN 'D:\\Proj\\Content\\' ELSE 'E:\\Other\\' END || name || '.uasset' AS file FROM v_assets)
  SELECT file, CASE WHEN file LIKE '%Kit%' THEN '/Kit/' || replace(regexp_extract(file, '([^\\\\]*)$', 1), '.uasset', '') WHEN file LIKE 'D:%' THEN '/Game/' || replace(regexp_extract(file, '([^\\\\]*)$', 1), '.uasset', '') ELSE replace(file, '\\', '/') END AS asset_path FROM f""")
def _to_asset_path(spark, d):
    n = F.col("id") % 3
    file = F.concat(F.when(n == 0, "D:\\Proj\\Plugins\\Kit\\Content\\").when(n == 1, "D:\\Proj\\Content\\").otherwise("E:\\Other\\"), F.col("name"), F.lit(".uasset"))
    return view(spark, d, "v_assets").select(file.alias("file")).withColumn("asset_path", P.to_asset_path(F.col("file"), "D:/Proj/Content", {"D:/Proj/Plugins/Kit/Content": "Kit"}))


@query("normalize_object_path", with_views("v_assets") + """, f AS (SELECT path, CASE WHEN id % 3 = 0 THEN path || '.' || name || '_C' WHEN id % 3 = 1 THEN '/Script/Game.' || name ELSE name END AS object FROM v_assets)
  SELECT object, CASE WHEN object LIKE '/Game/%' THEN path ELSE object END AS package FROM f""")
def _normalize_object_path(spark, d):
    n = F.col("id") % 3
    obj = F.when(n == 0, F.concat("path", F.lit("."), "name", F.lit("_C"))).when(n == 1, F.concat(F.lit("/Script/Game."), "name")).otherwise(F.col("name"))
    return view(spark, d, "v_assets").select(obj.alias("object")).withColumn("package", P.normalize_object_path(F.col("object")))


@query("normalize_inherits_target", with_views("v_assets") + """
  SELECT CASE WHEN id % 2 = 0 THEN 'class: ' || name || '_C' ELSE 'asset:' || path || '.' || name || '_C?' END AS token,
    CASE WHEN id % 2 = 0 THEN name || '_C' ELSE path END AS normalized, name AS bare_name FROM v_assets""")
def _normalize_inherits_target(spark, d):
    token = F.when(F.col("id") % 2 == 0, F.concat(F.lit("class: "), "name", F.lit("_C"))).otherwise(F.concat(F.lit("asset:"), "path", F.lit("."), "name", F.lit("_C?")))
    return view(spark, d, "v_assets").select(token.alias("token")).select("token", P.normalize_inherits_target(F.col("token")).alias("x")).select("token", "x.*")


@query("classify_by_name", with_views("v_assets") + f""", p AS (SELECT * FROM {_values(NAME_PREFIXES.items(), "prefix, kind")}),
  r AS (SELECT a.name, p.kind, row_number() OVER (PARTITION BY a.name ORDER BY length(p.prefix) DESC) AS k FROM v_assets a JOIN p ON starts_with(upper(a.name), upper(p.prefix)))
  SELECT a.name, coalesce(r.kind, 'Unknown') AS asset_type FROM v_assets a LEFT JOIN r ON r.name = a.name AND r.k = 1""")
def _classify_by_name(spark, d):
    return view(spark, d, "v_assets").select("name", C.classify_by_name(F.col("name")).alias("asset_type"))


@query("classify_asset", with_views("v_assets") + f""", c AS (SELECT * FROM {_values(CLASS_TYPES.items(), "cls, kind")}),
  a AS (SELECT id, 'X' || name AS name, CASE id % 4 WHEN 0 THEN 'Texture2D' WHEN 1 THEN 'K2Node_Call' WHEN 2 THEN 'MyGeneratedClass' ELSE 'Other' END AS cls FROM v_assets)
  SELECT a.id, coalesce(c.kind, CASE WHEN a.cls LIKE 'K2Node%' OR a.cls LIKE '%GeneratedClass' THEN 'Blueprint' ELSE 'Unknown' END) AS asset_type FROM a LEFT JOIN c ON c.cls = a.cls""")
def _classify_asset(spark, d):
    n = F.col("id") % 4
    cls = F.when(n == 0, "Texture2D").when(n == 1, "K2Node_Call").when(n == 2, "MyGeneratedClass").otherwise("Other")
    return view(spark, d, "v_assets").select("id", C.classify_asset(F.concat(F.lit("X"), "name"), F.array(cls)).alias("asset_type"))


@query("guess_type", with_views("v_assets") + ", f AS (SELECT lower(name) AS n, path FROM v_assets) SELECT path, CASE " + " ".join(f"WHEN {' OR '.join(f'''starts_with(n, '{s}')''' for s in starts)} THEN '{kind}'" for kind, starts in GUESSES) + " END AS asset_type FROM f")
def _guess_type(spark, d):
    return view(spark, d, "v_assets").select("path", C.guess_type(F.col("name"), F.col("path")).alias("asset_type"))


RECLASSIFIED = "CASE WHEN id % 5 = 0 THEN 'GameFeatureData' WHEN starts_with(name, 'GE_') AND id % 5 <> 1 THEN 'GameplayEffect' WHEN id % 5 = 1 THEN 'DataAsset' ELSE 'Blueprint' END"


def _reclassified(spark, d):
    n = F.col("id") % 5
    typed = view(spark, d, "v_assets").withColumn("asset_type", F.when(n < 2, "Unknown").otherwise("Blueprint")).withColumn("main_class", F.when(n == 0, "GameFeatureAction_AddWidgets").when(n == 1, "PrimaryDataAsset").otherwise("Actor"))
    return C.reclassify(typed, Profile())


@query("reclassify", with_views("v_assets") + f" SELECT path, {RECLASSIFIED} AS asset_type FROM v_assets")
def _reclassify(spark, d):
    return _reclassified(spark, d).select("path", "asset_type")


@query("route_tier", with_views("v_assets") + f""", t AS (SELECT path, {RECLASSIFIED} AS asset_type FROM v_assets)
  SELECT path, asset_type, CASE WHEN asset_type IN ({", ".join(f"'{t}'" for t in [*SEMANTIC_TYPES, "GameplayEffect"])}) THEN 'semantic' WHEN asset_type IN ({", ".join(f"'{t}'" for t in NO_REFERENCE_TYPES)}) THEN 'lightweight_no_refs' ELSE 'lightweight_refs' END AS tier FROM t""")
def _route_tier(spark, d):
    return C.route_tier(_reclassified(spark, d), Profile()).select("path", "asset_type", "tier")


@query("filter_docs", with_views("v_docs") + " SELECT doc_id, module FROM v_docs WHERE lower(path) LIKE '/game/src1%' AND lower(asset_type) IN ('en', 'fr')")
def _filter_docs(spark, d):
    return C.filter_docs(view(spark, d, "v_docs"), type="asset_summary", path_prefix="/game/SRC1", asset_types=["EN", "Fr"]).select("doc_id", "module")


@query("module_of", with_views("v_assets", "v_headers") + " SELECT path, split_part(path, '/', 3) AS module FROM v_assets UNION ALL SELECT path, 'Game' AS module FROM v_headers")
def _module_of(spark, d):
    both = view(spark, d, "v_assets").select("path").union(view(spark, d, "v_headers").select("path"))
    return both.select("path", P.module_of(F.col("path")).alias("module"))


@query("fingerprint", with_views("v_docs") + " SELECT doc_id, substr(sha256(lower(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)))), 1, 16) AS fingerprint FROM v_docs")
def _fingerprint(spark, d):
    return view(spark, d, "v_docs").select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"))


@query("normalize_reference", with_views("v_assets") + """, f AS (SELECT CASE id % 4 WHEN 0 THEN path WHEN 1 THEN '/Script/Game.' || name WHEN 2 THEN 'class:' || name ELSE 'material:' || path END AS ref FROM v_assets)
  SELECT ref, CASE WHEN ref LIKE 'class:%' OR ref LIKE 'material:%' THEN ref WHEN ref LIKE '/Script/%' THEN 'script:' || ref ELSE 'asset:' || ref END AS normalized FROM f""")
def _normalize_reference(spark, d):
    n = F.col("id") % 4
    ref = F.when(n == 0, F.col("path")).when(n == 1, F.concat(F.lit("/Script/Game."), "name")).when(n == 2, F.concat(F.lit("class:"), "name")).otherwise(F.concat(F.lit("material:"), "path"))
    return view(spark, d, "v_assets").select(ref.alias("ref")).withColumn("normalized", P.normalize_reference(F.col("ref")))


@query("extract_refs", with_views("v_assets") + """
  SELECT path, path AS asset_path, name AS class_name FROM v_assets""")
def _extract_refs(spark, d):
    value = F.concat(F.lit("(, "), "path", F.lit(", )"))
    return view(spark, d, "v_assets").select("path", P.extract_asset_path(value).alias("asset_path"), P.extract_class_name(value).alias("class_name"))


@query("extract_all_refs", """SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(html, '/[A-Za-z0-9_]+(?:/[A-Za-z0-9_]+)+'), lambda p: NOT starts_with(p, '/Script/') AND NOT regexp_matches(p, '/(Plugins|Content|Source)/')))), ' ') AS refs FROM pages""")
def _extract_all_refs(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", F.array_join(P.extract_all_refs(F.col("html"), F.lit("")), " ").alias("refs"))


JSON = "'{{\"_type\":\"GameplayTagContainer\",\"tags\":[\"Event.' || event_type || '\",\"None\"],\"asset\":\"/Game/Users/U_' || CAST(user_id AS STRING) || '\"}}'".replace("{{", "{").replace("}}", "}")


def _events_json(spark, d):
    spark.read.parquet(f"{d}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(f"SELECT user_id, event_type, {JSON} AS json FROM events")


@query("collect_refs", "SELECT user_id, '/Game/Users/U_' || CAST(user_id AS STRING) AS refs FROM events")
def _collect_refs(spark, d):
    return _events_json(spark, d).select("user_id", F.array_join(X.collect_refs(F.col("json")), " ").alias("refs"))


@query("collect_tags", "SELECT user_id, 'Event.' || event_type AS tags FROM events")
def _collect_tags(spark, d):
    return _events_json(spark, d).select("user_id", F.array_join(X.collect_tags(F.col("json")), " ").alias("tags"))


@query("class_name_candidates", with_views("v_assets") + """
  SELECT name, CASE WHEN regexp_matches(name, '^[UAFISET][A-Z]') THEN name ELSE array_to_string([name, 'U' || name, 'A' || name, 'F' || name, 'I' || name, 'S' || name, 'E' || name, 'T' || name], ' ') END AS candidates FROM v_assets""")
def _class_name_candidates(spark, d):
    return view(spark, d, "v_assets").select("name", F.array_join(P.class_name_candidates(F.concat("name", F.lit("_C"))), " ").alias("candidates"))


@query("snippet", with_views("v_docs") + " SELECT doc_id, substr(trim(regexp_replace(text, '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g')), 1, 180) AS snippet, CAST(floor(length(text) / 4.0) AS BIGINT) AS tokens FROM v_docs")
def _snippet(spark, d):
    return view(spark, d, "v_docs").select("doc_id", X.snippet(F.col("text")).alias("snippet"), X.estimate_tokens(F.col("text")).alias("tokens"))


def _old_and_new(spark, d):
    docs = view(spark, d, "v_docs").select("doc_id", "path", "text", "n")
    old = docs.filter("n % 3 <> 0")
    new = docs.filter("n % 2 = 0").withColumn("text", F.when(F.col("n") % 4 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    return old, new


@query("upsert_docs", with_views("v_docs") + """ SELECT doc_id, CASE WHEN n % 2 <> 0 THEN 'kept' WHEN n % 3 = 0 THEN 'inserted' WHEN n % 4 = 0 THEN 'replaced' ELSE 'unchanged' END AS action,
    CAST(length(text) + CASE WHEN n % 4 = 0 THEN 5 ELSE 0 END AS BIGINT) AS n_chars FROM v_docs WHERE n % 2 = 0 OR n % 3 <> 0""")
def _upsert_docs(spark, d):
    return U.upsert_docs(*_old_and_new(spark, d)).select("doc_id", "action", F.length("text").cast("long").alias("n_chars"))


@query("upsert_stats", with_views("v_docs") + """, a AS (SELECT CASE WHEN n % 2 <> 0 THEN 'kept' WHEN n % 3 = 0 THEN 'inserted' WHEN n % 4 = 0 THEN 'replaced' ELSE 'unchanged' END AS action FROM v_docs WHERE n % 2 = 0 OR n % 3 <> 0)
  SELECT action, count(*) AS n FROM a GROUP BY action""")
def _upsert_stats(spark, d):
    return U.upsert_stats(U.upsert_docs(*_old_and_new(spark, d)))


def _changed_tags(spark, d):
    tags = view(spark, d, "v_tags")
    return tags, tags.filter(F.col("path").endswith("1")).withColumn("tag", F.concat("tag", F.lit(".New")))


@query("upsert_tags", with_views("v_tags") + " SELECT path, tag || CASE WHEN path LIKE '%1' THEN '.New' ELSE '' END AS tag FROM v_tags")
def _upsert_tags(spark, d):
    return U.upsert_tags(*_changed_tags(spark, d))


@query("replace_tags", with_views("v_tags") + " SELECT path, tag || CASE WHEN path LIKE '%1' THEN '.New' ELSE '' END AS tag FROM v_tags WHERE path NOT LIKE '%2'")
def _replace_tags(spark, d):
    tags, new = _changed_tags(spark, d)
    return U.replace_tags(tags, new, tags.filter(F.col("path").rlike("[12]$")).select("path"))


@query("detect_changes", with_views("v_snapshot", "v_file_meta") + """ SELECT s.path, CASE WHEN m.path IS NULL THEN 'new' WHEN abs(s.mtime - m.mtime) < 0.001 AND s.size = m.size THEN 'unchanged' ELSE 'changed' END AS status
  FROM v_snapshot s LEFT JOIN v_file_meta m ON m.path = s.path""")
def _detect_changes(spark, d):
    return U.detect_changes(view(spark, d, "v_snapshot"), view(spark, d, "v_file_meta"))


@query("vanished_paths", with_views("v_snapshot", "v_file_meta") + " SELECT m.path FROM v_file_meta m WHERE NOT EXISTS (SELECT 1 FROM v_snapshot s WHERE s.path = m.path)")
def _vanished_paths(spark, d):
    return U.vanished_paths(view(spark, d, "v_snapshot"), view(spark, d, "v_file_meta"))


@query("docs_needing_embedding", with_views("v_docs") + " SELECT doc_id FROM v_docs WHERE (n % 3 = 0 AND length(text) > 20) OR n % 3 = 1")
def _docs_needing_embedding(spark, d):
    docs = view(spark, d, "v_docs")
    emb = docs.filter("n % 3 <> 0").select("doc_id", F.lit("m").alias("embed_model"), F.when(F.col("n") % 3 == 1, "1").otherwise("2").alias("embed_version"))
    return U.docs_needing_embedding(docs, emb, "m", "2")


@query("promote_to_semantic", with_views("v_light") + " SELECT path, unnest(['light', 'ref']) AS what FROM v_light WHERE o_orderkey % 5 <> 0")
def _promote(spark, d):
    light = view(spark, d, "v_light")
    refs = light.select(F.col("path").alias("asset_path"), "name")
    stays, of = U.promote_to_semantic(light, refs, light.filter("o_orderkey % 5 = 0"))
    return stays.select("path", F.lit("light").alias("what")).union(of.select("asset_path", F.lit("ref")))


@query("get_docs", with_views("v_docs") + " SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM v_docs WHERE n % 20 = 0")
def _get_docs(spark, d):
    docs = view(spark, d, "v_docs")
    return U.get_docs(docs, docs.filter("n % 20 = 0").select("doc_id")).select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query("delete_docs", with_views("v_inherits", "v_assets") + " SELECT from_id, to_id FROM v_inherits e JOIN v_assets a ON e.from_id = 'asset:' || a.path WHERE a.id % 6 <> 0")
def _delete_docs(spark, d):
    docs = view(spark, d, "v_assets").select(F.concat(F.lit("asset:"), "path").alias("doc_id"), "path", "id")
    tags = docs.select("path", F.lit("T").alias("tag"))
    return U.delete_docs(docs, view(spark, d, "v_inherits"), tags, docs.filter("id % 6 = 0"))[1].select("from_id", "to_id")


@query("index_status", with_views("v_docs", "v_light", "v_inherits", "v_assets") + """ SELECT 'docs' AS metric, type AS key, count(*) AS value FROM v_docs GROUP BY type UNION ALL SELECT 'light', asset_type, count(*) FROM v_light GROUP BY asset_type UNION ALL SELECT 'total_docs', '', count(*) FROM v_docs UNION ALL SELECT 'total_light', '', count(*) FROM v_light
  UNION ALL SELECT 'edges', '', count(*) FROM v_inherits UNION ALL SELECT 'classes', '', count(*) FROM v_assets UNION ALL SELECT 'last_indexed', max('2026-01-' || lpad(CAST(1 + n % 28 AS VARCHAR), 2, '0')), 1 FROM v_docs UNION ALL SELECT 'embed_model', 'm1', 1""")
def _index_status(spark, d):
    docs, *others = [view(spark, d, v) for v in ("v_docs", "v_light", "v_inherits", "v_assets")]
    day = F.concat(F.lit("2026-01-"), F.lpad((1 + F.col("n") % 28).cast("string"), 2, "0"))
    return R.index_status(docs.withColumn("indexed_at", day).withColumn("embed_model", F.when(F.col("n") % 2 == 0, "m1")), *others)


@query("type_distribution", with_views("v_assets") + f""", t AS (SELECT {RECLASSIFIED} AS asset_type FROM v_assets)
  SELECT asset_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM t), 6) AS percent, asset_type IN ({", ".join(f"'{t}'" for t in SEMANTIC_TYPES)}) AS semantic,
    round(count(*) / CASE WHEN asset_type IN ({", ".join(f"'{t}'" for t in SEMANTIC_TYPES)}) THEN CAST(2.0 AS DOUBLE) ELSE CAST(50.0 AS DOUBLE) END, 6) AS seconds FROM t GROUP BY asset_type""")
def _type_distribution(spark, d):
    return R.type_distribution(_reclassified(spark, d))


@query("tag_stats", with_views("v_tags") + " SELECT tag, count(DISTINCT path) AS n FROM v_tags WHERE tag ILIKE 'event.c%' GROUP BY tag ORDER BY n DESC, tag LIMIT 20")
def _tag_stats(spark, d):
    return R.tag_stats(view(spark, d, "v_tags"), prefix="event.c", limit=20)


@query("tag_level_stats", with_views("v_tags") + """, l AS (SELECT path, 1 AS level, split_part(tag, '.', 1) AS tag FROM v_tags UNION ALL SELECT path, 2, split_part(tag, '.', 1) || '.' || split_part(tag, '.', 2) FROM v_tags UNION ALL SELECT path, 3, tag FROM v_tags)
  SELECT CAST(level AS INTEGER) AS level, tag, count(DISTINCT path) AS n FROM l GROUP BY level, tag""")
def _tag_level_stats(spark, d):
    return R.tag_level_stats(view(spark, d, "v_tags"))


@query("folder_counts", with_views("v_assets") + " SELECT split_part(path, '/', 3) AS subfolder, count(*) AS n FROM v_assets GROUP BY 1")
def _folder_counts(spark, d):
    return R.folder_counts(view(spark, d, "v_assets"), "/Game")


@query("list_assets", with_views("v_assets", "v_light") + " SELECT path, name, (SELECT count(*) FROM v_light) AS undecided FROM v_assets WHERE starts_with(name, 'M_')")
def _list_assets(spark, d):
    every = view(spark, d, "v_assets").select("path", "name").union(view(spark, d, "v_light").select("path", "name"))
    guess = C.guess_type(F.col("name"), F.col("path"))
    return R.list_assets(every.withColumn("asset_type", F.nullif(guess, F.lit("Unknown"))), "/Game", "Material").select("path", "name", "undecided")


@query("paginate", with_views("v_assets") + " SELECT path, (SELECT count(*) FROM v_assets) AS total, (SELECT count(*) FROM v_assets) > 60 AS has_more FROM v_assets ORDER BY path LIMIT 40 OFFSET 20")
def _paginate(spark, d):
    return R.paginate(view(spark, d, "v_assets").select("path"), ["path"], limit=40, offset=20)


@query("profile_data_table", """WITH r AS (SELECT p_brand AS tbl, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, p_type FROM part)
  SELECT tbl, arg_min(p_type, p_partkey) AS struct, count(*) AS row_count, 'Size:' || CAST(min(p_partkey) AS VARCHAR) AS columns, string_agg(CASE WHEN k <= 10 THEN CAST(p_partkey AS VARCHAR) END, ',' ORDER BY p_partkey) AS sample_keys FROM r GROUP BY tbl""")
def _profile_data_table(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("tbl"), F.col("p_type").alias("struct"), F.col("p_partkey").alias("row_key"), F.concat(F.lit("Size:"), F.col("p_partkey").cast("string")).alias("columns"))
    return R.profile_data_table(rows)
