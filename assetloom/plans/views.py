"""Catalog tables derived from the given tables, in SQL that runs in Spark and in DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAME = """CASE p_type WHEN 'ECONOMY' THEN 'BP_' WHEN 'SMALL' THEN 'WBP_' WHEN 'MEDIUM' THEN 'DT_'
  WHEN 'PROMO' THEN 'M_' WHEN 'STANDARD' THEN 'MI_' ELSE 'GE_' END || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING)"""

VIEWS = {
    "v_assets": f"""SELECT p_partkey AS id, {NAME} AS name, '/Game/' || replace(p_brand, '#', '') || '/' || {NAME} AS path,
  p_type AS raw_type, CAST(p_size AS BIGINT) AS size FROM part""",
    "v_inherits": """SELECT 'asset:' || c.path AS from_id, 'asset:' || p.path AS to_id, 'inherits_from' AS edge_type
  FROM v_assets c JOIN v_assets p ON p.id = CAST(floor((c.id - 1) / 8.0) AS BIGINT) WHERE c.id > 0""",
    "v_asset_docs": "SELECT 'asset:' || path AS doc_id, 'asset_summary' AS type, path, name, raw_type AS asset_type FROM v_assets",
    "v_light": """SELECT '/Game/__ExternalActors__/L_' || CAST(o_custkey % 20 AS STRING) || '/OBJ_' || CAST(o_orderkey AS STRING) AS path,
  'OBJ_' || CAST(o_orderkey AS STRING) AS name, 'Unknown' AS asset_type, o_orderkey FROM orders""",
    "v_light_refs": """SELECT DISTINCT l.path AS asset_path, a.path AS ref_path FROM lineitem i
  JOIN v_light l ON l.o_orderkey = i.l_orderkey JOIN v_assets a ON a.id = i.l_partkey""",
    "v_tags": """SELECT DISTINCT '/Game/Users/U_' || CAST(user_id AS STRING) AS path,
  'Event.' || event_type || '.K' || regexp_extract(props, '[0-9]+', 0) AS tag FROM events""",
    "v_docs": """SELECT 'asset:/Game/' || source || '/D_' || CAST(doc_id AS STRING) AS doc_id, 'asset_summary' AS type,
  '/Game/' || source || '/D_' || CAST(doc_id AS STRING) AS path, 'D_' || CAST(doc_id AS STRING) AS name,
  source AS module, lang AS asset_type, text, doc_id AS n FROM documents""",
    "v_snapshot": """SELECT path, size + CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS size,
  CAST(1700000000.0 + id + CASE WHEN id % 7 = 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS mtime FROM v_assets WHERE id % 17 <> 0""",
    "v_file_meta": "SELECT path, size, CAST(1700000000.0 + id AS DOUBLE) AS mtime FROM v_assets WHERE id % 13 <> 0",
    "v_instr": """SELECT l_orderkey AS fn, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'JumpIfNot' WHEN l_returnflag = 'R' THEN 'Jump'
  WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'Switch' WHEN l_returnflag = 'A' THEN 'Return' ELSE 'Let' END AS op,
  CAST(l_partkey % 8 AS BIGINT) AS target FROM lineitem""",
    "v_headers": """SELECT 'Source/Game/M' || CAST(id % 5 AS STRING) || '/F_' || CAST(id AS STRING) || '.h' AS path,
  '// class UCommented' || CAST(id AS STRING) || chr(10) || 'UCLASS(Meta=(X))' || chr(10) || 'class GAME_API U' || name || ' : public AActor'
  || chr(10) || '{' || chr(10) || 'UPROPERTY(EditAnywhere)' || chr(10) || 'float Size = ' || CAST(size AS STRING) || ';' || chr(10) || '};' AS text, id, name FROM v_assets""",
    "v_query": """SELECT item_id AS query_id, text AS query, CASE WHEN item_id % 3 = 0 THEN '/game/web' END AS filter_path_prefix, CASE WHEN item_id % 5 = 0 THEN 'EN' END AS filter_asset_type FROM benchmark
  UNION ALL SELECT 1000000 + n, CASE n % 3 WHEN 0 THEN path WHEN 1 THEN name ELSE 'of ' || path || ' ' || lower(name) END, NULL, NULL FROM v_docs WHERE n % 20 = 0""",
    "v_targets": "SELECT id AS query_id, path, name FROM v_assets WHERE id % 20 = 0",
}
TABLES = ["part", "orders", "lineitem", "events", "documents", "benchmark", "embeddings", "pages"]


def with_views(*wanted: str) -> str:
    """The WITH clause of the wanted views and of those that they read."""
    need: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS:
            if other != name and other in VIEWS[name].replace(",", " ").split() and other not in need:
                add(other)
        if name not in need:
            need.append(name)

    for w in wanted:
        add(w)
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in need)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table."""
    sql = with_views(name)
    for t in TABLES:
        if t in sql.replace(")", " ").replace(",", " ").split():
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(f"{sql} SELECT * FROM {name}")
