"""Queries on references, inheritance, search and code."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetloom.operators import code as K
from assetloom.operators import graph as G
from assetloom.operators import hybrid as H
from assetloom.operators import lookup as L
from assetloom.operators import search_text as S
from assetloom.operators import upsert as U
from assetloom.operators import vector as V
from assetloom.plans.views import VIEWS, view, with_views
from assetloom.sources.scratch import stored

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def views(spark, d, *names):
    return [view(spark, d, n) for n in names]


def ref_docs(spark, d):
    """Assets as documents whose references are their parents, typed, and those of light assets, untyped."""
    up = view(spark, d, "v_inherits").select(F.col("from_id").alias("doc_id"), F.regexp_replace("to_id", "^asset:", "").alias("ref"), F.lit("inherits_from").alias("kind"))
    down = view(spark, d, "v_light_refs").select(F.concat(F.lit("asset:"), "asset_path").alias("doc_id"), F.col("ref_path").alias("ref"), F.lit(None).cast("string").alias("kind"))
    typed = F.map_from_entries(F.filter(F.collect_list(F.struct("ref", "kind")), lambda x: x["kind"].isNotNull()))
    return up.union(down).groupBy("doc_id").agg(F.collect_list("ref").alias("references_out"), typed.alias("typed_references_out"))


EDGES = "SELECT from_id, to_id, edge_type FROM v_inherits UNION SELECT 'asset:' || asset_path, 'asset:' || ref_path, 'uses_asset' FROM v_light_refs"


@query("build_edges", with_views("v_inherits", "v_light_refs") + " " + EDGES)
def _build_edges(spark, d):
    return U.build_edges(ref_docs(spark, d))


@query("normalize_refs", with_views("v_light_refs") + " SELECT asset_path, ref_path FROM v_light_refs")
def _normalize_refs(spark, d):
    light = view(spark, d, "v_light_refs").groupBy(F.col("asset_path").alias("path")).agg(F.concat(F.collect_list("ref_path"), F.collect_list("ref_path")).alias("references"))
    return U.normalize_refs(light)


@query("upsert_lightweight", with_views("v_light_refs") + " SELECT asset_path, CASE WHEN asset_path LIKE '%7' THEN '/Game/New' ELSE ref_path END AS ref_path FROM v_light_refs GROUP BY 1, 2")
def _upsert_lightweight(spark, d):
    refs = view(spark, d, "v_light_refs")
    new = refs.filter("asset_path like '%7'").groupBy(F.col("asset_path").alias("path")).agg(F.array(F.lit("/Game/New")).alias("references"))
    return U.upsert_lightweight(refs, new)


@query("deep_refs", with_views("v_assets") + " SELECT path AS asset_path, '/Game/Deep/' || name AS ref_path FROM v_assets WHERE id % 3 = 0 UNION SELECT path, '/Game/Light/X' FROM v_assets WHERE id % 3 = 0")
def _deep_refs(spark, d):
    files = view(spark, d, "v_assets").select("path", "name", F.lit("Unknown").alias("asset_type"), F.array(F.when(F.col("id") % 3 == 0, "DataRegistry").otherwise("Actor")).alias("export_classes"), F.concat(F.lit('{"a":"/Game/Deep/'), "name", F.lit('","b":"/Script/X/Y"}')).alias("json"), F.array(F.lit("/Game/Light/X")).alias("references"))
    return U.deep_refs(files, classes=["DataRegistry"], prefixes=[])


@query("resolve_parents", with_views("v_assets") + """ SELECT id, CASE id % 5 WHEN 0 THEN 'asset:' || path WHEN 1 THEN 'class:' || name WHEN 2 THEN 'class:Actor' WHEN 3 THEN NULL ELSE 'asset:' || path END AS parent_ref FROM v_assets""")
def _resolve_parents(spark, d):
    a, n = view(spark, d, "v_assets"), F.col("id") % 5
    df = a.select("id", F.when(n == 0, F.concat("name", F.lit("_C"))).when(n == 1, F.concat(F.lit("/Script/Game."), "name")).when(n == 2, "Actor").when(n == 3, "Unknown").otherwise(F.concat("path", F.lit("."), "name", F.lit("_C"))).alias("parent"))
    return U.resolve_parents(df, a.filter("id % 2 = 0"), a.filter("id % 2 = 1"), ["Actor"]).select("id", "parent_ref")


@query("where_used", with_views("v_targets", "v_light_refs", "v_inherits", "v_asset_docs") + """, u AS (SELECT t.query_id, r.asset_path AS user_path, 0 AS source FROM v_targets t JOIN v_light_refs r ON r.ref_path = t.path
    UNION ALL SELECT t.query_id, d.path, 1 FROM v_targets t JOIN v_inherits e ON e.to_id = 'asset:' || t.path JOIN v_asset_docs d ON d.doc_id = e.from_id),
  o AS (SELECT query_id, user_path, min(source) AS source FROM u GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source, user_path) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM o)
  SELECT query_id, user_path, source, rank, total FROM r WHERE rank <= 50""")
def _where_used(spark, d):
    return G.where_used(*views(spark, d, "v_targets", "v_light_refs", "v_inherits", "v_asset_docs"))


@query("level_contents", with_views("v_light", "v_light_refs") + """ SELECT split_part(l.path, '/', 4) AS level, l.path, l.name, min(r.ref_path) AS source FROM v_light l LEFT JOIN v_light_refs r ON r.asset_path = l.path
  WHERE split_part(l.path, '/', 4) <> 'L_3' GROUP BY 1, 2, 3""")
def _level_contents(spark, d):
    light, refs = views(spark, d, "v_light", "v_light_refs")
    levels = light.select(F.split("path", "/")[3].alias("level")).filter("level <> 'L_3'")
    return G.level_contents(light, refs, levels)


@query("descendants", "WITH RECURSIVE " + with_views("v_inherits", "v_asset_docs")[5:] + """, r AS (SELECT to_id AS seed, from_id AS doc_id, 1 AS depth FROM v_inherits UNION SELECT r.seed, e.from_id, r.depth + 1 FROM r JOIN v_inherits e ON e.to_id = r.doc_id WHERE r.depth < 4)
  SELECT r.seed, r.doc_id, d.path, d.name, r.depth FROM r JOIN v_asset_docs d ON d.doc_id = r.doc_id""")
def _descendants(spark, d):
    edges, docs = views(spark, d, "v_inherits", "v_asset_docs")
    return G.descendants(docs.select(F.col("doc_id").alias("seed"), F.col("doc_id").alias("node_id")), edges, docs)


@query("expand_refs", "WITH RECURSIVE " + with_views("v_inherits", "v_targets")[5:] + """, b AS (SELECT from_id, to_id FROM v_inherits UNION SELECT to_id, from_id FROM v_inherits),
  r AS (SELECT query_id AS seed, 'asset:' || path AS node_id, 0 AS depth FROM v_targets UNION SELECT r.seed, b.to_id, r.depth + 1 FROM r JOIN b ON b.from_id = r.node_id WHERE r.depth < 2),
  m AS (SELECT seed, node_id, min(depth) AS depth FROM r GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node_id) AS k FROM m)
  SELECT seed, node_id, depth FROM k WHERE k <= 40""")
def _expand_refs(spark, d):
    edges, t = views(spark, d, "v_inherits", "v_targets")
    return G.expand_refs(t.select(F.col("query_id").alias("seed"), F.concat(F.lit("asset:"), "path").alias("node_id")), edges, direction="both", depth=2, max_nodes=40)


@query("expand_refs_of_type", "WITH RECURSIVE " + with_views("v_inherits", "v_targets", "v_asset_docs")[5:] + """, r AS (SELECT query_id AS seed, 'asset:' || path AS node_id, 0 AS depth FROM v_targets UNION SELECT r.seed, e.from_id, r.depth + 1 FROM r JOIN v_inherits e ON e.to_id = r.node_id WHERE r.depth < 2),
  m AS (SELECT seed, node_id, min(depth) AS depth FROM r GROUP BY 1, 2) SELECT seed, node_id, m.depth FROM m JOIN v_asset_docs d ON d.doc_id = m.node_id WHERE m.depth = 0 OR d.asset_type IN ('ECONOMY', 'PROMO')""")
def _expand_refs_of_type(spark, d):
    edges, t, docs = views(spark, d, "v_inherits", "v_targets", "v_asset_docs")
    seeds = t.select(F.col("query_id").alias("seed"), F.concat(F.lit("asset:"), "path").alias("node_id"))
    return G.expand_refs(seeds, edges, direction="reverse", depth=2, docs=docs.select("doc_id", F.col("asset_type").alias("type")), types=["ECONOMY", "PROMO"])


# the types of assets as the catalog names them; every third asset maps or uses another, every seventh a script
TYPED_DOCS = "SELECT doc_id, type, path, name, CASE asset_type WHEN 'ECONOMY' THEN 'Blueprint' WHEN 'PROMO' THEN 'Material' WHEN 'SMALL' THEN 'GameFeatureData' ELSE 'Other' END AS asset_type FROM v_asset_docs"
MORE_EDGES = """SELECT from_id, to_id, edge_type FROM v_inherits UNION ALL SELECT 'asset:' || a.path, 'asset:' || b.path, CASE WHEN a.id % 2 = 0 THEN 'maps_input' ELSE 'uses_asset' END FROM v_assets a JOIN v_assets b ON b.id = a.id + 11 WHERE a.id % 3 = 0
  UNION ALL SELECT 'asset:' || a.path, 'asset:' || b.path, 'uses_asset' FROM v_assets a JOIN v_assets b ON b.id = a.id + 5 UNION ALL SELECT 'asset:' || path, 'script:/Script/M.' || name, 'uses_asset' FROM v_assets WHERE id % 7 = 0"""
OWNERS = """w AS (SELECT substr(e.to_id, 7) AS below, d.path AS owner, d.name AS owner_name, CASE WHEN d.asset_type IN ('Blueprint', 'GameFeatureData') THEN 10 ELSE 0 END + CASE WHEN d.asset_type = 'GameFeatureData' THEN 5 ELSE 0 END AS w FROM ed e JOIN dd d ON d.doc_id = e.from_id WHERE e.to_id LIKE 'asset:%'
    UNION SELECT r.ref_path, r.asset_path, l.name, 0 FROM v_light_refs r JOIN v_light l ON l.path = r.asset_path),
  o AS (SELECT t.path, 0 AS n, t.path AS top, [t.path] AS seen, t.name AS chain FROM v_targets t UNION ALL
    SELECT path, n, top, seen, chain FROM (SELECT o.path, o.n + 1 AS n, w.owner AS top, list_append(o.seen, w.owner) AS seen, w.owner_name || ' -> ' || o.chain AS chain, row_number() OVER (PARTITION BY o.path ORDER BY w.w DESC, w.owner) AS k FROM o JOIN w ON w.below = o.top WHERE o.n < 4 AND NOT list_contains(o.seen, w.owner)) WHERE k = 1),
  oc AS (SELECT path, arg_max(chain, n) AS chain, max(n) AS n FROM o GROUP BY path)"""
OWNED = "WITH RECURSIVE " + with_views("v_inherits", "v_assets", "v_targets", "v_asset_docs", "v_light", "v_light_refs")[5:] + f", ed AS ({MORE_EDGES}), dd AS ({TYPED_DOCS}), {OWNERS}"


def _graph(spark, d):
    """Edges and documents of the above."""
    for v in ("v_inherits", "v_assets", "v_asset_docs"):
        view(spark, d, v).createOrReplaceTempView(v)
    return spark.sql(MORE_EDGES), spark.sql(TYPED_DOCS)


@query("ownership_chain", OWNED + " SELECT path, chain FROM oc")
def _ownership_chain(spark, d):
    t, light, refs = views(spark, d, "v_targets", "v_light", "v_light_refs")
    return G.ownership_chain(t, *_graph(spark, d), light=light, refs=refs)


@query("system_trace", OWNED + """, x AS (
    SELECT t.query_id, CASE WHEN e.edge_type <> 'uses_asset' OR d.asset_type IN ('Blueprint', 'GameFeatureData') OR (d.asset_type = 'Other' AND regexp_matches(upper(d.name), '^(B|BP|W|WBP|DA|DT|GE|GA|GCN)_')) THEN 'structural' ELSE 'visual' END AS section, d.path, e.edge_type, 'deps' AS l FROM v_targets t JOIN ed e ON e.from_id = 'asset:' || t.path JOIN dd d ON d.doc_id = e.to_id WHERE d.path <> t.path
    UNION ALL SELECT t.query_id, 'inbound', d.path, e.edge_type, 'in' FROM v_targets t JOIN ed e ON e.to_id = 'asset:' || t.path JOIN dd d ON d.doc_id = e.from_id
    UNION ALL SELECT t.query_id, 'inbound', r.asset_path, 'light', 'in' FROM v_targets t JOIN v_light_refs r ON r.ref_path = t.path
    UNION ALL SELECT t.query_id, 'script', substr(e.to_id, 8), 'script', 'script' FROM v_targets t JOIN ed e ON e.from_id = 'asset:' || t.path WHERE e.to_id LIKE 'script:%'),
  y AS (SELECT *, CAST(CASE WHEN section = 'script' THEN 0 WHEN edge_type = 'light' THEN 1.6 WHEN section = 'inbound' THEN 1.7 WHEN edge_type = 'maps_input' THEN 1.8 WHEN edge_type = 'inherits_from' THEN 1.5 WHEN section = 'structural' THEN 1.8 ELSE 1.0 END AS DOUBLE) AS score,
    CASE WHEN section = 'script' THEN 'unresolved' WHEN edge_type NOT IN ('uses_asset', 'light') THEN edge_type WHEN section = 'inbound' THEN 'inbound_ref' ELSE section || '_dependency' END AS relationship FROM x),
  z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, l, path ORDER BY score DESC, section, relationship) AS one FROM y) WHERE one = 1),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id, section ORDER BY score DESC, path) AS rank FROM z)
  SELECT query_id, section, path, relationship, score, rank FROM k WHERE rank <= 12 UNION ALL SELECT query_id, 'ownership_chain', chain, 'owners', 0.0::DOUBLE, 1 FROM oc JOIN v_targets USING (path) WHERE n > 0""")
def _system_trace(spark, d):
    t, light, refs = views(spark, d, "v_targets", "v_light", "v_light_refs")
    return G.system_trace(t, *_graph(spark, d), refs, light)


TREE = "SELECT CAST(floor(id / 100.0) AS BIGINT) AS tree, id AS node, CASE WHEN id % 100 < 3 THEN NULL ELSE CAST(floor(id / 100.0) * 100 + floor((id % 100 - 1) / 8.0) AS BIGINT) END AS parent, name, raw_type AS type FROM v_assets"


@query("build_tree", "WITH RECURSIVE " + with_views("v_assets")[5:] + f""", n AS (SELECT tree, node, parent, type || '(' || name || ')' AS label FROM ({TREE})), r AS (SELECT tree, node, node AS root, label, 0 AS depth, lpad(CAST(node AS VARCHAR), 20, '0') AS position FROM n WHERE parent IS NULL
  UNION ALL SELECT n.tree, n.node, r.root, n.label, r.depth + 1, r.position || '/' || lpad(CAST(n.node AS VARCHAR), 20, '0') FROM n JOIN r ON n.parent = r.node AND n.tree = r.tree)
  SELECT tree, node, root, label, depth, position, repeat('  ', depth) || label AS text FROM r""")
def _build_tree(spark, d):
    view(spark, d, "v_assets").createOrReplaceTempView("v_assets")
    # every hundredth widget has no slot at all
    t = spark.sql(TREE).withColumn("slot", F.when(F.col("node") % 100 != 0, F.col("node") + 10))
    return G.build_tree(G.slot_nodes(t.select("tree", "node", "name", "type", "slot"), t.filter("slot is not null").select("tree", "slot", "parent")))


@query("compact_graph", "WITH RECURSIVE " + with_views("v_assets")[5:] + """, n AS (SELECT CAST(floor(id / 100.0) AS BIGINT) AS graph, id, raw_type AS kind, '$' || name AS inline, CAST(floor(id / 100.0) * 100 + floor((id % 100 - 1) / 8.0) AS BIGINT) AS up FROM v_assets),
  l AS (SELECT c.graph, c.up AS s, c.id AS t FROM n c JOIN n p ON c.up = p.id WHERE c.id % 100 > 0),
  r AS (SELECT s, t FROM l WHERE s % 5 <> 2 UNION SELECT r.s, l.t FROM r JOIN l ON l.s = r.t WHERE r.t % 5 = 2),
  x AS (SELECT s, t FROM r WHERE t % 5 <> 2),
  kept AS (SELECT *, 'N' || row_number() OVER (PARTITION BY graph ORDER BY id) AS short FROM n WHERE id % 5 <> 2 AND id % 11 <> 3 AND (id IN (SELECT s FROM l) OR id IN (SELECT t FROM l))),
  e AS (SELECT s AS node, 'out' AS pin, t AS other, ':in' AS tail FROM x UNION ALL SELECT t, 'in', s, ':out' FROM x),
  o AS (SELECT e.node, e.pin, string_agg(CASE WHEN e.other % 11 = 3 THEN n.inline ELSE k.short || e.tail END, ',' ORDER BY CASE WHEN e.other % 11 = 3 THEN n.inline ELSE k.short || e.tail END) AS ends FROM e JOIN n ON n.id = e.other LEFT JOIN kept k ON k.id = e.other GROUP BY ALL),
  p AS (SELECT t AS node, 'in' AS pin, 'in' AS direction, CAST(NULL AS VARCHAR) AS default_ FROM l UNION ALL SELECT DISTINCT s, 'out', 'out', CAST(NULL AS VARCHAR) FROM l WHERE s % 13 <> 0 UNION ALL SELECT id, 'value', 'in', '7' FROM n WHERE id % 3 = 0)
  SELECT k.graph, k.short, k.id AS node, k.kind, p.pin, p.direction, p.default_ AS default_value, coalesce(o.ends, '') AS ends FROM kept k LEFT JOIN p ON p.node = k.id LEFT JOIN o ON o.node = p.node AND o.pin = p.pin""")
def _compact_graph(spark, d):
    a = view(spark, d, "v_assets")
    n = a.select(F.floor(F.col("id") / 100).alias("graph"), F.col("id").alias("node"), F.col("raw_type").alias("kind"), (F.col("id") % 5 == 2).alias("passes"), F.when(F.col("id") % 11 == 3, F.concat(F.lit("$"), "name")).alias("inline"))
    pin = lambda name, way, default, orphaned: F.struct(F.lit(name).alias("pin"), F.lit(way).alias("direction"), default.alias("default"), F.lit(name == "secret").alias("hidden"), orphaned.alias("orphaned"))
    none, no = F.lit(None).cast("string"), F.lit(False)
    value = F.when(F.col("node") % 3 == 0, "7").when(F.col("node") % 3 == 1, " ")
    p = n.select("graph", "node", F.inline(F.array(pin("in", "in", none, no), pin("out", "out", none, F.col("node") % 13 == 0), pin("self", "in", F.lit("x"), no), pin("value", "in", value, no), pin("secret", "in", F.lit("x"), no))))
    up = (F.floor(F.col("node") / 100) * 100 + F.floor((F.col("node") % 100 - 1) / 8)).alias("source")
    links = n.filter("node % 100 > 0").select("graph", up, F.lit("out").alias("source_pin"), F.col("node").alias("target"), F.lit("in").alias("target_pin"))
    links = links.join(n.select("graph", F.col("node").alias("source")), ["graph", "source"], "left_semi")
    return G.compact_graph(n, p, links).select("graph", "short", "node", "kind", "pin", "direction", F.col("default").alias("default_value"), F.array_join("to", ",").alias("ends"))


@query("contract_graph", "WITH RECURSIVE " + with_views("v_inherits", "v_assets")[5:] + """, l AS (SELECT p.id AS source, c.id AS target FROM v_inherits e JOIN v_assets c ON e.from_id = 'asset:' || c.path JOIN v_assets p ON e.to_id = 'asset:' || p.path),
  r AS (SELECT source, target FROM l WHERE source % 5 <> 0 UNION SELECT r.source, l.target FROM r JOIN l ON l.source = r.target WHERE r.target % 5 = 0) SELECT source, target FROM r WHERE target % 5 <> 0""")
def _contract_graph(spark, d):
    a, e = views(spark, d, "v_assets", "v_inherits")
    ids = a.select(F.concat(F.lit("asset:"), "path").alias("k"), "id")
    links = e.join(ids.toDF("to_id", "source"), "to_id").join(ids.toDF("from_id", "target"), "from_id").select("source", "target")
    return G.contract_graph(a.select(F.col("id").alias("node"), (F.col("id") % 5 == 0).alias("passes")), links)


@query("delegate_bindings", """SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS owner, l_shipmode AS op, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_returnflag END AS target, CASE WHEN l_partkey % 2 = 0 THEN l_linestatus END AS function, 'o' AS object,
  CASE WHEN l_partkey % 2 = 0 AND l_partkey % 3 <> 0 THEN 'high' WHEN l_partkey % 2 = 0 OR l_partkey % 3 <> 0 THEN 'medium' ELSE 'low' END AS confidence FROM lineitem""".replace("l_shipmode", "l_linestatus"))
def _delegate_bindings(spark, d):
    p = F.col("l_partkey")
    obs = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").cast("string").alias("owner"), F.col("l_linestatus").alias("op"), F.when(p % 3 != 0, F.col("l_returnflag")).alias("target"), F.when(p % 2 == 0, F.col("l_linestatus")).alias("function"), F.lit("o").alias("object"))
    return G.delegate_bindings(obs)


@query("scan_classes", with_views("v_headers") + " SELECT 'U' || name AS class_name, min(path) AS source_path FROM v_headers GROUP BY 1")
def _scan_classes(spark, d):
    return K.scan_classes(view(spark, d, "v_headers"))


# defaults and parameters with brackets, commas and ends of statements in strings; bodies with braces
HEADERS = """SELECT id, name, 'Source/Game/F_' || CAST(id AS STRING) || '.h' AS path, '// class UCommented' || chr(10) || '#pragma once' || chr(10) || 'UCLASS(Meta=(X))' || chr(10) || 'class GAME_API U' || name || ' : public AActor' || chr(10) || '{' || chr(10)
  || 'UPROPERTY(EditAnywhere, Meta=(ClampMin="0", Note="a;b"))' || chr(10) || CASE id % 5 WHEN 0 THEN 'float Size = ' || CAST(size AS STRING) || ';' WHEN 1 THEN 'TMap<FName, int32> Size = {};' WHEN 2 THEN 'int32 Size{' || CAST(size AS STRING) || '};' WHEN 3 THEN 'FString Size = TEXT("x;{//y");' ELSE 'uint8 Size : 1;' END || chr(10)
  || 'UFUNCTION(BlueprintCallable' || CASE WHEN id % 2 = 0 THEN ', Category="A|(B"' ELSE '' END || ')' || chr(10) || CASE id % 4 WHEN 0 THEN 'virtual void Fire(int A, FString B = TEXT("x;y")) const override;' WHEN 1 THEN 'TArray<int> Fire(const TMap<FName, int>& M, int N = Max(1, 2)) const { return X; }' WHEN 2 THEN 'static void Fire();' ELSE 'virtual int* Fire(FName N) override' || chr(10) || '{ if (N) { return 0; } }' END || chr(10) || '};' AS text, size FROM v_assets"""


@query("scan_members", with_views("v_assets") + f""", h AS ({HEADERS})
  SELECT path, CAST(6 AS BIGINT) AS line, 'property' AS kind, 'Size' AS name, CASE id % 5 WHEN 0 THEN 'float' WHEN 1 THEN 'TMap<FName, int32>' WHEN 2 THEN 'int32' WHEN 3 THEN 'FString' ELSE 'uint8' END AS type, 'EditAnywhere, Meta=(ClampMin="0", Note="a;b")' AS specifiers, NULL AS params,
    CASE id % 5 WHEN 0 THEN CAST(size AS VARCHAR) WHEN 1 THEN '{{}}' WHEN 2 THEN '{{' || CAST(size AS VARCHAR) || '}}' WHEN 3 THEN 'TEXT("x;{{//y")' END AS default_value, false AS is_virtual, false AS is_const, false AS is_override, 'U' || name AS owner, 2 AS n_specifiers, -1 AS n_params FROM h
  UNION ALL SELECT path, 8, 'function', 'Fire', CASE id % 4 WHEN 1 THEN 'TArray<int>' WHEN 3 THEN 'int*' ELSE 'void' END, 'BlueprintCallable' || CASE WHEN id % 2 = 0 THEN ', Category="A|(B"' ELSE '' END, CASE id % 4 WHEN 0 THEN 'int A, FString B = TEXT("x;y")' WHEN 1 THEN 'const TMap<FName, int>& M, int N = Max(1, 2)' WHEN 2 THEN '' ELSE 'FName N' END,
    NULL, id % 4 IN (0, 3), id % 4 < 2, id % 4 IN (0, 3), 'U' || name, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END, CASE id % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END FROM h""")
def _scan_members(spark, d):
    view(spark, d, "v_assets").createOrReplaceTempView("v_assets")
    out = K.scan_members(spark.sql(HEADERS))
    return out.withColumns({"n_specifiers": F.size("specifier_list"), "n_params": F.coalesce(F.size("param_list"), F.lit(-1))}).drop("specifier_list", "param_list")


@query("resolve_classes", with_views("v_assets") + " SELECT name, 'U' || name AS class_name, min(path) AS source_path FROM v_assets WHERE NOT regexp_matches(name, '^[UAFISET][A-Z]') GROUP BY 1, 2")
def _resolve_classes(spark, d):
    a = view(spark, d, "v_assets")
    return K.resolve_classes(a.select("name"), a.groupBy(F.concat(F.lit("U"), "name").alias("class_name")).agg(F.min("path").alias("source_path")))


@query("control_flow_metrics", with_views("v_instr") + """, c AS (SELECT fn, count(*) FILTER (op = 'JumpIfNot') AS branches, count(*) FILTER (op = 'Switch') AS switches FROM v_instr GROUP BY fn)
  SELECT fn, branches, switches, branches + switches > 0 AS has_branches, CASE WHEN branches + switches = 0 THEN 'none' WHEN branches + switches <= 2 THEN 'low' WHEN branches + switches <= 5 THEN 'medium' ELSE 'high' END AS complexity FROM c""")
def _control_flow_metrics(spark, d):
    return K.control_flow_metrics(view(spark, d, "v_instr"))


CFG = with_views("v_instr") + """, e AS (SELECT *, max(pos) OVER (PARTITION BY fn) AS last_pos, lag(op) OVER (PARTITION BY fn ORDER BY pos) AS before FROM v_instr),
  j AS (SELECT fn, pos, target FROM e WHERE op IN ('Jump', 'JumpIfNot', 'Switch') AND target <= last_pos),
  s AS (SELECT e.fn, e.pos, e.op, CASE WHEN e.pos = 0 OR e.before IN ('Jump', 'JumpIfNot', 'Switch', 'Return') OR EXISTS (SELECT 1 FROM j WHERE j.fn = e.fn AND j.target = e.pos) THEN 1 ELSE 0 END AS s FROM e),
  b AS (SELECT fn, pos, op, CAST(sum(s) OVER (PARTITION BY fn ORDER BY pos) - 1 AS BIGINT) AS block FROM s),
  k AS (SELECT fn, block, min(pos) AS first, max(pos) AS last, arg_max(op, pos) AS op FROM b GROUP BY 1, 2),
  g AS (SELECT DISTINCT x.fn, x.block, y.block AS successor FROM j JOIN b x ON x.fn = j.fn AND x.pos = j.pos JOIN b y ON y.fn = j.fn AND y.pos = j.target
    UNION SELECT k.fn, k.block, k.block + 1 FROM k JOIN k n ON n.fn = k.fn AND n.block = k.block + 1 WHERE k.op NOT IN ('Jump', 'Return'))"""


@query("control_flow_blocks", CFG + " SELECT k.fn, k.block, k.first, k.last, EXISTS (SELECT 1 FROM g WHERE g.fn = k.fn AND g.successor = k.block AND g.successor <= g.block) AS loop_target FROM k")
def _control_flow_blocks(spark, d):
    return K.control_flow_graph(view(spark, d, "v_instr").withColumn("pos", F.col("pos").cast("long")))[0]


@query("control_flow_edges", CFG + " SELECT fn, block, successor FROM g")
def _control_flow_edges(spark, d):
    return K.control_flow_graph(view(spark, d, "v_instr").withColumn("pos", F.col("pos").cast("long")))[1]


TOKENS_OF = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"


@query("build_postings", with_views("v_docs") + ", c AS (" + " UNION ALL ".join(f"SELECT doc_id, {k} AS k, {w} AS w, {TOKENS_OF.format(c)} AS l FROM v_docs" for k, (c, w) in enumerate(S.WEIGHTS.items())) + """), t AS (SELECT doc_id, w, unnest(l) AS token, k * 1099511627776 + generate_subscripts(l, 1) - 1 AS place FROM c),
  n AS (SELECT doc_id, CAST(sum(len(l)) AS BIGINT) AS dl FROM c GROUP BY 1) SELECT token, doc_id, CAST(sum(w) AS DOUBLE) AS tf, string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) AS places, max(dl) AS dl FROM t JOIN n USING (doc_id) GROUP BY 1, 2""")
def _build_postings(spark, d):
    postings = S.build_postings(view(spark, d, "v_docs"))[0]
    return postings.select("token", "doc_id", "tf", F.array_join(F.col("at").cast("array<string>"), ",").alias("places"), "dl")


WORDS = "list_filter(regexp_split_to_array(query, '\\s+'), lambda x: x <> '')"
SEARCH = with_views("v_docs", "v_query") + f""", c AS (SELECT doc_id, 10.0::DOUBLE AS w, regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}]+') AS t FROM v_docs UNION ALL SELECT doc_id, 5.0, regexp_extract_all(lower(path), '[\\p{{L}}\\p{{N}}]+') FROM v_docs
    UNION ALL SELECT doc_id, 1.0, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') FROM v_docs),
  s AS (SELECT doc_id, w, ' ' || array_to_string(t, ' ') || ' ' AS s FROM c), dl AS (SELECT doc_id, sum(len(t)) AS dl FROM c GROUP BY 1 HAVING sum(len(t)) > 0), tot AS (SELECT count(*) AS nd, avg(dl) AS av FROM dl),
  qw AS (SELECT query_id, unnest({WORDS}) AS word FROM v_query),
  q AS (SELECT DISTINCT query_id, ' ' || array_to_string(regexp_extract_all(lower(word), '[\\p{{L}}\\p{{N}}]+'), ' ') || CASE WHEN regexp_matches(word, '^/(Game|Script)/') THEN ' ' ELSE '' END AS unit FROM qw WHERE length(array_to_string(regexp_extract_all(lower(word), '[\\p{{L}}\\p{{N}}]+'), '')) >= 2),
  u AS (SELECT DISTINCT unit FROM q),
  h AS (SELECT unit, doc_id, sum(w * ((length(s) - length(replace(s, unit, ''))) // length(unit))) AS tf FROM u JOIN s ON contains(s, unit) GROUP BY 1, 2),
  f AS (SELECT unit, count(*) AS df FROM h GROUP BY 1),
  p AS (SELECT unit, h.doc_id, greatest(ln((nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / av)) AS part FROM h JOIN f USING (unit) JOIN dl USING (doc_id), tot),
  b AS (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM q JOIN p USING (unit) GROUP BY 1, 2),
  ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b JOIN v_query USING (query_id) JOIN v_docs USING (doc_id)
    WHERE (filter_path_prefix IS NULL OR starts_with(lower(path), lower(filter_path_prefix))) AND (filter_asset_type IS NULL OR lower(asset_type) = lower(filter_asset_type)))"""


def _search(spark, d, k=10):
    return S.search_text(view(spark, d, "v_query"), stored(S.build_blocks(view(spark, d, "v_docs"))), k=k)


@query("search_text", SEARCH + " SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 10")
def _search_text(spark, d):
    return _search(spark, d)


NEAR = """n AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM n WHERE score >= 0)"""


def _near(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return V.search_vector(e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("doc_id"), "embedding"), k=10)


@query("search_vector", f"WITH {NEAR} SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10")
def _search_vector(spark, d):
    return _near(spark, d)


# every third query asks for a module, every fourth for a path's beginning, in its own case
FILTERED = "SELECT vec_id AS query_id, embedding, CASE WHEN vec_id % 3 = 0 THEN 'M' || CAST(label AS STRING) END AS filter_module, CASE WHEN vec_id % 80 = 20 THEN '/GAME/L' || CAST(label % 4 AS STRING) END AS filter_path_prefix FROM embeddings WHERE vec_id % 20 = 0"
VECTOR_DOCS = "SELECT vec_id AS doc_id, 'M' || CAST(vec_id % 10 AS STRING) AS module, CASE WHEN vec_id % 11 <> 0 THEN '/Game/L' || CAST(vec_id % 4 AS STRING) || '/V' END AS path FROM embeddings WHERE vec_id % 13 <> 0"


@query("search_vector_filtered", f"""WITH q AS ({FILTERED}), d AS ({VECTOR_DOCS}), n AS (SELECT query_id, doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM q, embeddings e JOIN d ON d.doc_id = e.vec_id
    WHERE (filter_module IS NULL OR filter_module = module) AND (filter_path_prefix IS NULL OR starts_with(lower(path), lower(filter_path_prefix)))),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM n WHERE score >= 0.1) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 7""")
def _search_vector_filtered(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    e.createOrReplaceTempView("embeddings")
    return V.search_vector(spark.sql(FILTERED), e.select(F.col("vec_id").alias("doc_id"), "embedding"), k=7, min_score=0.1, docs=spark.sql(VECTOR_DOCS))


@query("search_vector_index", "SELECT count(*) AS queries, 10 * count(*) AS found, true AS recalled FROM embeddings WHERE vec_id % 20 = 0")
def _search_vector_index(spark, d):
    """Whether the index finds at least nine in ten of the nearest that the exact search finds."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    asked, own = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("doc_id"), "embedding")
    exact = V.search_vector(asked, own, min_score=-1.0)
    found = V.search_vector_index(asked, V.build_vector_index(own), min_score=-1.0)
    both = exact.join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("found"), (F.count("hit") >= 0.9 * F.count("*")).alias("recalled"))


# documents are asked for by their paths and by the vectors of the same number, each query by its own plan
MODES = "CASE query_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'semantic' ELSE 'hybrid' END"


@query("search_hybrid", SEARCH + f""", {NEAR}, x AS (SELECT query_id - 1000000 AS query_id, doc_id, score, rank FROM ranked WHERE query_id >= 1000000 AND rank <= 10),
  v AS (SELECT query_id, d.doc_id, rank FROM r JOIN v_docs d ON d.n = r.doc_id WHERE rank <= 10), i AS (SELECT query_id FROM x UNION SELECT query_id FROM v),
  m AS (SELECT i.query_id, {MODES.replace("query_id", "i.query_id")} AS mode, count(x.doc_id) AS hits FROM i LEFT JOIN x ON x.query_id = i.query_id GROUP BY 1, 2),
  l AS (SELECT query_id, doc_id, rank FROM x JOIN m USING (query_id) WHERE (mode <> 'semantic' OR rank <= 5) AND NOT (mode = 'exact' AND hits >= 5)
    UNION ALL SELECT query_id, doc_id, rank FROM v JOIN m USING (query_id) WHERE NOT (mode = 'exact' AND hits >= 5) AND rank <= CASE WHEN mode = 'exact' THEN 10 - hits ELSE 10 END),
  fu AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (59 + rank)), 6) AS score FROM l GROUP BY 1, 2), fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fu)
  SELECT query_id, doc_id, score, rank FROM fr WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, score, rank FROM x JOIN m USING (query_id) WHERE mode = 'exact' AND hits >= 5""")
def _search_hybrid(spark, d):
    exact = _search(spark, d).filter("query_id >= 1000000").withColumn("query_id", F.col("query_id") - 1000000)
    ids = view(spark, d, "v_docs").select(F.col("n").alias("_n"), F.col("doc_id").alias("_id"))
    near = _near(spark, d).join(ids, F.col("doc_id") == F.col("_n")).select("query_id", F.col("_id").alias("doc_id"), "rank")
    modes = exact.select("query_id").union(near.select("query_id")).distinct().withColumn("mode", F.expr(MODES))
    return H.search_hybrid(exact, near, modes=modes)


QUESTIONS = """CASE id % 6 WHEN 0 THEN 'what inherits from the ' || name || '?' WHEN 1 THEN 'how does ' || name || ' work?' WHEN 2 THEN path WHEN 3 THEN 'Where is ' || lower(name) || ' used' WHEN 4 THEN 'InputTag.Ability.*' ELSE 'fire damage widget' END"""
NO_PREFIX = "NOT regexp_matches(upper(query), '^(BP|B|WBP|W|DT|M|MI|GE)_')"


@query("route_queries", with_views("v_assets") + f""", q AS (SELECT id AS query_id, name, path, {QUESTIONS} AS query FROM v_assets)
  SELECT query_id, query, CASE query_id % 6 WHEN 0 THEN 'inherits' WHEN 1 THEN 'trace' WHEN 2 THEN 'name' WHEN 3 THEN 'refs' WHEN 4 THEN 'tags_candidate' ELSE 'semantic' END AS mode, CASE query_id % 6 WHEN 0 THEN name WHEN 1 THEN name ELSE query END AS target FROM q""")
def _route_queries(spark, d):
    view(spark, d, "v_assets").createOrReplaceTempView("v_assets")
    return H.route_queries(spark.sql(f"SELECT id AS query_id, {QUESTIONS} AS query FROM v_assets"))


RESULTS = """SELECT a.id % 40 AS query_id, a.path, CASE WHEN a.id % 3 = 0 THEN 'Blueprint' WHEN a.id % 3 = 1 THEN 'Material' ELSE '' END AS type, a.name, 'Parent: Unknown ' || a.raw_type AS snippet, CAST(a.id % 17 AS DOUBLE) / 16 AS score FROM v_assets a
  UNION ALL SELECT a.id % 40, a.path, 'DataTable', a.name, '', CAST(a.id % 13 AS DOUBLE) / 16 FROM v_assets a WHERE a.id % 2 = 0"""


def _results(spark, d):
    view(spark, d, "v_assets").createOrReplaceTempView("v_assets")
    return spark.sql(RESULTS)


# questions of all intents, by query
INTENTS = """CASE query_id % 6 WHEN 0 THEN 'blueprint economy' WHEN 1 THEN 'Where is the WIDGET used' WHEN 2 THEN 'MI_Rock surface' WHEN 3 THEN 'datatable standard small' WHEN 4 THEN 'the map' ELSE 'dt_brand interaction of bp_hero' END"""
HAS = lambda column, words: "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


# scores off the thousandths' halves, which the engines round unlike
@query("rerank", with_views("v_assets") + rf""", r AS (SELECT query_id, path, type, name, snippet, score + 0.0001237::DOUBLE AS score FROM ({RESULTS})), w AS (SELECT *, lower({INTENTS}) AS q, lower(type) AS k, lower(name) AS n, lower(snippet) AS s FROM r),
  f AS (SELECT *, {HAS("q", H.BLUEPRINT_WORDS)} OR regexp_matches(q, '\b(bp_|b_)\w+') AS b, {HAS("q", H.WIDGET_WORDS)} OR regexp_matches(q, '\b(wbp_|w_)\w+') AS wi, contains(q, 'datatable') OR regexp_matches(q, '\bdt_\w+') AS d, {HAS("q", H.MATERIAL_WORDS)} OR regexp_matches(q, '\b(mi_|m_|mf_)\w+') AS m, {HAS("q", H.INTERACTION_WORDS)} AS i,
    k = 'blueprint' AS is_bp, list_filter(regexp_extract_all(q, '[a-z0-9_]+'), lambda x: length(x) >= 4 AND x NOT IN ({", ".join(f"'{w}'" for w in H.STOP_WORDS)})) AS tokens FROM w),
  o AS (SELECT *, len(list_filter(tokens, lambda x: contains(n || ' ' || s, x))) AS hits FROM f)
  SELECT query_id, path, type, name, snippet, round(score * CASE WHEN b AND (is_bp OR starts_with(n, 'bp_') OR starts_with(n, 'b_')) THEN 1.35::DOUBLE ELSE 1.0 END * CASE WHEN b AND contains(k, 'material') THEN 0.88::DOUBLE ELSE 1.0 END * CASE WHEN wi AND (contains(k, 'widget') OR starts_with(n, 'wbp_') OR starts_with(n, 'w_')) THEN 1.35::DOUBLE ELSE 1.0 END
    * CASE WHEN d AND k = 'datatable' THEN 1.4::DOUBLE WHEN d AND contains(k, 'material') THEN 0.9::DOUBLE ELSE 1.0 END * CASE WHEN m AND (contains(k, 'material') OR starts_with(n, 'mi_') OR starts_with(n, 'm_') OR starts_with(n, 'mf_')) THEN 1.25::DOUBLE ELSE 1.0 END * CASE WHEN i AND is_bp THEN 1.2::DOUBLE ELSE 1.0 END
    * CASE WHEN k IN ('blueprint', 'widgetblueprint') AND contains(s, 'parent: unknown') THEN 0.6::DOUBLE ELSE 1.0 END * CASE WHEN len(tokens) = 0 THEN 1.0::DOUBLE WHEN hits = 0 THEN 0.65::DOUBLE WHEN hits = 1 THEN 0.9::DOUBLE ELSE 1.1::DOUBLE END * CASE WHEN contains(n, 'save') AND NOT {HAS("q", H.SAVE_WORDS)} THEN 0.65::DOUBLE ELSE 1.0 END, 3) AS score FROM o""")
def _rerank(spark, d):
    r = _results(spark, d).withColumn("score", F.col("score") + 0.0001237)
    return H.rerank(r, r.select("query_id").distinct().withColumn("query", F.expr(INTENTS))).select("query_id", "path", "type", "name", "snippet", "score")


@query("finalize_results", with_views("v_assets") + f""", r AS ({RESULTS}), o AS (SELECT *, CASE WHEN lower(type) IN ('', 'unknown') THEN 0 ELSE 1 END AS kn, CASE WHEN trim(snippet) <> '' THEN 1 ELSE 0 END AS sn FROM r),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, kn DESC, sn DESC, name, type) AS k FROM o) WHERE k = 1),
  f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kn DESC, sn DESC, lower(name), path) AS rank, count(*) OVER (PARTITION BY query_id) AS total, max(score) OVER (PARTITION BY query_id) AS m FROM b)
  SELECT query_id, path, type, name, snippet, CASE WHEN m > 0 THEN round(score / m, 3) ELSE score END AS score, rank, total FROM f WHERE rank <= 10""")
def _finalize_results(spark, d):
    return H.finalize_results(_results(spark, d))


# of each query's assets the name of the second, the first's within a longer text, a part of the first's, and none
ASKED = """SELECT query_id, CASE query_id % 4 WHEN 0 THEN max(CASE WHEN rank = 2 THEN upper(name) END) WHEN 1 THEN 'the ' || max(CASE WHEN rank = 1 THEN name END) || ' asset' WHEN 2 THEN ' ' || max(CASE WHEN rank = 1 THEN substr(name, 4, 8) END) ELSE 'no such asset' END AS query FROM ranked GROUP BY query_id"""
RANKED = f"SELECT query_id, path, name, score * score AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM ({RESULTS}) AS r WHERE type = 'Blueprint'"


@query("select_confident", with_views("v_assets") + f""", ranked AS ({RANKED}), q AS ({ASKED}), x AS (SELECT ranked.*, lower(trim(query)) AS q, lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS nx, min(CASE WHEN lower(name) = lower(trim(query)) THEN rank END) OVER (PARTITION BY query_id) AS ex FROM ranked JOIN q USING (query_id)),
  h AS (SELECT query_id, path, name, CASE WHEN ex = rank THEN 'exact' WHEN ex IS NULL AND rank = 1 AND (contains(lower(name), q) OR contains(q, lower(name))) THEN 'contains' WHEN ex IS NULL AND rank = 1 AND (nx IS NULL OR score - nx > 0.15) THEN 'gap' END AS how FROM x) SELECT query_id, path, name, how FROM h WHERE how IS NOT NULL""")
def _select_confident(spark, d):
    view(spark, d, "v_assets").createOrReplaceTempView("v_assets")
    r = spark.sql(RANKED)
    r.createOrReplaceTempView("ranked")
    return H.select_confident(r, spark.sql(ASKED)).select("query_id", "path", "name", "how")


# full-text hits by name, prefixes, parts of light assets' names, and classes
NAMED = """SELECT query_id, query FROM v_query WHERE query_id >= 1000000 AND query_id % 3 = 2 UNION ALL SELECT 2000000 + id, CASE id % 4 WHEN 0 THEN substr(name, 1, instr(name, '_')) WHEN 1 THEN name ELSE lower(replace(name, '_' || CAST(id AS STRING), '')) END FROM v_assets WHERE id % 25 = 0 OR id % 20 = 1
  UNION ALL SELECT 3000000 + o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN substr(name, 3) ELSE lower(name) END FROM v_light WHERE o_orderkey % 500 = 0"""
TYPED_LIGHT = "SELECT path, name, asset_type FROM v_light UNION ALL SELECT path, name, CASE WHEN id % 9 = 0 THEN 'CppClass' ELSE raw_type END FROM v_assets"


@query("search_name", SEARCH.replace("v_query AS (", "v_query AS MATERIALIZED (", 1) + f""", v_assets AS ({VIEWS["v_assets"]}), v_light AS ({VIEWS["v_light"]}), nq AS ({NAMED}), li AS ({TYPED_LIGHT}),
  al AS (SELECT query_id, upper(unnest(CASE upper(query) WHEN 'BP_' THEN ['BP_', 'B_'] WHEN 'WBP_' THEN ['WBP_', 'W_'] ELSE [query] END)) AS p FROM nq WHERE ends_with(query, '_')),
  lo AS (SELECT query_id, lower(query) AS q FROM nq WHERE NOT ends_with(query, '_')),
  e AS (SELECT query_id, path, name, asset_type, 1.0::DOUBLE AS score FROM al JOIN (SELECT path, name, asset_type FROM v_docs UNION ALL SELECT path, name, asset_type FROM li) n ON starts_with(upper(name), p)
    UNION ALL SELECT query_id, path, name, asset_type, round(score, 3) FROM ranked JOIN lo USING (query_id) JOIN v_docs USING (doc_id) WHERE rank <= 60 AND contains(lower(name), q) UNION ALL SELECT query_id, path, name, asset_type, 0.9 FROM lo JOIN li ON contains(lower(name), q)),
  cc AS (SELECT query_id, 'Source/' || a.name AS path, 'U' || a.name AS name, 'CppClass' AS asset_type, 1.0::DOUBLE AS score FROM nq JOIN v_assets a ON a.name = nq.query WHERE nq.query_id NOT IN (SELECT query_id FROM e WHERE asset_type = 'CppClass')),
  g AS (SELECT query_id, path, name, min(asset_type) AS asset_type, max(score) AS score FROM (SELECT * FROM e UNION ALL SELECT * FROM cc) GROUP BY 1, 2, 3), s2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name, path) AS rank FROM g)
  SELECT query_id, path, name, asset_type, score, rank FROM s2 WHERE rank <= 20""")
def _search_name(spark, d):
    for v in ("v_assets", "v_light", "v_query", "v_docs"):
        view(spark, d, v).createOrReplaceTempView(v)
    queries, docs = spark.sql(NAMED), spark.table("v_docs")
    hits = S.search_text(queries, stored(S.build_blocks(docs)), k=60).join(docs.select("doc_id", "path", "name"), "doc_id")
    classes = spark.table("v_assets").select(F.concat(F.lit("U"), "name").alias("class_name"), F.concat(F.lit("Source/"), "name").alias("source_path"))
    return L.search_name(queries, docs, spark.sql(TYPED_LIGHT), hits=hits, classes=classes)


# every tag as it is, without its last part, cut, and as patterns
TAGGED = """SELECT DISTINCT CASE length(tag) * 5 % 7 WHEN 0 THEN tag WHEN 1 THEN 'tag:' || head WHEN 2 THEN head || '.*' WHEN 3 THEN lower(k) WHEN 4 THEN '%.' || lower(k) WHEN 5 THEN 'ev%' || lower(substr(tag, 8)) ELSE lower(tag) END AS query
  FROM (SELECT tag, 'Event.' || split_part(tag, '.', 2) AS head, split_part(tag, '.', 3) AS k FROM v_tags) AS t UNION SELECT DISTINCT split_part(tag, '.', 3) FROM v_tags UNION SELECT DISTINCT lower(split_part(tag, '.', 2)) || '.*' FROM v_tags"""
TAG_DOCS = "SELECT DISTINCT path, 'asset_summary' AS type, 'User ' || substr(path, 15) AS name, CASE WHEN path LIKE '%1' THEN NULL ELSE 'Player' END AS asset_type FROM v_tags WHERE path LIKE '%1' OR path LIKE '%2'"


@query("search_tag", with_views("v_tags") + f""", tq AS ({TAGGED} UNION SELECT '%'), q AS (SELECT query AS query_id, regexp_replace(query, '^tag:', '') AS q FROM tq), v AS (SELECT DISTINCT tag FROM v_tags), td AS ({TAG_DOCS}),
  h AS (SELECT query_id, tag, CASE WHEN q LIKE '%.*' OR contains(q, '%') THEN CASE WHEN tag ILIKE regexp_replace(q, '[*]$', '%') THEN 1 END WHEN tag = q THEN 1 WHEN starts_with(lower(tag), lower(q) || '.') THEN 2 WHEN contains(lower(tag), lower(q)) THEN 3 END AS level FROM q, v),
  b AS (SELECT * FROM h WHERE level IS NOT NULL QUALIFY level = min(level) OVER (PARTITION BY query_id)),
  r AS (SELECT query_id, t.path, t.tag, level, row_number() OVER (PARTITION BY query_id ORDER BY t.tag, t.path) AS rank FROM b JOIN v_tags t USING (tag))
  SELECT query_id, r.path, tag, level, rank, coalesce(td.name, regexp_extract(r.path, '[^/]*$')) AS name, coalesce(td.asset_type, 'Unknown') AS asset_type FROM r LEFT JOIN td ON td.path = r.path WHERE rank <= 20""")
def _search_tag(spark, d):
    view(spark, d, "v_tags").createOrReplaceTempView("v_tags")
    queries = spark.sql(f"{TAGGED} UNION SELECT '%'").select(F.col("query").alias("query_id"), "query")
    return L.search_tag(queries, spark.table("v_tags"), spark.sql(TAG_DOCS))


# names, their aliases, paths, and parts that several names have
TOKENS = "SELECT query_id AS token_id, CASE (query_id / 20) % 5 WHEN 0 THEN name WHEN 1 THEN CASE WHEN name LIKE 'BP%' THEN 'B_' || substr(name, 4) ELSE lower(name) END WHEN 2 THEN path WHEN 3 THEN substr(name, 5, 6) ELSE split_part(name, '_', 2) END AS token FROM v_targets"


@query("resolve_tokens", with_views("v_assets", "v_targets") + f""", k AS ({TOKENS.replace("query_id / 20", "query_id // 20")}), al AS (SELECT token_id, token, list_transform(CASE WHEN starts_with(upper(token), 'BP_') THEN [token, 'B_' || substr(token, 4)] WHEN starts_with(upper(token), 'B_') THEN [token, 'BP_' || substr(token, 3)]
    WHEN starts_with(upper(token), 'WBP_') THEN [token, 'W_' || substr(token, 5)] WHEN starts_with(upper(token), 'W_') THEN [token, 'WBP_' || substr(token, 3)] WHEN NOT contains(token, '_') AND length(token) > 2 THEN [token, 'W_' || token, 'WBP_' || token, 'BP_' || token, 'B_' || token] ELSE [token] END, lambda x: lower(x)) AS a FROM k WHERE NOT starts_with(token, '/Game/')),
  m AS (SELECT token_id, token, a, path, name, raw_type, list_contains(a, lower(name)) AS ex, len(list_filter(a, lambda x: contains(lower(name), x))) > 0 AS part FROM al, v_assets),
  f AS (SELECT *, bool_or(ex) OVER (PARTITION BY token_id) AS any_ex FROM m WHERE part),
  s AS (SELECT token_id, path, name, CASE WHEN ex THEN 100 ELSE 0 END + CASE WHEN lower(replace(name, '_', '')) = lower(replace(token, '_', '')) THEN 45 ELSE 0 END + 20 + CASE WHEN starts_with(lower(name), 'mi_') THEN 12 ELSE 0 END + CASE WHEN raw_type = 'ECONOMY' THEN 15 ELSE 0 END + 2 AS score FROM f WHERE ex OR NOT any_ex
    UNION ALL SELECT token_id, token, regexp_extract(token, '[^/]*$'), 0 FROM k WHERE starts_with(token, '/Game/')),
  r AS (SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY score DESC, lower(name) DESC, path DESC) AS rank FROM s) SELECT token_id, path, name, CAST(score AS DOUBLE) AS score, rank FROM r WHERE rank <= 5""")
def _resolve_tokens(spark, d):
    view(spark, d, "v_targets").createOrReplaceTempView("v_targets")
    tokens = spark.sql(TOKENS.replace("query_id / 20", "query_id DIV 20"))
    return L.resolve_tokens(tokens, view(spark, d, "v_assets").withColumnRenamed("raw_type", "asset_type"), prefer_types=("ECONOMY",), prefer_prefixes=("MI_",))


@query("enrich_results", with_views("v_docs") + """ SELECT n AS query_id, CASE WHEN n % 40 = 0 THEN path ELSE path || '/None' END AS path, CASE WHEN n % 40 = 0 THEN text || chr(10) || chr(10) || 'tree ' || name END AS text, CASE WHEN n % 40 = 0 THEN 'b,' || module ELSE '' END AS meta, CASE WHEN n % 40 = 0 THEN 'full' ELSE 'summary' END AS level,
    CASE WHEN n % 40 = 0 THEN '{"a":"b","l":{"k":[1,' || CAST(n AS VARCHAR) || '.5,null]},"m":"' || module || '","n":' || CAST(n AS VARCHAR) || '}' END AS typed FROM v_docs WHERE n % 20 = 0""")
def _enrich_results(spark, d):
    docs = view(spark, d, "v_docs")
    more = docs.select(F.concat(F.lit("widget:"), "path").alias("doc_id"), F.lit("widget_tree").alias("type"), "path", F.concat(F.lit("tree "), "name").alias("text"), F.lit('{"a":"b"}').alias("metadata"))
    own = docs.select("doc_id", "type", "path", "text", F.format_string('{"n":%d,"l":{"k":[1,%d.5,null]},"m":"%s","a":"x"}', "n", "n", "module").alias("metadata"))
    broken = docs.select(F.concat(F.lit("broken:"), "path").alias("doc_id"), F.lit("zzz").alias("type"), "path", F.lit(None).cast("string").alias("text"), F.when(F.col("n") % 3 == 0, "{bad").otherwise("[1]").alias("metadata"))
    asked = docs.filter("n % 20 = 0").select(F.col("n").alias("query_id"), F.when(F.col("n") % 40 == 0, F.col("path")).otherwise(F.concat("path", F.lit("/None"))).alias("path"))
    out = L.enrich_results(asked, own.union(more.select(*own.columns)).union(broken))
    return out.select("query_id", "path", "text", F.concat_ws(",", F.col("metadata")["a"], F.col("metadata")["m"]).alias("meta"), "level", F.to_json("typed").alias("typed"))


@query("embed_docs", with_views("v_docs") + " SELECT doc_id, round(CAST(CASE WHEN length(text) <= 4000 THEN length(text) ELSE (4000.0 * 4000 * (length(text) // 4000) + (length(text) % 4000) * (length(text) % 4000)) / length(text) END AS FLOAT), 1) AS first, false AS failed FROM v_docs")
def _embed_docs(spark, d):
    from assetloom.plans.toys import length_embedding

    return V.embed_docs(view(spark, d, "v_docs"), length_embedding).select("doc_id", F.round(F.col("embedding")[0], 1).alias("first"), "failed")
