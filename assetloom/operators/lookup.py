"""Lookups by name, tag and token, and enrichment of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.operators.best import first_rows
from assetloom.operators.code import resolve_classes
from assetloom.operators.substring import containing, matches
from assetloom.sources.scratch import evenly, small_side, stored, uncounted

# Prefixes that stand for each other.
ALIASES = {"BP_": ["B_"], "B_": ["BP_"], "WBP_": ["W_"], "W_": ["WBP_"]}
PREFIX_ALIASES = {"BP_": ["BP_", "B_"], "B_": ["B_", "BP_"], "WBP_": ["WBP_", "W_"], "W_": ["W_", "WBP_"], "SM_": ["SM_", "S_"], "SK_": ["SK_", "S_"], "S_": ["S_", "SM_", "SK_"]}


def enrich_results(results: DataFrame, docs: DataFrame) -> DataFrame:
    """Results (query_id, path) with the texts of all documents of the path, in the order of their types, and
    their metadata merged, that of the later type winning; what is no JSON object is skipped. ``metadata`` has the
    values as texts, ``typed`` is one VARIANT in which numbers, lists and objects are what they were. ``level`` is
    full where a result of the query has either, else summary."""
    wanted = results.select("path").distinct()
    # a bad part of a row must not make the whole row bad, so objects are told from the rest first
    parsed = F.try_parse_json(F.col("metadata"))
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    own = F.when(is_object, F.from_json("metadata", "map<string,string>"))
    typed = F.when(is_object, F.from_json("metadata", "map<string,variant>"))
    rows = docs.join(wanted, "path", "left_semi").select("path", "type", "doc_id", "text", F.map_entries(own).alias("m"), F.to_json(typed).alias("v"))
    by_type = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("type", "doc_id", "text", "m", "v"))).alias("ds"))

    def merged(name: str, kind: str):
        empty = F.array().cast(f"array<struct<key:string,value:{kind}>>")
        entries = (lambda d: F.coalesce(d[name], empty)) if kind == "string" else (lambda d: F.coalesce(F.map_entries(F.from_json(d[name], f"map<string,{kind}>")), empty))
        join = lambda acc, d: F.concat(F.filter(acc, lambda e: ~F.exists(entries(d), lambda x: x["key"] == e["key"])), entries(d))
        return F.map_from_entries(F.aggregate("ds", empty, join))

    text = F.array_join(F.transform("ds", lambda d: d["text"]), "\n\n")
    out = by_type.select("path", text.alias("text"), merged("m", "string").alias("metadata"), F.parse_json(F.to_json(merged("v", "variant"))).alias("typed"))
    found = F.max((F.coalesce("text", F.lit("")) != "") | (F.coalesce(F.size("metadata"), F.lit(0)) > 0)).over(Window.partitionBy("query_id"))
    return results.join(out, "path", "left").withColumn("level", F.when(found, "full").otherwise("summary"))


def search_name(queries: DataFrame, docs: DataFrame, light: DataFrame, *, hits: DataFrame | None = None, classes: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """Assets by name: (query_id, path, name, asset_type, score, rank).

    A query that ends in ``_`` is a prefix, with its aliases, of documents and light assets alike (score
    1). Any other is contained in a name, in either case: in that of a full-text hit (``hits``: query_id,
    path, name, score) where these are given, else of any document (1 for the whole name, else 0.9); and
    of light assets (0.9). A query without a class among its results gets that which ``classes``
    (class_name, source_path) has under its name or one of its prefixed forms.

    Names are ranked once for all queries that ask for the same part or prefix, and each task keeps the first of
    what it reads. Assets of one path and name are one, of the greatest score and the least type."""
    kind = lambda t, is_doc: t.select("path", "name", F.coalesce("asset_type", F.lit("Unknown")).alias("asset_type"), F.lower("name").alias("word"), F.lit(is_doc).alias("is_doc"))
    docs, light, q = kind(docs, True), kind(light, False), F.trim("query")
    is_class = F.lower("asset_type").isin("cppclass", "cpp_class")
    table = F.create_map(*[x for k, v in PREFIX_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    prefixes = queries.filter(q.endswith("_")).select("query_id", F.explode(F.coalesce(table[F.upper(q)], F.array(q))).alias("p"))
    asked = queries.filter(~q.endswith("_") & (q != "")).select("query_id", F.lower(q).alias("part"))
    wanted = stored(prefixes.select("query_id", F.upper("p").alias("part"), F.lit(True).alias("is_prefix")).union(asked.withColumn("is_prefix", F.lit(False))))
    kinds, found = ["part", "is_prefix"], ["query_id", "path", "name", "asset_type", "score"]
    every = docs.union(light)
    # names that contain a part are those of light assets and, without hits, of documents
    held = every if hits is None else light
    score = F.when(F.col("is_prefix") | (F.col("is_doc") & (F.col("word") == F.col("part"))), 1.0).otherwise(0.9)
    # names are met by every start of theirs that ends in an underscore, so this is an equi-join
    pieces = F.split("name", "_")
    starts = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.upper(F.concat(F.array_join(F.slice(pieces, 1, n), "_"), F.lit("_"))))
    begun = every.filter(F.col("name").contains("_")).select("*", F.explode(F.slice(starts, 1, F.size(pieces) - 1)).alias("part"))
    begun = begun.join(small_side(wanted.filter("is_prefix").select("part").distinct()), "part").withColumn("is_prefix", F.lit(True))
    within = matches(wanted.filter("not is_prefix"), evenly(held)).withColumn("is_prefix", F.lit(False))
    # classes are also ranked by themselves, to tell whether there is one
    ranked = F.explode(F.when(is_class, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("of_class")
    by = [*kinds, "score", "of_class"]
    up = lambda *of: [(c, "ascending") for c in of]
    rows = begun.unionByName(within).select(*kinds, "path", "name", "asset_type", score.alias("score"), ranked)
    best = first_rows(rows, limit, by=by, once=["name", "path"], within=up("asset_type"), order=up("name", "path"))
    best = best.groupBy(*by, "path", "name").agg(F.min("asset_type").alias("asset_type"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy("name", "path"))
    best = stored(best.withColumn("_k", first).filter(F.col("_k") <= limit).drop("_k"))
    of_part = stored(wanted.join(uncounted(best.filter("not of_class")), kinds).select(*found, "is_prefix"))
    more = of_part.select(*found).limit(0)
    if hits is not None:
        types = docs.groupBy("path").agg(F.min("asset_type").alias("asset_type"))
        hit = hits.select("query_id", "path", "name", "score").join(uncounted(asked), "query_id").filter(F.lower("name").contains(F.col("part")))
        more = stored(hit.join(uncounted(types), "path").select("query_id", "path", "name", "asset_type", F.round("score", 3).alias("score")))
    if classes is not None:
        has = wanted.join(uncounted(best.filter("of_class").select(*kinds).distinct()), kinds, "left_semi").select("query_id").union(more.filter(is_class).select("query_id")).distinct()
        rest = stored(queries.join(uncounted(has), "query_id", "left_anti").select("query_id", q.alias("name")))
        declared = resolve_classes(rest.select("name").distinct(), classes).select("name", F.col("source_path").alias("path"), "class_name")
        more = stored(more.union(rest.join(uncounted(declared), "name").select("query_id", "path", F.col("class_name").alias("name"), F.lit("CppClass").alias("asset_type"), F.lit(1.0).alias("score"))))
    # what is also found in another way may be an asset that comes after the first ones there: its rows are looked up
    twice = more.union(of_part.filter("score = 1 and not is_prefix").select(*found)).select("query_id", "path", "name").distinct()
    keyed = twice.join(uncounted(wanted.withColumnRenamed("query_id", "_id")), F.col("query_id").eqNullSafe(F.col("_id"))).select("query_id", "part", "is_prefix", F.col("path").alias("_path"), F.col("name").alias("_name"))
    fits = F.when(F.col("is_prefix"), F.upper("name").startswith(F.col("part"))).otherwise((F.lit(hits is None) | ~F.col("is_doc")) & F.col("word").contains(F.col("part")))
    again = every.join(small_side(keyed), F.col("path").eqNullSafe(F.col("_path")) & (F.col("name") == F.col("_name"))).filter(fits).select("query_id", "path", "name", "asset_type", score.alias("score"))
    once = of_part.select(*found).union(more).union(again).groupBy("query_id", "path", "name").agg(F.max("score").alias("score"), F.min("asset_type").alias("asset_type"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "name", "path"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= limit).select("query_id", "path", "name", "asset_type", "score", "rank")


def _longest_literal(pattern: Column) -> Column:
    """The longest run of a pattern that holds no wildcard."""
    return F.array_max(F.transform(F.split(pattern, "[%_]"), lambda x: F.struct(F.length(x), x.alias("x"))))["x"]


def _like(words: DataFrame, patterns: DataFrame, limit: int) -> DataFrame:
    """(pattern, word) of lower-cased words and patterns (``%`` any characters, ``_`` one), once each. A pattern is
    met by its longest literal run; of one of wildcards only, the first ``limit`` words stand for all."""
    asked = stored(patterns.select("pattern").distinct().withColumn("part", _longest_literal(F.col("pattern"))))
    held = F.expr(r"word like replace(pattern, '\\', '\\\\')")
    hit = asked.join(containing(asked, words), "part").filter(held).select("pattern", "word")
    bare = words.join(F.broadcast(asked.filter("part = ''").select("pattern")), held)
    first = F.row_number().over(Window.partitionBy("pattern").orderBy("word"))
    return hit.union(bare.withColumn("_k", first).filter(F.col("_k") <= limit).select("pattern", "word"))


def search_tag(queries: DataFrame, tags: DataFrame, docs: DataFrame | None = None, *, limit: int = 20) -> DataFrame:
    """(query_id, path, tag, level, rank, name, asset_type). ``X.*`` and patterns with ``%`` are matched as
    such, in either case; other queries exactly, else below ``X.``, else anywhere: the first of these
    that has rows (levels 1 to 3). In all but exact matches ``_`` stands for any character. Name and type are those
    of the path in ``docs``, else its last segment and Unknown."""
    q = F.regexp_replace(F.trim("query"), "^(?i)tag:", "")
    asked = stored(queries.select("query_id", q.alias("q")).filter("q <> ''"))
    vocabulary = stored(tags.select("tag", F.lower("tag").alias("word")).filter("tag is not null").distinct())
    words = vocabulary.select("word").distinct()
    is_pattern = F.col("q").endswith(".*") | F.col("q").contains("%")
    plain = asked.filter(~is_pattern)
    exact = stored(plain.join(vocabulary, plain["q"] == vocabulary["tag"]).select("query_id", "tag", F.lit(1).alias("level")))
    rest = plain.join(exact.select("query_id"), "query_id", "left_anti").select("query_id", F.lower("q").alias("part"))
    given = asked.filter(is_pattern).select("query_id", F.lower(F.regexp_replace("q", r"\.\*$", ".%")).alias("pattern"), F.lit(None).cast("string").alias("below"))
    open_ = stored(given.union(rest.select("query_id", F.concat(F.lit("%"), "part", F.lit("%")), F.concat("part", F.lit(".%")))))
    hit = open_.join(_like(words, open_, limit), "pattern")
    level = F.when(F.col("below").isNull(), 1).when(F.expr(r"word like replace(below, '\\', '\\\\')"), 2).otherwise(3)
    loose = stored(hit.select("query_id", "word", level.alias("level")))
    best = loose.groupBy("query_id").agg(F.min("level").alias("level"))
    every = exact.union(loose.join(best, ["query_id", "level"]).join(vocabulary, "word").select("query_id", "tag", "level"))
    rows = every.join(tags, "tag").select("query_id", "path", "tag", "level").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("tag", "path"))
    top = rows.withColumn("rank", rank).filter(F.col("rank") <= limit)
    bare = F.element_at(F.split("path", "/"), -1)
    if docs is None:
        return top.withColumn("name", bare).withColumn("asset_type", F.lit("Unknown"))
    own = docs.groupBy("path").agg(F.min(F.struct("type", "name", "asset_type")).alias("_d"))
    return top.join(own, "path", "left").select(*top.columns, F.coalesce(F.nullif("_d.name", F.lit("")), bare).alias("name"), F.coalesce(F.nullif("_d.asset_type", F.lit("")), F.lit("Unknown")).alias("asset_type"))


def token_aliases(token: Column) -> Column:
    """A token and its aliases: either form of a blueprint or widget prefix; of a bare one, four prefixes."""
    upper = F.upper(token)
    bare = ~token.contains("_") & ~token.contains("/") & (F.length(token) > 2)
    out = F.when(bare, F.array(token, *[F.concat(F.lit(p), token) for p in ("W_", "WBP_", "BP_", "B_")])).otherwise(F.array(token))
    for prefix, others in ALIASES.items():
        out = F.when(upper.startswith(prefix), F.array(token, *[F.concat(F.lit(o), F.substr(token, F.lit(len(prefix) + 1))) for o in others])).otherwise(out)
    return out


def resolve_tokens(tokens: DataFrame, assets: DataFrame, *, prefer_types: tuple[str, ...] = (), prefer_prefixes: tuple[str, ...] = (), limit: int = 5) -> DataFrame:
    """(token_id, path, name, score, rank): assets of each token (token_id, token) by exact name of it or
    an alias, or, where none has it, by names that contain one; a ``/Game/`` path is its own asset. Ties go
    by name, descending; of the names of a path the one that comes first counts. ``assets``: path, name, asset_type.

    Assets are ranked once for all ids that ask for the same, and each task keeps the best of what it reads."""
    bare = F.trim("token")
    asked = tokens.select("token_id", bare.alias("token")).filter("token <> ''")
    own = asked.filter(F.col("token").startswith("/Game/")).select("token_id", F.col("token").alias("path"), F.element_at(F.split("token", "/"), -1).alias("name"), F.lit(0.0).alias("score"))
    # the tokens of an id are settled together, so what is asked is a list of them
    listed = F.to_json(F.array_sort(F.collect_set("token"))).alias("asked")
    ids = stored(asked.filter(~F.col("token").startswith("/Game/") & F.col("token_id").isNotNull()).groupBy("token_id").agg(listed))
    named = ids.select("asked").distinct().select("asked", F.explode(F.from_json("asked", "array<string>")).alias("token"))
    aliases = F.transform(token_aliases(F.col("token")), F.lower)
    each = stored(named.select("asked", F.explode(aliases).alias("part")).distinct())
    a = evenly(assets.filter(F.col("path").startswith("/")).select("path", "name", "asset_type", F.lower("name").alias("word")))
    compact = F.lower(F.replace("token", F.lit("_"), F.lit("")))
    starts = F.lit(False)
    for p in prefer_prefixes:
        starts = starts | F.col("word").startswith(p.lower())
    # What each sign of a match adds
    signs = [
        (F.array_contains(aliases, F.col("word")), 100), (F.replace("word", F.lit("_"), F.lit("")) == compact, 45),
        (F.exists(aliases, lambda x: F.col("word").contains(x)), 20), (starts, 12), (F.coalesce(F.col("asset_type").isin(*prefer_types), F.lit(False)), 15),
        (compact.contains("health") & F.col("path").contains("/UI/Hud/"), 8), (F.col("path").startswith("/Game/"), 2),
    ]
    score = sum((F.when(when, float(n)).otherwise(0.0) for when, n in signs), F.lit(0.0))

    def best(found: DataFrame, of: DataFrame) -> DataFrame:
        """The best assets of rows (part, word, path, name, asset_type), of each that asks for the part, in each task."""
        scored = found.join(small_side(of.join(uncounted(named), "asked").select("part", "asked", "token")), "part").select("asked", "path", "name", F.lower("name").alias("low"), score.alias("score"))
        down = lambda *columns: [(c, "descending") for c in columns]
        return stored(first_rows(scored, limit, by=["asked"], once=["path"], within=down("score", "low", "name"), order=down("score", "low", "path")))

    exact = best(a.withColumn("part", F.col("word")), each)
    rest = stored(each.join(uncounted(exact.select("asked").distinct()), "asked", "left_anti"))
    rows = exact.union(best(matches(rest, a), rest))
    once = rows.groupBy("asked", "path").agg(F.max(F.struct("score", "low", "name")).alias("b"))
    first = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("b.score"), F.desc("b.low"), F.desc("path")))
    top = once.withColumn("_k", first).filter(F.col("_k") <= limit)
    every = ids.join(uncounted(top), "asked").select("token_id", "path", "b.name", "b.score").union(own.select("token_id", "path", "name", "score"))
    rank = F.row_number().over(Window.partitionBy("token_id").orderBy(F.desc("score"), F.desc(F.lower("name")), F.desc("path")))
    return every.withColumn("rank", rank).filter(F.col("rank") <= limit)
