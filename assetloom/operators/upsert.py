"""Upserts, edges, tags and change detection over the index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetloom.functions.paths import extract_all_refs, normalize_object_path, normalize_reference
from assetloom.functions.text import wide_fingerprint


def _decided(old: DataFrame, incoming: DataFrame, force: bool, order_col: str | None, more: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """One incoming row of each id, and what becomes of it (doc_id, action): inserted, replaced, unchanged."""
    order = [F.desc_nulls_last(c) for c in dict.fromkeys([order_col or "text", "text"])]
    new = incoming.withColumn("fingerprint", wide_fingerprint(incoming, list(more))).withColumn("_k", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).filter("_k = 1").drop("_k")
    known = old.groupBy(F.col("doc_id").alias("_id")).agg(F.first("fingerprint").alias("_old"), F.lit(True).alias("_known"))
    changed = F.lit(force) | ~F.col("_old").eqNullSafe(F.col("fingerprint"))
    action = F.when(F.col("_known").isNull(), "inserted").when(changed, "replaced").otherwise("unchanged")
    return new, new.select("doc_id", "fingerprint").join(known, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", action.alias("action"))


def _arriving(new: DataFrame, decided: DataFrame) -> DataFrame:
    return new.join(decided.filter("action <> 'unchanged'"), new["doc_id"].eqNullSafe(decided["doc_id"])).drop(decided["doc_id"])


def upsert_docs(existing: DataFrame, incoming: DataFrame, *, force: bool = False, order_col: str | None = None, fingerprint_cols: list[str] = ()) -> DataFrame:
    """The union of both by doc_id, with a column ``action``: kept, unchanged, inserted or replaced.

    A row of ``incoming`` takes the place of an existing one if its text's fingerprint differs, null
    being a text of its own, or with ``force``. With ``fingerprint_cols`` these columns count like the text, so a
    change of references alone is one; fingerprints that ``existing`` has must be of the same columns. A missing id is an id like any other. Of several incoming rows of one id the last by
    ``order_col`` counts (the greatest text where there is none). A fingerprint that ``existing`` has
    already isn't computed again, and what to do is settled on ids and fingerprints alone.
    """
    old = existing if "fingerprint" in existing.columns else existing.withColumn("fingerprint", wide_fingerprint(existing, list(fingerprint_cols)))
    columns = [c for c in old.columns if c != "doc_id"]
    new, decided = _decided(old, incoming, force, order_col, fingerprint_cols)
    settled = decided.withColumnRenamed("doc_id", "_id")
    stays = old.join(settled, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id").withColumn("action", F.coalesce("action", F.lit("kept"))).filter("action <> 'replaced'")
    return stays.select("doc_id", *columns, "action").unionByName(_arriving(new, decided).select("doc_id", *columns, "action"))


def changed_docs(fingerprints: DataFrame, incoming: DataFrame, *, force: bool = False, order_col: str | None = None, fingerprint_cols: list[str] = ()) -> DataFrame:
    """The rows of ``incoming`` that ``upsert_docs`` inserts or puts in place of others, with fingerprint and
    action; of what exists only ids and fingerprints are read (doc_id, fingerprint)."""
    return _arriving(*_decided(fingerprints, incoming, force, order_col, fingerprint_cols))


def upsert_stats(upserted: DataFrame) -> DataFrame:
    """Rows by action."""
    return upserted.groupBy("action").agg(F.count("*").alias("n"))


def build_edges(docs: DataFrame) -> DataFrame:
    """(from_id, to_id, edge_type), once each, of ``docs`` (doc_id, references_out, typed_references_out)."""
    refs = docs.select("doc_id", "typed_references_out", F.explode("references_out").alias("ref"))
    kind = F.coalesce(F.try_element_at("typed_references_out", F.col("ref")), F.lit("uses_asset"))
    return refs.filter("ref is not null and ref <> ''").select(F.col("doc_id").alias("from_id"), normalize_reference(F.col("ref")).alias("to_id"), kind.alias("edge_type")).distinct()


def replace_edges(existing: DataFrame, docs: DataFrame) -> DataFrame:
    """Existing edges with those of changed documents built anew."""
    return existing.join(docs.select(F.col("doc_id").alias("from_id")).distinct(), "from_id", "left_anti").unionByName(build_edges(docs)).distinct()


def edge_changes(existing: DataFrame, docs: DataFrame) -> DataFrame:
    """(from_id, to_id, edge_type, change): the edges that changed documents add and remove, for who follows a graph."""
    ids = docs.select(F.col("doc_id").alias("from_id")).distinct()
    was = existing.select("from_id", "to_id", "edge_type").join(ids, "from_id", "left_semi").withColumn("_n", F.lit(-1))
    change = F.when(F.col("n") > 0, "added").otherwise("removed")
    both = was.unionByName(build_edges(docs).withColumn("_n", F.lit(1))).groupBy("from_id", "to_id", "edge_type").agg(F.sum("_n").alias("n"))
    return both.filter("n <> 0").select("from_id", "to_id", "edge_type", change.alias("change"))


def resolve_parents(df: DataFrame, docs: DataFrame, light: DataFrame, engine_classes: list[str]) -> DataFrame:
    """``df`` (name, parent) with ``parent_ref``: script parents, and names that several assets or
    none have, as ``class:``; paths as ``asset:``; names of one document, else of one light asset, as
    ``asset:`` with its path; none for no parent."""

    def unique(t: DataFrame, column: str) -> DataFrame:
        return t.groupBy("name").agg(F.min("path").alias(column), F.countDistinct("path").alias("_n")).filter("_n = 1").select(F.col("name").alias("_bare"), column)

    parent = F.btrim(F.coalesce("parent", F.lit("")))
    bare = F.regexp_replace(F.when(parent.startswith("/Script/"), F.element_at(F.split(parent, r"\."), -1)).otherwise(parent), r"_C$", "")
    d = df.withColumn("_p", parent).withColumn("_bare", bare)
    d = d.join(unique(docs, "_doc"), "_bare", "left").join(unique(light, "_light"), "_bare", "left")
    as_class = F.concat(F.lit("class:"), F.col("_bare"))
    ref = (
        F.when(F.col("_p").isin("", "Unknown", "None", "Object"), F.lit(None).cast("string"))
        .when(F.col("_p").startswith("/Script/"), as_class)
        .when(F.col("_p").startswith("/"), F.concat(F.lit("asset:"), normalize_object_path(F.col("_p"))))
        .when(F.col("_bare").isin(*engine_classes), as_class)
        .otherwise(F.coalesce(F.concat(F.lit("asset:"), F.col("_doc")), F.concat(F.lit("asset:"), F.col("_light")), as_class))
    )
    return d.withColumn("parent_ref", ref).drop("_p", "_bare", "_doc", "_light")


def clean_tags(tags: DataFrame) -> DataFrame:
    return tags.select("path", F.btrim("tag").alias("tag")).filter("tag is not null and tag <> ''").distinct()


def upsert_tags(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Tags with those of every path that brings tags replaced."""
    new = clean_tags(incoming)
    return existing.join(new.select("path").distinct(), "path", "left_anti").unionByName(new).distinct()


def replace_tags(existing: DataFrame, incoming: DataFrame, paths: DataFrame) -> DataFrame:
    """Tags of the given paths replaced, even by none."""
    return existing.join(paths.select("path").distinct(), "path", "left_anti").unionByName(clean_tags(incoming)).distinct()


def normalize_refs(light: DataFrame) -> DataFrame:
    """(asset_path, ref_path), once each, of ``light`` (path, references)."""
    return light.select(F.col("path").alias("asset_path"), F.explode("references").alias("ref_path")).filter("ref_path is not null and ref_path <> ''").distinct()


def upsert_lightweight(refs: DataFrame, light: DataFrame) -> DataFrame:
    """References with those of the assets in ``light`` replaced."""
    return refs.join(light.select(F.col("path").alias("asset_path")).distinct(), "asset_path", "left_anti").unionByName(normalize_refs(light))


def deep_refs(files: DataFrame, *, classes: list[str], prefixes: list[str], types: list[str] = ("Unknown", "DataAsset")) -> DataFrame:
    """(asset_path, ref_path): all paths in the property JSON of high-value files, beside the light
    ones. ``files``: path, name, asset_type, export_classes, json, references. Placed actors are left out."""
    high = F.arrays_overlap("export_classes", F.array(*map(F.lit, classes)))
    for p in prefixes:
        high = high | F.col("name").startswith(p)
    kept = files.filter(F.col("asset_type").isin(*types) & ~F.col("path").contains("/__External") & F.coalesce(high, F.lit(False)))
    all_refs = F.array_union(F.coalesce("references", F.array().cast("array<string>")), extract_all_refs(F.coalesce("json", F.lit("")), F.col("path")))
    return normalize_refs(kept.select("path", all_refs.alias("references")))


def get_docs(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def get_lightweight(light: DataFrame, paths: DataFrame) -> DataFrame:
    return light.join(paths.select("path").distinct(), "path", "left_semi")


def delete_docs(docs: DataFrame, edges: DataFrame, tags: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, edges and tags without the given documents and what is theirs."""
    gone = docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "path")
    kept = docs.join(gone.select("doc_id"), "doc_id", "left_anti")
    orphan = gone.select("path").distinct().join(kept.select("path").distinct(), "path", "left_anti")
    return kept, edges.join(gone.select(F.col("doc_id").alias("from_id")), "from_id", "left_anti"), tags.join(orphan, "path", "left_anti")


def promote_to_semantic(light: DataFrame, refs: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Light assets that are no document yet, and the references (asset_path, ref_path) without those of
    assets that are one."""
    full = docs.select("path").distinct()
    return light.join(full, "path", "left_anti"), refs.join(full.withColumnRenamed("path", "asset_path"), "asset_path", "left_anti")


def detect_changes(snapshot: DataFrame, file_meta: DataFrame) -> DataFrame:
    """path and status: new, changed, or unchanged (equal size, times less than a millisecond apart)."""
    was = file_meta.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    same = (F.abs(F.col("mtime") - F.col("_m")) < 0.001) & (F.col("size") == F.col("_s"))
    status = F.when(F.col("_m").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return snapshot.join(was, "path", "left").select("path", status.alias("status"))


def vanished_paths(snapshot: DataFrame, file_meta: DataFrame) -> DataFrame:
    return file_meta.join(snapshot.select("path"), "path", "left_anti").select("path")


def docs_needing_embedding(docs: DataFrame, embeddings: DataFrame, model: str, version: str, *, min_chars: int = 20) -> DataFrame:
    """doc_id of texts longer than ``min_chars`` without an embedding, or with one of another model or version."""
    e = embeddings.select("doc_id", F.col("embed_model").alias("_m"), F.col("embed_version").alias("_v"), F.lit(True).alias("_has"))
    stale = (F.col("_m") != model) | (F.col("_v") != version)
    return docs.join(e, "doc_id", "left").filter((F.col("_has").isNull() & (F.length("text") > min_chars)) | F.coalesce(stale, F.lit(False))).select("doc_id")
