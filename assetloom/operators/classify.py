"""Types of assets, by name, by class and by profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.config import CLASS_TYPES, GUESSES, NAME_PREFIXES, NO_REFERENCE_TYPES, SEMANTIC_TYPES, STRUCTURE_MARKERS, Profile


def _first(cases: list[tuple[Column, str]], otherwise: Column) -> Column:
    out = otherwise
    for condition, value in reversed(cases):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def classify_by_name(name: Column, prefixes: dict[str, str] = NAME_PREFIXES) -> Column:
    """The type of the longest naming prefix, in either case; else Unknown."""
    upper = F.upper(name)
    longest = sorted(prefixes.items(), key=lambda x: -len(x[0]))
    return _first([(upper.startswith(p.upper()), t) for p, t in longest], F.lit("Unknown"))


def classify_asset(name: Column, classes: Column) -> Column:
    """By naming prefix, else by exact export class, structural marker, generated class; else Unknown."""
    by_name = F.nullif(classify_by_name(name), F.lit("Unknown"))
    table = F.create_map(*[F.lit(x) for pair in CLASS_TYPES.items() for x in pair])
    exact = F.get(F.filter(F.transform(classes, lambda c: table[c]), lambda t: t.isNotNull()), 0)
    starts = lambda m: F.exists(classes, lambda c: c.startswith(m))
    marker = _first([(starts(m), t) for m, t in STRUCTURE_MARKERS.items()], F.lit(None).cast("string"))
    generated = F.when(F.exists(classes, lambda c: c.endswith("GeneratedClass")), "Blueprint")
    return F.coalesce(by_name, exact, marker, generated, F.lit("Unknown"))


def guess_type(name: Column, path: Column) -> Column:
    """A quick guess by name and path, first rule that fits; null if unsure."""
    n, p = F.lower(name), F.lower(path)
    cases = [(path.endswith(".umap"), "World"), (n.contains("_builtdata"), "_BuiltData")]
    for kind, starts in GUESSES:
        cases += [(n.startswith(s), kind) for s in starts]
    ui = p.contains("/ui/") | p.contains("/widgets/")
    cases += [
        (n.startswith("w_") & (p.contains("/ui/") | n.contains("widget")), "WidgetBlueprint"),
        (n.startswith("b_") & p.contains("/experiences/"), "Blueprint"),
        (ui & (n.contains("widget") | n.startswith("w_")), "WidgetBlueprint"),
        (p.contains("/datatables/"), "DataTable"),
    ]
    return _first(cases, F.lit(None).cast("string"))


def reclassify(df: DataFrame, profile: Profile, *, feature_folders: tuple[str, ...] = ()) -> DataFrame:
    """asset_type by the profile: unknown types by export class; feature actions by class start or
    folder; then unknown types and blueprints by the first naming prefix in the profile's order.
    Columns used: name, path, main_class, asset_type."""
    kind, cls, name = F.col("asset_type"), F.col("main_class"), F.col("name")
    by_class = F.when(kind == "Unknown", _first([(cls == c, t) for c, t in profile.class_types.items()], kind)).otherwise(kind)
    feature = cls.startswith("GameFeatureAction_")
    for f in feature_folders:
        feature = feature | F.col("path").startswith(f"/{f}/{f}")
    by_feature = F.when((by_class == "Unknown") & F.coalesce(feature, F.lit(False)), "GameFeatureData").otherwise(by_class)
    by_prefix = F.when(by_feature.isin("Unknown", "Blueprint"), _first([(name.startswith(p), t) for p, t in profile.name_prefixes.items()], by_feature)).otherwise(by_feature)
    return df.withColumn("asset_type", by_prefix)


def route_tier(df: DataFrame, profile: Profile, types: list[str] | None = None) -> DataFrame:
    """tier: semantic, lightweight_no_refs or lightweight_refs; only the given types, if any."""
    kind = F.col("asset_type")
    tier = F.when(kind.isin(*SEMANTIC_TYPES, *profile.semantic_types), "semantic").when(kind.isin(*NO_REFERENCE_TYPES), "lightweight_no_refs").otherwise("lightweight_refs")
    out = df.withColumn("tier", tier)
    return out.filter(kind.isin(*types)) if types else out


def filter_docs(docs: DataFrame, *, type: str | None = None, path_prefix: str | None = None, module: str | None = None, asset_types: list[str] | None = None) -> DataFrame:
    """Documents by equality of type and module, path prefix in either case, and asset types in either case."""
    out = docs
    if type:
        out = out.filter(F.col("type") == type)
    if module:
        out = out.filter(F.col("module") == module)
    if path_prefix:
        out = out.filter(F.col("path").ilike(path_prefix + "%"))
    if asset_types:
        out = out.filter(F.lower("asset_type").isin(*[t.lower() for t in asset_types]))
    return out
