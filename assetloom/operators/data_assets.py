"""Documents of feature data, inputs, effects and data assets, from the properties of their exports.

Records have path, name, ``exports`` (array of class, properties (array of name, value: JSON text), and,
where known, name and type) and, where known, asset_type and ``refs``, the references of the file's
import table. Values that are missing or no JSON count as absent.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.functions.paths import extract_asset_path, extract_class_name, last_segment, normalize_object_path
from assetloom.functions.text import collect_refs, collect_tags
from assetloom.operators.docs import STRINGS, document, listed, sentence
from assetloom.operators.upsert import resolve_parents

ALL = 1 << 20
LINKS = "array<struct<ref:string,kind:string>>"
EXPORTS = "array<struct<class:string,name:string,type:string,properties:array<struct<name:string,value:string>>>>"


def nothing(kind: str = STRINGS) -> Column:
    return F.array().cast(kind)


def with_exports(records: DataFrame) -> DataFrame:
    """``records`` with exports that have a name and a type, asset_type and refs, null where unknown."""
    known = records.schema["exports"].dataType.elementType.names
    optional = lambda e, c: e[c] if c in known else F.lit(None).cast("string")
    same = lambda e: F.struct(e["class"].alias("class"), optional(e, "name").alias("name"), optional(e, "type").alias("type"), e["properties"].alias("properties"))
    out = records.withColumn("exports", F.coalesce(F.transform("exports", same).cast(EXPORTS), nothing(EXPORTS)))
    for c, kind in (("asset_type", "string"), ("refs", STRINGS)):
        if c not in records.columns:
            out = out.withColumn(c, F.lit(None).cast(kind))
    return out


def value(props: Column, *names: str) -> Column:
    """The JSON text of the last property of one of these names; null without one."""
    return F.try_element_at(F.filter(props, lambda p: p["name"].isin(*names)), F.lit(-1))["value"]


def plain(json: Column) -> Column:
    """The text of a JSON value: strings without their quotes, all else as it stands."""
    return F.when(json.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v")).otherwise(json)


def entries(json: Column) -> Column:
    """The elements of a JSON list as texts: strings without their quotes, objects as JSON."""
    return F.filter(F.coalesce(F.from_json(json, STRINGS), nothing()), lambda x: x.isNotNull())


def objects(json: Column) -> Column:
    return F.filter(entries(json), lambda x: x.startswith("{"))


def field(entry: Column, name: str) -> Column:
    return F.get_json_object(entry, f"$.{name}")


def tag(entry: Column, name: str) -> Column:
    """The name of a tag in a field; empty for none."""
    return F.coalesce(F.nullif(field(entry, f"{name}.TagName"), F.lit("None")), F.lit(""))


def enum(text: Column) -> Column:
    """Of enum text the part after the last ``::``."""
    return F.element_at(F.split(text, "::"), -1)


def number(json: Column) -> Column:
    return plain(json).try_cast("double")


def short(number: Column) -> Column:
    """A signed number of six digits, without zeros at the end."""
    text = F.regexp_replace(F.format_string("%+.6g", number), r"(\.\d*?)0*(e.*)?$", "$1$2")
    return F.regexp_replace(text, r"\.(e.*)?$", "$1")


def as_json(json: Column) -> Column:
    """A value as JSON, text that has lost its quotes with quotes."""
    quoted = F.regexp_replace(F.to_json(F.struct(json.alias("v"))), r'^\{"v":|\}$', "")
    return F.when(json.rlike(r'^\s*([\[{"]|-?[0-9.eE+-]+\s*$|(true|false|null)\s*$)'), json).otherwise(quoted)


def together(props: Column) -> Column:
    """All values of some properties as one JSON list."""
    values = F.filter(F.transform(props, lambda p: as_json(p["value"])), lambda x: x.isNotNull())
    return F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))


def paths_in(json: Column) -> Column:
    """The paths in a JSON text, without what comes after a dot, each once."""
    return F.array_distinct(F.transform(collect_refs(json), lambda r: F.regexp_replace(r, r"\.[^./]*$", "")))


def link(ref: Column, kind: str) -> Column:
    return F.struct(ref.alias("ref"), F.lit(kind).alias("kind"))


def links(refs: Column, kind: str = "uses_asset") -> Column:
    return F.transform(F.filter(refs, lambda r: r.isNotNull()), lambda r: link(r, kind)).cast(LINKS)


def typed(flat: Column) -> Column:
    """The map of links: of several kinds of a reference the last counts."""
    refs = F.array_distinct(F.transform(flat, lambda x: x["ref"]))
    return F.map_from_arrays(refs, F.transform(refs, lambda r: F.element_at(F.filter(flat, lambda x: x["ref"] == r), -1)["kind"]))


def named_path(entry: Column, key: str) -> Column:
    """struct(name, path) of a reference in a field: its last segment, or the text where it is no path."""
    path = extract_asset_path(field(entry, key))
    return F.struct(F.coalesce(last_segment(path), field(entry, key), F.lit("")).alias("name"), path.alias("path"))


def tail(path: Column) -> Column:
    """The last segment of a path; null for none."""
    return F.nullif(last_segment(path), F.lit(""))


def labelled(label: str, text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(label), text))


# Extractors. Each takes the columns name, class and properties of an asset and returns the parts of its
# text (null: none), a struct of metadata and its links. The classes are fixed values.


def ability_set(name: Column, cls: Column, props: Column):
    found = F.transform(objects(value(props, "GrantedGameplayAbilities")), lambda x: F.struct(named_path(x, "Ability")["name"].alias("name"), named_path(x, "Ability")["path"].alias("path"), tag(x, "InputTag").alias("input_tag")))
    shown = F.transform(found, lambda a: F.when(a["input_tag"] != "", F.concat(a["name"], F.lit(" ("), a["input_tag"], F.lit(")"))).otherwise(a["name"]))
    return [F.concat(name, F.lit(" is a "), cls), listed("Grants abilities: ", shown, ALL)], F.struct(found.alias("abilities")), links(F.transform(found, lambda a: a["path"]))


def pawn_data(name: Column, cls: Column, props: Column):
    text = lambda c: plain(value(props, c))
    path = lambda c: extract_asset_path(text(c))
    pawn, camera = (F.coalesce(path(c), extract_class_name(text(c))) for c in ("PawnClass", "DefaultCameraMode"))
    sets = F.filter(F.transform(entries(value(props, "AbilitySets")), extract_asset_path), lambda r: r.isNotNull())
    config, mapping = path("InputConfig"), path("TagRelationshipMapping")
    parts = [F.concat(name, F.lit(" is a "), cls), labelled("PawnClass: ", tail(pawn)), listed("AbilitySets: ", F.transform(sets, last_segment), ALL), labelled("InputConfig: ", tail(config)), labelled("DefaultCameraMode: ", tail(camera)), labelled("TagRelationshipMapping: ", tail(mapping))]
    meta = F.struct(pawn.alias("pawn_class"), sets.alias("ability_sets"), config.alias("input_config"), camera.alias("default_camera"), mapping.alias("tag_mapping"))
    return parts, meta, links(F.concat(sets, F.array(config, mapping)))


def input_config(name: Column, cls: Column, props: Column):
    def actions(c):
        return F.transform(objects(value(props, c)), lambda x: F.struct(named_path(x, "InputAction")["name"].alias("action"), named_path(x, "InputAction")["path"].alias("path"), tag(x, "InputTag").alias("tag")))

    native, ability = actions("NativeInputActions"), actions("AbilityInputActions")
    shown = lambda a: F.transform(a, lambda x: F.when(x["tag"] != "", F.concat(x["action"], F.lit("->"), x["tag"])).otherwise(x["action"]))
    parts = [F.concat(name, F.lit(" is a "), cls), listed("NativeInputActions: ", shown(native), ALL), listed("AbilityInputActions: ", shown(ability), ALL)]
    return parts, F.struct(native.alias("native_actions"), ability.alias("ability_actions")), links(F.transform(F.concat(native, ability), lambda a: a["path"]))


def playlist(name: Column, cls: Column, props: Column):
    level, experience = (F.coalesce(field(value(props, c), "PrimaryAssetName"), F.lit("")) for c in ("MapID", "ExperienceID"))
    players = F.coalesce(value(props, "MaxPlayerCount").try_cast("int"), F.lit(0))
    widget = extract_asset_path(plain(value(props, "LoadingScreenWidget")))
    parts = [F.concat(name, F.lit(" is a "), cls), labelled("Map: ", last_segment(level)), labelled("Experience: ", experience), F.when(players != 0, F.concat(F.lit("MaxPlayers: "), players.cast("string"))), labelled("LoadingScreenWidget: ", tail(widget))]
    return parts, F.struct(level.alias("map_id"), experience.alias("experience_id"), players.alias("max_players"), widget.alias("loading_widget")), links(F.array(widget))


def context_effects(name: Column, cls: Column, props: Column):
    def surface(entry):
        """The last name of the first tag of a context, or of its text."""
        context = field(entry, "Context")
        first = F.get_json_object(context, "$.tags[0]")
        text = F.when(context.startswith("{"), F.coalesce(F.get_json_object(context, "$.Context"), F.lit(""))).otherwise(F.coalesce(context, F.lit("")))
        text = F.when(F.get_json_object(context, "$.tags").isNotNull(), F.coalesce(first, F.lit(""))).otherwise(F.btrim(text, F.lit("() ")))
        return F.element_at(F.split(text, r"\."), -1)

    found = F.transform(objects(value(props, "ContextEffects")), lambda x: F.struct(tag(x, "EffectTag").alias("tag"), surface(x).alias("surface")))
    tags = F.filter(F.array_distinct(F.transform(found, lambda x: x["tag"])), lambda t: t != "")
    of = lambda t: F.array_distinct(F.transform(F.filter(found, lambda x: (x["tag"] == t) & (x["surface"] != "")), lambda x: x["surface"]))
    shown = F.transform(tags, lambda t: F.when(F.size(of(t)) > 0, F.concat(t, F.lit(" ("), F.array_join(of(t), ", "), F.lit(")"))).otherwise(t))
    meta = F.struct(F.map_from_arrays(tags, F.transform(tags, of)).alias("effects_by_tag"))
    return [F.concat(name, F.lit(" is a "), cls), labelled("ContextEffects: ", F.array_join(shown, "; "))], meta, nothing(LINKS)


def gameplay_effect(name: Column, cls: Column, props: Column):
    def magnitude(m):
        given = F.coalesce(field(m, "ModifierMagnitude"), field(m, "Magnitude"))
        scalar = F.get_json_object(given, "$.ScalableFloatMagnitude")
        inner = F.when(scalar.startswith("{"), F.get_json_object(scalar, "$.Value").try_cast("double")).when(scalar.try_cast("double").isNotNull(), scalar.try_cast("double")).otherwise(F.get_json_object(given, "$.Value").try_cast("double"))
        kind = F.when(given.startswith("{"), F.nullif(enum(F.get_json_object(given, "$.MagnitudeCalculationType")), F.lit("")))
        return F.coalesce(kind, F.lit("ScalableFloat")), F.coalesce(F.when(given.startswith("{"), inner).otherwise(given.try_cast("double")), F.lit(0.0))

    def modifier(m):
        attribute = field(m, "Attribute")
        inside = F.coalesce(F.get_json_object(attribute, "$.AttributeName"), F.get_json_object(attribute, "$.PropertyName"), F.lit(""))
        kind, size = magnitude(m)
        op = F.coalesce(F.nullif(enum(field(m, "ModifierOp")), F.lit("")), F.lit("Additive"))
        return F.struct(F.when(attribute.startswith("{"), inside).otherwise(F.coalesce(attribute, F.lit(""))).alias("attribute"), op.alias("operation"), kind.alias("magnitude_type"), size.alias("magnitude"))

    def required(*names):
        tags = collect_tags(together(F.filter(props, lambda p: p["name"].isin(*names))))
        return F.when(F.size(tags) > 0, tags)

    duration = F.coalesce(enum(plain(value(props, "DurationPolicy"))), F.lit(""))
    mods = F.transform(objects(value(props, "Modifiers")), modifier)
    stacking = F.coalesce(enum(plain(value(props, "StackingType"))), F.lit("None"))
    limit = F.coalesce(value(props, "StackLimitCount").try_cast("int"), F.lit(0))
    given = value(props, "Period")
    period = F.coalesce(F.when(given.startswith("{"), F.get_json_object(given, "$.Value").try_cast("double")).otherwise(number(given)), F.lit(0.0))
    up = plain(value(props, "ParentClass", "Parent"))
    path = extract_asset_path(up)
    parent = F.when(path.isNotNull() & ~path.startswith("/Script/"), path).otherwise(extract_class_name(up))
    shown = F.transform(F.slice(mods, 1, 5), lambda m: F.concat(m["attribute"], F.lit(" "), short(m["magnitude"]), F.lit(" ("), m["operation"], F.lit(")")))
    parts = [
        F.concat(name, F.lit(" is a GameplayEffect"), F.when(duration != "", F.concat(F.lit(" ("), duration, F.lit(")"))).otherwise("")),
        labelled("Parent: ", tail(parent)),
        listed("Modifiers: ", shown, 5),
        F.when(~stacking.isin("", "None"), F.concat(F.lit("Stacking: "), stacking, F.lit(" (limit "), limit.cast("string"), F.lit(")"))),
        F.when(period > 0, F.concat(F.lit("Period: "), period.cast("string"), F.lit("s"))),
    ]
    tags = F.struct(required("InheritableGameplayEffectTags", "InheritableOwnedTagsContainer").alias("inheritable"), required("ApplicationTagRequirements").alias("application"), required("OngoingTagRequirements").alias("ongoing"), required("RemovalTagRequirements").alias("removal"))
    meta = F.struct(F.coalesce(F.nullif(duration, F.lit("")), F.lit("Instant")).alias("duration_policy"), mods.alias("modifiers"), F.struct(stacking.alias("type"), limit.alias("limit")).alias("stacking"), F.when(period > 0, period).alias("period"), parent.alias("parent_class"), tags.alias("tag_requirements"))
    return parts, meta, links(F.col("_refs"))


def any_class(name: Column, cls: Column, props: Column):
    names = F.filter(F.transform(props, lambda p: p["name"]), lambda n: n != "")
    parts = [F.concat(name, F.lit(" is a "), cls), listed("Properties: ", names, 15), listed("References: ", F.transform(F.col("_refs"), last_segment), 10)]
    return parts, F.struct(names.alias("properties")), nothing(LINKS)


Extractor = Callable[[Column, Column, Column], tuple[list[Column], Column, Column]]
# Classes of data assets that have texts of their own.
EXTRACTORS: dict[str, Extractor] = {
    "LyraAbilitySet": ability_set, "LyraPawnData": pawn_data, "LyraInputConfig": input_config,
    "LyraUserFacingExperienceDefinition": playlist, "LyraContextEffectsLibrary": context_effects, "GameplayEffect": gameplay_effect,
}


def _merged(head: Column, meta: Column) -> Column:
    """Two structs as one JSON object."""
    inside = lambda c: F.nullif(F.regexp_replace(F.to_json(c), r"^\{|\}$", ""), F.lit(""))
    return F.concat(F.lit("{"), F.concat_ws(",", inside(head), inside(meta)), F.lit("}"))


def data_asset_docs(records: DataFrame, registry: dict[str, Extractor] | None = None, *, parents: tuple[DataFrame, DataFrame, list[str]] | None = None, own_types: tuple[str, ...] = ("GameplayEffect",)) -> DataFrame:
    """One document of each data asset. Its main export is the first that is no metadata; of a subclass
    of a blueprint the properties are those of its ``Default__`` export, with the main one's
    ParentClass, and its class is its asset type. The extractor of the class, from ``registry``, gives
    text, metadata and typed references; other classes get their properties and references, raw exports
    a stub. All gameplay tags go into text and metadata; a parent gives an ``inherits_from`` reference,
    looked up by name in ``parents`` (docs, light assets, engine classes) where given."""
    registry = EXTRACTORS if registry is None else registry
    r = with_exports(records)
    is_meta = lambda e: F.coalesce(e["type"] == "MetaDataExport", F.lit(False)) | F.coalesce(e["name"] == "PackageMetaData", F.lit(False)) | e["class"].isin("MetaData", "Package")
    r = r.withColumn("_main", F.get(F.filter("exports", lambda e: ~is_meta(e)), F.lit(0))).withColumn("_default", F.get(F.filter("exports", lambda e: F.coalesce(e["name"].startswith("Default__"), F.lit(False))), F.lit(0)))
    own, kind = F.col("_main.properties"), F.coalesce("asset_type", F.lit("DataAsset"))
    subclass = (F.col("_main.class") == "Blueprint") & (kind != "Blueprint") & F.col("_default").isNotNull()
    no_props = nothing("array<struct<name:string,value:string>>")
    up = F.slice(F.filter(F.coalesce(own, no_props), lambda p: p["name"] == "ParentClass"), 1, 1)
    props = F.coalesce(F.when(subclass, F.concat(up, F.coalesce("_default.properties", no_props))).otherwise(own), no_props)
    cls = F.when(subclass, kind).otherwise(F.coalesce("_main.class", F.lit("DataAsset")))
    raw = F.coalesce(F.col("_main.type") == "RawExport", F.lit(False))
    r = r.withColumn("_raw", raw).withColumn("_class", cls).withColumn("_props", F.when(raw, no_props).otherwise(props)).drop("exports", "_main", "_default")
    r = r.withColumn("_json", together(F.col("_props"))).withColumn("_refs", paths_in(F.col("_json"))).withColumn("_tags", collect_tags(F.col("_json")))

    def of_class(extract: Extractor) -> Column:
        parts, meta, flat = extract(F.col("name"), F.col("_class"), F.col("_props"))
        head = F.struct(F.col("_class").alias("class"), F.when(F.size("_tags") > 0, F.col("_tags")).alias("gameplay_tags"))
        tags = listed("Tags: ", F.col("_tags"), ALL)
        return F.struct(sentence(*parts, tags).alias("text"), _merged(head, meta).alias("meta"), flat.cast(LINKS).alias("links"))

    stub = F.struct(F.concat("name", F.lit(" is a "), "_class", F.lit(" (raw data, properties not parseable).")).alias("text"), _merged(F.struct(F.col("_class").alias("class")), F.struct(F.lit(True).alias("raw_export"))).alias("meta"), nothing(LINKS).alias("links"))
    chosen = reduce(lambda w, kv: w.when(F.col("_class") == kv[0], of_class(kv[1])), registry.items(), F.when(F.col("_raw"), stub)).otherwise(of_class(any_class))
    r = r.withColumn("_made", chosen).withColumn("parent", F.get_json_object("_made.meta", "$.parent_class"))
    if parents is None:
        to = F.when(F.col("parent").startswith("/"), F.concat(F.lit("asset:"), normalize_object_path(F.col("parent")))).otherwise(F.concat(F.lit("class:"), F.regexp_replace("parent", r"_C$", "")))
        r = r.withColumn("parent_ref", F.when(F.col("parent").isin("", "Unknown", "None", "Object"), None).otherwise(to))
    else:
        r = resolve_parents(r, *parents)
    flat = F.concat("_made.links", F.when(F.col("parent_ref").isNotNull(), F.array(link(F.col("parent_ref"), "inherits_from"))).otherwise(nothing(LINKS)))
    r = r.withColumn("_links", flat)
    first = F.when(F.col("_raw"), F.coalesce("refs", nothing())).otherwise(F.coalesce("_refs", nothing()))
    refs = F.array_distinct(F.concat(first, F.transform("_links", lambda x: x["ref"])))
    shown_type = F.when(F.col("_raw"), kind).when(F.col("_class").isin(*own_types), F.col("_class")).otherwise("DataAsset")
    return document(r, F.concat(F.lit("asset:"), "path"), "asset_summary", F.col("name"), shown_type, F.col("_made.text"), F.col("_made.meta"), refs, typed(F.col("_links")))


def effect_docs(records: DataFrame) -> DataFrame:
    """Gameplay effects: data assets whose asset type is that."""
    return data_asset_docs(records.withColumn("asset_type", F.lit("GameplayEffect")))


# Classes of actions, the property of each that holds its entries, and the edge types of
# the fields of an entry.
ACTIONS = {
    "GameFeatureAction_AddWidgets": [("Layout", "LayoutClass", "uses_layout"), ("Widgets", "WidgetClass", "registers_widget")],
    "GameFeatureAction_AddComponents": [("ComponentList", "ComponentClass", "adds_component"), ("ComponentList", "ActorClass", "targets_actor")],
    "GameFeatureAction_AddInputContextMapping": [("InputMappings", "InputMapping", "maps_input")],
    "GameFeatureAction_AddInputBinding": [("InputConfigs", "InputConfig", "maps_input")],
    "GameFeatureAction_DataRegistry": [("RegistriesToAdd", None, "uses_asset")],
}


def game_feature_docs(records: DataFrame, *, types: tuple[str, ...] = ("GameFeatureData",)) -> DataFrame:
    """One document of each feature data or action set: its actions in the order of its exports, each
    reference typed by action and field; features that it enables; action sets and pawn data of its
    ``Default__`` export; tags; then the references of the file that no action has."""
    r = with_exports(records).withColumn("asset_type", F.coalesce("asset_type", F.lit(types[0])))

    def refs_of(e: Column, prop: str, key: str | None) -> Column:
        found = entries(value(e["properties"], prop))
        paths = F.transform(found, lambda x: extract_asset_path(x if key is None else field(x, key)))
        return F.filter(paths, lambda p: p.isNotNull())

    def tagged(x: Column, key: str, slot: str, before: str, after: str) -> Column:
        bare = last_segment(extract_asset_path(field(x, key)))
        return F.when(tag(x, slot) != "", F.concat(bare, F.lit(before), tag(x, slot), F.lit(after))).otherwise(bare)

    def said(e: Column) -> Column:
        """The parts of the text of one export."""
        rows = lambda prop, key: F.filter(objects(value(e["properties"], prop)), lambda x: extract_asset_path(field(x, key)).isNotNull())
        names = lambda prop, key: F.transform(refs_of(e, prop, key), last_segment)
        layout = F.transform(rows("Layout", "LayoutClass"), lambda x: tagged(x, "LayoutClass", "LayerID", " (tag ", ")"))
        widgets = F.transform(rows("Widgets", "WidgetClass"), lambda x: tagged(x, "WidgetClass", "SlotID", "→", ""))
        class_of = lambda x, key: F.coalesce(extract_class_name(field(x, key)), F.lit(""))
        components = F.transform(objects(value(e["properties"], "ComponentList")), lambda x: F.concat(class_of(x, "ComponentClass"), F.lit("→"), class_of(x, "ActorClass")))
        of = lambda *parts: F.filter(F.array(*parts), lambda p: p.isNotNull())
        cls = e["class"]
        return (
            F.when(cls == "GameFeatureAction_AddWidgets", of(labelled("Layout: ", F.try_element_at(layout, F.lit(-1))), listed("Widgets: ", widgets, ALL)))
            .when(cls == "GameFeatureAction_AddComponents", of(listed("Components: ", components, ALL)))
            .when(cls == "GameFeatureAction_AddInputContextMapping", of(listed("Input: ", names("InputMappings", "InputMapping"), ALL)))
            .when(cls == "GameFeatureAction_AddInputBinding", of(listed("Input bindings: ", names("InputConfigs", "InputConfig"), ALL)))
            .when(cls == "GameFeatureAction_DataRegistry", of(listed("Registries: ", names("RegistriesToAdd", None), ALL)))
            .otherwise(nothing())
        )

    is_default = lambda e: F.coalesce(e["name"].startswith("Default__") & (e["type"] == "NormalExport"), F.lit(False)) & ~e["class"].isin(*ACTIONS, *types)

    def linked(e: Column) -> Column:
        out = F.when(is_default(e), F.concat(links(F.filter(F.transform(entries(value(e["properties"], "ActionSets")), extract_asset_path), lambda x: x.isNotNull()), "includes_action_set"), links(F.array(extract_asset_path(plain(value(e["properties"], "DefaultPawnData")))), "uses_pawn_data")))
        for cls, fields in ACTIONS.items():
            out = out.when(e["class"] == cls, F.concat(*[links(refs_of(e, p, k), kind) for p, k, kind in fields]))
        return out.otherwise(nothing(LINKS))

    enabled = F.array_distinct(F.flatten(F.transform(F.filter("exports", lambda e: e["class"].isin(*types) | is_default(e)), lambda e: entries(value(e["properties"], "GameFeaturesToEnable")))))
    every = F.flatten(F.transform("exports", lambda e: e["properties"]))
    r = r.withColumn("_features", enabled).withColumn("_parts", F.flatten(F.transform("exports", said))).withColumn("_links", F.flatten(F.transform("exports", linked))).withColumn("_tags", collect_tags(together(every)))
    r = r.withColumn("_typed", typed(F.col("_links")))
    of_kind = lambda kind: F.map_keys(F.map_filter("_typed", lambda _, v: v == kind))
    text = sentence(F.concat("name", F.lit(" is a "), "asset_type"), listed("Enables features: ", F.col("_features"), ALL), F.when(F.size("_parts") > 0, F.array_join("_parts", ". ")), listed("ActionSets: ", F.transform(of_kind("includes_action_set"), last_segment), ALL), listed("DefaultPawnData: ", F.transform(of_kind("uses_pawn_data"), last_segment), ALL), listed("Tags: ", F.col("_tags"), ALL))
    cues = F.flatten(F.transform(F.filter("exports", lambda e: e["class"] == "GameFeatureAction_AddGameplayCuePath"), lambda e: F.transform(objects(value(e["properties"], "DirectoryPathsToAdd")), lambda x: F.coalesce(field(x, "Path"), F.lit("")))))
    meta = F.struct(F.col("_parts").alias("actions"), cues.alias("cue_paths"), F.col("_tags").alias("gameplay_tags"), F.col("_features").alias("features_to_enable"), of_kind("includes_action_set").alias("action_sets"), of_kind("uses_pawn_data").alias("pawn_data"))
    refs = F.array_distinct(F.concat(F.transform("_links", lambda x: x["ref"]), F.coalesce("refs", nothing())))
    return document(r, F.concat(F.lit("asset:"), "path"), "asset_summary", F.col("name"), F.col("asset_type"), text, F.to_json(meta), refs, F.col("_typed"))


HEX = "^[0-9A-Fa-f]+$"


def input_docs(records: DataFrame) -> DataFrame:
    """Input actions and mapping contexts (by ``asset_type``). Actions have the display name, category
    (no hash of hex digits), triggers and modifiers of their exports and class references; contexts map
    the actions (``IA_``) among their references, by ``maps_input``."""
    r = with_exports(records).withColumn("refs", F.coalesce("refs", nothing()))
    settings = F.flatten(F.transform(F.filter("exports", lambda e: e["class"] == "PlayerMappableKeySettings"), lambda e: e["properties"]))
    categories = F.filter(settings, lambda p: p["name"].isin("DisplayName", "DisplayCategory") & ~F.coalesce(plain(p["value"]), F.lit("")).rlike(HEX) & (plain(p["value"]) != ""))
    label = F.coalesce(plain(value(settings, "Name")), F.lit(""))
    category = F.coalesce(plain(F.try_element_at(categories, F.lit(-1))["value"]), F.lit(""))
    classes = F.filter(F.transform("refs", lambda x: F.when(x.startswith("/Script/"), F.substr(x, F.lit(9)))), lambda x: x.isNotNull())
    seen = F.concat(F.transform("exports", lambda e: e["class"]), classes)
    without = lambda start: F.array_distinct(F.filter(F.transform(F.filter(seen, lambda c: c.startswith(start)), lambda c: F.replace(last_segment(c), F.lit(start), F.lit(""))), lambda c: c != ""))
    a = r.filter("asset_type = 'InputAction'").withColumn("_label", label).withColumn("_category", category).withColumn("_triggers", without("InputTrigger")).withColumn("_modifiers", without("InputModifier"))
    text = sentence(F.concat("name", F.lit(" is an InputAction")), labelled("Display name: ", F.col("_label")), labelled("Category: ", F.col("_category")), listed("Triggers: ", F.col("_triggers"), ALL), listed("Modifiers: ", F.col("_modifiers"), ALL))
    meta = F.to_json(F.struct(F.col("_label").alias("display_name"), F.col("_category").alias("display_category"), F.col("_triggers").alias("triggers"), F.col("_modifiers").alias("modifiers")))
    actions = document(a, F.concat(F.lit("asset:"), "path"), "asset_summary", F.col("name"), F.lit("InputAction"), text, meta, F.col("refs"))

    mapped = F.filter("refs", lambda x: ~x.startswith("/Script/") & last_segment(x).startswith("IA_"))
    triggers = F.array_sort(F.array_distinct(F.transform(F.filter(classes, lambda c: c.startswith("InputTrigger")), lambda c: F.replace(c, F.lit("InputTrigger"), F.lit("")))))
    modifiers = F.array_sort(F.array_distinct(F.filter(classes, lambda c: ~c.startswith("InputTrigger") & c.contains("Modifier"))))
    c = r.filter("asset_type = 'InputMappingContext'").withColumn("_mapped", mapped).withColumn("_names", F.array_sort(F.transform(mapped, last_segment))).withColumn("_triggers", triggers).withColumn("_modifiers", modifiers)
    count = F.size("_names")
    text = sentence(F.concat("name", F.lit(" is an InputMappingContext")), F.when(count > 0, F.concat(F.lit("Maps "), count.cast("string"), F.lit(" InputActions: "), F.array_join("_names", ", "))), listed("Triggers: ", F.col("_triggers"), ALL), listed("Modifiers: ", F.col("_modifiers"), ALL))
    meta = F.to_json(F.struct(F.col("_names").alias("mapped_actions"), count.alias("action_count"), F.col("_triggers").alias("trigger_classes"), F.col("_modifiers").alias("modifier_classes")))
    contexts = document(c, F.concat(F.lit("asset:"), "path"), "asset_summary", F.col("name"), F.lit("InputMappingContext"), text, meta, F.col("refs"), typed(links(F.col("_mapped"), "maps_input")))
    return actions.unionByName(contexts)
