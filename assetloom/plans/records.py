"""Queries that build documents from records derived from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetloom.functions.text import collect_tags
from assetloom.operators import data_assets as A
from assetloom.operators import docs as D
from assetloom.plans.views import view, with_views

QUERIES, SQL = {}, {}
OUT = ["doc_id", "text", "refs"]


def query(name: str, sql: str):
    def register(f):
        QUERIES[name] = lambda spark, d: shown(f(spark, d))
        SQL[name] = with_views("v_assets") + sql
        return f

    return register


def shown(docs):
    typed = F.transform("references_out", lambda r: F.concat_ws(" ", r, F.try_element_at("typed_references_out", r)))
    return docs.select("doc_id", "text", F.array_join(typed, ",").alias("refs"))


def assets(spark, d):
    empty = F.array().cast("array<string>")
    size = F.col("size").cast("int")
    names = lambda p: F.transform(F.sequence(F.lit(1), size % 4 + 1), lambda i: F.concat(F.lit(p), i.cast("string")))
    return view(spark, d, "v_assets").select(
        "id", "path", "name", F.lit("Actor").alias("parent"), F.lit("class:Actor").alias("parent_ref"), empty.alias("interfaces"), names("C").alias("components"), empty.alias("events"), empty.alias("variables"),
        empty.alias("function_names"), F.lit(0).alias("widget_count"), F.array(F.lit("/Game/X/A")).alias("refs"), names("W").alias("widget_names"), size.alias("size"),
    )


def listed(prefix: str, limit: int = 10) -> str:
    return "array_to_string(list_transform(range(1, CAST(size % 4 + 2 AS BIGINT)), lambda i: '" + prefix + "' || i), ', ')"


@query("asset_summary_docs", f" SELECT 'asset:' || path AS doc_id, name || ' is a DataAsset. inheriting from Actor. Components: ' || {listed('C')} || '.' AS text, '/Game/X/A,class:Actor inherits_from' AS refs FROM v_assets")
def _summary(spark, d):
    return D.asset_summary_docs(assets(spark, d).withColumn("asset_type", F.lit("DataAsset")))


def numbered(prefix: str, n: str) -> str:
    return f"array_to_string(list_transform(range(1, CAST(least({n}, 10) + 1 AS BIGINT)), lambda i: '{prefix}' || i), ', ')"


VARIABLES = f"CASE WHEN size % 12 > 0 THEN '. Variables: ' || {numbered('V', 'size % 12')} ELSE '' END"


@query("blueprint_docs", f""" SELECT 'asset:' || path AS doc_id, name || ' is a Blueprint. inheriting from Actor. Components: ' || {listed('C')} || '. Functions: Fire' || CASE WHEN id % 3 = 0 THEN ', Tick' ELSE '' END || {VARIABLES} || '.' AS text, '/Game/X/A,class:Actor inherits_from' AS refs FROM v_assets
  UNION ALL SELECT 'bp_func:' || path || '::Fire', 'Function Fire in ' || name || '. Flags: Public, Native. Parameters: out Hit: bool, Range: float' || CASE WHEN size % 13 > 0 THEN '. Calls: ' || {numbered('F', 'size % 13')} ELSE '' END || {VARIABLES}
    || CASE WHEN id % 2 = 0 THEN '. Contains conditional logic (' || CASE WHEN id % 5 = 0 THEN 'unknown' ELSE 'low' END || ' complexity)' ELSE '' END || '.', '/Game/X/A' FROM v_assets
  UNION ALL SELECT 'bp_func:' || path || '::Tick', 'Event Tick in ' || name || '. Flags: BlueprintEvent' || {VARIABLES} || '.', '/Game/X/A' FROM v_assets WHERE id % 3 = 0""")
def _blueprint(spark, d):
    a = assets(spark, d)
    many = lambda p, n: F.transform(F.slice(F.sequence(F.lit(1), F.lit(12)), F.lit(1), n), lambda i: F.concat(F.lit(p), i.cast("string")))
    param = lambda n, t, w: F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(w).alias("direction"))
    flow = F.struct((F.col("id") % 2 == 0).alias("has_branches"), F.when(F.col("id") % 5 != 0, "low").alias("complexity"))
    params = F.array(param("Hit", "bool", "out"), param("Range", "float", "in"))
    function = lambda n, flags, calls, f, p: F.struct(n.alias("name"), F.lit(flags).alias("flags"), calls.alias("calls"), f.alias("control_flow"), p.alias("params"))
    fire = function(F.lit("Fire"), "Public, Native", many("F", F.col("size") % 13), flow, params)
    null = lambda c: F.when(F.lit(False), c)
    tick = function(F.when(F.col("id") % 3 == 0, "Tick"), "BlueprintEvent", null(many("F", F.col("size") % 13)), null(flow), null(params))
    return D.blueprint_docs(a.withColumn("variables", many("V", F.col("size") % 12)).withColumn("functions", F.array(fire, tick)))


def _records_of_blueprints(spark, d):
    param = lambda n, t, w: F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(w).alias("direction"))
    flow = F.struct(F.lit(True).alias("has_branches"), F.lit("low").alias("complexity"))
    f = F.struct(F.lit("Fire").alias("name"), F.lit("Public, Native").alias("flags"), F.array(F.lit("Trace")).alias("calls"), flow.alias("control_flow"), F.array(param("Hit", "bool", "out"), param("Range", "float", "in")).alias("params"))
    return assets(spark, d).withColumn("functions", F.array(f))


def _snippets(spark, d):
    return D.semantic_snippet(D.blueprint_docs(_records_of_blueprints(spark, d))).select("doc_id", "snippet")


QUERIES["semantic_snippet"] = _snippets
SQL["semantic_snippet"] = with_views("v_assets") + """ SELECT 'asset:' || path AS doc_id, 'Blueprint ' || name || '. Parent: Actor. Functions: Fire' AS snippet FROM v_assets
  UNION ALL SELECT 'bp_func:' || path || '::Fire', substr('Blueprint function Fire in ' || path || '. Flags: Public, Native. Calls: Trace. Has conditional branches', 1, 260) FROM v_assets"""


@query("widget_docs", f""" SELECT 'asset:' || path AS doc_id, name || ' is a WidgetBlueprint. inheriting from Actor. Components: ' || {listed('C')} || '.' AS text, '/Game/X/A,class:Actor inherits_from' AS refs FROM v_assets
  UNION ALL SELECT 'widget:' || path || '/WidgetTree', 'Widget tree for ' || name || '. Root widget: W1. Contains widgets: ' || {listed('W')} || '. Hierarchy: Text(T) text=''hi''', '/Game/X/A' FROM v_assets""")
def _widget(spark, d):
    w = F.struct(F.lit("T").alias("name"), F.lit("Text").alias("type"), F.lit("hi").alias("text"))
    return D.widget_docs(assets(spark, d).withColumn("widgets", F.array(w)))


@query("material_docs", " SELECT 'material:' || path AS doc_id, CASE WHEN id % 2 = 0 THEN 'MaterialInstance ' ELSE 'Material ' END || name || CASE WHEN id % 2 = 0 THEN '. inherits from /Game/M/Base' ELSE '' END || '. Domain: Surface, Blend: Opaque, Shading: Lit. Scalar params: Size=' || size || '. Vector params: Tint. Texture params: Tex=/Game/T/Wood. Static switches: Use=true.' AS text, CASE WHEN id % 2 = 0 THEN '/Game/M/Base,' ELSE '' END || '/Game/X/A,/Game/T/Wood' AS refs FROM v_assets")
def _material(spark, d):
    lit = lambda v, n: F.lit(v).alias(n)
    r = assets(spark, d).select("path", "name", "refs", (F.col("id") % 2 == 0).alias("is_instance"), F.when(F.col("id") % 2 == 0, "/Game/M/Base").alias("parent"), lit("Surface", "domain"), lit("Opaque", "blend_mode"), lit("Lit", "shading_model"), F.create_map(F.lit("Size"), "size").alias("scalar_params"), F.create_map(F.lit("Tint"), F.array(F.lit(1.0))).alias("vector_params"), F.create_map(F.lit("Tex"), F.lit("/Game/T/Wood")).alias("texture_params"), F.create_map(F.lit("Use"), F.lit(True)).alias("static_switches"))
    return D.material_docs(r)


@query("material_function_docs", f" SELECT 'materialfunction:' || path AS doc_id, 'MaterialFunction ' || name || '. Inputs: ' || {listed('C')} || '. Outputs: ' || {listed('W')} || '.' AS text, '/Game/X/A' AS refs FROM v_assets")
def _material_function(spark, d):
    return D.material_function_docs(assets(spark, d).select("path", "name", "refs", F.lit("").alias("description"), F.col("components").alias("inputs"), F.col("widget_names").alias("outputs"), F.array().cast("array<string>").alias("params")))


@query("datatable_docs", f" SELECT 'datatable:' || path AS doc_id, 'DataTable ' || name || ' with struct Row. ' || size || ' rows. Columns: ' || {listed('C')} || '. Sample keys: ' || {listed('W')} || '.' AS text, '/Game/X/A' AS refs FROM v_assets")
def _datatable(spark, d):
    return D.datatable_docs(assets(spark, d).select("path", "name", "refs", F.lit("Row").alias("row_struct"), F.col("size").alias("row_count"), F.col("components").alias("columns"), F.col("widget_names").alias("sample_keys")))


# one export: class, name, type and its properties, names and JSON values in turn
def export(cls: str, name: str | None, type: str | None, *props: str) -> str:
    text = lambda v: "CAST(NULL AS STRING)" if v is None else f"'{v}'"
    pairs = ", ".join(f"named_struct('name', '{n}', 'value', {v})" for n, v in zip(props[::2], props[1::2], strict=True))
    return f"named_struct('class', '{cls}', 'name', {text(name)}, 'type', {text(type)}, 'properties', filter(array({pairs}), p -> p.value IS NOT NULL))"


def first(n: str, *items: str) -> str:
    """The JSON list of the first n of these texts."""
    return f"'[' || array_join(slice(array({', '.join(items)}), 1, CAST({n} AS INT)), ',') || ']'"


def records_of(spark, d, asset_type: str, exports: str, refs: str = "array('/Game/R/1')"):
    view(spark, d, "v_assets").createOrReplaceTempView("v_assets")
    return spark.sql(f"SELECT path, name, {asset_type} AS asset_type, {exports} AS exports, {refs} AS refs FROM v_assets")


TAG = """'{"_type":"GameplayTag","TagName":"%s"}'"""


@query("game_feature_docs", """, t AS (SELECT *, size % 3 AS w, id % 2 = 0 AS even FROM v_assets)
  SELECT 'asset:' || path AS doc_id, name || ' is a GameFeatureData. Enables features: F1, F2' || CASE WHEN even THEN '. Layout: W_Top (tag UI.Top)' ELSE '' END
    || CASE w WHEN 0 THEN '' WHEN 1 THEN '. Widgets: W_' || name || '→UI.Slot' ELSE '. Widgets: W_' || name || '→UI.Slot, W_Two' END || CASE WHEN id % 3 = 0 THEN '. Components: C_Aim→Pawn' ELSE '' END
    || '. Input: IMC_' || name || '. Registries: DR_1. ActionSets: AS_1. DefaultPawnData: Hero' || CASE WHEN even OR w > 0 THEN '. Tags: ' || CASE WHEN w > 0 THEN 'UI.Slot' ELSE '' END || CASE WHEN even AND w > 0 THEN ', ' ELSE '' END || CASE WHEN even THEN 'UI.Top' ELSE '' END ELSE '' END || '.' AS text,
    CASE WHEN even THEN '/Game/UI/W_Top uses_layout,' ELSE '' END || CASE WHEN w > 0 THEN '/Game/UI/W_' || name || ' registers_widget,' ELSE '' END || CASE WHEN w > 1 THEN '/Game/UI/W_Two registers_widget,' ELSE '' END
    || CASE WHEN id % 3 = 0 THEN '/Game/C/C_Aim adds_component,/Script/Engine targets_actor,' ELSE '' END || '/Game/In/IMC_' || name || ' maps_input,/Game/D/DR_1 uses_asset,/Game/S/AS_1 includes_action_set,/Game/P/Hero uses_pawn_data,/Game/R/1' AS refs FROM t""")
def _feature(spark, d):
    layout = f"""'{{"LayoutClass":"(, /Game/UI/W_Top.W_Top_C, )","LayerID":' || {TAG % "UI.Top"} || '}}'"""
    widgets = first("size % 3", f"""'{{"WidgetClass":"/Game/UI/W_' || name || '","SlotID":' || {TAG % "UI.Slot"} || '}}'""", """'{"WidgetClass":"/Game/UI/W_Two"}'""")
    component = """CASE WHEN id % 3 = 0 THEN '[{"ActorClass":"(/Script/Engine, Pawn, )","ComponentClass":"/Game/C/C_Aim"},7]' END"""
    every = ", ".join([
        export("GameFeatureAction_AddWidgets", None, None, "Layout", f"CASE WHEN id % 2 = 0 THEN '[' || {layout} || ']' END", "Widgets", widgets),
        export("GameFeatureAction_AddComponents", None, None, "ComponentList", component),
        export("GameFeatureAction_AddInputContextMapping", None, None, "InputMappings", """'[{"InputMapping":"/Game/In/IMC_' || name || '","Priority":1}]'"""),
        export("GameFeatureAction_DataRegistry", None, None, "RegistriesToAdd", "'[\"/Game/D/DR_1\",null]'"),
        export("GameFeatureData", None, None, "GameFeaturesToEnable", "'[\"F1\"]'"),
        export("Experience_C", "Default__E", "NormalExport", "ActionSets", "'[\"/Game/S/AS_1\"]'", "DefaultPawnData", "'\"/Game/P/Hero\"'", "GameFeaturesToEnable", "'[\"F1\",\"F2\"]'"),
    ])
    return A.game_feature_docs(records_of(spark, d, "'GameFeatureData'", f"array({every})"))


@query("input_docs", """ SELECT 'asset:' || path AS doc_id, CASE WHEN id % 2 = 0 THEN name || ' is an InputAction' || CASE WHEN size % 2 = 0 THEN '. Display name: Jump' || size ELSE '' END || CASE WHEN size % 3 = 0 THEN '. Category: Moves' ELSE '' END || '. Triggers: Hold, Down. Modifiers: Negate.'
    ELSE name || ' is an InputMappingContext' || CASE WHEN size % 3 > 0 THEN '. Maps ' || size % 3 || ' InputActions: IA_A' || CASE WHEN size % 3 = 2 THEN ', IA_' || lower(name) ELSE '' END ELSE '' END || '. Triggers: Down. Modifiers: InputModifierNegate.' END AS text,
    CASE WHEN id % 2 = 0 THEN '/Script/InputTriggerDown,/Script/InputModifierNegate' ELSE CASE WHEN size % 3 = 2 THEN '/Game/I/IA_' || lower(name) || ' maps_input,' ELSE '' END || CASE WHEN size % 3 > 0 THEN '/Game/I/IA_A maps_input,' ELSE '' END || '/Game/I/Other,/Script/InputTriggerDown,/Script/InputModifierNegate' END AS refs FROM v_assets""")
def _input(spark, d):
    settings = export("PlayerMappableKeySettings", None, None, "Name", "CASE WHEN size % 2 = 0 THEN '\"Jump' || size || '\"' END", "DisplayName", "CASE WHEN size % 3 = 0 THEN '\"Moves\"' END", "DisplayCategory", "'\"00FFAB\"'")
    every = f"array({settings}, {export('InputTriggerHold', None, None, 'X', 'CAST(NULL AS STRING)')}, {export('InputTriggerHold', None, None, 'X', 'CAST(NULL AS STRING)')})"
    mapped = "concat(slice(array('/Game/I/IA_' || lower(name), '/Game/I/IA_A'), CAST(3 - size % 3 AS INT), 2), array('/Game/I/Other'))"
    refs = f"concat(CASE WHEN id % 2 = 0 THEN array() ELSE {mapped} END, array('/Script/InputTriggerDown', '/Script/InputModifierNegate'))"
    return A.input_docs(records_of(spark, d, "CASE WHEN id % 2 = 0 THEN 'InputAction' ELSE 'InputMappingContext' END", every, refs))


@query("data_asset_docs", """, t AS (SELECT *, id % 7 AS n, size % 3 AS w, size % 2 = 0 AS even FROM v_assets)
  SELECT 'asset:' || path AS doc_id, name || CASE n
    WHEN 0 THEN ' is a LyraAbilitySet' || CASE w WHEN 0 THEN '' WHEN 1 THEN '. Grants abilities: A_' || name || ' (InputTag.K)' ELSE '. Grants abilities: A_' || name || ' (InputTag.K), A2' END || CASE WHEN w > 0 THEN '. Tags: InputTag.K.' ELSE '.' END
    WHEN 1 THEN ' is a LyraPawnData. PawnClass: B_' || name || CASE w WHEN 0 THEN '' WHEN 1 THEN '. AbilitySets: S1' ELSE '. AbilitySets: S1, S2' END || CASE WHEN even THEN '. InputConfig: Cfg' ELSE '' END || '. DefaultCameraMode: Engine.'
    WHEN 2 THEN ' is a LyraInputConfig. NativeInputActions: IA_' || name || '->InputTag.K' || CASE WHEN even THEN '. AbilityInputActions: IA_Jump' ELSE '' END || '. Tags: InputTag.K.'
    WHEN 3 THEN ' is a LyraUserFacingExperienceDefinition. Map: L_' || name || '. Experience: B_Exp' || CASE WHEN w > 0 THEN '. MaxPlayers: ' || w ELSE '' END || CASE WHEN even THEN '. LoadingScreenWidget: W_Load' ELSE '' END || '.'
    WHEN 4 THEN ' is a LyraContextEffectsLibrary. ContextEffects: FX.A (Wood, Stone)' || CASE WHEN even THEN '; FX.B' ELSE '' END || '. Tags: FX.A, ' || CASE WHEN even THEN 'FX.B, ' ELSE '' END || 'Surface.Wood.'
    WHEN 5 THEN ' is a MyAsset. Properties: Size, Link. References: X_' || name || '.' ELSE ' is a MyRaw (raw data, properties not parseable).' END AS text,
    CASE n WHEN 0 THEN CASE w WHEN 0 THEN '' WHEN 1 THEN '/Game/GA/A_' || name || ' uses_asset' ELSE '/Game/GA/A_' || name || ' uses_asset,/Game/GA/A2 uses_asset' END
    WHEN 1 THEN '/Game/H/B_' || name || CASE w WHEN 0 THEN '' WHEN 1 THEN ',/Game/S/S1 uses_asset' ELSE ',/Game/S/S1 uses_asset,/Game/S/S2 uses_asset' END || CASE WHEN even THEN ',/Game/I/Cfg uses_asset' ELSE '' END || ',/Script/Engine'
    WHEN 2 THEN '/Game/I/IA_' || name || ' uses_asset' || CASE WHEN even THEN ',/Game/I/IA_Jump uses_asset' ELSE '' END WHEN 3 THEN '/Game/M/L_' || name || CASE WHEN even THEN ',/Game/UI/W_Load uses_asset' ELSE '' END
    WHEN 4 THEN '' WHEN 5 THEN '/Game/L/X_' || name ELSE '/Game/R/1' END AS refs FROM t""")
def _data_asset(spark, d):
    key = TAG % "InputTag.K"
    entry = lambda field, path, tag: f"""'{{"{field}":"' || {path} || '","InputTag":' || {tag} || '}}'"""
    fx = lambda tag, context: f"""'{{"EffectTag":' || {TAG % tag} || '{context}}}'"""
    by = [
        export("LyraAbilitySet", None, "NormalExport", "GrantedGameplayAbilities", first("size % 3", entry("Ability", "'/Game/GA/A_' || name", key), entry("Ability", "'(, /Game/GA/A2.A2_C, )'", TAG % "None"))),
        export("LyraPawnData", None, "NormalExport", "PawnClass", "'\"/Game/H/B_' || name || '\"'", "AbilitySets", first("size % 3", "'\"/Game/S/S1\"'", "'\"/Game/S/S2\"'"), "InputConfig", "CASE WHEN size % 2 = 0 THEN '/Game/I/Cfg' END", "DefaultCameraMode", "'\"(/Script/Engine, CameraMode, )\"'"),
        export("LyraInputConfig", None, "NormalExport", "NativeInputActions", f"'[' || {entry('InputAction', "'/Game/I/IA_' || name", key)} || ']'", "AbilityInputActions", """CASE WHEN size % 2 = 0 THEN '[{"InputAction":"/Game/I/IA_Jump"},"x"]' END"""),
        export("LyraUserFacingExperienceDefinition", None, "NormalExport", "MapID", """'{"PrimaryAssetName":"/Game/M/L_' || name || '"}'""", "ExperienceID", """'{"PrimaryAssetName":"B_Exp"}'""", "MaxPlayerCount", "CAST(size % 3 AS STRING)", "LoadingScreenWidget", "CASE WHEN size % 2 = 0 THEN '\"(, /Game/UI/W_Load.W_Load_C, )\"' END"),
        export("LyraContextEffectsLibrary", None, "NormalExport", "ContextEffects", first("2 + (size + 1) % 2", fx("FX.A", ',"Context":{"_type":"GameplayTagContainer","tags":["Surface.Wood"]}'), fx("FX.A", ',"Context":"(Surface.Stone)"'), fx("FX.B", ""))),
        export("MyAsset", None, "NormalExport", "Size", "CAST(size AS STRING)", "Link", """'{"Asset":["/Game/L/X_' || name || '.X"]}'"""),
        export("MyRaw", None, "RawExport", "Size", "'1'"),
    ]
    main = "CASE id % 7 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(by)) + " END"
    return A.data_asset_docs(records_of(spark, d, "'DataAsset'", f"array({export('MetaData', 'PackageMetaData', 'MetaDataExport', 'X', "'1'")}, {main})"))


@query("effect_docs", """, t AS (SELECT *, id % 2 = 0 AS even, least(size % 7, 5) AS m FROM v_assets)
  SELECT 'asset:' || path AS doc_id, name || ' is a GameplayEffect' || CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN ' (HasDuration)' ELSE ' (Instant)' END || CASE WHEN even THEN '. Parent: Base' ELSE '. Parent: GameplayEffect' END
    || CASE WHEN m > 0 THEN '. Modifiers: ' || array_to_string(list_transform(range(1, CAST(m + 1 AS BIGINT)), lambda i: 'A' || i || CASE WHEN i % 2 = 1 THEN ' -' || i || ' (Additive)' ELSE ' +' || i || '.25 (Multiply)' END), ', ') ELSE '' END
    || CASE WHEN id % 5 = 0 THEN '. Stacking: AggregateBySource (limit ' || size || ')' ELSE '' END || CASE id % 4 WHEN 0 THEN '. Period: 0.5s' WHEN 1 THEN '. Period: 2.0s' ELSE '' END || CASE WHEN even THEN '. Tags: State.Dead' ELSE '' END || '.' AS text,
    CASE WHEN even THEN '/Game/GE/Base uses_asset,asset:/Game/GE/Base inherits_from' ELSE '/Script/GameplayAbilities uses_asset,class:GameplayEffect inherits_from' END AS refs FROM t""")
def _effect(spark, d):
    odd = lambda k: f"""'{{"Attribute":{{"AttributeName":"A{k}"}},"ModifierOp":"EOp::Additive","ModifierMagnitude":-{k}}}'"""
    even = lambda k: f"""'{{"Attribute":"A{k}","ModifierOp":"Multiply","Magnitude":{{"MagnitudeCalculationType":"EM::ScalableFloat","ScalableFloatMagnitude":{{"Value":{k}.25}}}}}}'"""
    mods = first("size % 7", *[odd(k) if k % 2 else even(k) for k in range(1, 7)])
    parent = "CASE WHEN id % 2 = 0 THEN '\"(, /Game/GE/Base.Base_C, )\"' ELSE '\"(/Script/GameplayAbilities, GameplayEffect, )\"' END"
    own = export("E_C", "Default__E_C", "NormalExport", "DurationPolicy", "CASE id % 3 WHEN 1 THEN '\"EDur::HasDuration\"' WHEN 2 THEN 'Instant' END", "Modifiers", mods, "StackingType", "CASE WHEN id % 5 = 0 THEN '\"EStack::AggregateBySource\"' END", "StackLimitCount", "CAST(size AS STRING)", "Period", """CASE id % 4 WHEN 0 THEN '{"Value":0.5}' WHEN 1 THEN '2.0' END""", "ApplicationTagRequirements", """CASE WHEN id % 2 = 0 THEN '{"_type":"GameplayTagContainer","tags":["State.Dead","None"]}' END""")
    return A.effect_docs(records_of(spark, d, "'GameplayEffect'", f"array({export('Blueprint', 'E', 'NormalExport', 'ParentClass', parent)}, {own})"))


def _tags(spark, d):
    value = F.concat(F.lit('{"_type":"GameplayTag","TagName":"Size.S'), F.col("size").cast("string"), F.lit('"}'))
    prop = F.struct(F.lit("Tag").alias("name"), value.alias("value"))
    records = view(spark, d, "v_assets").select("path", F.array(F.struct(F.lit("A").alias("class"), F.array(prop, prop).alias("properties"))).alias("exports"))
    return D.export_tags(records, collect_tags)


QUERIES["export_tags"] = _tags
SQL["export_tags"] = with_views("v_assets") + " SELECT path, 'Size.S' || size AS tag FROM v_assets"
