"""Record tables to documents: text, metadata, references and typed references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.functions.paths import module_of

#: Names listed in a text, and in metadata.
IN_TEXT, IN_METADATA = 10, 15
STRINGS = "array<string>"


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(STRINGS))


def listed(label: str, items: Column, n: int = IN_TEXT) -> Column:
    """``label: a, b, c`` of the first n items; null if there are none."""
    return F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(F.slice(items, 1, n), ", ")))


def sentence(*parts: Column) -> Column:
    """The parts that aren't null, joined by full stops."""
    return F.concat(F.concat_ws(". ", *parts), F.lit("."))


def document(df: DataFrame, doc_id: Column, type: str, name: Column, asset_type: Column, text: Column, metadata: Column, references: Column, typed: Column | None = None) -> DataFrame:
    """Documents of ``df``; ``metadata`` is JSON text."""
    no_types = F.map_from_arrays(F.array().cast(STRINGS), F.array().cast(STRINGS))
    return df.select(
        doc_id.alias("doc_id"),
        F.lit(type).alias("type"),
        "path",
        name.alias("name"),
        module_of(F.col("path")).alias("module"),
        asset_type.alias("asset_type"),
        text.alias("text"),
        metadata.alias("metadata"),
        references.alias("references_out"),
        (no_types if typed is None else typed).alias("typed_references_out"),
    )


def summary_text(name: Column, kind: Column, parent: Column, widgets: Column) -> Column:
    return sentence(
        F.concat(name, F.lit(" is a "), kind),
        F.when(F.coalesce(parent, F.lit("")) != "", F.concat(F.lit("inheriting from "), parent)),
        listed("implementing ", _list("interfaces"), 5),
        F.when(widgets > 0, F.concat(F.lit("containing "), widgets.cast("string"), F.lit(" widgets"))),
        listed("Components: ", _list("components")),
        listed("Events: ", _list("events")),
        listed("Functions: ", _list("function_names")),
        listed("Variables: ", _list("variables")),
    )


def asset_summary_docs(records: DataFrame) -> DataFrame:
    """``records``: path, name, asset_type, parent, interfaces, components, events, function_names,
    variables, widget_count, refs, parent_ref. The parent, if known, is a typed reference."""
    head = lambda c: F.slice(_list(c), 1, IN_METADATA).alias(c.replace("function_names", "functions"))
    meta = F.struct(F.col("widget_count"), F.size(_list("function_names")).alias("function_count"), F.coalesce("parent", F.lit("")).alias("parent_class"), head("events"), head("function_names"), head("components"), head("variables"), F.slice(_list("interfaces"), 1, 10).alias("interfaces"))
    up = F.col("parent_ref")
    refs = F.when(up.isNull(), _list("refs")).otherwise(F.array_union(_list("refs"), F.array(up)))
    typed = F.when(up.isNotNull(), F.create_map(up, F.lit("inherits_from"))).otherwise(F.map_from_arrays(F.array().cast(STRINGS), F.array().cast(STRINGS)))
    return document(records, F.concat(F.lit("asset:"), "path"), "asset_summary", F.col("name"), F.col("asset_type"), summary_text(F.col("name"), F.col("asset_type"), F.col("parent"), F.col("widget_count")), F.to_json(meta), refs, typed)


def blueprint_docs(records: DataFrame) -> DataFrame:
    """A summary of each blueprint, and a document of each function. ``records``: path, name, parent,
    interfaces, components, events, variables, functions (array of name, flags, calls, control_flow,
    params), refs, parent_ref. Variables and references of functions are those of the record, without the
    parent; functions without a name have no document."""
    r = records.withColumn("asset_type", F.lit("Blueprint")).withColumn("widget_count", F.lit(0)).withColumn("function_names", F.transform("functions", lambda f: f["name"]))
    f = records.select("path", F.col("name").alias("asset"), "refs", _list("variables").alias("variables"), F.explode("functions").alias("f")).filter("f.name <> ''").withColumn("flags", F.filter(F.split(F.coalesce("f.flags", F.lit("")), r",\s*"), lambda x: x != ""))
    is_event = F.array_contains("flags", "BlueprintEvent") | F.array_contains("flags", "Event")
    way = lambda p: F.when(p["direction"] == "out", "out ").when(p["direction"] == "return", "returns ").otherwise("")
    params = F.transform(F.col("f.params"), lambda p: F.concat(way(p), p["name"], F.lit(": "), p["type"]))
    text = sentence(
        F.concat(F.when(is_event, "Event ").otherwise("Function "), F.col("f.name"), F.lit(" in "), "asset"),
        listed("Flags: ", F.col("flags"), 1 << 20),
        listed("Parameters: ", F.coalesce(params, F.array().cast(STRINGS)), 1 << 20),
        listed("Calls: ", F.coalesce("f.calls", F.array().cast(STRINGS))),
        listed("Variables: ", F.col("variables")),
        F.when(F.col("f.control_flow.has_branches"), F.concat(F.lit("Contains conditional logic ("), F.coalesce("f.control_flow.complexity", F.lit("unknown")), F.lit(" complexity)"))),
    )
    functions = document(f, F.concat(F.lit("bp_func:"), "path", F.lit("::"), "f.name"), "bp_graph_summary", F.col("f.name"), F.lit("Blueprint"), text, F.to_json(F.struct("flags", "f.calls", "variables", is_event.alias("is_event"), "f.control_flow", F.col("f.params").alias("parameters"))), _list("refs"))
    return asset_summary_docs(r).unionByName(functions)


def widget_docs(records: DataFrame) -> DataFrame:
    """A summary and a widget tree of each widget blueprint. ``records``: those of a summary, and
    widget_names, widgets (array of name, type, text)."""
    shown = F.transform(F.slice("widgets", 1, 20), lambda w: F.concat(w["type"], F.lit("("), w["name"], F.lit(")"), F.when(F.coalesce(w["text"], F.lit("")) != "", F.concat(F.lit(" text='"), w["text"], F.lit("'"))).otherwise("")))
    root = F.coalesce(F.get("widget_names", F.lit(0)), F.lit("Unknown"))
    text = F.concat(F.lit("Widget tree for "), "name", F.lit(". Root widget: "), root, F.lit(". Contains widgets: "), F.array_join(F.slice("widget_names", 1, IN_METADATA), ", "), F.lit(". Hierarchy: "), F.substring(F.array_join(shown, ", "), 1, 500))
    trees = records.filter(F.size("widget_names") > 0)
    tree = document(trees, F.concat(F.lit("widget:"), "path", F.lit("/WidgetTree")), "umg_widget_tree", F.concat("name", F.lit("/WidgetTree")), F.lit("WidgetBlueprint"), text, F.to_json(F.struct(root.alias("root_widget"), "widget_names", F.size("widget_names").alias("widget_count"))), _list("refs"))
    return asset_summary_docs(records.withColumn("asset_type", F.lit("WidgetBlueprint"))).unionByName(tree)


def _pairs(column: str, value: bool = True) -> Column:
    """The first five entries of a map by key, as ``k=v`` or as ``k``."""
    entries = F.array_sort(F.map_entries(F.col(column)))
    text = F.transform(F.slice(entries, 1, 5), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")) if value else e["key"])
    return F.coalesce(text, F.array().cast(STRINGS))


def material_docs(records: DataFrame) -> DataFrame:
    """Materials and instances. ``records``: path, name, is_instance, parent, domain, blend_mode,
    shading_model, scalar_params, vector_params, texture_params, static_switches, refs. The parent
    goes first among the references, texture paths last."""
    kind = F.when(F.col("is_instance"), "MaterialInstance").otherwise("Material")
    has_parent = F.coalesce("parent", F.lit("")) != ""
    text = sentence(
        F.concat(kind, F.lit(" "), "name"),
        F.when(has_parent, F.concat(F.lit("inherits from "), "parent")),
        F.concat(F.lit("Domain: "), "domain", F.lit(", Blend: "), "blend_mode", F.lit(", Shading: "), "shading_model"),
        listed("Scalar params: ", _pairs("scalar_params"), 5),
        listed("Vector params: ", _pairs("vector_params", value=False), 5),
        listed("Texture params: ", _pairs("texture_params"), 5),
        listed("Static switches: ", _pairs("static_switches"), 5),
    )
    textures = F.filter(F.coalesce(F.map_values("texture_params"), F.array().cast(STRINGS)), lambda t: t.startswith("/"))
    refs = F.array_union(F.array_union(F.when(has_parent, F.array("parent")).otherwise(F.array().cast(STRINGS)), _list("refs")), textures)
    meta = F.struct("is_instance", "parent", "domain", "blend_mode", "shading_model", "scalar_params", "vector_params", "texture_params", "static_switches")
    return document(records, F.concat(F.lit("material:"), "path"), "material_params", F.col("name"), kind, text, F.to_json(meta), refs)


def material_function_docs(records: DataFrame) -> DataFrame:
    """``records``: path, name, description, inputs, outputs, params, refs."""
    text = sentence(
        F.concat(F.lit("MaterialFunction "), "name"),
        F.nullif("description", F.lit("")),
        listed("Inputs: ", _list("inputs")),
        listed("Outputs: ", _list("outputs")),
        listed("Parameters: ", _list("params")),
    )
    meta = F.struct("inputs", "outputs", "params", F.size(_list("inputs")).alias("input_count"), F.size(_list("outputs")).alias("output_count"))
    return document(records, F.concat(F.lit("materialfunction:"), "path"), "material_function", F.col("name"), F.lit("MaterialFunction"), text, F.to_json(meta), _list("refs"))


def datatable_docs(records: DataFrame) -> DataFrame:
    """``records``: path, name, row_struct, row_count, columns, sample_keys, refs."""
    text = sentence(
        F.concat(F.lit("DataTable "), "name", F.lit(" with struct "), F.coalesce("row_struct", F.lit("Unknown"))),
        F.concat(F.col("row_count").cast("string"), F.lit(" rows")),
        listed("Columns: ", _list("columns"), 10),
        listed("Sample keys: ", _list("sample_keys"), 5),
    )
    meta = F.struct("row_struct", "row_count", "columns", F.slice(_list("sample_keys"), 1, 5).alias("sample_keys"))
    return document(records, F.concat(F.lit("datatable:"), "path"), "datatable", F.col("name"), F.lit("DataTable"), text, F.to_json(meta), _list("refs"))


def export_tags(records: DataFrame, collect) -> DataFrame:
    """(path, tag), once each: the tags in the properties of all exports of ``records``, as ``collect`` finds them."""
    values = records.select("path", F.explode("exports").alias("e")).select("path", F.explode("e.properties").alias("p"))
    return values.select("path", F.explode(collect(F.col("p.value"))).alias("tag")).distinct()


METADATA = "parent_class string, flags array<string>, calls array<string>, functions array<string>, events array<string>, variables array<string>, control_flow struct<has_branches: boolean>"


def semantic_snippet(docs: DataFrame) -> DataFrame:
    """``docs`` with ``snippet``: of functions their flags, calls and branches, of blueprints and widgets
    their parent and members, both cut at 260 characters; of others the first 200 of the text."""
    m = F.from_json("metadata", METADATA)
    items = lambda label, c, n: listed(label, F.coalesce(F.col(f"_m.{c}"), F.array().cast(STRINGS)), n)
    function = F.concat_ws(". ", F.concat(F.lit("Blueprint function "), "name", F.lit(" in "), "path"), items("Flags: ", "flags", 4), items("Calls: ", "calls", 6), F.when(F.col("_m.control_flow.has_branches"), "Has conditional branches"))
    parent = F.when(F.coalesce("_m.parent_class", F.lit("")) != "", F.concat(F.lit("Parent: "), "_m.parent_class"))
    summary = F.concat_ws(". ", F.concat("asset_type", F.lit(" "), "name"), parent, items("Functions: ", "functions", 5), items("Events: ", "events", 5), items("Variables: ", "variables", 5))
    of_blueprint = (F.col("type") == "asset_summary") & F.lower("asset_type").isin("blueprint", "widgetblueprint")
    out = F.when(F.col("type") == "bp_graph_summary", F.substring(function, 1, 260)).when(of_blueprint, F.substring(summary, 1, 260)).otherwise(F.substring(F.coalesce("text", F.lit("")), 1, 200))
    return docs.withColumn("_m", m).withColumn("snippet", out).drop("_m")
