"""Where-used, inheritance, neighbourhoods, ownership and traces over the reference graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.config import STRUCTURAL_PREFIXES, STRUCTURAL_TYPES, VISUAL_TYPES
from assetloom.operators.substring import containing
from assetloom.sources.scratch import dropped, stored

#: Before the names of targets that aren't assets; a target may also be given with its own.
NAMESPACES = ("script:", "class:", "material:", "")


def where_used(targets: DataFrame, refs: DataFrame, edges: DataFrame, docs: DataFrame, *, limit: int = 50) -> DataFrame:
    """Users of each target (query_id, path): light references first, then documents by edges;
    once by path, first ``limit`` by (source, path): query_id, user_path, source, rank, total. A target
    outside /Game/ is met in every namespace, or, if no edge has it, in any id that contains it."""
    by_ref = targets.join(refs, targets["path"] == refs["ref_path"]).select("query_id", F.col("asset_path").alias("user_path"), F.lit(0).alias("source"))
    other = ~F.col("path").startswith("/Game/") & (F.col("path") != "")
    names = F.array(*[F.concat(F.lit(p), F.col("path")) for p in ("asset:", *NAMESPACES)])
    ids = targets.select("query_id", F.explode(F.when(other, names).otherwise(F.slice(names, 1, 1))).alias("to_id"))
    asked = stored(targets.filter(other).select("query_id", "path").distinct())
    if not asked.isEmpty():
        known = stored(edges.select(F.col("to_id").alias("word")).distinct())
        answered = asked.select("query_id", "path", F.explode(names).alias("word")).join(known, "word", "left_semi")
        part = stored(asked.join(answered, ["query_id", "path"], "left_anti").select("query_id", F.col("path").alias("part")))
        ids = ids.union(part.join(containing(part, known), "part").select("query_id", F.col("word").alias("to_id")))
    by_edge = ids.join(edges, "to_id").join(docs.select(F.col("doc_id").alias("from_id"), "path"), "from_id").select("query_id", F.col("path").alias("user_path"), F.lit(1).alias("source"))
    once = by_ref.union(by_edge).groupBy("query_id", "user_path").agg(F.min("source").alias("source"))
    total = once.groupBy("query_id").agg(F.count("*").alias("total"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("source", "user_path"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= limit).join(total, "query_id")


def level_contents(light: DataFrame, refs: DataFrame, levels: DataFrame) -> DataFrame:
    """Placed actors of each level (level) and the first of their references that is no actor."""
    level = F.regexp_extract(F.col("path"), r"/__ExternalActors__/([^/]+)/", 1)
    actors = light.withColumn("level", level).join(levels.select("level").distinct(), "level")
    source = refs.filter(~F.col("ref_path").contains("/__External")).groupBy("asset_path").agg(F.min("ref_path").alias("source"))
    return actors.join(source, actors["path"] == source["asset_path"], "left").select("level", "path", "name", "source")


def descendants(seeds: DataFrame, edges: DataFrame, docs: DataFrame, *, max_depth: int = 4) -> DataFrame:
    """(seed, doc_id, path, name, depth) of all that inherit from each seed (seed, node_id), at each
    depth at which they do; nodes without a document are passed through but not shown."""
    child = edges.filter("edge_type = 'inherits_from'").select(F.col("to_id").alias("node_id"), F.col("from_id").alias("child"))
    front, found = seeds.select("seed", "node_id").distinct(), []
    for depth in range(1, max_depth + 1):
        front = stored(front.join(child, "node_id").select("seed", F.col("child").alias("node_id")).distinct())
        found.append(front.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
    every = reduce(DataFrame.union, found)
    return every.join(docs.select(F.col("doc_id").alias("node_id"), "path", "name"), "node_id").select("seed", F.col("node_id").alias("doc_id"), "path", "name", "depth")


def expand_refs(seeds: DataFrame, edges: DataFrame, *, direction: str = "forward", depth: int = 2, max_nodes: int | None = None, docs: DataFrame | None = None, types: list[str] | None = None) -> DataFrame:
    """(seed, node_id, depth): breadth first from each seed (seed, node_id); ``direction`` is forward,
    reverse or both. With ``docs`` (doc_id, type) only nodes that are documents stay, with ``types`` too
    only seeds and those of these types; the search goes through all others. With ``max_nodes`` the
    first nodes of a seed by (depth, id) stay."""
    forward, reverse = edges.select("from_id", "to_id"), edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    steps = {"forward": forward, "reverse": reverse, "both": forward.union(reverse)}[direction].distinct()
    seen = seeds.select("seed", "node_id").distinct().withColumn("depth", F.lit(0))
    front = seen.select("seed", "node_id")
    for d in range(1, depth + 1):
        front = stored(front.join(steps, front["node_id"] == steps["from_id"]).select("seed", F.col("to_id").alias("node_id")).distinct().join(seen, ["seed", "node_id"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.union(front.withColumn("depth", F.lit(d)))
    if docs is not None:
        kind = docs.select(F.col("doc_id").alias("node_id"), F.col("type").alias("_type"))
        wanted = F.lit(True) if types is None else F.col("_type").isin(*types) | (F.col("depth") == 0)
        seen = seen.join(kind, "node_id").filter(wanted).select("seed", "node_id", "depth")
    if max_nodes is None:
        return seen
    return seen.withColumn("_k", F.row_number().over(Window.partitionBy("seed").orderBy("depth", "node_id"))).filter(F.col("_k") <= max_nodes).drop("_k")


def ownership_chain(targets: DataFrame, edges: DataFrame, docs: DataFrame, *, light: DataFrame | None = None, refs: DataFrame | None = None, max_depth: int = 4) -> DataFrame:
    """(path, chain): from each path up to its best inbound owner, a document by an edge or a light asset
    by a reference, again and again; structural types weigh 10, feature data 5 more, ties go to the
    lesser path; a path isn't entered twice."""
    kind = F.coalesce("asset_type", F.lit(""))
    feature = kind.contains("GameFeature")
    weight = F.when(kind.isin(*STRUCTURAL_TYPES) | feature, 10).otherwise(0) + F.when(feature | F.coalesce(F.col("name").contains("GameFeature"), F.lit(False)), 5).otherwise(0)
    owner = docs.select(F.col("doc_id").alias("from_id"), F.col("path").alias("owner"), F.col("name").alias("owner_name"), weight.alias("w"))
    up = edges.select("from_id", F.regexp_replace("to_id", "^asset:", "").alias("below")).join(owner, "from_id").select("below", "owner", "owner_name", "w").distinct()
    if light is not None and refs is not None:
        of_light = light.select(F.col("path").alias("asset_path"), F.col("name").alias("owner_name"), weight.alias("w"))
        up = up.union(refs.join(of_light, "asset_path").select(F.col("ref_path").alias("below"), F.col("asset_path").alias("owner"), "owner_name", "w")).distinct()
    up = stored(up)
    now = targets.select("path", "name").distinct().select("path", F.col("path").alias("top"), F.array("path").alias("seen"), F.array("name").alias("names"))
    parts = []
    for _ in range(max_depth):
        # of each path its owners' best that it hasn't met; none leaves it where it is
        new = F.col("owner").isNotNull() & ~F.array_contains("seen", F.col("owner"))
        best = F.min_by(F.when(new, F.struct("owner", "owner_name")), F.when(new, F.struct(-F.col("w"), F.col("owner")))).alias("o")
        stepped = stored(now.join(up, now["top"] == up["below"], "left").groupBy("path", "top", "seen", "names").agg(best))
        parts.append(stepped.filter("o is null").select("path", "names"))
        now = stepped.filter("o is not null").select("path", F.col("o.owner").alias("top"), F.array_append("seen", F.col("o.owner")).alias("seen"), F.array_append("names", F.col("o.owner_name")).alias("names"))
        if now.isEmpty():
            break
    done = reduce(DataFrame.union, [*parts, now.select("path", "names")])
    return done.select("path", F.array_join(F.reverse("names"), " -> ").alias("chain"))


def dependency_section(asset_type: Column, name: Column) -> Column:
    """structural or visual, by type, else by name; visual if neither tells."""
    by_name = F.lit(False)
    for p in STRUCTURAL_PREFIXES:
        by_name = by_name | F.upper(name).startswith(p)
    return F.when(asset_type.isin(*STRUCTURAL_TYPES) | asset_type.contains("GameFeature"), "structural").when(asset_type.isin(*VISUAL_TYPES), "visual").when(by_name, "structural").otherwise("visual")


# Edge types that weigh more among the structural ones.
STRONG_EDGES = ["registers_widget", "adds_component", "uses_layout", "maps_input", "targets_actor"]


def system_trace(targets: DataFrame, edges: DataFrame, docs: DataFrame, refs: DataFrame, light: DataFrame | None = None, *, limit: int = 12) -> DataFrame:
    """Long rows (query_id, section, path, relationship, score, rank) of each target (query_id, path): the
    assets that it depends on (structural: by typed edges and structural types; visual), what refers to
    it (inbound: documents, then light assets), script references that are no documents, and, where it
    has owners, its ownership chain in place of a path. Each section has the first max(4, min(limit, 12))
    by score and path, scripts the first 12; a path comes once a section."""
    # what is read more than once: edges and documents, three and four times, and the targets
    edges, docs, targets = (stored(df) for df in (edges.select("from_id", "to_id", "edge_type"), docs.select("doc_id", "path", "name", "asset_type"), targets.select("query_id", "path")))
    own = targets.select("query_id", F.concat(F.lit("asset:"), F.col("path")).alias("id"), F.col("path").alias("own"))
    known = docs.select(F.col("doc_id").alias("to_id"), "name", "asset_type")
    out = own.join(edges, own["id"] == edges["from_id"]).join(known, "to_id", "left")
    path = F.regexp_replace("to_id", "^(asset|script):", "")
    typed = F.coalesce("edge_type", F.lit("uses_asset")) != "uses_asset"
    section = F.when(typed, "structural").otherwise(dependency_section(F.col("asset_type"), F.coalesce("name", F.element_at(F.split("to_id", "/"), -1))))
    strong = F.col("edge_type").isin(*STRONG_EDGES) | (~typed & (section == "structural"))
    score = F.when(strong, 1.8).when(typed, 1.5).otherwise(1.0)
    relationship = F.when(typed, F.col("edge_type")).otherwise(F.concat(section, F.lit("_dependency")))
    deps = out.filter(F.col("to_id").startswith("asset:") & (path != F.col("own"))).select("query_id", section.alias("section"), path.alias("path"), relationship.alias("relationship"), score.alias("score"))
    scripts = out.filter(F.col("to_id").startswith("script:/Script/")).select("query_id", F.lit("script").alias("section"), path.alias("path"), F.lit("unresolved").alias("relationship"), F.lit(0.0).alias("score"))
    how = F.when(typed, F.col("edge_type")).otherwise("inbound_ref")
    inbound = own.select("query_id", F.col("id").alias("to_id")).join(edges, "to_id").join(docs.select(F.col("doc_id").alias("from_id"), "path"), "from_id").select("query_id", F.lit("inbound").alias("section"), "path", how.alias("relationship"), F.lit(1.7).alias("score"))
    placed = targets.join(refs, targets["path"] == refs["ref_path"]).select("query_id", F.lit("inbound").alias("section"), F.col("asset_path").alias("path"), F.lit("inbound_ref").alias("relationship"), F.lit(1.6).alias("score"))
    # an asset is structural or visual by its best edge
    every = deps.union(inbound).union(placed).union(scripts).withColumn("_list", F.when(F.col("section").isin("structural", "visual"), "deps").otherwise(F.col("section")))
    best = every.groupBy("query_id", "_list", "path").agg(F.min(F.struct(-F.col("score"), "section", "relationship", "score")).alias("b"))
    rows = best.select("query_id", "b.section", "path", "b.relationship", "b.score")
    rank = F.row_number().over(Window.partitionBy("query_id", "section").orderBy(F.desc("score"), "path"))
    top = rows.withColumn("rank", rank).filter(F.col("rank") <= F.when(F.col("section") == "script", 12).otherwise(max(4, min(limit, 12))))
    names = docs.groupBy("path").agg(F.min("name").alias("name"))
    asked = targets.select("query_id", "path").join(names, "path", "left").withColumn("name", F.coalesce("name", F.element_at(F.split("path", "/"), -1)))
    chains = ownership_chain(asked, edges, docs, light=light, refs=refs if light is not None else None).filter(F.col("chain").contains(" -> "))
    chain = asked.join(chains, "path").select("query_id", F.lit("ownership_chain").alias("section"), F.col("chain").alias("path"), F.lit("owners").alias("relationship"), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    return top.union(chain)


def slot_nodes(widgets: DataFrame, slots: DataFrame) -> DataFrame:
    """Nodes of ``build_tree`` of ``widgets`` (tree, node, name, type, slot) and ``slots`` (tree, slot, parent):
    a widget hangs where its slot does (of equal slots the one of the least parent), and is a root if it
    has no slot or its slot hangs nowhere or on what is no widget; the label is ``type(name)``."""
    hangs = slots.filter("parent is not null").groupBy("tree", "slot").agg(F.min("parent").alias("parent"))
    label = F.concat(F.coalesce("type", F.lit("")), F.lit("("), F.coalesce("name", F.lit("")), F.lit(")"))
    return widgets.join(hangs, ["tree", "slot"], "left").select("tree", "node", "parent", label.alias("label"))


def build_tree(nodes: DataFrame) -> DataFrame:
    """(tree, node, depth, root, text) of ``nodes`` (tree, node, parent, label), to any depth; text is
    the label indented by depth; ``position`` sorts a tree as it is read.

    No node is lost: one whose parent is none of its tree's is a root, and of nodes that hang on each other in
    a ring the least of what is left of a tree is. A node isn't entered again below itself; rows of equal tree,
    node and parent are one, of the least label."""
    sort_key = F.lpad(F.col("node").cast("string"), 20, "0")
    nodes = stored(nodes.groupBy("tree", "node", "parent").agg(F.min("label").alias("label")))
    known = nodes.select("tree", F.col("node").alias("parent")).distinct()
    hanging = nodes.join(known, ["tree", "parent"], "left_semi")

    def walked(roots: DataFrame) -> DataFrame:
        level = stored(roots.select("tree", "node", F.col("node").alias("root"), "label", F.lit(0).alias("depth"), sort_key.alias("position"), F.array("node").alias("_seen")))
        levels, d = [level], 0
        while not level.isEmpty():
            d += 1
            above = level.select("tree", F.col("node").alias("parent"), "root", F.col("position").alias("_p"), "_seen")
            below = hanging.join(above, ["tree", "parent"]).filter(~F.array_contains("_seen", F.col("node")))
            level = stored(below.select("tree", "node", "root", "label", F.lit(d).alias("depth"), F.concat("_p", F.lit("/"), sort_key).alias("position"), F.array_append("_seen", F.col("node")).alias("_seen")))
            levels.append(level)
        out = stored(reduce(DataFrame.union, levels).drop("_seen"))
        dropped(*levels)
        return out

    out = walked(nodes.join(known, ["tree", "parent"], "left_anti"))
    while True:  # rings, one of each tree a time
        rest = nodes.join(out.select("tree", "node").distinct(), ["tree", "node"], "left_anti")
        least = stored(rest.groupBy("tree").agg(F.min(F.struct("node", "label")).alias("n")).select("tree", "n.*"))
        if least.isEmpty():
            break
        out = out.union(walked(least))
    return out.withColumn("text", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("label")))


def contract_graph(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(source, target): links between nodes that aren't pass-through, through any that are; a
    pass-through node isn't entered twice by one link. ``nodes``: node, passes; ``links``: source, target."""
    real = nodes.filter("not passes").select(F.col("node").alias("source"))
    through = stored(links.join(nodes.filter("passes").select(F.col("node").alias("source")), "source", "left_semi").select(F.col("source").alias("via"), "target").distinct())
    via = nodes.filter("passes").select(F.col("node").alias("target"))
    seen = now = stored(links.join(real, "source", "left_semi").select("source", "target").distinct())
    while not now.isEmpty():
        onward = now.join(via, "target", "left_semi").select("source", F.col("target").alias("via"))
        now = stored(onward.join(through, "via").select("source", "target").distinct().join(seen, ["source", "target"], "left_anti"))
        seen = seen.union(now)
    return seen.join(via, "target", "left_anti").select("source", "target")


def compact_graph(nodes: DataFrame, pins: DataFrame, links: DataFrame) -> DataFrame:
    """What is worth reading of node graphs: (graph, short, node, kind, pin, direction, default, to), one row a
    pin. ``nodes``: graph, node, kind, passes, inline; ``pins``: graph, node, pin, direction, default, hidden,
    orphaned; ``links``: graph, source, source_pin, target, target_pin.

    Links run through pass-through nodes. Nodes with an ``inline`` text are shown as this text where they
    are linked to. Nodes without a link go, and so do hidden and orphaned pins and those with neither
    a link nor a default (a blank one is none; ``self`` inputs need a link). A node left without pins has
    one row of null pin. ``short`` numbers the nodes of a graph, N1 first; ``to`` are the other ends, sorted,
    as ``short:pin``, inline texts, or ``node:pin`` of nodes that aren't known. The numbering sorts each
    graph in one task, as a graph is one function of one asset."""
    no = F.lit(False)
    flags = nodes.select("graph", "node", F.coalesce("passes", no).alias("passes"), "inline")
    end = lambda side: F.struct("graph", F.col(side).alias("node"), F.coalesce(f"{side}_passes", no).alias("passes"), F.when(F.coalesce(f"{side}_passes", no), "").otherwise(F.col(f"{side}_pin")).alias("pin"))
    passing = flags.select("graph", "node", "passes")
    known = links.join(passing.toDF("graph", "source", "source_passes"), ["graph", "source"], "left").join(passing.toDF("graph", "target", "target_passes"), ["graph", "target"], "left")
    joined = stored(known.select(end("source").alias("source"), end("target").alias("target")))
    places = joined.select(F.col("source").alias("node")).union(joined.select("target")).distinct()
    linked = places.select("node.*").filter("not passes")
    ends = contract_graph(places.select("node", "node.passes"), joined)
    kept = flags.filter("not passes and inline is null").join(linked, ["graph", "node"], "left_semi").select("graph", "node")
    kept = kept.withColumn("short", F.concat(F.lit("N"), F.row_number().over(Window.partitionBy("graph").orderBy("node")).cast("string")))
    other = ends.select("source", "target").union(ends.select(F.col("target"), F.col("source"))).select("source.graph", F.col("source.node").alias("at"), F.col("source.pin").alias("at_pin"), "target.node", "target.pin")
    texts = flags.select("graph", "node", "inline").join(kept, ["graph", "node"], "left")
    text = F.coalesce("inline", F.concat(F.coalesce("short", F.col("node").cast("string")), F.lit(":"), "pin"))
    to = other.join(texts, ["graph", "node"], "left").groupBy("graph", F.col("at").alias("node"), F.col("at_pin").alias("pin")).agg(F.sort_array(F.collect_list(text)).alias("to"))
    alone = (F.length(F.btrim(F.coalesce("default", F.lit("")))) > 0) & ~((F.col("pin") == "self") & (F.col("direction") == "in"))
    shown = pins.filter(~F.coalesce("hidden", no) & ~F.coalesce("orphaned", no)).select("graph", "node", "pin", "direction", "default")
    shown = shown.join(linked.select("graph", "node", "pin", F.lit(True).alias("_linked")), ["graph", "node", "pin"], "left").filter(F.col("_linked") | alone)
    rows = kept.join(nodes.select("graph", "node", "kind"), ["graph", "node"]).join(shown.join(to, ["graph", "node", "pin"], "left"), ["graph", "node"], "left")
    return rows.select("graph", "short", "node", "kind", "pin", "direction", "default", F.coalesce("to", F.array().cast("array<string>")).alias("to"))


def delegate_bindings(observations: DataFrame) -> DataFrame:
    """Bind, add, remove and clear observations, once each, with their confidence."""
    keys = ["owner", "op", "target", "function", "object"]
    named = (F.coalesce("function", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != "")
    confidence = F.when(named, "high").when((F.coalesce("function", F.lit("")) != "") | (F.coalesce("target", F.lit("")) != ""), "medium").otherwise("low")
    return observations.select(*keys).distinct().withColumn("confidence", confidence)
