"""Cases with literal rows, written for behaviour that the given tables don't show."""

import json

import pytest
from pyspark.sql import functions as F

from assetloom.functions import paths as P
from assetloom.functions import text as X
from assetloom.operators import classify as C
from assetloom.operators import code as K
from assetloom.operators import graph as G
from assetloom.operators import hybrid as H
from assetloom.operators import lookup as L
from assetloom.operators import search_text as S
from assetloom.operators import upsert as U
from assetloom.operators import vector as V
from assetloom.operators.data_assets import data_asset_docs
from assetloom.sources import files as W


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first().x


def test_object_paths(spark):
    for value, want in {"/Game/GE/X.X_C": "/Game/GE/X", "/Script/Eng.Thing": "/Script/Eng.Thing", "Plain": "Plain", "/Game/A_C.A_C": "/Game/A"}.items():
        assert one(spark, value, P.normalize_object_path) == want
    assert tuple(one(spark, "class:asset: /Game/B/Gun.Gun_C?", P.normalize_inherits_target)) == ("/Game/B/Gun", "Gun")
    assert tuple(one(spark, "/Script/Mod.Pawn", P.normalize_inherits_target)) == ("/Script/Mod.Pawn", "Pawn")


def test_modules_and_names(spark):
    for value, want in {"/Game/UI/X": "UI", "C:/p/Source/Core/a.h": "Core", "Plugins/Kit/b.h": "Kit", "/Other": "Unknown"}.items():
        assert one(spark, value, P.module_of) == want
    assert one(spark, "Hero_C", P.class_name_candidates)[:2] == ["Hero", "UHero"]
    assert one(spark, "AHero", P.class_name_candidates) == ["AHero"]


def test_json_walks(spark):
    tag = {"_type": "GameplayTag", "TagName": "A.B"}
    value = json.dumps({"x": [tag, {"_type": "GameplayTagContainer", "tags": ["C", "None", "", "A.B"]}], "r": "see /Game/P/Q and /Game/Z/Z", "s": ["/Script/M/N"]})
    assert one(spark, value, X.collect_tags) == ["A.B", "C"]
    assert one(spark, value, X.collect_refs) == ["/Game/P/Q", "/Script/M/N"]
    deep = tag
    for _ in range(12):
        deep = {"d": deep}
    assert one(spark, json.dumps(deep), X.collect_tags) == []
    assert one(spark, "{bad", X.collect_tags) == [] == one(spark, None, X.collect_refs)


def test_fingerprint_ignores_case_and_outer_space(spark):
    assert one(spark, "\t Text\n", X.fingerprint) == one(spark, "text", X.fingerprint) != one(spark, "text2", X.fingerprint)


def test_types(spark):
    for value, want in {"BP_X": "Blueprint", "wbp_x": "WidgetBlueprint", "RIG_A": "Animation", "Thing": "Unknown", "MPC_a": "MaterialParameterCollection"}.items():
        assert one(spark, value, C.classify_by_name) == want
    df = spark.createDataFrame([("W_A", "/Game/UI/W_A"), ("x", "/Game/Maps/x.umap"), ("X", "/Game/DataTables/X"), ("B_E", "/Game/Experiences/B_E"), ("q", "/Game/q")], "n string, p string")
    assert [r.t for r in df.select(C.guess_type(F.col("n"), F.col("p")).alias("t")).collect()] == ["WidgetBlueprint", "World", "DataTable", "Blueprint", None]


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, text string")
    new = spark.createDataFrame([("b", "Y "), ("c", "z"), ("c", "zz")], "doc_id string, text string")
    first = U.upsert_docs(old, new)
    assert {(r.doc_id, r.text, r.action) for r in first.collect()} == {("a", "x", "kept"), ("b", "y", "unchanged"), ("c", "zz", "inserted")}
    again = U.upsert_docs(first.select("doc_id", "text"), new)
    assert {r.action for r in again.collect()} == {"kept", "unchanged"}
    assert U.upsert_docs(old, new, force=True).filter("action = 'replaced'").count() == 1


def test_upsert_with_null_texts(spark):
    old = spark.createDataFrame([(1, None), (2, "x"), (3, None), (4, "y")], "doc_id int, text string")
    new = spark.createDataFrame([(1, "new"), (2, None), (3, None), (5, None), (4, "Y "), (None, "n")], "doc_id int, text string")
    got = {r.doc_id: (r.text, r.action) for r in U.upsert_docs(old, new).collect()}
    assert got == {1: ("new", "replaced"), 2: (None, "replaced"), 3: (None, "unchanged"), 4: ("y", "unchanged"), 5: (None, "inserted"), None: ("n", "inserted")}


def test_index_survives_a_crash_between_tables_and_pointer(spark, tmp_path, monkeypatch):
    import os

    folder = str(tmp_path / "i")
    with pytest.raises(FileNotFoundError):
        W.read_index(spark, folder)
    edges = lambda n: {"edges": spark.createDataFrame([(str(n), "b", "uses_asset")], "from_id string, to_id string, edge_type string")}
    for n in range(4):
        W.write_index(edges(n), folder)
    with monkeypatch.context() as m:
        m.setattr(W, "POINTER", "number long, version string")
        with pytest.raises(Exception):
            W.write_index(edges(9), folder)
    assert [r.from_id for r in W.read_index(spark, folder)["edges"].collect()] == ["3"]
    assert len([x for x in os.listdir(folder) if x != "pointers"]) == 3  # the last two, and what the crash left


def test_hostile_json(spark):
    deep = '{"a":' * 3_000 + '"/Game/X/Y"' + "}" * 3_000
    worse = "[" * 200_000 + "]" * 200_000
    got = spark.createDataFrame([(deep,), (worse,), ("{",), (None,)], "j string").select(X.collect_refs(F.col("j")).alias("r"), X.collect_tags(F.col("j")).alias("t")).collect()
    assert [r.r for r in got[1:]] == [[], [], []] and got[0].r in ([], ["/Game/X/Y"]) and all(r.t == [] for r in got)


def test_ownership_plan_grows_by_a_constant(spark):
    edges = spark.createDataFrame([(f"asset:/Game/{i + 1}", f"asset:/Game/{i}", "uses_asset") for i in range(9)] + [("asset:/Game/0", "asset:/Game/3", "uses_asset")], "from_id string, to_id string, edge_type string")
    docs = spark.createDataFrame([(f"asset:/Game/{i}", f"/Game/{i}", f"N{i}", "Blueprint") for i in range(10)], "doc_id string, path string, name string, asset_type string")
    targets = docs.filter("name in ('N0', 'N2', 'N9')").select("path", "name")
    scans = []
    for depth in (2, 3, 4):
        df = G.ownership_chain(targets, edges, docs, max_depth=depth)
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
    assert {r.path: r.chain for r in df.collect()} == {"/Game/0": "N4 -> N3 -> N2 -> N1 -> N0", "/Game/2": "N1 -> N0 -> N3 -> N2", "/Game/9": "N9"}
    assert scans[2] - scans[1] == scans[1] - scans[0] <= 2


def test_typed_reference_without_reference_gives_no_edge(spark):
    docs = spark.createDataFrame([("asset:/A", ["/B", "/Script/M.C", ""], {"/B": "inherits_from", "/D": "x"})], "doc_id string, references_out array<string>, typed_references_out map<string,string>")
    assert {tuple(r) for r in U.build_edges(docs).collect()} == {("asset:/A", "asset:/B", "inherits_from"), ("asset:/A", "script:/Script/M.C", "uses_asset")}


def test_inheritance_with_cycle_and_missing_documents(spark):
    edges = spark.createDataFrame([("d", "b", "inherits_from"), ("p", "d", "inherits_from"), ("b", "p", "inherits_from"), ("x", "b", "uses_asset")], "from_id string, to_id string, edge_type string")
    docs = spark.createDataFrame([("p", "/p", "P")], "doc_id string, path string, name string")
    seeds = spark.createDataFrame([("b", "b")], "seed string, node_id string")
    assert [(r.doc_id, r.depth) for r in G.descendants(seeds, edges, docs).collect()] == [("p", 2)]


def test_expand_refs_types_and_cap(spark):
    edges = spark.createDataFrame([("a", "b", "u"), ("b", "c", "u"), ("c", "a", "u")], "from_id string, to_id string, edge_type string")
    seeds = spark.createDataFrame([(1, "a")], "seed int, node_id string")
    assert sorted((r.node_id, r.depth) for r in G.expand_refs(seeds, edges, depth=5).collect()) == [("a", 0), ("b", 1), ("c", 2)]
    assert sorted(r.node_id for r in G.expand_refs(seeds, edges, direction="reverse", depth=1).collect()) == ["a", "c"]
    assert G.expand_refs(seeds, edges, depth=5, max_nodes=2).count() == 2


def test_contract_graph_with_cycle_of_knots(spark):
    nodes = spark.createDataFrame([("a", False), ("k", True), ("l", True), ("b", False)], "node string, passes boolean")
    links = spark.createDataFrame([("a", "k"), ("k", "l"), ("l", "k"), ("l", "b")], "source string, target string")
    assert [tuple(r) for r in G.contract_graph(nodes, links).collect()] == [("a", "b")]


def test_where_used_outside_game(spark):
    edges = spark.createDataFrame([("x", "script:/Script/Engine.Actor"), ("y", "script:/Script/Engine.ActorComponent"), ("y", "class:Gun"), ("x", "asset:/Game/A")], "from_id string, to_id string")
    docs = spark.createDataFrame([("x", "/Game/X"), ("y", "/Game/Y")], "doc_id string, path string")
    refs = spark.createDataFrame([], "asset_path string, ref_path string")
    targets = spark.createDataFrame([(1, "/Script/Engine.Actor"), (2, "Gun"), (3, "Engine.Actor"), (4, "script:/Script/Engine.Actor"), (5, "/Game/"), (6, "/Game/A"), (7, "")], "query_id int, path string")
    got = sorted((r.query_id, r.user_path) for r in G.where_used(targets, refs, edges, docs).collect())
    assert got == [(1, "/Game/X"), (2, "/Game/Y"), (3, "/Game/X"), (3, "/Game/Y"), (4, "/Game/X"), (6, "/Game/X")]


def test_contract_graph_through_many_knots(spark):
    nodes = spark.createDataFrame([("a", False), ("b", False), *((f"k{i}", True) for i in range(20))], "node string, passes boolean")
    links = spark.createDataFrame([("a", "k0"), *((f"k{i}", f"k{i + 1}") for i in range(19)), ("k19", "b")], "source string, target string")
    assert [tuple(r) for r in G.contract_graph(nodes, links).collect()] == [("a", "b")]


def test_build_tree_to_any_depth_and_past_a_cycle(spark):
    rows = [(0, i, i - 1 if i else None, f"n{i}") for i in range(36)] + [(0, 3, 5, "n3")]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, label string")
    got = {r.node: r.depth for r in G.build_tree(nodes).collect()}
    assert got == {i: i for i in range(36)}


def test_batches_are_written_over_each_other(spark, tmp_path):
    from assetloom.streaming.upserts import RECORD, apply_batch

    batches = [
        [("a", "t", "/P", "one", ["/Game/X"], {}, ["A.B"]), ("b", "t", "/P", "two", [], {}, ["C"]), ("c", "t", "/Q", None, None, None, None)],
        [("a", "t", "/P", "other", ["/Game/Y", "/Game/Z"], {"/Game/Z": "maps_input"}, ["D"]), ("d", "u", "/R", "new", [], {}, []), (None, "t", "/P", "none", [], {}, ["E"])],
        [("a", "t", "/P", "other", [], {}, ["F"])],
        [("a", "t", "/P", "last", [], {}, [])],
        [("c", "t", "/Q", "text", ["/Game/X"], {}, ["G"])],
    ]
    folder, known, parts = str(tmp_path / "index"), {}, []
    for rows in batches:
        apply_batch(spark, spark.createDataFrame(rows, RECORD), folder, most_parts=3)
        for r in rows:
            if r[0] and (r[0] not in known or known[r[0]][3] != r[3]):
                known[r[0]] = r
        index = W.read_index(spark, folder)
        parts.append(len(W.index_parts(spark, folder)))
        assert sorted((r.doc_id, r.text) for r in index["docs"].collect()) == sorted((k, r[3]) for k, r in known.items())
        assert sorted((r.path, r.tag) for r in index["tags"].collect()) == sorted({(r[2], t) for r in known.values() for t in r[6] or []})
        assert sorted((r.from_id, r.to_id, r.edge_type) for r in index["edges"].collect()) == sorted((k, f"asset:{t}", (r[5] or {}).get(t, "uses_asset")) for k, r in known.items() for t in r[4] or [])
    assert parts == [1, 2, 2, 3, 1]


def test_slot_nodes(spark):
    widgets = spark.createDataFrame([(1, 1, "Root", "Canvas", None), (1, 2, "Go", "Button", 9), (1, 3, "Lost", "Text", 8), (1, 4, None, None, 7), (2, 2, "Other", "Text", 9)], "tree int, node int, name string, type string, slot int")
    slots = spark.createDataFrame([(1, 9, 1), (1, 9, 3), (1, 8, None)], "tree int, slot int, parent int")
    got = sorted((r.tree, r.node, r.parent, r.label) for r in G.slot_nodes(widgets, slots).collect())
    assert got == [(1, 1, None, "Canvas(Root)"), (1, 2, 1, "Button(Go)"), (1, 3, None, "Text(Lost)"), (1, 4, None, "()"), (2, 2, None, "Text(Other)")]


def test_compact_graph(spark):
    nodes = spark.createDataFrame([(1, 1, "Call", False, None), (1, 2, "Knot", True, None), (1, 3, "Set", None, None), (1, 4, "Get", False, "Health"), (1, 5, "Alone", False, None), (2, 3, "Set", False, None)], "graph int, node int, kind string, passes boolean, inline string")
    pins = [(1, 1, "then", "out", None, False, False), (1, 1, "self", "in", "x", False, False), (1, 3, "exec", "in", None, None, None), (1, 3, "value", "in", None, False, False), (1, 3, "note", "in", " ", False, False), (1, 3, "size", "in", "2", False, False)]
    pins += [(1, 3, "old", "in", "2", False, True), (1, 3, "hid", "in", "2", True, False), (1, 5, "value", "in", "2", False, False), (2, 3, "gone", "in", None, True, False)]
    pins = spark.createDataFrame(pins, "graph int, node int, pin string, direction string, default string, hidden boolean, orphaned boolean")
    links = [(1, 1, "then", 2, "in"), (1, 2, "out", 3, "exec"), (1, 4, "Health", 3, "value"), (2, 9, "then", 3, "gone")]
    links = spark.createDataFrame(links, "graph int, source int, source_pin string, target int, target_pin string")
    got = {(r.graph, r.short, r.node, r.pin, ",".join(r.to)) for r in G.compact_graph(nodes, pins, links).collect()}
    assert got == {(1, "N1", 1, "then", "N2:exec"), (1, "N2", 3, "exec", "N1:then"), (1, "N2", 3, "value", "Health"), (1, "N2", 3, "size", ""), (2, "N1", 3, None, "")}
    assert G.compact_graph(nodes.limit(0), pins.limit(0), links.limit(0)).count() == 0


def test_routes(spark):
    asked = ["what inherits from the Base?", "how does Gun work?", "/Game/A/B", "WBP_", "where is X placed", "Input.Ability.*", "fire damage", "what system does Gun talk to", "BP_Hero"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    got = {r.query_id: (r.mode, r.target) for r in H.route_queries(q).collect()}
    assert [got[i][0] for i in range(9)] == ["inherits", "trace", "name", "name", "refs", "tags_candidate", "semantic", "trace", "name"]
    assert got[0][1] == "Base" and got[1][1] == "Gun" and got[7][1] in ("to", "Gun")


def test_confident(spark):
    rows = [(1, "BP_Gun", 0.5, 2), (1, "BP_GunBig", 0.9, 1), (2, "Other", 0.9, 1), (2, "More", 0.7, 2), (3, "A", 0.9, 1), (3, "B", 0.85, 2)]
    r = spark.createDataFrame(rows, "query_id int, name string, score double, rank int")
    q = spark.createDataFrame([(1, "bp_gun"), (2, "zzz"), (3, "zzz")], "query_id int, query string")
    assert sorted((x.query_id, x.name, x.how) for x in H.select_confident(r, q).collect()) == [(1, "BP_Gun", "exact"), (2, "Other", "gap")]


def test_tags(spark):
    tags = spark.createDataFrame([("/a", "InputTag"), ("/b", "InputTag.A"), ("/c", "InputTag.B"), ("/d", "Other.InputTag")], "path string, tag string")
    q = spark.createDataFrame([(1, "InputTag.*"), (2, "InputTag"), (3, "putt")], "query_id int, query string")
    got = {}
    for r in L.search_tag(q, tags).collect():
        got.setdefault(r.query_id, set()).add(r.path)
    assert got == {1: {"/b", "/c"}, 2: {"/a"}, 3: {"/a", "/b", "/c", "/d"}}


def test_phrases_prefixes_and_filters(spark):
    rows = [("a", "BP_Door", "/Game/Doors/BP_Door", "opens the door to door", "m", "Blueprint"), ("b", "BP_Doorbell", "/Game/Doors/BP_Doorbell", "rings", "m", "blueprint"), ("c", "Door_BP", "/Game/BP/Door", "bp door game doors", "n", "Widget")]
    docs = spark.createDataFrame(rows, "doc_id string, name string, path string, text string, module string, asset_type string")
    index = S.build_postings(docs)
    queries = [(1, "BP_Door", None, None, None), (2, "/Game/Doors/BP_Door", None, None, None), (3, "door x", None, None, None), (4, "door", "m", None, None), (5, "door", None, "WIDGET", None), (6, "door", None, None, "/GAME/doors"), (7, "x !", None, None, None), (8, None, None, None, None)]
    q = spark.createDataFrame(queries, "query_id int, query string, filter_module string, filter_asset_type string, filter_path_prefix string")
    got: dict = {}
    for r in S.search_text(q, *index, docs=docs).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert {k: sorted(v) for k, v in got.items()} == {1: ["a", "b", "c"], 2: ["a"], 3: ["a", "b", "c"], 4: ["a", "b"], 5: ["c"], 6: ["a", "b"]}
    one = S.search_text(q.filter("query_id = 3"), *index, docs=docs, k=1, offset=1).collect()
    assert [r.rank for r in one] == [2]


def test_hybrid_by_each_plan(spark):
    exact = spark.createDataFrame([(q, f"e{i}", 9.0 - i, i + 1) for q, n in ((1, 6), (2, 2), (3, 6), (4, 3)) for i in range(n)], "query_id int, doc_id string, score double, rank int")
    near = spark.createDataFrame([(q, f"v{i}", i + 1) for q in (1, 2, 3, 4, 5) for i in range(10)], "query_id int, doc_id string, rank int")
    modes = spark.createDataFrame([(1, "exact"), (2, "exact"), (3, "semantic"), (4, "hybrid"), (5, "exact")], "query_id int, mode string")
    got: dict = {}
    for r in H.search_hybrid(exact, near, modes=modes, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got[1] == [f"e{i}" for i in range(6)] and sorted(got[2]) == ["e0", "e1"] + [f"v{i}" for i in range(8)]
    assert [x for x in got[3] if x[0] == "e"] == [f"e{i}" for i in range(5)] and len(got[4]) == 10 and got[5] == [f"v{i}" for i in range(10)]


def test_vector_search_with_filters_and_long_texts(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, module string")
    e = spark.createDataFrame([("a", [0.5, 0.5]), ("b", [1.0, 0.0])], "doc_id string, embedding array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0], "x"), (2, [2.0, 0.0], None)], "query_id int, embedding array<float>, filter_module string")
    assert [(r.query_id, r.doc_id) for r in V.search_vector(q, e, k=1, docs=docs).orderBy("query_id").collect()] == [(1, "a"), (2, "b")]
    model = lambda: lambda texts: [[float(t.count("a")), float(len(t))] for t in texts]
    long = spark.createDataFrame([(1, "a" * 6 + "b" * 4), (2, None)], "doc_id int, text string")
    assert {r.doc_id: r.embedding for r in V.embed_docs(long, model, max_chars=4).collect()} == {1: [pytest.approx(2.4), pytest.approx(3.6)], 2: [0.0, 0.0]}


def test_search_empty(spark):
    docs = spark.createDataFrame([], "doc_id string, name string, path string, text string")
    q = spark.createDataFrame([(1, "x y")], "query_id int, query string")
    assert S.search_text(q, *S.build_postings(docs)).count() == 0
    e = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 0.0])], "doc_id string, embedding array<float>")
    v = spark.createDataFrame([(1, [2.0, 0.0])], "query_id int, embedding array<float>")
    assert [(r.doc_id, r.score) for r in V.search_vector(v, e).orderBy("rank").collect()] == [("b", 1.0), ("a", 0.0)]


def test_headers(spark, tmp_path):
    text = "// UCLASS() class UNo\nUCLASS(Meta=(X))\nclass GAME_API UYes : public X\n{\nUFUNCTION(BlueprintCallable)\nvirtual int Fire(int N) const;\n/* UCLASS() class UOff */\n};\nUSTRUCT()\nstruct FData {\nUPROPERTY()\nint32 Count = 3;\n};"
    for sub, name in [("Source/G", "a.h"), ("Source/G/Intermediate", "b.h"), ("Source/G", "a.generated.h"), ("Docs", "c.h")]:
        (tmp_path / sub).mkdir(parents=True, exist_ok=True)
        (tmp_path / sub / name).write_text(text)
    headers = W.read_headers(spark, str(tmp_path))
    assert sorted(r.class_name for r in K.scan_classes(headers).collect()) == ["FData", "UYes"]
    members = {r.name: r for r in K.scan_members(headers).collect()}
    assert members["Count"].owner == "FData" and members["Count"].default_value == "3"
    assert members["Fire"].owner == "UYes" and members["Fire"].is_virtual and members["Fire"].is_const and members["Fire"].params == "int N"


def test_files(spark, tmp_path):
    for name in ("a.uasset", "b.umap", "c.txt", "Saved/d.uasset"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    got = W.list_asset_files(spark, [str(tmp_path)], exclude=["saved"]).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in got) == ["a.uasset", "b.umap"] and {r.size for r in got} == {5}
    assert W.list_asset_files(spark, [str(tmp_path)], max_assets=1).count() == 1


def test_control_flow(spark):
    i = spark.createDataFrame([(1, 0, "JumpIfNot", 2), (1, 1, "Let", 0), (1, 2, "Jump", 2)], "fn int, pos long, op string, target long")
    blocks, edges = K.control_flow_graph(i)
    assert sorted(tuple(r) for r in edges.collect()) == [(1, 0, 1), (1, 0, 2), (1, 1, 2), (1, 2, 2)]
    assert [r.block for r in blocks.filter("loop_target").collect()] == [2]


def test_data_assets_of_odd_exports(spark):
    exports = "array<struct<class:string,name:string,type:string,properties:array<struct<name:string,value:string>>>>"
    rows = [
        ("/Game/A/None", "None", None, None),
        ("/Game/A/Meta", "Meta", None, [("MetaData", "PackageMetaData", "MetaDataExport", [])]),
        ("/Game/A/Bad", "Bad", None, [("LyraAbilitySet", "Bad", "NormalExport", [("GrantedGameplayAbilities", "{no json"), ("Other", None)])]),
        ("/Game/A/GE", "GE", "GameplayEffect", [("Blueprint", "GE", "NormalExport", [("ParentClass", "/Game/A/Up.Up_C")]), ("GE_C", "Default__GE_C", "NormalExport", [("Modifiers", '[{"Attribute":"Health","ModifierMagnitude":{"Value":1234567.0}},{},3]'), ("Period", '{"Value":0}')])]),
    ]
    df = spark.createDataFrame(rows, f"path string, name string, asset_type string, exports {exports}")
    out = {r.name: r for r in data_asset_docs(df).collect()}
    assert out["None"].text == "None is a DataAsset." and out["Meta"].text == "Meta is a DataAsset."
    assert out["Bad"].text == "Bad is a LyraAbilitySet." and out["Bad"].references_out == []
    assert out["GE"].text == "GE is a GameplayEffect. Parent: Up. Modifiers: Health +1.23457e+06 (Additive),  +0 (Additive)."
    assert out["GE"].asset_type == "GameplayEffect" and out["GE"].typed_references_out == {"/Game/A/Up": "uses_asset", "asset:/Game/A/Up": "inherits_from"}
    assert data_asset_docs(df.limit(0)).count() == 0


def test_parents_of_data_assets_by_name(spark):
    exports = "array<struct<class:string,name:string,type:string,properties:array<struct<name:string,value:string>>>>"
    df = spark.createDataFrame([("/Game/A/GE", "GE", "GameplayEffect", [("GameplayEffect", "GE", "NormalExport", [("Parent", "(/Script/Mod, GE_Up_C, )")])])], f"path string, name string, asset_type string, exports {exports}")
    known = spark.createDataFrame([("GE_Up", "/Game/B/GE_Up")], "name string, path string")
    typed = data_asset_docs(df, parents=(known, known.limit(0), [])).first().typed_references_out
    assert typed["asset:/Game/B/GE_Up"] == "inherits_from"


def test_questions_in_other_words(spark):
    asked = {
        "Show all subclasses of 'BP_Base'": ("inherits", "BP_Base"),
        "which widgets are derived from a UserWidget": ("inherits", "UserWidget"),
        "everything that extends the Gun": ("inherits", "Gun"),
        "children play": ("semantic", "children play"),
        "What systems does the Big Gun depend on?": ("trace", "Big Gun"),
        "how do bullets behave": ("trace", "bullets"),
        "Trace the damage flow": ("trace", "damage"),
        "how does": ("semantic", "how does"),
        "trace flow": ("semantic", "trace flow"),
        "where was X placed?": ("refs", "where was X placed?"),
        "/Script/Engine.Actor": ("semantic", "/Script/Engine.Actor"),
        "explain the inventory system": ("semantic", "explain the inventory system"),
    }
    q = spark.createDataFrame([(k,) for k in [*asked, None, " "]], "query string")
    got = {r.query: (r.mode, r.target) for r in H.route_queries(q).collect()}
    assert {k: got[k] for k in asked} == asked and got[None] == ("semantic", None)


def test_members_of_hard_headers(spark):
    text = """UCLASS(Meta=(X))
class GAME_API UYes : public X
{
UFUNCTION(meta=(A="(", B)) DEPRECATED(4.2, "x") void Fire(int A, FString B = TEXT("x;y")) const override;
UPROPERTY() TMap<FName, TArray<int>> M = {};
UPROPERTY() int X{3};
UPROPERTY() FString U = TEXT("http://x/*");
UPROPERTY() uint8 b : 1;
UPROPERTY() TSubclassOf<class UBar> Sub = nullptr;
UFUNCTION() TFunction<void(int)> Get(TFunction<void(int, int)> F, const TMap<A, B>& C = {}) ;
struct FInner { UPROPERTY() int In; };
UFUNCTION() virtual bool operator==(int B) const;
UPROPERTY()
};
USTRUCT()
struct FData { UPROPERTY() int32 Count = 3; };
UPROPERTY( never closed"""
    rows = K.scan_members(spark.createDataFrame([("a.h", text), ("b.h", None), ("c.h", "UFUNCTION")], "path string, text string")).collect()
    got = {r.name: r for r in rows}
    assert set(got) == {"Fire", "M", "X", "U", "b", "Sub", "Get", "In", "operator==", "Count"}
    fire = got["Fire"]
    assert (fire.is_const, fire.is_override, fire.is_virtual, fire.line, fire.owner) == (True, True, False, 4, "UYes")
    assert fire.param_list == ["int A", 'FString B = TEXT("x;y")'] and fire.specifier_list == ['meta=(A="(", B)']
    assert [got[n].default_value for n in ("M", "X", "U", "b", "Sub")] == ["{}", "{3}", 'TEXT("http://x/*")', None, "nullptr"]
    assert got["Get"].param_list == ["TFunction<void(int, int)> F", "const TMap<A, B>& C = {}"] and got["Get"].type == "TFunction<void(int)>"
    assert got["In"].owner == "FInner" and got["operator=="].owner == "UYes" and got["Count"].owner == "FData"


def test_trees_lose_no_node(spark):
    rows = [(1, 1, None, "a"), (1, 2, 9, "orphan"), (1, 3, 2, "below"), (1, 3, 2, "below"), (1, 4, 5, "ring"), (1, 5, 4, "ring"), (1, 6, 5, "tail"), (1, 7, 7, "self"), (2, 3, 1, "else")]
    got = sorted((r.tree, r.node, r.root, r.depth) for r in G.build_tree(spark.createDataFrame(rows, "tree int, node int, parent int, label string")).collect())
    assert got == [(1, 1, 1, 0), (1, 2, 2, 0), (1, 3, 2, 1), (1, 4, 4, 0), (1, 5, 4, 1), (1, 6, 4, 2), (1, 7, 7, 0), (2, 3, 3, 0)]


def test_null_ids_come_in_once(spark):
    old = spark.createDataFrame([(None, "x"), ("a", "y")], "doc_id string, text string")
    got = U.upsert_docs(old, old)
    assert sorted((str(r.doc_id), r.action) for r in got.collect()) == [("None", "unchanged"), ("a", "unchanged")]
    other = spark.createDataFrame([(None, "z")], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.text, r.action) for r in U.upsert_docs(old, other).collect()) == [("None", "z", "replaced"), ("a", "y", "kept")]


def test_vector_search_over_many_blocks(spark, monkeypatch):
    """With blocks of a few vectors, ties and filters, against a plain search."""
    import numpy as np

    r = np.random.default_rng(5)
    monkeypatch.setattr(V, "BLOCK", 7)
    e = [(f"d{i:03}", np.round(r.normal(size=4), 1).tolist(), ["x", "y", None][i % 3], f"/Game/{'AB'[i % 2]}/{i}") for i in range(120)] + [("zero", [0.0] * 4, "x", "/Game/A/z")]
    q = [(i, np.round(r.normal(size=4), 1).tolist(), [None, "x"][i % 2], [None, None, "/GAME/b"][i % 3]) for i in range(20)]
    df = spark.createDataFrame(e, "doc_id string, embedding array<double>, module string, path string")
    asked = spark.createDataFrame(q, "query_id int, embedding array<double>, filter_module string, filter_path_prefix string")
    got = [(x.query_id, x.doc_id, x.rank) for x in V.search_vector(asked, df.select("doc_id", "embedding"), k=5, min_score=-0.2, docs=df).orderBy("query_id", "rank").collect()]

    def cosine(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(np.dot(a, b) / n), 6) if n else 0.0

    want = []
    for i, v, module, path in q:
        hits = [(-cosine(v, x), d) for d, x, m, p in e if module in (None, m) and (path is None or p.lower().startswith(path.lower()))]
        want += [(i, d, k + 1) for k, (s, d) in enumerate(sorted(h for h in hits if -h[0] >= -0.2)[:5])]
    assert got == want
    index = V.build_vector_index(df, sample=64)
    near = V.search_vector_index(asked, index, k=5, min_score=-0.2)
    found = {(x.query_id, x.doc_id) for x in near.collect()}
    assert len(found & {(i, d) for i, d, _ in want}) >= 0.9 * len(want) and index.blocks.selectExpr("sum(size(ids))").first()[0] == 121


@pytest.mark.parametrize("k", [1, 3, 50])
def test_text_search_over_many_blocks(spark, monkeypatch, k):
    """Blocks of a few documents against blocks of all, and postings against blocks; one word is in every document."""
    import random

    r = random.Random(k)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, f"N_{i}", f"/Game/P{i % 4}/N_{i}", "common " + " ".join(r.choices(words, weights=range(1, 41), k=r.randrange(0, 30))), f"m{i % 3}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id int, name string, path string, text string, module string").repartition(3)
    asked = [(i, " ".join(["common", *r.choices(words, k=4), f"N_{i}"][r.randrange(0, 3) :]), [None, "m1"][i % 2]) for i in range(25)] + [(90, "/Game/P1/N_5", None), (91, "w1 w1", None), (92, "no such", None)]
    q = spark.createDataFrame(asked, "query_id int, query string, filter_module string")
    top = lambda df: sorted((x.query_id, x.rank, x.doc_id, round(x.score, 5)) for x in df.collect())
    want = top(S.search_text(q, S.build_blocks(docs), k=k))
    assert top(S.search_text(q, *S.build_postings(docs), k=k, docs=docs)) == want
    monkeypatch.setattr(S, "QUERIES", 4)
    monkeypatch.setattr(S, "UNITS", 5)
    monkeypatch.setattr(S, "BROADCAST_BYTES", 0)
    small = S.build_blocks(docs.repartition(20).sortWithinPartitions("doc_id"))
    assert top(S.search_text(q, small, k=k)) == want
    assert {x[0] for x in want} == {x[0] for x in asked} - {92}


def test_moved_documents_take_their_tags_along(spark, tmp_path):
    from assetloom.streaming.upserts import RECORD, apply_batch

    folder = str(tmp_path / "index")
    rows = [[("a", "t", "/P/One", "alpha words", [], {}, ["A"]), ("b", "t", "/P/One", "beta words", [], {}, ["B"])], [("a", "t", "/P/Two", "gamma words", [], {}, ["A2"])], [("b", "t", "/P/One", "beta words", [], {}, ["B"])]]
    for batch in rows:
        apply_batch(spark, spark.createDataFrame(batch, RECORD), folder)
        index = W.read_index(spark, folder)
    assert sorted((r.path, r.tag) for r in index["tags"].collect()) == [("/P/One", "B"), ("/P/Two", "A2")]
    q = spark.createDataFrame([(1, "alpha"), (2, "words"), (3, "two")], "query_id int, query string")
    assert sorted((r.query_id, r.doc_id) for r in S.search_text(q, index["blocks"]).collect()) == [(2, "a"), (2, "b"), (3, "a")]


def test_two_writers_from_the_same_version(spark, tmp_path, monkeypatch):
    from assetloom.streaming import upserts
    from assetloom.streaming.upserts import RECORD, apply_batch

    folder, real, came = str(tmp_path / "index"), upserts.write_index, []
    batch = lambda *ids: spark.createDataFrame([(i, "t", f"/P/{i}", f"text {i}", ["/Game/X"], {}, []) for i in ids], RECORD)
    apply_batch(spark, batch("a"), folder)

    def late(tables, where, **more):
        if not came:  # another writer comes in between
            came.append(1)
            apply_batch(spark, batch("c"), folder)
        return real(tables, where, **more)

    monkeypatch.setattr(upserts, "write_index", late)
    apply_batch(spark, batch("b"), folder)
    index = W.read_index(spark, folder)
    assert sorted(r.doc_id for r in index["docs"].collect()) == ["a", "b", "c"] and index["edges"].count() == 3
    with pytest.raises(W.VersionTaken):
        real({"docs": index["docs"]}, folder, after=1)
    monkeypatch.setattr(W, "PATIENCE", 0.1)
    (tmp_path / "index" / "pointers" / f"{4:012d}.json").write_text("")  # a writer that crashed
    W.write_index({"docs": index["docs"]}, folder)
    assert W.index_number(spark, folder) == 5


def test_bucketed_tables_are_not_exchanged(spark, tmp_path):
    from assetloom.sources import buckets as B

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = spark.createDataFrame([(f"/Game/{i}", i, float(i)) for i in range(500)], "path string, size long, mtime double")
        now, was = (B.write_buckets(df, str(tmp_path / n), "path") for n, df in (("now", files.filter("size % 3 > 0")), ("was", files.withColumn("size", F.col("size") + F.when(F.col("size") % 2 == 0, 1).otherwise(0)))))
        df = U.detect_changes(now, was)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
        assert {r.status: r["count"] for r in df.groupBy("status").count().collect()} == {"changed": 166, "unchanged": 167}
        refs = B.write_buckets(spark.createDataFrame([(f"u{i}", f"/Game/{i % 50}") for i in range(500)], "asset_path string, ref_path string"), str(tmp_path / "refs"), "ref_path", buckets=16)
        edges = B.write_buckets(spark.createDataFrame([(f"d{i}", f"asset:/Game/{i % 40}") for i in range(500)], "from_id string, to_id string"), str(tmp_path / "edges"), "to_id")
        docs = spark.createDataFrame([(f"d{i}", f"/Game/D{i}") for i in range(500)], "doc_id string, path string")
        targets = spark.createDataFrame([(1, "/Game/3"), (2, "/Game/45")], "query_id int, path string")
        used = G.where_used(targets, refs, edges, docs)
        plan = used._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(ref_path" not in plan and "Exchange hashpartitioning(to_id" in plan.replace("ids", "to_id") and plan.count("Bucketed: true") >= 2
        assert sorted((r.query_id, r.total) for r in used.select("query_id", "total").distinct().collect()) == [(1, 23), (2, 10)]
        again = B.read_buckets(spark, str(tmp_path / "refs"), "ref_path", 16)
        assert again.count() == 500 and B.bucket_sizes(again, "ref_path", 16).agg(F.sum("n")).first()[0] == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_patterns_with_underscores(spark):
    tags = spark.createDataFrame([("/a", "In.Move"), ("/b", "In.Mave"), ("/c", "In.Mo_e"), ("/d", "Out")], "path string, tag string")
    q = spark.createDataFrame([(1, "in.m_v%"), (2, "M_ve"), (3, "In.Mo_e"), (4, "___"), (5, "_%"), (6, "I_.*"), (7, "%"), (8, "a\\b")], "query_id int, query string")
    got: dict = {}
    for r in L.search_tag(q, tags).collect():
        got.setdefault(r.query_id, set()).add(r.path)
    assert got == {1: {"/a", "/b"}, 2: {"/a", "/b"}, 3: {"/c"}, 4: {"/a", "/b", "/c", "/d"}, 5: {"/a", "/b", "/c", "/d"}, 6: {"/a", "/b", "/c"}, 7: {"/a", "/b", "/c", "/d"}}


def test_metadata_keeps_its_types(spark):
    docs = [("d1", "a_type", "/p", "one", '{"n": 1, "s": "x", "o": {"k": [1, 2.5, null]}, "gone": true}'), ("d2", "b_type", "/p", "two", '{"n": 2.5, "s": null, "gone": {"deep": "y"}}'), ("d3", "c", "/p", None, "{bad"), ("d4", "d", "/p", None, "[1]"), ("d5", "e", "/p", None, None)]
    docs = spark.createDataFrame(docs, "doc_id string, type string, path string, text string, metadata string")
    results = spark.createDataFrame([(1, "/p"), (2, "/none")], "query_id int, path string")
    got = {r.query_id: r for r in L.enrich_results(results, docs).withColumn("typed", F.to_json("typed")).collect()}
    assert json.loads(got[1].typed) == {"n": 2.5, "s": None, "o": {"k": [1, 2.5, None]}, "gone": {"deep": "y"}}
    assert got[1].text == "one\n\ntwo" and got[1].level == "full" and got[2].level == "summary" and got[2].typed is None


def test_changes_of_references_alone(spark, tmp_path):
    from assetloom.streaming.upserts import RECORD, apply_batch

    one = [("a", "t", "/P/a", "text", ["/Game/X", "/Game/Y"], {"/Game/X": "uses", "/Game/Y": "maps"}, [])]
    two = [("a", "t", "/P/a", "text", ["/Game/X", "/Game/Z"], {"/Game/X": "uses"}, [])]
    swapped = [("a", "t", "/P/a", "text", ["/Game/X", "/Game/Y"], {"/Game/Y": "maps", "/Game/X": "uses"}, [])]
    for columns, want in (((), {"/Game/X", "/Game/Y"}), (["references_out", "typed_references_out"], {"/Game/X", "/Game/Z"})):
        folder = str(tmp_path / str(len(columns)))
        for rows in (one, swapped):
            apply_batch(spark, spark.createDataFrame(rows, RECORD), folder, fingerprint_cols=columns)
        assert len(W.index_parts(spark, folder)) == 1
        apply_batch(spark, spark.createDataFrame(two, RECORD), folder, fingerprint_cols=columns)
        index = W.read_index(spark, folder)
        assert {r.to_id.removeprefix("asset:") for r in index["edges"].collect()} == want
    changes = {(r.to_id, r.change) for r in index["edge_changes"].collect()}
    assert changes == {("asset:/Game/Y", "removed"), ("asset:/Game/Z", "added")}
