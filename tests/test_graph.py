import math

import pytest
from pyspark.sql import functions as F

from graphloom.operators import answers, layout, store, traverse

NODES = [("f1", "File", None, "src/main.rs", None, None), ("main", "Function", "main", "src/main.rs", 1, 5), ("a", "Function", "alpha", "src/main.rs", 10, 15), ("b", "Function", "beta", "src/main.rs", 20, 25), ("c", "Function", "gamma", "src/main.rs", 30, 35), ("base", "Class", "Base", "src/lib/types.rs", 1, None), ("derived", "Class", "Derived", "src/lib/types.rs", 40, None), ("m", "Method", "run", "src/lib/types.rs", 5, None), ("com1", "Community", "community-one", None, None, None), ("com2", "Community", "community-two", None, None, None)]
EDGES = [("main", "a", "CALLS"), ("a", "b", "CALLS"), ("b", "c", "CALLS"), ("derived", "base", "EXTENDS"), ("base", "m", "HAS_METHOD"), ("main", "com1", "MEMBER_OF"), ("a", "com1", "MEMBER_OF"), ("b", "com1", "MEMBER_OF"), ("c", "com2", "MEMBER_OF"), ("base", "com2", "MEMBER_OF"), ("derived", "com2", "MEMBER_OF"), ("m", "com2", "MEMBER_OF"), ("f1", "main", "CONTAINS")]
NODE_FACT, EDGE_FACT = "ordinal long, id string, label string, properties string", "ordinal long, id string, sourceId string, targetId string, type string, confidence double, reason string, step int, evidence string"


def node_facts(spark, rows):
    import json

    out = []
    for i, (k, label, name, path, start, end) in enumerate(rows):
        props = {n: v for n, v in (("name", name), ("filePath", path), ("startLine", start), ("endLine", end)) if v is not None}
        out.append((i, k, label, json.dumps(props)))
    return spark.createDataFrame(out, NODE_FACT)


def edge_facts(spark, rows):
    return spark.createDataFrame([(i, f"e{i}", r[0], r[1], r[2], 1.0, "", r[3] if len(r) > 3 else None, r[4] if len(r) > 4 else None) for i, r in enumerate(rows)], EDGE_FACT)


@pytest.fixture(scope="module")
def mini(spark):
    nodes, edges, counts = store.ingest(node_facts(spark, NODES), edge_facts(spark, EDGES))
    assert tuple(counts.first()) == (10, 0, 13, 0, 0)
    return nodes.cache(), edges.withColumn("ordinal", F.monotonically_increasing_id()).cache()


def ids(nodes, found, *columns):
    return [tuple(r) for r in found.join(nodes.select("rowid", "id"), "rowid").orderBy("place" if "place" in found.columns else "rowid").select("id", *columns).collect()]


def start(nodes, name):
    return store.by_id(nodes, name).select("rowid")


def test_lines_are_counted_from_one(mini):
    nodes, _ = mini
    assert tuple(store.by_id(nodes, "main").select("start_line", "end_line").first()) == (2, 6)
    assert [r.id for r in store.in_file(nodes, "src/main.rs").collect()] == ["f1", "main", "a", "b", "c"]
    assert {tuple(r) for r in store.file_list(nodes).collect()} == {("src/lib/types.rs", 3), ("src/main.rs", 4)}
    assert {tuple(r) for r in store.searchable_file_list(nodes).collect()} == {("src/lib/types.rs", 3), ("src/main.rs", 5)}


def test_closures(mini):
    nodes, edges = mini
    assert ids(nodes, traverse.callees(start(nodes, "main"), edges, 10), "depth") == [("a", 1), ("b", 2), ("c", 3)]
    assert ids(nodes, traverse.callers(start(nodes, "c"), edges, 10).withColumn("place", F.col("depth")), "depth") == [("b", 1), ("a", 2), ("main", 3)]
    assert ids(nodes, traverse.bfs(start(nodes, "m"), edges, 10, ("HAS_METHOD", "EXTENDS"), True), "depth")[0] == ("base", 1)
    assert {x for x in ids(nodes, traverse.impact(start(nodes, "m"), edges, 10), "depth")} == {("base", 1), ("derived", 2)}
    assert ids(nodes, traverse.bfs(start(nodes, "c"), edges, 10, ("CALLS",), True, 2), "depth") == [("b", 1), ("a", 2)]
    both = traverse.impact(start(nodes, "b"), edges, 10, "both").join(nodes, "rowid").select("id", "edge_type", "depth").collect()
    assert {tuple(r) for r in both} == {("a", "IMPACT", 1), ("main", "IMPACT", 2), ("c", "CALLS", 1)}


def test_degrees_clusters_and_level_of_detail(mini):
    nodes, edges = mini
    by_id = {r.id: r.degree for r in store.degree(edges).join(nodes, "rowid").collect()}
    assert (by_id["com2"], by_id["main"]) == (4, 3)
    placed, found = layout.positions(nodes, edges)
    assert [(r.cluster_label, r.members) for r in found.orderBy("cluster").collect()] == [("community-two", 5), ("community-one", 4), ("src", 1)]
    assert sorted(tuple(r) for r in layout.cluster_edges(edges, placed).collect()) == [(0, 1, 1), (1, 2, 1)]
    top, links = layout.lod(placed, edges, 5)
    assert [r.id for r in top.join(nodes, "rowid").orderBy("i").collect()] == ["com2", "main", "a", "b", "base"]
    assert sorted((r.s, r.t) for r in links.collect()) == [(1, 2), (2, 3), (4, 0)]
    labels = layout.display_labels(found, layout.top_files(nodes, placed), layout.top_symbols(nodes, placed))
    assert {r.display for r in labels.collect()} == {"Base Derived", "Alpha Beta", "Main"}
    again, _ = layout.positions(nodes.repartition(3), edges.repartition(5))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, placed.collect()))


def test_layout_without_communities(spark):
    rows = [("x1", "Function", "x1", "core/a.rs", 1, 2), ("x2", "Function", "x2", "core/b.rs", 1, 2), ("y1", "Function", "y1", "ui/c.rs", 1, 2), ("z1", "Function", "z1", "root.rs", 1, 2), ("w1", "Function", "w1", None, None, None), ("p1", "Process", "p1", None, None, None), ("p2", "Process", "p2", None, None, None)]
    nodes, edges, _ = store.ingest(node_facts(spark, rows), edge_facts(spark, [("x1", "x2", "CALLS")]))
    _, found = layout.positions(nodes, edges)
    assert {(r.cluster_label, r.members) for r in found.collect()} == {("core", 2), ("ui", 1), ("(root)", 2), ("Processes", 2)}
    assert layout.quality(found, layout.edge_stats(edges, layout.positions(nodes, edges)[0]), layout.top_files(nodes, layout.positions(nodes, edges)[0])).where("cohesion = 1.0").count() >= 1


def test_ego(mini):
    nodes, edges = mini
    center = start(nodes, "a").first()[0]
    found, links = traverse.ego(center, edges, store.degree(edges), 2)
    rows = found.join(nodes.select("rowid", "id"), "rowid").orderBy("i").collect()
    assert [(r.id, r.ring) for r in rows] == [("a", 0), ("main", 1), ("b", 1), ("com1", 1), ("c", 2), ("f1", 2)]
    assert {(r.s, r.t) for r in links.collect()} == {(0, 2), (0, 3), (1, 0), (1, 3), (2, 4), (2, 3), (5, 1)}
    assert math.isclose(math.hypot(rows[1].x, rows[1].y), 100.0)
    few, _ = traverse.ego(center, edges, store.degree(edges), 2, 3)
    assert [r.id for r in few.join(nodes.select("rowid", "id"), "rowid").orderBy("i").collect()] == ["a", "main", "b"]


def test_ingest_counts(spark):
    n = lambda *k: node_facts(spark, [(x, "Function", x, None, None, None) for x in k])
    nodes, edges, counts = store.ingest(n("n1", "n2"), edge_facts(spark, [("n1", "n2", "CALLS"), ("n1", "ghost", "CALLS"), ("ghost", "n2", "CALLS")]))
    assert (counts.first().edges, counts.first().dangling_edges) == (1, 2)
    _, _, more = store.ingest(n("n1", "n3"), edge_facts(spark, []), nodes, edges)
    assert (more.first().nodes, more.first().duplicate_nodes) == (1, 1)
    known = edge_facts(spark, [("n1", "n2", "CALLS", None, '{"provenance":{}}')])
    nodes, edges, _ = store.ingest(n("n1", "n2"), known)
    _, _, again = store.ingest(n("n1"), known, nodes, edges)
    assert again.first().duplicate_edges == 1
    _, twice, _ = store.ingest(n("n1", "n2"), edge_facts(spark, [("n1", "n2", "CALLS")] * 2))
    assert twice.count() == 2


def test_flows(spark):
    rows = [(x, "Function", x, None, None, None) for x in ("main", "a", "b")] + [("proc1", "Process", "one", None, None, None), ("proc2", "Process", "two", None, None, None), ("route", "Route", "/r", None, None, None)]
    links = [("main", "a", "CALLS"), ("a", "b", "CALLS"), ("main", "proc1", "ENTRY_POINT_OF"), ("route", "proc1", "ENTRY_POINT_OF"), ("b", "proc1", "STEP_IN_PROCESS", 3), ("main", "proc1", "STEP_IN_PROCESS", 1), ("a", "proc1", "STEP_IN_PROCESS", 2), ("a", "proc2", "STEP_IN_PROCESS", 1), ("b", "proc2", "STEP_IN_PROCESS", None)]
    nodes, edges, _ = store.ingest(node_facts(spark, rows), edge_facts(spark, links))
    row = {r.id: r.rowid for r in nodes.collect()}
    steps = lambda p: [(r.id, r.step) for r in store.process_steps(edges, nodes, row[p]).collect()]
    assert steps("proc1") == [("main", 1), ("a", 2), ("b", 3)] and steps("proc2") == [("a", 1), ("b", None)]
    assert {r.id for r in store.processes_of(start(nodes, "a"), edges, nodes).collect()} == {"proc1", "proc2"}
    entry = store.processes_of(start(nodes, "route"), edges, nodes, "ENTRY_POINT_OF").collect()
    assert [(r.id, r.step) for r in entry] == [("proc1", None)]
    got = answers.impact(nodes, edges, name="b")
    assert {(r.id, r.hits, r.first_step) for r in got["processes"].collect()} == {("proc1", 3, 1), ("proc2", 2, 1)}
    assert {r.id for r in answers.context(nodes, edges, "a")["callers"].collect()} == {"main"}
    assert answers.node_detail(nodes, edges, "b").first().callers == 1


def test_lookups(mini):
    nodes, edges = mini
    assert [r.id for r in store.by_name(nodes, "B", 5).collect()] == ["base", "b"]
    assert [r.id for r in store.by_label(nodes, "Class", "DER", 5).collect()] == ["derived"]
    assert store.select(nodes, name="run", kind="method", path="lib/types.rs").count() == 1
    assert store.resolve(nodes, "al").first().id == "a" and store.definitions(nodes, "alpha").count() == 1
    left, kept, counts = store.delete_file(nodes, edges, "src/lib/types.rs")
    assert left.count() == 7 and tuple(counts.first()) == (3, 5) and kept.count() == 8
