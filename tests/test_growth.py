"""What must not grow faster than the input: joined rows, rows that one task holds, tables that are shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom import session
from graphloom.operators import answers, index, layout, search, store, traverse, viewer
from graphloom.plans.catalogue import QUERIES
from graphloom.sources import semantic, tables

DATA = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _joined(df) -> int:
    """The most rows that a join of a collected table made."""
    df.collect()
    left, most = [df._jdf.queryExecution().executedPlan()], 0
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(node.plan())
        if "Join" in kind:
            most = max(most, node.metrics().apply("numOutputRows").value())
        left += [node.children().apply(i) for i in range(node.children().size())]
    return most


@pytest.fixture
def no_small_tables(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tied_first_definitions_are_told_apart(spark):
    none = spark.createDataFrame([], "path string, language string, digest string")
    symbols = spark.createDataFrame([("a", None, "Struct", None, None, None)], "symbol string, display_name string, kind string, file_path string, start_line int, end_line int")
    met = spark.createDataFrame([("a", "Definition", f, 1, 1, 5) for f in "zbx"], "symbol string, role string, file_path string, start_line int, end_line int, ordinal int").coalesce(1)
    nodes, _ = semantic.lowered(none, symbols, met, spark.createDataFrame([], "source string, target string, kind string"))
    assert '"filePath":"b"' in nodes.first()["properties"]


def test_points_and_clicks_at_one_place_are_joined_once(spark):
    points = spark.createDataFrame([(i, 5.0, float(i % 2)) for i in range(300)], "rowid long, x double, y double")
    clicks = spark.createDataFrame([(i, 6.0, 0.0) for i in range(300)], "click long, x double, y double")
    found = viewer.pick(points, clicks, 3.0)
    assert {tuple(r) for r in found.collect()} == {(i, 0, 1.0) for i in range(300)}
    assert _joined(found) <= 300


def test_ends_are_dealt_before_they_are_counted(spark):
    edges = spark.range(100).selectExpr("id AS src", "id * 7 % 50 AS dst")
    for df in (store.degree(edges), tables.different(edges, 10**7)):
        plan = _plan(df)
        assert plan.rindex("HashAggregate") < plan.index("Exchange")
    assert store.degree(edges).agg(F.sum("degree")).first()[0] == 200


def test_edges_of_some_types_store_nothing_else(spark):
    session.forget(DATA)
    whole = tables.edges(spark, DATA)
    names = {k[1] for k in session._STORED if k[2] == DATA}
    assert names == {"calls", "steps"}
    session.forget(DATA)
    some = tables.edges(spark, DATA, ("CALLS", "EXTENDS"))
    assert {k[1] for k in session._STORED if k[2] == DATA} == {"calls"}
    assert some.exceptAll(whole).isEmpty() and some.count() == whole.where("type IN ('CALLS', 'EXTENDS')").count()


def test_places_in_a_cluster_are_numbered_by_ranges(spark):
    nodes = spark.createDataFrame([(i, f"n{i}", "Function", f"n{i}", f"{'ab'[i > 900]}/f.rs") for i in range(1000)], "rowid long, id string, label string, name string, file_path string")
    edges = spark.createDataFrame([(i, i * i % 17, "CALLS") for i in range(1000)], "src long, dst long, type string")
    placed, _ = layout.positions(nodes, edges)
    assert "Window" not in _plan(placed)
    rows = placed.collect()
    for cluster in (0, 1):
        own = sorted((r for r in rows if r.cluster == cluster), key=lambda r: (-r.degree, r.rowid))
        assert [r.k for r in own] == list(range(len(own)))
    assert len(rows) == 1000


@pytest.mark.parametrize("kind", ["dense", "holes", "repeated", "far", "negative"])
def test_edges_between_clusters_by_blocks_and_by_joins(spark, no_small_tables, monkeypatch, kind):
    pick = random.Random(1)
    ids = {"dense": range(70_000), "holes": range(0, 70_000, 3), "repeated": [*range(32_767), 32_766], "far": [10**12 * k + i for k in range(3) for i in range(40)], "negative": range(-40_000, 10)}[kind]
    placed = spark.createDataFrame([(i, 1 if 40_000 <= i < 66_000 else i % 3) for i in ids], "rowid long, cluster int")
    ends = [*ids, 10**6, -10**6]
    edges = spark.createDataFrame([(pick.choice(ends), pick.choice(ends)) for _ in range(3000)] + [(32_766, 1), (32_767, 2)], "src long, dst long")
    counted = layout._ends(edges, placed)
    assert ("SortMergeJoin" in _plan(counted)) == (kind == "repeated")
    got = {tuple(r) for r in counted.collect()}
    stats = {tuple(r) for r in layout.edge_stats(edges, placed).collect()}
    monkeypatch.setattr(layout, "BLOCKS", 0)
    assert got == {tuple(r) for r in layout._ends(edges, placed).collect()}
    assert stats == {tuple(r) for r in layout.edge_stats(edges, placed).collect()}


def test_met_nodes_are_put_together_before_seen_ones_are_left_out(spark, no_small_tables, monkeypatch):
    plans = []
    monkeypatch.setattr(traverse, "written", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), session.written(df, name))[1])
    edges = spark.createDataFrame([(1, 2, "CALLS"), (1, 3, "CALLS"), (2, 4, "CALLS"), (3, 4, "CALLS"), (4, 1, "CALLS")], "src long, dst long, type string")
    found = traverse.bfs(spark.createDataFrame([(1,)], "rowid long"), edges, 3)
    assert {tuple(r) for r in found.select("rowid", "depth").collect()} == {(2, 1), (3, 1), (4, 2)}
    assert plans[1].index("LeftAnti") < plans[1].index("Aggregate")


def test_an_ego_counts_degrees_of_met_nodes_alone(spark, no_small_tables):
    edges = spark.createDataFrame([(1, k) for k in range(2, 40)] + [(k, k + 50) for k in range(2, 30)] + [(90, 91)], "src long, dst long")
    nodes, pairs = traverse.ego(1, edges, None, 2, 45)
    want, wanted = traverse.ego(1, edges, store.degree(edges), 2, 45)
    assert sorted(nodes.collect()) == sorted(want.collect()) and sorted(pairs.collect()) == sorted(wanted.collect())
    assert [r.i for r in nodes.orderBy("ring", "k").collect()] == list(range(45))
    assert "Window" not in _plan(nodes)
    plan = _plan(store.degree_of(nodes.select("rowid"), edges))
    assert "LeftSemi" in plan and "SortMergeJoin" not in plan


def test_documents_are_dealt_before_they_are_cut(spark):
    docs = spark.createDataFrame([("a", "fooBar foo", "x", None), ("a", "fooBar foo", "x", None), ("b", None, "_the-End_ été-là", "p/q.rs")], "doc_id string, name string, text string, file_path string")
    posted = search.postings(docs)
    plan = _plan(posted)
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    got = {(r.field, r.term, r.doc_id, r.tf, r.dl) for r in posted.collect()}
    assert {("name", "foo", "a", 4, 4), ("name", "foobar", "a", 2, 4), ("name", "bar", "a", 2, 4), ("text", "the-end", "b", 1, 6), ("text", "été", "b", 1, 6)} <= got


def test_reranking_stores_its_postings(spark):
    session.forget(DATA)
    QUERIES["search_rerank"](spark, DATA)
    assert "postings-callables" in {k[1] for k in session._STORED if k[2] == DATA}


def test_a_frequent_term_is_dealt_to_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BUCKET_ROWS", 50, raising=False)
    nodes = spark.createDataFrame([(i, f"n{i}", "Function", "same" if i % 2 else f"own{i}", f"f{i % 3}.rs", 1, 2) for i in range(400)], "rowid long, id string, label string, name string, file_path string, start_line int, end_line int")
    edges = spark.createDataFrame([(1, 2, "CALLS")], "src long, dst long, type string")
    made = index.build(spark, str(tmp_path), nodes, edges)
    folder = tmp_path / made.version / "postings" / f"bucket={index.bucket_of('same')}"
    assert len(list(folder.glob("*.parquet"))) >= 4
    assert made.postings(["same"]).count() == 200
    after, gone = index.without_paths(made, spark.createDataFrame([("f0.rs",)], "path string"))
    assert gone == 134 and after.postings(["same"]).count() == sum(1 for i in range(400) if i % 2 and i % 3)
    assert made.table("postings").columns == after.table("postings").columns


def test_few_anchors_are_sent_to_the_edges(spark, no_small_tables):
    edges = spark.createDataFrame([(1, 2, "CALLS"), (3, 2, "CALLS"), (2, 1, "CALLS"), (4, 2, "IN")], "src long, dst long, type string")
    found = answers.node_degrees(spark.createDataFrame([(2,)], "rowid long"), edges)
    assert _plan(found).count("BroadcastHashJoin") == 2
    assert found.select("callers", "callees", "references").collect() == [(2, 1, 3)]
