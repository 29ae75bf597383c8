import shutil

import pytest
from pyspark.sql import functions as F

from graphloom import session
from graphloom.operators import index, store, traverse
from graphloom.sources import facts, files


def test_numbers_follow_the_order(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("ordinal"), F.col("id").alias("x")).repartition(7)
    got = store.numbered(rows, "ordinal", 10).collect()
    assert sorted((r.ordinal, r.rowid) for r in got) == [(i, i + 11) for i in range(500)]
    assert store.numbered(rows.limit(0), "ordinal").collect() == []


def test_each_start_has_its_own_depths_and_limit(spark):
    edges = spark.createDataFrame([(1, 2, "CALLS"), (2, 3, "CALLS"), (3, 4, "CALLS"), (2, 5, "CALLS"), (5, 1, "CALLS")], "src long, dst long, type string")
    start = spark.createDataFrame([(1,), (2,), (2,)], "rowid long")
    got = {tuple(r) for r in traverse.closures(start, edges, 3).select("start", "rowid", "depth").collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (1, 5, 2), (1, 4, 3), (2, 3, 1), (2, 5, 1), (2, 4, 2), (2, 1, 2)}
    few = {tuple(r) for r in traverse.closures(start, edges, 3, limit=2).select("start", "rowid").collect()}
    assert few == {(1, 2), (1, 3), (2, 3), (2, 5)}
    assert {tuple(r) for r in traverse.bfs(start, edges, 3).select("rowid", "depth").collect()} == {(3, 1), (5, 1), (4, 2)}


def test_stored_tables_are_made_once_and_again_if_gone(spark):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert session.stored(spark, "t", "somewhere", build).count() == 3
    assert len(made) == 1
    path, _ = session._STORED[(spark.sparkContext.applicationId, "t", "somewhere")]
    shutil.rmtree(path.removeprefix("file:"))
    assert session.stored(spark, "t", "somewhere", build).count() == 3 and len(made) == 2
    session.forget("somewhere")
    assert session.stored(spark, "t", "somewhere", build).count() == 3 and len(made) == 3


def test_versions_are_put_in_place(spark, tmp_path):
    root = str(tmp_path)
    assert index.open_index(spark, root) is None
    for version in ("a", "b"):
        index._put(spark, root, version)
        assert index.open_index(spark, root).version == version


def test_a_late_provider_is_not_started(spark):
    nodes = spark.createDataFrame([("a", "x")], "id string, label string")
    edges = spark.createDataFrame([], "id string, source_id string, target_id string")
    *_, report = index.enriched(nodes, edges, [index.Provider("p", "scip", lambda s: None)], -1.0)
    assert report.rows == [("p", "deadline")]


def test_lines_of_several_files_are_numbered_in_order(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text("\n".join(f'{{"kind":"node","id":"b{i}"}}' for i in range(40)))
    (tmp_path / "a.jsonl").write_text('{"kind":"node","id":"a0"}\n\n{"kind":"node","id":"a1"}\n')
    got = facts.read_jsonl(spark, str(tmp_path)).nodes.orderBy("ordinal").collect()
    assert [r.id for r in got] == ["a0", "a1", *(f"b{i}" for i in range(40))] and [r.ordinal for r in got][:3] == [0, 2, 3]
    (tmp_path / "bad.jsonl").write_text('{"kind":"node","id":"x"}\n{"kind":')
    with pytest.raises(ValueError, match="line 2"):
        facts.read(spark, str(tmp_path / "bad.jsonl"))


def test_one_file_is_read_for_a_slice(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a b.rs").write_text("one\ntwo\nthree\n")
    (tmp_path / "other.rs").write_text("no\n")
    assert [r.text for r in files.read_slice(spark, str(tmp_path), "src/a b.rs", 2, 9).collect()] == ["two", "three"]
    with pytest.raises(ValueError):
        files.read_slice(spark, str(tmp_path), "../x", 1, 2)
