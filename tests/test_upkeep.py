import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import incremental, viewer
from graphloom.sources import facts, files, semantic
from graphloom.streaming import debounce, progress


def test_delta(spark):
    table = lambda **k: spark.createDataFrame(list(k.items()), "path string, hash string")
    before, after = table(same="1", changed="1", deleted="1"), table(same="1", changed="2", added="1")
    found = incremental.delta(before, after)
    assert incremental.summary(found).first()[0] == "+1 ~1 -1 =1"
    assert incremental.preflight(found, True, True) == "incremental" and incremental.preflight(found, True, False) == "full"
    assert incremental.reusable(before, before, True) and not incremental.reusable(before, after, True)


def test_slice_and_merge(spark):
    nodes = spark.createDataFrame([("a", "Function", "x.rs"), ("b", "Function", "y.rs"), ("c", "Community", None)], "id string, label string, file_path string")
    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "b", "c")], "id string, source_id string, target_id string")
    chunks = spark.createDataFrame([("x.rs", "a")], "file_path string, node_id string")
    found = spark.createDataFrame([("x.rs", "modified")], "path string, status string")
    part, touching, _, unsafe = incremental.slice_of(nodes, edges, chunks, found)
    assert [r.id for r in part.collect()] == ["a"] and [r.id for r in touching.collect()] == ["e1"] and unsafe.count() == 0
    assert incremental.slice_of(nodes, edges, chunks, found.withColumn("path", F.lit("y.rs")))[3].count() == 1
    stamped = spark.createDataFrame([(None,), ('{"a":1}',), ("[1]",)], "e string").select(incremental.stamped(F.col("e"), '{"x":2}')).collect()
    assert [json.loads(r[0]) for r in stamped] == [{"provenance": {"x": 2}}, {"a": 1, "provenance": {"x": 2}}, {"value": [1], "provenance": {"x": 2}}]


RECORDS = [{"kind": "manifest", "contractVersion": 1}, {"kind": "node", "id": "a", "label": "File", "properties": {"path": "x.rs"}}, {"kind": "edge", "id": "e", "sourceId": "a", "targetId": "b", "type": "CALLS", "confidence": 0.5, "reason": "r", "step": 2, "evidence": {"k": 1}}, {"kind": "chunk", "nodeId": "a", "chunkKind": "ast", "filePath": "x.rs", "startLine": 0, "endLine": 3, "text": "t"}]


def _check(found):
    assert [(r.id, json.loads(r.properties)) for r in found.nodes.collect()] == [("a", {"path": "x.rs"})]
    assert [(r.sourceId, r.step, json.loads(r.evidence)) for r in found.edges.collect()] == [("a", 2, {"k": 1})]
    assert [(r.kind, r.start_line, r.end_line) for r in found.chunks.collect()] == [("ast", 1, 4)]
    assert tuple(found.stats.first()) == (1, 1, 1, 1)


def test_facts_files(spark, tmp_path):
    forms = {"l.jsonl": "\n\n".join(map(json.dumps, RECORDS)), "a.json": json.dumps(RECORDS), "b.json": json.dumps({"analyzer": {"id": "scip"}, "stats": {"files": 0, "nodes": 0, "edges": 0, "chunks": 0}, "nodes": [RECORDS[1]], "edges": [RECORDS[2]], "chunks": [{**RECORDS[3], "kind": "ast"}]}, indent=1)}
    for name, text in forms.items():
        (tmp_path / name).write_text(text)
        found = facts.read(spark, str(tmp_path / name))
        _check(found)
    assert found.analyzer == "scip" and facts.read_optional(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "bad.jsonl").write_text(json.dumps(RECORDS[0]) + "\n\nnot json\n")
    with pytest.raises(ValueError, match="line 3"):
        facts.read(spark, str(tmp_path / "bad.jsonl"))
    (tmp_path / "empty.json").write_text("")
    with pytest.raises(ValueError, match="empty"):
        facts.read(spark, str(tmp_path / "empty.json"))


def _varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def _field(number, value):
    return _varint(number << 3) + _varint(value) if isinstance(value, int) else _varint(number << 3 | 2) + _varint(len(value)) + value


def test_index_protobuf(spark, tmp_path):
    met = _field(1, _varint(4) + _varint(0) + _varint(9)) + _field(2, b"sym") + _field(3, 1)
    other = _field(1, b"".join(map(_varint, (1, 2, 3, 4)))) + _field(2, b"sym") + _field(3, 12)
    (tmp_path / "index.scip").write_bytes(_field(2, _field(4, b"rust") + _field(1, b"a.rs") + _field(2, met) + _field(2, other)))
    found, occurrences = semantic.read_index(spark, str(tmp_path / "index.scip"))
    assert [(r.path, r.language) for r in found.collect()] == [("a.rs", "rust")]
    assert {tuple(r) for r in occurrences.collect()} == {("sym", "Definition", "a.rs", 4, 4), ("sym", "WriteAccess", "a.rs", 1, 3)}


def test_symbol_trees(spark):
    span = {"start": {"line": 1}, "end": {"line": 4}}
    tree = [{"name": "A", "kind": 5, "range": span, "children": [{"name": "m", "kind": 6, "range": span}]}]
    nodes, edges = semantic.symbol_tables(spark.createDataFrame([("x.py", json.dumps(tree))], "file_path string, symbols string"))
    assert [(r.label, r.qualified_name, r.start_line) for r in nodes.collect()] == [("Class", "A", 2), ("Method", "A.m", 2)]
    assert [r.type for r in edges.collect()] == ["DEFINES", "CONTAINS"]


def test_resolutions(spark):
    text = ["a.py:3:5: found 1 definition for queried position", "  b.py:7:1", "a.py:9:2: found 0 definitions for queried position"]
    nodes, edges = semantic.lowered_resolutions(semantic.resolutions(spark.createDataFrame(list(enumerate(text)), "line int, text string")))
    assert {(r.label, r.file_path) for r in nodes.collect()} == {("File", "a.py"), ("File", "b.py"), ("Reference", "a.py"), ("Symbol", "b.py")}
    assert sorted(r.type for r in edges.collect()) == ["CONTAINS", "DEFINES", "REFERS_TO"]


def test_source_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "src/a.rs").write_text("one\ntwo\n")
    (tmp_path / ".git/x").write_text("no")
    (tmp_path / "src/b.bin").write_bytes(b"a\0b")
    assert {(r.path, r.size) for r in files.fingerprints(spark, str(tmp_path)).collect()} == {("src/a.rs", 8), ("src/b.bin", 3)}
    lines = files.source_lines(spark, str(tmp_path))
    assert [(r.line, r.text) for r in files.source_slice(lines, "src/a.rs", 0, 99).collect()] == [(1, "one"), (2, "two")]
    with pytest.raises(ValueError, match="inside"):
        files.source_slice(lines, "../x", 1, 2)
    state = spark.createDataFrame([("a", 1)], "name string, n long")
    for _ in range(2):
        files.write_state(state, str(tmp_path / "state"))
    assert files.read_state(spark, str(tmp_path / "state"), "name string, n long").count() == 1 and files.read_state(spark, str(tmp_path / "no"), "name string").count() == 0


def test_viewer(spark):
    paths = spark.createDataFrame([("src/a/b/x.rs",), ("src/a/b/y.rs",), ("top.rs",)], "path string")
    tree = {r.folder: (r.files, r.folders, r.folded) for r in viewer.file_tree(paths).collect()}
    assert tree == {"src": (0, 1, True), "src/a": (0, 1, True), "src/a/b": (2, 0, False)}
    points = spark.createDataFrame([(i, float(i % 10), float(i // 10)) for i in range(100)], "rowid long, x double, y double")
    clicks = spark.createDataFrame([(1, 3.2, 4.1), (2, 99.0, 99.0)], "click long, x double, y double")
    assert [(r.click, r.rowid) for r in viewer.pick(points, clicks, 1.0).collect()] == [(1, 43)]
    assert viewer.in_rect(points, 0, 0, 1, 1).count() == 4 and viewer.bounds(points).first().n == 100 and viewer.cell_size(points) > 0


def test_quiet_periods_on_a_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:02"), (1, "2024-01-01 00:00:09"), (2, "2024-01-01 00:00:01"), (9, "2024-01-01 02:00:00")]
    events = spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    batch = {(r.user_id, r.events) for r in debounce.sessions(events).collect()}
    assert batch == {(1, 2), (1, 1), (2, 1), (9, 1)}
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream, _ = debounce.poll(spark, str(tmp_path / "in"), events.schema)
    run = debounce.stream_sessions(stream, late="1 minute").writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r.user_id, r.events) for r in spark.table("quiet").collect()} == {(1, 2), (1, 1), (2, 1)}


def test_progress_on_a_stream(spark, tmp_path):
    logs = spark.createDataFrame([("j", 1, 10.0, "a"), ("j", 2, 5.0, "a"), ("j", 3, 20.0, "b"), ("k", 4, 1.0, "a")], "job string, seq long, percent double, line string")
    want = {("j", 10.0, "a"), ("j", 20.0, "b"), ("k", 1.0, "a")}
    assert {(r.job, r.percent, r.line) for r in progress.log_dedup(logs).collect()} == want
    logs.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(logs.schema).parquet(str(tmp_path / "in"))
    run = progress.stream_log_dedup(stream).writeStream.format("memory").queryName("logs").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r.job, r.percent, r.line) for r in spark.table("logs").collect()} == want
    copy = progress.keyed_updates(stream, str(tmp_path / "out"), str(tmp_path / "c2")).trigger(availableNow=True).start()
    copy.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
