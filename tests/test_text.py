import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars
from graphloom.functions import text as X
from graphloom.operators import changes, grep, search, vectors

TOKENS = {"runPipelineFromRepo": ["runpipelinefromrepo", "run", "pipeline", "from", "repo"], "kernel_add": ["kernel_add", "kernel", "add"], "HTTPServer": ["httpserver", "http", "server"], "utf8Parser": ["utf8parser", "utf", "8", "parser"], "my-component": ["my-component", "my", "component"], "pipeline": ["pipeline"], "fn kernel_add(a, b)": ["fn", "kernel_add", "kernel", "add", "a", "b"], "--- __ _foo_": ["foo"], "": []}


def _one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def test_code_tokens(spark):
    rows = spark.createDataFrame([(k,) for k in TOKENS], "v string").select("v", X.code_tokens(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in rows} == TOKENS
    assert all(scalars.query_terms(k) == list(dict.fromkeys(v)) for k, v in TOKENS.items())
    assert scalars.query_terms("jwt auth") == ["jwt", "auth", "token", "claims", "security", "credential", "login"]


def test_paths_and_names(spark):
    noisy = {"a/node_modules/x.js": True, "src/x.rs": False, "A\\Target\\y.rs": True, "pkg/Cargo.lock": True, "data.json": True, "targets/a.rs": False}
    for path, want in noisy.items():
        assert _one(spark, path, X.noisy_path) is want
    for path, want in {"src": False, "a/b.rs": True, "x/{id}.rs": False, "Makefile": True, "src/Makefile": True, " ": False}.items():
        assert _one(spark, path, X.plausible_file) is want
    assert [_one(spark, p, X.layout_dir) for p in ("core/a.rs", "root.rs")] == ["core", ""]
    assert [_one(spark, p, X.first_segment) for p in ("core/a.rs", "/root.rs")] == ["core", "root.rs"]
    assert _one(spark, "cbm:a.b::run", X.short_name) == "run" and _one(spark, "./a\\b", X.selector_path) == "a/b"
    assert _one(spark, "HTTPServer fooBar9x", X.label_words) == ["httpserver", "foo", "bar9x"]


def test_bytes_are_cut_between_characters(spark):
    for text in ("abc", "aé" * 3000, "é" * 1024, "x" + "é" * 1024, "\U0001f600" * 600, "xy" + "\U0001f600" * 600):
        data, n = text.encode(), 2048
        while n < len(data) and data[n] & 0xC0 == 0x80:
            n -= 1
        assert _one(spark, text, X.cut_bytes) == data[:n].decode()


def test_reasons_and_properties(spark):
    rows = spark.createDataFrame([("keys:a, b,|fetches:2",), ("",), ("fetches:x|keys:",)], "r string").select(*X.fetch_reason(F.col("r"))).collect()
    assert [tuple(r) for r in rows] == [(["a", "b"], 2), ([], None), ([], None)]
    assert _one(spark, '{"k":["a","",3]}', lambda c: X.array_prop(c, "k")) == ["a", "3"]
    assert _one(spark, '{"name":"/x","steps":[{"name":"one"},"two"]}', lambda c: X.node_text(F.lit("Route"), c)) == "Route /x one two"


def test_scalars():
    assert scalars.fnv1a(b"a") == 0xE40C292C and scalars.clamp(None, 10, 100) == 10 and scalars.clamp(500, 10, 100) == 100
    assert scalars.expanded_query("find route", "route and handler code", None) == "find route and code handler"
    assert scalars.risk_level(10, True) == "HIGH" and scalars.risk_level(4, False) == "MEDIUM" and scalars.risk_level(0, True) == "MEDIUM"
    assert scalars.file_uri_path("file:///a%20b") == "/a b" and scalars.file_uri_path("http://x/") is None
    assert scalars.repository_name("git@h:o/r.git") == "r" and scalars.unique_name("r", {"r", "r-2"}) == "r-3"


CORPUS = [("fn:runPipelineFromRepo", "fn runPipelineFromRepo(path) loads the pipeline from a repo", "src/pipeline.rs"), ("fn:kernel_add", "fn kernel_add(a, b) adds in the kernel", "src/kernel.rs"), ("class:HTTPServer", "class HTTPServer listens", "src/http.rs"), ("fn:other", "fn unrelated helper", "src/other.rs"), ("fn:verify_token", "checks the token claims", "src/auth.rs")]


@pytest.fixture(scope="module")
def index(spark):
    rows = [(f"d{i}", k, "Function", k.split(":")[1], text, path, 10, 30, "function") for i, (k, text, path) in enumerate(CORPUS)]
    docs = spark.createDataFrame(rows, "doc_id string, node_id string, label string, name string, text string, file_path string, start_line int, end_line int, kind string").cache()
    return docs, search.postings(docs).cache()


def test_relevance(index):
    docs, posted = index
    first = lambda q: [r.node_id for r in search.search(docs, posted, q, 5).collect()][:1]
    assert first("pipeline repo") == ["fn:runPipelineFromRepo"] and first("kernel add") == ["fn:kernel_add"] and first("http server") == ["class:HTTPServer"]
    assert first("pipelne") == ["fn:runPipelineFromRepo"] and first("jwt authentication") == ["fn:verify_token"]
    assert search.search(docs, posted, "", 5).count() == search.search(docs, posted, "--- !!", 5).count() == search.search(docs, posted, "kernel", 0).count() == 0
    assert "<b>kernel</b>" in search.search(docs, posted, "kernel", 1).first().snippet


def test_one_edit(spark):
    words = spark.createDataFrame([(w,) for w in ("ring", "rign", "rng", "rings", "wring", "sing", "grin", "ringed", "irng")], "w string")
    assert {r.w for r in words.where(search.within_one_edit(F.col("w"), "ring")).collect()} == {"ring", "rign", "rng", "rings", "wring", "sing", "irng"}


def test_rank_fusion(spark):
    table = lambda *x: spark.createDataFrame([(k, i) for i, k in enumerate(x)], "node_id string, rank int")
    known = spark.createDataFrame([("A",), ("B",), ("C",)], "node_id string")
    got = vectors.rrf(table("A", "B"), table("B", "C", "Z"), known, 10).collect()
    assert [r.node_id for r in got] == ["B", "A", "C"] and abs(got[0].score - (1 / 62 + 1 / 61)) < 1e-12


def test_vectors(spark):
    import random

    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(100)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    top = vectors.knn(table, rows[7][1], 3).collect()
    assert top[0].vec_id == 7 and top[0].similarity > 0.999
    with pytest.raises(Exception, match="dimension"):
        vectors.knn(table, [1.0, 2.0], 3).collect()
    new = spark.createDataFrame([(7, [0.0] * 15 + [1.0])], "vec_id long, embedding array<float>")
    assert vectors.knn(vectors.upsert_vectors(table, new), [0.0] * 15 + [1.0], 1).first().vec_id == 7


def test_line_search(spark):
    text = ["fn kernelAdd(a)", "let x = 1;", "", "// add the kernel", "end"]
    lines = spark.createDataFrame([("src/a.rs", i + 1, t) for i, t in enumerate(text)] + [("b.rs", 1, "KERNEL ADD")], "file_path string, line int, text string")
    symbols = spark.createDataFrame([("src/a.rs", 3, "late"), ("src/a.rs", 1, "s1")], "file_path string, start_line int, id string")
    hits, dirs = grep.search_code(lines, symbols, "kernel add", 10, 1)
    assert [(r.node_id, r.score) for r in hits.orderBy(F.desc("score")).collect()] == [("s1", 2), ("file:b.rs", 1)]
    assert {(r.dir, r.matches) for r in dirs.collect()} == {("src", 2), ("b.rs", 1)}
    shown = hits.where("file_path = 'src/a.rs'").first().matches
    assert [(m.line, m.matched) for m in shown] == [(1, True), (2, False), (3, False), (4, True), (5, False)]
    assert grep.grep(lines, "kernel", regex=True).count() == 2 and grep.search_code(lines, symbols, " ", 5)[0].count() == 0


DIFF = """diff --git a/a.rs b/a.rs
--- a/a.rs
+++ b/a.rs
@@ -1,2 +1,3 @@ fn x
+new
@@ -8 +4,2 @@
@@ -20,3 +30,0 @@
--- a/gone.rs
+++ /dev/null
@@ -1,5 +0,0 @@
"""


def test_changes(spark):
    from graphloom.sources.files import diff_lines

    found = changes.merged_ranges(changes.diff_ranges(diff_lines(spark, DIFF)))
    assert {tuple(r) for r in found.select("file_path", "start", "end").collect()} == {("a.rs", 1, 5), ("a.rs", 30, 30)}
    ranges = spark.createDataFrame([("f", 1, 3), ("f", 4, 5), ("f", 7, 9), ("f", 2, 2)], "file_path string, start int, end int")
    assert sorted((r.start, r.end) for r in changes.merged_ranges(ranges).collect()) == [(1, 5), (7, 9)]


def test_rename(spark):
    lines = spark.createDataFrame([("a", 1, "foo foobar bar_foo foo2 foo"), ("a", 2, "fn foo() { foo(); }"), ("a", 9, "foo")], "file_path string, line int, text string")
    points = spark.createDataFrame([("a", 1), ("a", 2)], "file_path string, line int")
    edits = {r.line: (r.column, r.after) for r in changes.rename_edits(points, lines, "foo", "qux").collect()}
    assert edits == {1: (1, "qux foobar bar_foo foo2 qux"), 2: (4, "fn qux() { qux(); }")}
    with pytest.raises(ValueError, match="identifiers"):
        changes.rename_edits(points, lines, "foo", "a b")


def test_nearest_of_every_query(spark):
    """Every hundredth vector asks; blocks of any size give the same, ties go to the smaller key."""
    rows = [(i, [float((i * 37 + j * j * 11) % 23 - 11) for j in range(8)]) for i in range(350)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    size = lambda v: sum(x * x for x in v) ** 0.5
    want = set()
    for q, a in rows[::100]:
        near = sorted((-round(sum(x * y for x, y in zip(a, b, strict=True)) / (size(a) * size(b)), 9), k) for k, b in rows)[:5]
        want |= {(q, k) for _, k in near}
    asked = table.where("vec_id % 100 = 0")
    for blocks in ({}, {"ask": 2, "hold": 40}):
        assert {(r.query_id, r.vec_id) for r in vectors.knn_join(table, asked, 5, **blocks).collect()} == want
    assert vectors.knn_join(table, table.where("false"), 5).collect() == []
