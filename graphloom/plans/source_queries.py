"""Facts files, indexes, symbol trees and resolver outputs, made of the tables, written and read back; slices and maps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalars
from graphloom.functions import text as X
from graphloom.operators import changes, incremental, maps, store
from graphloom.plans.registry import query
from graphloom.plans.text_queries import LINES
from graphloom.plans.upkeep_queries import _F, _facts
from graphloom.session import shared_dir, ship
from graphloom.sources import facts, files, semantic
from graphloom.sources.tables import SPAN, lines


def _tables(spark, sf_dir, *names):
    return [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names]


def _place(spark) -> str:
    return f"{shared_dir(spark)}/graphloom/facts-{uuid.uuid4().hex}"


# --- facts files ---------------------------------------------------------------------------------------------


def _records(spark, sf_dir) -> DataFrame:
    """(at, value): a record per nation, supplier, membership and part, in that order."""
    nation, supplier, part = _tables(spark, sf_dir, "nation", "supplier", "part")
    props = lambda name, line: F.to_json(F.struct(F.col(name).alias("name"), F.lit("a/b.rs").alias("filePath"), line.alias("startLine")))
    node = lambda t, kind, key, name: t.select(F.struct(F.lit(kind), F.col(key)).cast("struct<k:int,n:long>").alias("at"), F.concat(F.lit(f'{{"kind":"node","id":"{kind}:'), F.col(key), F.lit(f'","label":"{"Class" if kind == 0 else "File"}","properties":'), props(name, F.col(key)), F.lit("}")).alias("value"))
    edge = supplier.select(F.struct(F.lit(2), F.col("s_suppkey")).cast("struct<k:int,n:long>").alias("at"), F.concat(F.lit('{"kind":"edge","id":"e'), "s_suppkey", F.lit('","sourceId":"1:'), "s_suppkey", F.lit('","targetId":"0:'), "s_nationkey", F.lit('","type":"IN","confidence":0.5,"reason":""}')).alias("value"))
    chunk = part.select(F.struct(F.lit(3), F.col("p_partkey")).cast("struct<k:int,n:long>").alias("at"), F.concat(F.lit('{"kind":"chunk","nodeId":"1:'), "p_partkey", F.lit('","chunkKind":"ast","filePath":"a","startLine":'), "p_size", F.lit(',"endLine":'), "p_size", F.lit(',"text":"'), "p_name", F.lit('"}')).alias("value"))
    return node(nation, 0, "n_nationkey", "n_name").union(node(supplier, 1, "s_suppkey", "s_name")).union(edge).union(chunk)


def _read_back(found: facts.Facts) -> DataFrame:
    nodes = store.promoted(found.nodes).select(F.lit("node").alias("kind"), "id", "label", "name", F.col("start_line").alias("line"))
    edges = found.edges.select(F.lit("edge"), F.concat_ws(">", "sourceId", "targetId"), "type", "id", F.lit(None).cast("int"))
    chunks = found.chunks.select(F.lit("chunk"), "node_id", "kind", "text", "start_line")
    stats = found.stats.select(F.lit("stats"), F.concat_ws(",", "files", "nodes", "edges", "chunks"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int"))
    return nodes.union(edges).union(chunks).union(stats)


_FACTS_SQL = """SELECT 'node' AS kind, concat('0:', n_nationkey) AS id, 'Class' AS label, n_name AS name, n_nationkey::INT + 1 AS line FROM nation
UNION ALL SELECT 'node', concat('1:', s_suppkey), 'File', s_name, s_suppkey::INT + 1 FROM supplier UNION ALL SELECT 'edge', concat('1:', s_suppkey, '>0:', s_nationkey), 'IN', concat('e', s_suppkey), NULL FROM supplier
UNION ALL SELECT 'chunk', concat('1:', p_partkey), 'ast', p_name, p_size::INT + 1 FROM part UNION ALL SELECT 'stats', """
_COUNTED = "concat_ws(',', (SELECT count(*) FROM supplier), (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier), (SELECT count(*) FROM supplier), (SELECT count(*) FROM part)), NULL, NULL, NULL"


@query(f"{_FACTS_SQL} '7,8,9,10', NULL, NULL, NULL")
def facts_json_lines(spark, sf_dir):
    """Lines with blank ones between; the last record's stats count."""
    path = _place(spark)
    last = spark.createDataFrame([((8, 0), '{"kind":"manifest","stats":{"files":1,"nodes":1,"edges":1,"chunks":1}}'), ((9, 0), '{"kind":"done","stats":{"files":7,"nodes":8,"edges":9,"chunks":10}}'), ((9, 1), "  ")], "at struct<k:int,n:long>, value string")
    _records(spark, sf_dir).union(last).orderBy("at").select("value").write.text(path)
    return _read_back(facts.read(spark, path))


def _one_text(spark, value: DataFrame) -> str:
    path = _place(spark)
    value.coalesce(1).write.text(path)
    return path


@query(f"{_FACTS_SQL} {_COUNTED}")
def facts_array(spark, sf_dir):
    """One JSON array of tagged records; without stats of its own they are counted."""
    joined = _records(spark, sf_dir).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), ",").alias("v"))
    return _read_back(facts.read(spark, _one_text(spark, joined.select(F.concat(F.lit("["), "v", F.lit("]"))))))


@query(f"{_FACTS_SQL} {_COUNTED}")
def facts_bundle(spark, sf_dir):
    """An object of arrays with an analyzer; stats of zeros alone are counted anew."""
    rows = _records(spark, sf_dir).withColumn("value", F.replace("value", F.lit('"chunkKind"'), F.lit('"kind"')))
    kind = F.when(F.col("at.k") < 2, "node").when(F.col("at.k") == 2, "edge").otherwise("chunk")
    part = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kind == k, F.struct("at", F.regexp_replace("value", f'"kind":"{k}",', "").alias("value"))))), lambda x: x["value"]), ",")
    made = rows.agg(*[part(k).alias(k) for k in ("node", "edge", "chunk")])
    text = F.concat(F.lit('{"analyzer":{"id":"scip"},"stats":{"files":0,"nodes":0,"edges":0,"chunks":0},"nodes":['), "node", F.lit('],"edges":['), "edge", F.lit('],"chunks":['), "chunk", F.lit("]}"))
    found = facts.read(spark, _one_text(spark, made.select(text)))
    return _read_back(found)


@query("""SELECT concat('cbm:', p_partkey, ':pkg.', replace(p_name, ' ', '_')) AS id, p_partkey AS cbm_id, concat('pkg.', replace(p_name, ' ', '_')) AS qualified_name, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE replace(p_name, ' ', '_') END AS name FROM part
UNION ALL SELECT s_name, NULL, NULL, NULL FROM supplier""")
def engine_nodes(spark, sf_dir):
    part, supplier = _tables(spark, sf_dir, "part", "supplier")
    qualified = F.concat(F.lit("cbm:"), "p_partkey", F.lit(":pkg."), F.replace("p_name", F.lit(" "), F.lit("_")))
    rows = part.select(qualified.alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.struct(F.col("p_type").alias("name")))).otherwise("{}").alias("properties"))
    return facts.engine_node(rows.union(supplier.select("s_name", F.lit("{}")))).select("id", "cbm_id", "qualified_name", "name")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'own' ELSE '' END AS reason, CASE event_id % 3 WHEN 2 THEN NULL WHEN 1 THEN 1 ELSE user_id::INT END AS step, CASE WHEN event_id % 3 = 0 THEN 0.25 ELSE 1.0 END::DOUBLE AS confidence FROM events""")
def engine_edges(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    evidence = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("event_type").alias("reason"), F.col("user_id").alias("step"), F.lit(0.25).alias("confidence"))))
    rows = events.select("event_id", F.when(F.col("event_id") % 3 == 1, "own").otherwise("").alias("reason"), F.when(F.col("event_id") % 3 == 1, 1).alias("step"), F.lit(1.0).alias("confidence"), evidence.alias("evidence"))
    return facts.engine_edge(rows).drop("evidence")


@query(f"""WITH {LINES} SELECT concat('n:', file_path) AS node_id, CASE WHEN length(file_path) % 2 = 0 THEN 'ast-function' ELSE 'ast-class' END AS kind, file_path, 2 AS start_line, 4 AS end_line, string_agg(text, chr(10) ORDER BY line) AS text
FROM lines WHERE line BETWEEN 2 AND 4 GROUP BY file_path""")
def chunk_synthesis(spark, sf_dir):
    """Every file's second to fourth line as a function or class, and the file itself, which is a container."""
    table = lines(spark, sf_dir)
    own = table.select("file_path").distinct().withColumns({"id": F.concat(F.lit("n:"), "file_path"), "label": F.when(F.length("file_path") % 2 == 0, "Function").otherwise("Class"), "start_line": F.lit(2), "end_line": F.lit(4)})
    nodes = own.union(own.withColumn("label", F.lit("File")))
    return facts.synthesized_chunks(nodes, table)


@query("SELECT DISTINCT concat('rel:calls:part:', l_partkey, ':supp:', l_suppkey) AS id, concat('part:', l_partkey) AS source_id, concat('supp:', l_suppkey) AS target_id, 'CALLS' AS type FROM lineitem")
def facts_lower_edges(spark, sf_dir):
    lineitem, part = _tables(spark, sf_dir, "lineitem", "part")
    relations = lineitem.selectExpr("concat('part:', l_partkey) AS source", "concat('supp:', l_suppkey) AS target", "'calls' AS kind")
    none = part.limit(0)
    empty = none.selectExpr("p_name AS path", "p_name AS language", "p_name AS digest"), none.selectExpr("p_name AS symbol", "p_name AS display_name", "p_name AS kind", "p_name AS file_path", "p_size AS start_line", "p_size AS end_line"), none.selectExpr("p_name AS symbol", "p_name AS role", "p_name AS file_path", "p_size AS start_line", "p_size AS end_line", "p_partkey AS ordinal")
    _, edges = semantic.lowered(*empty, relations)
    return edges.select("id", F.col("sourceId").alias("source_id"), F.col("targetId").alias("target_id"), "type")


@query("""WITH o AS (SELECT l_partkey, arg_min(l_suppkey, (l_orderkey, l_linenumber)) AS s, arg_min(l_linenumber, (l_orderkey, l_linenumber)) AS n FROM lineitem WHERE l_linenumber > 1 GROUP BY 1)
SELECT concat('p', p_partkey) AS id, coalesce(CASE WHEN p_partkey % 2 = 0 THEN 'own.rs' END, concat('f', o.s)) AS file_path, o.n AS line FROM part LEFT JOIN o ON p_partkey = l_partkey""")
def symbol_first_definition(spark, sf_dir):
    """A symbol without a file or range of its own takes its first definition's."""
    lineitem, part = _tables(spark, sf_dir, "lineitem", "part")
    no = F.lit(None).cast("int")
    symbols = part.select(F.concat(F.lit("p"), "p_partkey").alias("symbol"), F.col("p_name").alias("display_name"), F.lit("Struct").alias("kind"), F.when(F.col("p_partkey") % 2 == 0, "own.rs").alias("file_path"), no.alias("start_line"), no.alias("end_line"))
    met = lineitem.select(F.concat(F.lit("p"), "l_partkey").alias("symbol"), F.when(F.col("l_linenumber") > 1, "Definition").otherwise("Reference").alias("role"), F.concat(F.lit("f"), "l_suppkey").alias("file_path"), F.col("l_linenumber").alias("start_line"), F.col("l_linenumber").alias("end_line"), F.struct("l_orderkey", "l_linenumber").alias("ordinal"))
    files_ = part.limit(0).selectExpr("p_name AS path", "p_name AS language", "p_name AS digest")
    nodes, _ = semantic.lowered(files_, symbols, met, part.limit(0).selectExpr("p_name AS source", "p_name AS target", "p_name AS kind"))
    p = lambda k: X.string_prop(F.col("properties"), k)
    return nodes.select("id", p("filePath").alias("file_path"), p("startLine").cast("int").alias("line"))


# --- indexes, symbol trees, resolver outputs -----------------------------------------------------------------


def _message(*fields: tuple[int, int | bytes | str]) -> bytes:
    """A protobuf message of varint and length-delimited fields."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    made = b""
    for number, value in fields:
        if isinstance(value, int):
            made += varint(number << 3) + varint(value)
        else:
            data = value.encode() if isinstance(value, str) else value
            made += varint(number << 3 | 2) + varint(len(data)) + data
    return made


def _indexes(spark, sf_dir) -> DataFrame:
    """(content): an index per nation, whose document defines its suppliers and implements the nation."""
    import pandas as pd

    nation, supplier = _tables(spark, sf_dir, "nation", "supplier")
    rows = supplier.groupBy("s_nationkey").agg(F.sort_array(F.collect_list("s_suppkey")).alias("keys")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_nationkey", "n_name", "keys")

    def run(frames):
        for frame in frames:
            out = []
            for key, name, keys in zip(frame["n_nationkey"], frame["n_name"], frame["keys"], strict=True):
                document = [(4, "rust"), (1, f"n{key}.rs")]
                for k in map(int, keys):
                    span = _message((1, bytes([k % 100, 1, 9]))) if k % 2 else _message((1, bytes([k % 100, 1, k % 100 + 1, 9])))
                    document += [(2, span + _message((2, f"s{k}"), (3, 1))), (2, _message((1, bytes([3, 1, 2])), (2, f"n{key}"), (3, 8 if k % 3 else 0)))]
                    document += [(3, _message((1, f"s{k}"), (5, 17), *([(6, name)] if k % 2 else []), (4, _message((1, f"n{key}"), (3, 1)))))]
                out.append(_message((1, _message((2, _message((1, "tool"), (2, "1.2"))), (3, f"file:///n{key}"))), (2, _message(*document))))
            yield pd.DataFrame({"content": out})

    ship(spark)
    return rows.mapInPandas(run, "content binary")


@query("""SELECT 'occurrence' AS kind, concat('s', s_suppkey) AS symbol, 'Definition' AS detail, concat('n', s_nationkey, '.rs') AS file_path, (s_suppkey % 100)::INT AS first, (s_suppkey % 100 + CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END)::INT AS last FROM supplier
UNION ALL SELECT 'occurrence', concat('n', s_nationkey), CASE WHEN s_suppkey % 3 = 0 THEN 'Reference' ELSE 'ReadAccess' END, concat('n', s_nationkey, '.rs'), 3, 3 FROM supplier
UNION ALL SELECT 'symbol', concat('s', s_suppkey), CASE WHEN s_suppkey % 2 = 0 THEN concat('s', s_suppkey) ELSE n_name END, concat('n', s_nationkey, '.rs'), 17, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'relation', concat('s', s_suppkey), 'implements', concat('n', s_nationkey), NULL, NULL FROM supplier
UNION ALL SELECT DISTINCT 'file', NULL, 'rust', concat('n', s_nationkey, '.rs'), NULL, NULL FROM supplier UNION ALL SELECT DISTINCT 'tool', 'tool', '1.2', concat('file:///n', s_nationkey), NULL, NULL FROM supplier""")
def index_protobufs(spark, sf_dir):
    """Files, occurrences with roles and ranges, symbols, relationships and tools of an index per nation."""
    t = semantic.index_tables(_indexes(spark, sf_dir))
    no = lambda kind: F.lit(None).cast(kind)
    out = t["occurrences"].select(F.lit("occurrence").alias("kind"), "symbol", F.col("role").alias("detail"), "file_path", F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    out = out.union(t["symbols"].select(F.lit("symbol"), "symbol", "display_name", "file_path", "kind", no("int")))
    out = out.union(t["relations"].select(F.lit("relation"), "source", "kind", "target", no("int"), no("int")))
    out = out.union(t["files"].select(F.lit("file"), no("string"), "language", "path", no("int"), no("int")))
    return out.union(t["tools"].select(F.lit("tool"), "name", "version", "project_root", no("int"), no("int")))


@query("""SELECT 'node' AS kind, 'Class' AS label, r_name AS name, concat('r', r_regionkey, '.rs') AS detail, 1 AS first, 100 AS last FROM region
UNION ALL SELECT 'node', 'Method', concat(r_name, '.', n_name), concat('r', r_regionkey, '.rs'), n_nationkey::INT + 2, n_nationkey::INT + 3 FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'edge', 'DEFINES', NULL, NULL, count(*)::INT, NULL FROM region UNION ALL SELECT 'edge', 'CONTAINS', NULL, NULL, count(*)::INT, NULL FROM nation""")
def symbol_trees(spark, sf_dir):
    """A file per region, whose class has the nations as methods."""
    region, nation = _tables(spark, sf_dir, "region", "nation")
    span = lambda a, b: F.struct(F.struct(a.alias("line")).alias("start"), F.struct(b.alias("line")).alias("end"))
    own = nation.groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("name"), F.lit(6).alias("kind"), span(F.col("n_nationkey") + 1, F.col("n_nationkey") + 2).alias("range"))).alias("children"))
    top = F.array(F.struct(F.col("r_name").alias("name"), F.lit(5).alias("kind"), span(F.lit(0), F.lit(99)).alias("range"), "children"))
    trees = region.join(own, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat(F.lit("r"), "r_regionkey", F.lit(".rs")).alias("file_path"), F.to_json(top).alias("symbols"))
    nodes, edges = semantic.symbol_tables(trees)
    no = F.lit(None)
    shown = nodes.select(F.lit("node").alias("kind"), "label", F.col("qualified_name").alias("name"), F.col("file_path").alias("detail"), F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    return shown.union(edges.groupBy("type").agg(F.count("*").cast("int").alias("n")).select(F.lit("edge"), "type", no.cast("string"), no.cast("string"), "n", no.cast("int")))


@query("""WITH f AS (SELECT s_suppkey, s_nationkey FROM supplier) SELECT 'node' AS kind, concat('file:u', s_suppkey, '.py') AS id, 'File' AS label FROM f UNION ALL SELECT DISTINCT 'node', concat('file:d', s_nationkey, '.py'), 'File' FROM f
UNION ALL SELECT 'node', concat('ref:u', s_suppkey, '.py:4:2'), 'Reference' FROM f UNION ALL SELECT DISTINCT 'node', concat('def:d', s_nationkey, '.py:', s_suppkey % 2 + 1, ':7'), 'Symbol' FROM f
UNION ALL SELECT 'edge', concat('file:u', s_suppkey, '.py>ref:u', s_suppkey, '.py:4:2'), 'CONTAINS' FROM f UNION ALL SELECT DISTINCT 'edge', concat('file:d', s_nationkey, '.py>def:d', s_nationkey, '.py:', s_suppkey % 2 + 1, ':7'), 'DEFINES' FROM f
UNION ALL SELECT 'edge', concat('ref:u', s_suppkey, '.py:4:2>def:d', s_nationkey, '.py:', s_suppkey % 2 + 1, ':7'), 'REFERS_TO' FROM f""")
def resolver_outputs(spark, sf_dir):
    """An output per supplier: the place that was asked for, then the definition that it resolves to."""
    text = F.array(F.concat(F.lit("u"), "s_suppkey", F.lit(".py:4:2: found 1 definitions for queried reference")), F.lit("has 1 definition"), F.concat(F.lit("  d"), "s_nationkey", F.lit(".py:"), (F.col("s_suppkey") % 2 + 1).cast("string"), F.lit(":7:")))
    said = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("output"), F.posexplode(text).alias("line", "text"))
    nodes, edges = semantic.lowered_resolutions(semantic.resolutions(said))
    return nodes.select(F.lit("node").alias("kind"), "id", "label").union(edges.select(F.lit("edge"), F.concat_ws(">", "source_id", "target_id"), "type"))


# --- files, slices, maps -------------------------------------------------------------------------------------


@query("""SELECT concat('n', n_nationkey, '.txt') AS path, sha256(concat(n_name, chr(10), n_regionkey, chr(10))) AS hash, octet_length(encode(concat(n_name, chr(10), n_regionkey, chr(10))))::BIGINT AS size FROM nation""")
def file_fingerprints(spark, sf_dir):
    """A file per nation, written and read back; files in build folders are passed over."""
    root = _place(spark)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("n"), "n_nationkey", F.lit(".txt")).alias("path"), F.concat("n_name", F.lit("\n"), "n_regionkey", F.lit("\n")).alias("text"))
    _write_files(rows.union(rows.select(F.concat(F.lit("target/"), "path"), "text")), root)
    return files.fingerprints(spark, root)


def _write_files(rows: DataFrame, root: str) -> None:
    """Writes (path, text) below a folder through Spark's file system, a small number of files."""
    spark = rows.sparkSession
    system = None
    for r in rows.collect():
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{r['path']}")
        system = system or where.getFileSystem(spark._jsc.hadoopConfiguration())
        out = system.create(where, True)
        out.write(bytearray(r["text"].encode()))
        out.close()


@query("SELECT concat('n', n_nationkey, '.txt') AS file_path, 2 AS line, n_regionkey::VARCHAR AS text FROM nation WHERE n_nationkey = 7")
def file_slice(spark, sf_dir):
    root = _place(spark)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("n"), "n_nationkey", F.lit(".txt")).alias("path"), F.concat("n_name", F.lit("\n"), "n_regionkey", F.lit("\n")).alias("text"))
    _write_files(rows, root)
    return files.read_slice(spark, root, "n7.txt", 2, 9)


_STATUS = "CASE WHEN file_path LIKE 'f2%' THEN 'modified' WHEN file_path LIKE 'f4%' THEN 'added' ELSE 'unchanged' END"


@query(f"""{_F}, d AS (SELECT DISTINCT file_path, {_STATUS} AS status FROM nodes), part_ AS (SELECT n.* FROM nodes n JOIN d USING (file_path) WHERE status <> 'unchanged')
SELECT 'node' AS kind, id FROM part_ UNION ALL SELECT 'edge', id FROM edges WHERE source_id IN (SELECT id FROM part_) OR target_id IN (SELECT id FROM part_)
UNION ALL SELECT 'chunk', node_id FROM chunks JOIN d USING (file_path) WHERE status <> 'unchanged'""")
def incremental_slice(spark, sf_dir):
    n, e, c = (_facts(spark, sf_dir, x) for x in ("nodes", "edges", "chunks"))
    found = n.select("file_path").distinct().select(F.col("file_path").alias("path"), F.expr(_STATUS).alias("status"))
    nodes, edges, chunks, _ = incremental.slice_of(n, e, c, found)
    return nodes.select(F.lit("node").alias("kind"), "id").union(edges.select(F.lit("edge"), "id")).union(chunks.select(F.lit("chunk"), "node_id"))


@query("SELECT * FROM (VALUES ('few', 'incremental', '+1 ~2 -1 =22'), ('many', 'full', '+0 ~25 -75 =0'), ('same', 'none', '+0 ~0 -0 =25'), ('moved', 'full', '+1 ~2 -1 =22')) v(name, answer, summary)")
def incremental_preflight(spark, sf_dir):
    """Few changes, too many, none, and few with other settings; the tables' 25 nations and a hundred numbers are the files."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("concat('f', n_nationkey) AS path", "n_name AS hash")
    few = nation.where("path <> 'f3'").withColumn("hash", F.when(F.col("path").isin("f1", "f2"), "new").otherwise(F.col("hash"))).union(spark.createDataFrame([("fresh", "x")], "path string, hash string"))
    many = spark.range(100).selectExpr("concat('f', id) AS path", "'old' AS hash")
    cases = (("few", incremental.delta(nation, few), True), ("many", incremental.delta(many, nation), True), ("same", incremental.delta(nation, nation), True), ("moved", incremental.delta(nation, few), False))
    rows = [(name, incremental.preflight(d, same, True), incremental.summary(d).first()[0]) for name, d, same in cases]
    return spark.createDataFrame(rows, "name string, answer string, summary string")


_TOOLS = f"""SELECT 20 * {SPAN} + r_regionkey AS rowid, concat('tool:', r_regionkey) AS id, 'Tool' AS label, r_name AS name, 't.rs' AS file_path, concat('{{{{"description":"', repeat('d', 150 + 30 * r_regionkey), '"}}}}') AS props FROM {{region}}
UNION ALL SELECT 21 * {SPAN} + n_nationkey, concat('op:', n_nationkey), 'GraphQL', n_name, 'g.rs', CASE WHEN n_nationkey % 2 = 0 THEN '{{{{"operationType":"query"}}}}' ELSE '{{{{}}}}' END FROM {{nation}}
UNION ALL SELECT 22 * {SPAN} + s_suppkey, concat('fn:', s_suppkey), 'Function', s_name, 'f.rs', '{{{{}}}}' FROM {{supplier}} UNION ALL SELECT 23 * {SPAN} + r_regionkey, concat('flow:', r_regionkey), 'Process', concat('flow ', r_name), NULL, '{{{{}}}}' FROM {{region}}"""
_TOOL_EDGES = f"""SELECT 22 * {SPAN} + s_suppkey AS src, 20 * {SPAN} + n_regionkey AS dst, 'HANDLES_TOOL' AS type FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey
UNION ALL SELECT 22 * {SPAN} + s_suppkey, 21 * {SPAN} + s_nationkey, 'HANDLES_GRAPHQL' FROM {{supplier}} UNION ALL SELECT 20 * {SPAN} + r_regionkey, 23 * {SPAN} + r_regionkey, 'STEP_IN_PROCESS' FROM {{region}}"""


def _tools(spark, sf_dir):
    t = dict(zip(("region", "nation", "supplier"), _tables(spark, sf_dir, "region", "nation", "supplier"), strict=True))
    return spark.sql(_TOOLS, **t), spark.sql(_TOOL_EDGES, **t).withColumns({"step": F.lit(1), "reason": F.lit(""), "confidence": F.lit(1.0)})


@query("""SELECT concat('tool:', r_regionkey) AS id, r_name AS name, repeat('d', least(200, 150 + 30 * r_regionkey)) AS description, (SELECT string_agg(s_name, ',' ORDER BY s_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS handlers, concat('flow ', r_name) AS flows FROM region""")
def tool_map(spark, sf_dir):
    found = maps.tool_map(*_tools(spark, sf_dir))
    return found.select("id", "name", "description", F.array_join("handlers", ",").alias("handlers"), F.array_join("flows", ",").alias("flows"))


@query("""SELECT concat('op:', n_nationkey) AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'query' ELSE 'unknown' END AS operation_type, n_name AS name, coalesce((SELECT string_agg(s_name, ',' ORDER BY s_name) FROM supplier WHERE s_nationkey = n_nationkey), '') AS handlers FROM nation""")
def graphql_map(spark, sf_dir):
    found = maps.graphql_map(*_tools(spark, sf_dir))
    return found.select("id", "operation_type", "name", F.array_join("handlers", ",").alias("handlers"))


@query("""WITH l AS (SELECT file_path, text, row_number() OVER (PARTITION BY file_path ORDER BY line) AS line FROM (SELECT concat('geo/', n_regionkey) AS file_path, n_nationkey AS line, concat('use ', n_name, ';') AS text FROM nation))
SELECT file_path, string_agg(replace(text, 'NATION_3;', 'Land;'), chr(10) ORDER BY line) AS content FROM l WHERE file_path IN (SELECT file_path FROM l WHERE contains(text, 'NATION_3;')) GROUP BY 1""")
def rename_applied(spark, sf_dir):
    """The contents of edited files, as they would be written."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("concat('geo/', n_regionkey) AS file_path", "n_nationkey AS n", "concat('use ', n_name, ';') AS text")
    table = spark.sql("SELECT file_path, CAST(row_number() OVER (PARTITION BY file_path ORDER BY n) AS INT) AS line, text FROM {n}", n=nation)
    points = table.where("text LIKE '%NATION_3;%'").select("file_path", "line")
    return changes.applied(table, changes.rename_edits(points, table, "NATION_3", "Land"))


#: Arguments and results of functions of requests: fixed values.
_CALLS = (
    ("query_terms", scalars.query_terms, ("getUserID auth",), "getuserid,get,user,id,auth,token,security,credential,login"),
    ("ranking_terms", scalars.ranking_terms, ("Parse_the-URL of _x_",), "parse_the,url"),
    ("expanded_query", scalars.expanded_query, ("parse url", "fast url reader", None), "parse url fast reader"),
    ("clamp", scalars.clamp, (500, 10, 100), "100"),
    ("clamp", scalars.clamp, (None, 10, 100), "10"),
    ("is_identifier", scalars.is_identifier, ("a_1",), "True"),
    ("is_identifier", scalars.is_identifier, ("1a",), "False"),
    ("fnv1a", scalars.fnv1a, (b"a",), "3826002220"),
    ("repository_name", scalars.repository_name, ("git@host:team/tool.git",), "tool"),
    ("file_uri_path", scalars.file_uri_path, ("file:///a%20b/c.rs",), "/a b/c.rs"),
    ("rank_name", scalars.rank_name, ("Foo-Bar_9",), "foobar9"),
    ("risk_level", scalars.risk_level, (4, True), "HIGH"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{name}', '{want}')" for i, (name, _, _, want) in enumerate(_CALLS)) + ") v(i, name, result)")
def request_functions(spark, sf_dir):
    shown = lambda x: ",".join(x) if isinstance(x, list) else str(x)
    return spark.createDataFrame([(i, name, shown(f(*arguments))) for i, (name, f, arguments, _) in enumerate(_CALLS)], "i int, name string, result string")
