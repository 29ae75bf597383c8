"""Stored indexes: built, opened, searched, pruned and enriched; sources and sinks; several repositories."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.operators import grep, index, vectors
from graphloom.plans.answer_queries import _CONTAINERS
from graphloom.plans.graph_queries import G
from graphloom.plans.registry import query
from graphloom.plans.source_queries import _COUNTED, _FACTS_SQL, _read_back, _records
from graphloom.plans.text_queries import LINES, _score, _tokens
from graphloom.plans.upkeep_queries import _F, _facts
from graphloom.session import shared_dir
from graphloom.sources import facts
from graphloom.sources.tables import edges, lines, nodes


def _place(spark) -> str:
    return f"{shared_dir(spark)}/graphloom/index-{uuid.uuid4().hex}"


def _built(spark, sf_dir) -> index.Index:
    root = _place(spark)
    index.build(spark, root, nodes(spark, sf_dir), edges(spark, sf_dir))
    return index.open_index(spark, root)


_POSTED = f"""SELECT 'name' AS field, concat('n:', id) AS doc_id, len(t) AS dl, unnest(t) AS term FROM (SELECT id, {_tokens('name')} AS t FROM {{n}}) UNION ALL SELECT 'text', concat('n:', id), 1, lower(label) FROM {{n}} WHERE label IN {_CONTAINERS}
UNION ALL SELECT 'file_path', concat('n:', id), len(t), unnest(t) FROM (SELECT id, regexp_extract_all(lower(file_path), '[a-z0-9]+') AS t FROM {{n}})"""
_BOOST = "CASE field WHEN 'name' THEN 3.0 ELSE 1.0 END"


@query(f"{G}, {_score(_POSTED.replace('{n}', 'nodes'), 'SELECT count(*) FROM nodes', chr(40) + repr('ring') + ', ' + repr('brand11') + chr(41), _BOOST)} SELECT doc_id, round(score, 6) AS score FROM scored")
def index_search(spark, sf_dir):
    """BM25 over the stored postings of two terms' folders."""
    return _built(spark, sf_dir).bm25(["ring", "brand11"]).select("doc_id", F.round("score", 6).alias("score"))


_LEFT = "(SELECT * FROM nodes WHERE file_path IS DISTINCT FROM 'catalog/brand11/parts.rs')"


@query(f"{G}, p AS ({_POSTED.replace('{n}', _LEFT)}) SELECT field, count(DISTINCT doc_id) AS docs, count(*) AS tokens FROM p GROUP BY 1")
def index_without_file(spark, sf_dir):
    """Postings after the documents of one path have gone, by field."""
    gone = spark.createDataFrame([("catalog/brand11/parts.rs",), ("no/such/file",)], "path string")
    after, _ = index.without_paths(_built(spark, sf_dir), gone)
    posted = index.open_index(spark, after.root).table("postings")
    return posted.groupBy("field").agg(F.count_distinct("doc_id").alias("docs"), F.sum("tf").alias("tokens"))


_GOOD = '{"analyzer":"scip","source":"s","toolVersion":"1","adapterVersion":"1","oss":true}'


@query(f"""{_F} SELECT 'report' AS kind, name, status FROM (VALUES ('good', 'merged'), ('unsigned', 'missing toolVersion'), ('broken', 'failed: ValueError'), ('odd', 'not accepted'), ('empty', 'nothing')) v(name, status)
UNION ALL SELECT 'added', 'nodes', (SELECT count(*) FROM nation)::VARCHAR UNION ALL SELECT 'added', 'edges', (SELECT count(*) FROM nation)::VARCHAR
UNION ALL SELECT 'total', 'nodes', ((SELECT count(*) FROM nodes) + (SELECT count(*) FROM nation))::VARCHAR UNION ALL SELECT 'total', 'edges', ((SELECT count(*) FROM edges) + (SELECT count(*) FROM nation))::VARCHAR""")
def enrichment_providers(spark, sf_dir):
    """One provider adds, the others fail or give nothing, each on its own."""
    n, e = _facts(spark, sf_dir, "nodes"), _facts(spark, sf_dir, "edges")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")

    def made(provenance: str):
        more = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("geo").alias("file_path"), F.lit("Class").alias("label"), F.lit(provenance).alias("provenance"))
        links = nation.select(F.concat(F.lit("x"), "n_nationkey").alias("id"), F.concat(F.lit("n"), "n_nationkey").alias("source_id"), F.lit("p1").alias("target_id"), F.lit(provenance).alias("provenance"))
        return more, links

    def broken(_):
        raise ValueError("no tool")

    cases = [("good", "scip", lambda s: made(_GOOD)), ("unsigned", "scip", lambda s: made(_GOOD.replace("toolVersion", "tool"))), ("broken", "gopls", broken), ("odd", "magic", lambda s: None), ("empty", "pyright", lambda s: None)]
    after_n, after_e, report = index.enriched(n, e, [index.Provider(*c) for c in cases], 3600.0)
    rows = [("report", *r) for r in report.rows] + [("added", "nodes", str(report.nodes)), ("added", "edges", str(report.edges)), ("total", "nodes", str(after_n.count())), ("total", "edges", str(after_e.count()))]
    return spark.createDataFrame(rows, "kind string, name string, status string")


@query(f"{_FACTS_SQL} {_COUNTED}")
def facts_replayed(spark, sf_dir):
    """A source written to a sink of tables, and the sink's tables read as a source again."""
    path = _place(spark)
    _records(spark, sf_dir).orderBy("at").select("value").write.text(path)
    sink = index.TableSink(spark, path + "-sink")
    index.replay(facts.read(spark, path), sink)
    return _read_back(sink.facts())


@query("SELECT count(*) AS len, max(len(embedding))::INT AS dim FROM embeddings")
def vector_store_shape(spark, sf_dir):
    """Vectors saved with an index, opened again: their number and dimension."""
    root = _place(spark)
    n = nodes(spark, sf_dir).where("label IN ('Community', 'Class')")
    index.build(spark, root, n, edges(spark, sf_dir).where("type = 'MEMBER_OF'"), vectors=spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return index.vector_shape(index.open_index(spark, root).table("vectors"))


_NEAR = "SELECT vec_id AS node_id, row_number() OVER (ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {0})), 9) DESC, vec_id) - 1 AS rank FROM embeddings QUALIFY rank < 200"


@query(f"""WITH a AS ({_NEAR.format(0)}), b AS ({_NEAR.format(100)})
SELECT node_id, round(coalesce(1.0 / (61 + a.rank), 0.0)::DOUBLE + coalesce(1.0 / (61 + b.rank), 0.0)::DOUBLE, 9) AS score FROM a FULL JOIN b USING (node_id)""")
def rrf_of_searches(spark, sf_dir):
    """Two searches over all vectors, fused by rank."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = vectors.knn_join(table, table.where("vec_id IN (0, 100)"), 200).withColumnRenamed("vec_id", "node_id")
    order = [F.round("similarity", 9).desc(), F.col("node_id")]
    lists = [vectors.ranks(found.where(f"query_id = {q}"), order) for q in (0, 100)]
    fused = vectors.rrf(*lists, table.select(F.col("vec_id").alias("node_id")), 400)
    return fused.select("node_id", F.round("score", 9).alias("score"))


_REPOS = "SELECT CAST(user_id % 3 AS INT) AS repo, event_id AS place, concat('e', event_id) AS node_id, CAST(event_id % 7 AS DOUBLE) AS score FROM {events} WHERE event_type <> 'view'"


@query(f"SELECT repo, place, node_id, score FROM ({_REPOS.replace('{events}', 'events')}) ORDER BY score DESC, repo, place LIMIT 40")
def cross_repository_search(spark, sf_dir):
    return index.merged_search(spark.sql(_REPOS, events=spark.read.parquet(f"{sf_dir}/events.parquet")), 40)


@query(f"WITH {LINES} SELECT split_part(file_path, '/', 1) AS dir, count(*) AS matches FROM lines WHERE contains(lower(text), 'stupid') GROUP BY 1")
def cross_repository_directories(spark, sf_dir):
    """The languages as repositories: each counts its own matches, then directories are added up."""
    found = grep.grep(lines(spark, sf_dir), "stupid")
    parts = [grep.directories(found.where(F.col("file_path").contains(f"/{lang}/"))) for lang in ("en", "de", "fr", "es")]
    rest = grep.directories(found.where(~F.col("file_path").rlike("/(en|de|fr|es)/")))
    out = rest
    for part in parts:
        out = out.unionByName(part)
    return index.merged_directories(out)


@query(f"{G} SELECT file_path, count(*) AS symbols FROM nodes WHERE start_line IS NOT NULL AND file_path IN (SELECT concat('supply/n', n_nationkey, '/suppliers.rs') FROM nation WHERE n_nationkey % 2 = 0) GROUP BY 1")
def listed_files_that_exist(spark, sf_dir):
    from graphloom.operators import store

    there = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey % 2 = 0").select(F.concat(F.lit("supply/n"), "n_nationkey", F.lit("/suppliers.rs")).alias("path"))
    return index.existing_files(store.file_list(nodes(spark, sf_dir)), there)
