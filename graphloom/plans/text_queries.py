"""Tokens, ranked search, vectors, line search, changes and grouped answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import answers, changes, grep, search, vectors
from graphloom.plans.graph_queries import G
from graphloom.plans.registry import query
from graphloom.session import stored
from graphloom.sources.tables import SPAN, edges, lines, nodes

LINES = "lines AS (SELECT concat(source, '/', lang, '/', doc_id, '.txt') AS file_path, generate_subscripts(l, 1)::INT AS line, unnest(l) AS text FROM (SELECT source, lang, doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"
#: Parts of a word by successive marking, as DuckDB's patterns have no lookahead.
_MARKED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '(\\p{Lu})(\\p{Lu}\\p{Ll})', '\\1 \\2', 'g'), '(\\p{Ll})(\\p{Lu})', '\\1 \\2', 'g'), '(\\p{L})(\\p{N})', '\\1 \\2', 'g'), '(\\p{N})(\\p{L})', '\\1 \\2', 'g')"


def _tokens(text: str) -> str:
    words = f"list_filter(list_transform(regexp_extract_all({text}, '[\\p{{L}}\\p{{M}}\\p{{N}}_-]+'), lambda w: trim(w, '_-')), lambda w: w <> '')"
    parts = f"list_filter(regexp_split_to_array({_MARKED}, '[ _-]+'), lambda p: p <> '')"
    return f"flatten(list_transform({words}, lambda w: CASE WHEN len({parts}) > 1 THEN list_concat([lower(w)], list_transform({parts}, lambda p: lower(p))) ELSE [lower(w)] END))"


NAMES = "concat('get', replace(p_brand, '#', ''), '_HTTPServer', p_size, '-', p_name, ' utf8Parser --x_ ', p_type)"


@query(f"SELECT p_partkey, array_to_string({_tokens('s')}, ',') AS tokens FROM (SELECT p_partkey, {NAMES} AS s FROM part)")
def tokenize_code(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(NAMES).alias("s"))
    return rows.select("p_partkey", F.array_join(X.code_tokens(F.col("s")), ",").alias("tokens"))


def _score(posted: str, docs: str, terms: str, boosts: str) -> str:
    return f"""posted AS ({posted}), tfs AS (SELECT field, term, doc_id, dl, count(*) AS tf FROM posted GROUP BY 1, 2, 3, 4),
avgs AS (SELECT field, sum(tf)::DOUBLE / count(DISTINCT doc_id) AS avgdl FROM tfs GROUP BY 1), hit AS (SELECT * FROM tfs WHERE term IN {terms}),
dfs AS (SELECT field, term, count(*) AS df FROM hit GROUP BY 1, 2),
scored AS (SELECT doc_id, sum({boosts} * ln(1 + (({docs}) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM hit JOIN dfs USING (field, term) JOIN avgs USING (field) GROUP BY 1)"""


_DOCS = "documents WHERE lang = 'en' AND text IS NOT NULL"


@query(f"""WITH d AS (SELECT doc_id, {_tokens('text')} AS t FROM {_DOCS}),
{_score("SELECT 'text' AS field, doc_id, len(t) AS dl, unnest(t) AS term FROM d", f"SELECT count(*) FROM {_DOCS}", "('stupid', 'worthless')", "1.0")}
SELECT doc_id, round(score, 6) AS score FROM scored""")
def bm25_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en' AND text IS NOT NULL")
    none = F.lit(None).cast("string")
    posted = stored(spark, "postings-en", sf_dir, lambda: search.postings(docs.select("doc_id", none.alias("name"), "text", none.alias("file_path"))))
    return search.bm25(posted, ["stupid", "worthless"], docs.count()).select("doc_id", F.round("score", 6).alias("score"))


_POSTED = r"""SELECT 'name' AS field, id AS doc_id, len(t) AS dl, unnest(t) AS term FROM (SELECT id, list_transform(regexp_extract_all(name, '[A-Za-z0-9]+'), lambda w: lower(w)) AS t FROM nd)
UNION ALL SELECT 'file_path', id, len(t), unnest(t) FROM (SELECT id, regexp_extract_all(lower(file_path), '[a-z0-9]+') AS t FROM nd)"""
_BOOST = "CASE field WHEN 'name' THEN 3.0 ELSE 1.0 END"


def _node_docs(spark, sf_dir, labels: str):
    return search.documents(nodes(spark, sf_dir).where(f"label IN ({labels})"))


@query(f"""{G}, nd AS (SELECT * FROM nodes WHERE label IN ('Struct', 'Function')), {_score(_POSTED, "SELECT count(*) FROM nd", "('small', 'ring', 'parts')", _BOOST)}
SELECT doc_id AS node_id, round(score, 6) AS score FROM scored""")
def bm25_fielded_boost(spark, sf_dir):
    docs = _node_docs(spark, sf_dir, "'Struct', 'Function'")
    posted = stored(spark, "postings-parts", sf_dir, lambda: search.postings(docs))
    found = search.bm25(posted, ["small", "ring", "parts"], docs.count())
    return found.join(docs.select("doc_id", "node_id"), "doc_id").select("node_id", F.round("score", 6).alias("score"))


@query("""SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS term FROM part)
WHERE damerau_levenshtein(term, 'rign') <= 1 OR damerau_levenshtein(term, 'smal') <= 1""")
def fuzzy_terms(spark, sf_dir):
    terms = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(X.code_tokens(F.col("p_name"))).alias("term")).distinct()
    return terms.where(search.within_one_edit(F.col("term"), "rign") | search.within_one_edit(F.col("term"), "smal"))


@query(f"""{G}, nd AS (SELECT * FROM nodes WHERE label IN ('Method', 'Function')), {_score(_POSTED, "SELECT count(*) FROM nd", "('customer', '000000007')", _BOOST)}
SELECT id AS node_id, round(score * 1.2 * CASE WHEN file_path LIKE '%.json' THEN 0.35 ELSE 1.0 END
 * CASE WHEN lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) = 'customer000000007' THEN 2.4 WHEN contains(lower(name), 'customer') AND contains(name, '000000007') THEN 1.45 ELSE 1.0 END, 6) AS score,
CASE WHEN file_path LIKE '%.json' THEN 5 ELSE 1 END AS bucket FROM scored JOIN nd ON doc_id = id""")
def search_rerank(spark, sf_dir):
    docs = _node_docs(spark, sf_dir, "'Method', 'Function'")
    posted = stored(spark, "postings-callables", sf_dir, lambda: search.postings(docs))
    found = search.bm25(posted, ["customer", "000000007"], docs.count()).join(docs, "doc_id")
    asked = "customer 000000007"
    return found.select("node_id", F.round(search.reranked(asked), 6).alias("score"), search.bucket(asked).alias("bucket"))


_HITS = "SELECT user_id AS node_id, CAST(event_id AS STRING) AS doc_id, value AS score, CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END AS name, CASE WHEN event_id % 3 = 0 THEN concat('p/', event_type) END AS file_path, 'Function' AS label, CASE WHEN event_id % 5 = 0 THEN 'ast' END AS kind, '' AS text, CAST(event_id % 4 AS INT) AS start_line FROM "


@query(f"""WITH h AS ({_HITS} events) SELECT node_id, max(score) AS score, first(name ORDER BY score DESC, doc_id) FILTER (name <> '') AS name,
first(file_path ORDER BY score DESC, doc_id) FILTER (file_path <> '') AS file_path, first(kind ORDER BY score DESC, doc_id) FILTER (kind <> '') AS kind,
first(start_line ORDER BY score DESC, doc_id) FILTER (start_line <> 0) AS start_line FROM h GROUP BY 1""")
def hit_merge(spark, sf_dir):
    hits = spark.sql(_HITS + "{events}", events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return search.merged_hits(hits).select("node_id", "score", "name", "file_path", "kind", "start_line")


@query("""SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS similarity
FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 20""")
def vector_knn(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = table.where("vec_id = 0").first()["embedding"]
    return vectors.knn(table, list(asked), 20).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, round(similarity, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC NULLS LAST, vec_id) <= 20""")
def vector_knn_all(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.knn_join(table, table.where("vec_id % 100 = 0"), 20).withColumn("similarity", F.round("similarity", 6))


_RANKS = ("SELECT vec_id AS node_id, CAST(row_number() OVER (ORDER BY vec_id * 7 % 101, vec_id) - 1 AS INT) AS rank FROM {0} WHERE vec_id < 60", "SELECT vec_id AS node_id, CAST(row_number() OVER (ORDER BY vec_id * 13 % 97, vec_id) - 1 AS INT) AS rank FROM {0} WHERE vec_id BETWEEN 30 AND 120")


@query(f"""WITH a AS ({_RANKS[0].format('embeddings')}), b AS ({_RANKS[1].format('embeddings')})
SELECT node_id, round(coalesce(1.0 / (61 + a.rank), 0.0)::DOUBLE + coalesce(1.0 / (61 + b.rank), 0.0)::DOUBLE, 9) AS score FROM a FULL JOIN b USING (node_id)
WHERE a.rank IS NOT NULL OR node_id % 5 <> 0""")
def rrf_fusion(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    a, b = (spark.sql(r.format("{t}"), t=table) for r in _RANKS)
    known = table.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("node_id"))
    return vectors.rrf(a, b, known, 1000).select("node_id", F.round("score", 9).alias("score"))


_LINE = "(contains(lower(text), 'stupid the') OR list_has_all(list_transform(regexp_extract_all(text, '[A-Z]*[a-z]+|[A-Z]+|[0-9]+'), lambda w: lower(w)), ['stupid', 'the']))"


@query(f"WITH {LINES} SELECT file_path, line, text FROM lines WHERE {_LINE}")
def grep_lines(spark, sf_dir):
    return grep.grep(lines(spark, sf_dir), "Stupid the")


@query(f"""WITH {LINES}, m AS (SELECT * FROM lines WHERE contains(lower(text), 'stupid') AND contains(file_path, '/en/'))
SELECT l.file_path, l.line, l.text, bool_or(l.line = m.line) AS matched FROM lines l JOIN m ON l.file_path = m.file_path AND l.line BETWEEN m.line - 2 AND m.line + 2 GROUP BY 1, 2, 3""")
def grep_context(spark, sf_dir):
    table = lines(spark, sf_dir)
    return grep.with_context(table, grep.grep(table, "stupid", path="/en/"), 2)


@query(f"WITH {LINES} SELECT split_part(file_path, '/', 1) AS dir, count(*) AS matches FROM lines WHERE regexp_matches(text, 'w[a-z]+less') GROUP BY 1")
def grep_dir_distribution(spark, sf_dir):
    return grep.directories(grep.grep(lines(spark, sf_dir), "w[a-z]+less", regex=True))


_POINTS = "SELECT DISTINCT file_path, CAST(start_line * 37 % 9000 AS INT) AS line FROM nodes WHERE label = 'Function'"


@query(f"""{G}, p AS ({_POINTS}), s AS (SELECT file_path, start_line, id FROM nodes WHERE start_line IS NOT NULL)
SELECT p.file_path, p.line, coalesce(max_by(id, (start_line, id)) FILTER (start_line <= line), min_by(id, (start_line, id))) AS symbol_id FROM p JOIN s USING (file_path) GROUP BY 1, 2""")
def nearest_symbol_asof(spark, sf_dir):
    n = nodes(spark, sf_dir)
    points = spark.sql(_POINTS.replace("FROM nodes", "FROM {n}"), n=n)
    return grep.nearest_symbol(points, n).select("file_path", "line", "symbol_id")


_RANGES = "SELECT concat('f', p_partkey % 50) AS file_path, CAST(p_partkey * 7 % 4000 AS INT) AS start, CAST(p_partkey * 7 % 4000 + p_size % 9 AS INT) AS \"end\" FROM part"


@query(f"""WITH r AS ({_RANGES}), f AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY file_path ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY file_path ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT file_path, min(start) AS start, max("end") AS "end" FROM i GROUP BY file_path, island""")
def diff_ranges_merge(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return changes.merged_ranges(part.selectExpr("concat('f', p_partkey % 50) AS file_path", "CAST(p_partkey * 7 % 4000 AS INT) AS start", "CAST(p_partkey * 7 % 4000 + p_size % 9 AS INT) AS end"))


_CHANGED = "SELECT concat('supply/n', s_nationkey, '/suppliers.rs') AS file_path, CAST(s_suppkey * 13 % 3000 AS INT) AS start, CAST(s_suppkey * 13 % 3000 + 400 AS INT) AS \"end\" FROM supplier"


@query(f"{G}, r AS ({_CHANGED}) SELECT DISTINCT n.id, n.start_line FROM nodes n JOIN r ON n.file_path = r.file_path AND NOT (n.end_line < r.start OR n.start_line > r.\"end\") WHERE label = 'Function'")
def changed_symbols_overlap(spark, sf_dir):
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    ranges = supplier.selectExpr("concat('supply/n', s_nationkey, '/suppliers.rs') AS file_path", "CAST(s_suppkey * 13 % 3000 AS INT) AS start", "CAST(s_suppkey * 13 % 3000 + 400 AS INT) AS end")
    return changes.changed_symbols(ranges, nodes(spark, sf_dir)).select("id", "start_line")


@query(f"""WITH {LINES}, p AS (SELECT file_path, unnest([3, 9]) AS pt FROM (SELECT DISTINCT file_path FROM lines WHERE contains(file_path, '/en/')))
SELECT DISTINCT l.file_path, line, (length(regexp_extract(text, '^(.*?)\\bthe\\b', 1)) + 1)::INT AS "column", regexp_replace(text, '\\bthe\\b', 'thy_x', 'g') AS after
FROM lines l JOIN p ON l.file_path = p.file_path AND line BETWEEN pt - 2 AND pt + 2 WHERE regexp_matches(text, '\\bthe\\b')""")
def rename_windows(spark, sf_dir):
    table = lines(spark, sf_dir)
    points = table.where(F.col("file_path").contains("/en/")).select("file_path").distinct().select("file_path", F.explode(F.array(F.lit(3), F.lit(9))).alias("line"))
    return changes.rename_edits(points, table, "the", "thy_x").select("file_path", "line", "column", "after")


_PARTS = f"SELECT id AS node_id, round(1.0 / (rowid - {5 * SPAN} + 1), 3) AS score, rowid - {5 * SPAN} AS place, rowid FROM nodes WHERE rowid BETWEEN {5 * SPAN + 1} AND {5 * SPAN + 60}"
_GROUPS = f"""g AS (SELECT n.id, n.name, sum(h.score::DOUBLE) + max(least(0.25, 0.05 * (contains(lower(concat_ws(' ', n.name, m.name, m.label)), 'order')::INT + contains(lower(concat_ws(' ', n.name, m.name, m.label)), 'ring')::INT)))::DOUBLE AS priority,
count(*) AS symbols, min((place, n.rowid)) AS first FROM h JOIN edges e ON e.src = h.rowid AND type = 'STEP_IN_PROCESS' JOIN nodes n ON n.rowid = e.dst JOIN nodes m ON m.rowid = h.rowid GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (ORDER BY round(priority, 9) DESC, symbols DESC, first) - 1 AS place FROM g QUALIFY place < 40)"""


@query(f"{G}, h AS ({_PARTS}), {_GROUPS} SELECT id, name, round(priority, 3) AS priority, symbols, place FROM top")
def query_process_groups(spark, sf_dir):
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    hits = spark.sql(_PARTS.replace("FROM nodes", "FROM {n}"), n=n).withColumn("score", F.col("score").cast("double"))
    return answers.process_groups(hits.drop("rowid"), e, n, ["order", "ring"], 40).withColumn("place", F.col("place").cast("long"))


@query(f"""{G}, h AS ({_PARTS}), {_GROUPS}, s AS (SELECT top.id AS process_id, node_id, step, score::DOUBLE AS score, row_number() OVER (PARTITION BY top.id ORDER BY step NULLS FIRST, score DESC, node_id) AS r
FROM h JOIN edges e ON e.src = h.rowid AND type = 'STEP_IN_PROCESS' JOIN nodes n ON n.rowid = e.dst JOIN top ON top.id = n.id)
SELECT process_id, node_id, step, score FROM s WHERE r <= 2 QUALIFY row_number() OVER (PARTITION BY process_id, node_id ORDER BY r) = 1""")
def process_symbol_cap(spark, sf_dir):
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    hits = spark.sql(_PARTS.replace("FROM nodes", "FROM {n}"), n=n).withColumn("score", F.col("score").cast("double")).drop("rowid")
    groups = answers.process_groups(hits, e, n, ["order", "ring"], 40)
    return answers.process_symbols(hits, groups, e, n, 2)
