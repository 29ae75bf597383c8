"""Ranked full-text search: fielded postings, BM25, one-edit terms, and reranking by kind, path and name.

docs: (doc_id, node_id, label, name, text, file_path, start_line, end_line, kind). Postings are built once and kept,
so a query reads the postings of its terms only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.functions import scalars
from graphloom.functions import text as X

K1, B = 1.2, 0.75
FIELDS = ("name", "text", "file_path")
#: Characters whose tokens a task counts.
TASK_CHARS = 2_000_000


def documents(nodes: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """A document per node (its semantic text if it has properties) and per chunk (its owner's label, else its kind)."""
    props = F.col("props") if "props" in nodes.columns else F.lit(None).cast("string")
    own = nodes.select(F.concat(F.lit("n:"), "id").alias("doc_id"), F.col("id").alias("node_id"), "label", "name", X.node_text(F.col("label"), props).alias("text"), "file_path", "start_line", "end_line", F.lit(None).cast("string").alias("kind"))
    if chunks is None:
        return own
    owners = nodes.select(F.col("id").alias("node_id"), "label")
    parts = chunks.join(owners, "node_id", "left").select(F.concat(F.lit("c:"), "node_id", F.lit(":"), "start_line").alias("doc_id"), "node_id", F.coalesce("label", "kind").alias("label"), F.lit(None).cast("string").alias("name"), "text", "file_path", "start_line", "end_line", "kind")
    return own.unionByName(parts)


def postings(docs: DataFrame) -> DataFrame:
    """(field, term, doc_id, tf, dl): name and text by code tokens, paths by runs of letters and digits.

    Documents are dealt by their id, about ``TASK_CHARS`` to a task, before they are cut into tokens: tokens outweigh
    them, and small files can hold many. A document's tokens are then counted where they are.
    """
    tokens = {"name": X.code_tokens(F.col("name")), "text": X.code_tokens(F.col("text")), "file_path": X.path_tokens(F.col("file_path"))}
    fields = docs.select("doc_id", *tokens)
    chars = fields.select(sum((F.coalesce(F.length(f), F.lit(0)) for f in tokens), F.lit(50)).cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0
    dealt = fields.repartition(chars // TASK_CHARS + 1, "doc_id")
    listed = dealt.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(t, F.array().cast("array<string>")).alias("terms")) for f, t in tokens.items()])).alias("f"))
    rows = listed.select("doc_id", "f.field", F.size("f.terms").alias("dl"), F.explode("f.terms").alias("term"))
    return rows.groupBy("field", "term", "doc_id", "dl").agg(F.count("*").alias("tf"))


def field_stats(posted: DataFrame, short: bool = False) -> DataFrame:
    """(field, avgdl): mean length over the documents that have the field; short ones are dealt before they are counted."""
    rows = posted.select("field", "doc_id", "tf")
    return (rows.repartition("doc_id") if short else rows).groupBy("field").agg((F.sum("tf") / F.count_distinct("doc_id")).alias("avgdl"))


def bm25(posted: DataFrame, terms: list[str], docs_count: int, boosts: dict[str, float] | None = None, stats: DataFrame | None = None) -> DataFrame:
    """(doc_id, score): BM25 summed over terms and fields, a field's share times its boost; ``stats`` if they are stored."""
    boosts = boosts or {"name": N.NAME_BOOST, "text": 1.0, "file_path": 1.0}
    stats = field_stats(posted) if stats is None else stats  # a row per field
    hits = posted.where(F.col("term").isin(*terms) & F.col("field").isin(*boosts)).join(F.broadcast(stats), "field")
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))  # a row per field and query term
    idf = F.log(1 + (docs_count - F.col("df") + 0.5) / (F.col("df") + 0.5))
    boost = F.create_map(*[x for f, b in boosts.items() for x in (F.lit(f), F.lit(b))])[F.col("field")]
    part = boost * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.join(F.broadcast(df), ["field", "term"]).groupBy("doc_id").agg(F.sum(part).alias("score"))


def within_one_edit(column: Column, term: str) -> Column:
    """Equal, or one insertion, deletion, replacement or swap of neighbours away."""
    near = F.levenshtein(column, F.lit(term), 1) >= 0
    swapped = F.lit(False)
    for i in range(len(term) - 1):
        if term[i] != term[i + 1]:
            swapped = swapped | (column == term[:i] + term[i + 1] + term[i] + term[i + 2 :])
    return near | swapped


def fuzzy(posted: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, score): one for each field (name, text) and query term that has a term within one edit."""
    long = [t for t in terms if len(t) >= N.FUZZY_CHARS]
    if not long:
        return posted.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    words = posted.where(F.col("field").isin("name", "text")).select("field", "term").distinct()
    close = words.select("field", "term", F.explode(F.array_compact(F.array(*[F.when(within_one_edit(F.col("term"), t), F.lit(t)) for t in long]))).alias("asked"))
    return posted.join(close, ["field", "term"]).select("doc_id", "field", "asked").distinct().groupBy("doc_id").agg(F.count("*").cast("double").alias("score"))


def covers(name: Column, terms: list[str]) -> Column:
    """Whether a name's tokens, with their synonyms, hold every query term."""
    if not terms:
        return F.lit(False)
    none = F.array().cast("array<string>")

    def all_there(own: Column) -> Column:  # the tokens are made once, and named
        brought = [F.when(F.array_contains(own, word), F.array(*map(F.lit, others))).otherwise(none) for word, others in N.SYNONYMS.items()]
        return F.size(F.array_except(F.array(*map(F.lit, terms)), F.concat(own, *brought))) == 0

    return F.coalesce(F.exists(F.array(X.code_tokens(name)), all_there), F.lit(False))


def reranked(query: str) -> Column:
    """The score times the factors of label, path and name."""
    terms, plain = scalars.query_terms(query), scalars.rank_name(query)
    label, name = F.coalesce("label", F.lit("")), F.coalesce("name", F.lit(""))
    own = X.rank_name(name)
    exact = (own != "") & (own == plain)
    factor = F.when(label.isin(*N.SYMBOL_LABELS), N.SYMBOL_BOOST).otherwise(1.0)
    factor = factor * F.when(label.isin(*N.CONTAINER_LABELS), N.CONTAINER_PENALTY).otherwise(1.0)
    factor = factor * F.when(X.noisy_path(F.coalesce("file_path", F.lit(""))), N.NOISY_PENALTY).otherwise(1.0)
    factor = factor * F.when(exact, N.EXACT_BOOST).when(covers(name, terms), N.COVERAGE_BOOST).otherwise(1.0)
    factor = factor * F.when(F.lower(label).isin(*terms), N.LABEL_BOOST).otherwise(1.0)
    return F.col("score") * factor


def bucket(query: str) -> Column:
    """0 exact symbol, 1 primary symbol, 2 other symbol or covered name, 3 rest, 4 container, 5 noisy path."""
    terms, plain = scalars.query_terms(query), scalars.rank_name(query)
    label, name = F.coalesce("label", F.lit("")), F.coalesce("name", F.lit(""))
    own = X.rank_name(name)
    return (
        F.when(X.noisy_path(F.coalesce("file_path", F.lit(""))), 5)
        .when(label.isin(*N.CONTAINER_LABELS), 4)
        .when(label.isin(*N.SYMBOL_LABELS) & (own != "") & (own == plain), 0)
        .when(label.isin(*N.PRIMARY_LABELS), 1)
        .when(label.isin(*N.SYMBOL_LABELS), 2)
        .when(covers(name, terms), 2)
        .otherwise(3)
    )


def merged_hits(hits: DataFrame) -> DataFrame:
    """One hit per node: the best document's, its missing fields filled from the lower ones in order."""
    fields = ("name", "file_path", "label", "kind", "text")
    best = Window.partitionBy("node_id").orderBy(F.desc("score"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = [F.first(F.nullif(F.col(f), F.lit("")), True).over(best).alias(f) for f in fields]
    rank = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("score"), "doc_id"))
    line = F.first(F.nullif(F.col("start_line"), F.lit(0)), True).over(best).alias("start_line")
    return hits.select("node_id", F.max("score").over(Window.partitionBy("node_id")).alias("score"), *filled, line, rank.alias("r")).where("r = 1").drop("r")


def search(docs: DataFrame, posted: DataFrame, query: str, limit: int) -> DataFrame:
    """(node_id, score, bucket, name, file_path, label, kind, snippet, start_line), by bucket, then score.

    Documents on clean paths come first; those on noisy ones are let in only if the clean ones' nodes are fewer
    than ``limit``. Each class gives at most the fetch size of documents before nodes are merged and reranked.
    """
    terms = scalars.query_terms(query)
    if not terms or limit <= 0:
        terms, limit = terms or ["\0"], 0
    scores = bm25(posted, terms, docs.count())
    if len(query.split()) < N.FUZZY_WORDS:
        scores = scores.unionByName(fuzzy(posted, terms)).groupBy("doc_id").agg(F.sum("score").alias("score"))
    hits = scores.join(docs, "doc_id").withColumn("noisy", X.noisy_path(F.coalesce("file_path", F.lit(""))))
    fetch = max(4 * limit, limit + 16)
    best = lambda noisy: hits.where(F.col("noisy") == noisy).orderBy(F.desc("score"), "doc_id").limit(fetch)
    clean, foreign = best(False), best(True)
    few = clean.agg((F.count_distinct("node_id") < limit).alias("few"))
    found = clean.unionByName(foreign.join(F.broadcast(few), F.col("few"), "left_semi"))
    rows = merged_hits(found).withColumn("score", reranked(query)).withColumn("bucket", bucket(query))
    ordered = rows.orderBy("bucket", F.desc("score"), F.asc_nulls_first("file_path"), F.asc_nulls_first("start_line"), "node_id").limit(limit)
    return ordered.select("node_id", "score", "bucket", "name", "file_path", "label", "kind", X.snippet(X.cut_bytes(F.col("text")), terms).alias("snippet"), "start_line")
