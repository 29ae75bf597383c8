"""Quality rules as a short-circuit cascade of native column expressions.

Each rule rejects a document or lets it pass. On a bounded sample every rule's cost (seconds per row)
and selectivity (share rejected) are measured; rules run by falling rejection per cost inside one CASE,
so that a document that a rule rejects is spared all later ones. Order changes cost alone: the verdict
is the conjunction of the rules. A rule's cost is what a pass with it takes beyond the same pass without it.

Input contract: a null text has no words; empty texts fail the base rule; texts of any length are counted
whole; repeated rows give a row each; an empty table gives an empty table; further columns of any name are
carried along by ``keep_good`` and ignored by ``quality``.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows on which cost and selectivity are measured, about, and how often each is judged to time a rule.
SAMPLE_ROWS, REPEATS = 1000, 32
#: Low bits of a packed window that hold its place; longer texts are sorted by the words themselves.
PLACE_BITS = 20

#: Fixed values of the word, symbol and base rules.
WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


@dataclass(frozen=True)
class Rule:
    """``rejects`` sees the columns ``_text``, ``_words`` and the base features with a leading underscore."""

    name: str
    rejects: str


RULES = (
    Rule("symbols", "_n_symbols > 0.1D * _n_words"),
    Rule("duplicate_lines", "_n_dup_lines > 0.4D * size(split(_text, '\\n', -1))"),
    Rule("mean_word_length", "_word_chars < 2.5D * _n_words OR _word_chars > 14D * _n_words"),
    Rule("shouting", r"regexp_count(_text, '\\p{Lu}') > 0.4D * _word_chars"),
    Rule("wordless", r"size(filter(_words, w -> NOT w RLIKE '\\p{L}')) > 0.3D * _n_words"),
    Rule("bullets", r"regexp_count(_text, '(?m)^[ \\t]*[-\\u2022*]') > 0.9D * size(split(_text, '\\n', -1))"),
)


def _repeat_words() -> dict[str, str]:
    """SQL for the words that lie in three-word windows found twice or more.

    Windows become longs, a hash above and the place below; equal hashes are neighbours once sorted. Neighbours
    are compared by their words; a text with a hash collision, or too long for the packing, is sorted by words.
    """
    low = (1 << PLACE_BITS) - 1
    packed = f"sort_array(transform(slice(_words, 1, greatest(size(_words) - 2, 0)), (w, i) -> (xxhash64(w, get(_words, i + 1), get(_words, i + 2)) & ~{low}L) | i))"
    same = lambda a, b: f"coalesce(({a} & ~{low}L) = ({b} & ~{low}L), false)"
    hits = f"filter(_packed, (v, k) -> {same('v', 'get(_packed, k - 1)')} OR {same('v', 'get(_packed, k + 1)')})"
    word = lambda v, d: f"get(_words, cast({v} & {low}L AS int) + {d})"
    differ = " OR ".join(f"{word('v', d)} <> {word('get(_hits, k + 1)', d)}" for d in range(3))
    clash = f"exists(transform(_hits, (v, k) -> {same('v', 'get(_hits, k + 1)')} AND ({differ})), x -> x)"
    covered = lambda places: f"size(array_distinct(flatten(transform({places}, i -> array(i, i + 1, i + 2)))))"
    by_words = "sort_array(transform(slice(_words, 1, greatest(size(_words) - 2, 0)), (w, i) -> struct(concat_ws(' ', w, get(_words, i + 1), get(_words, i + 2)) AS t, i AS i)))"
    slow = "transform(filter(_sorted, (v, k) -> coalesce(v.t = get(_sorted, k - 1).t, false) OR coalesce(v.t = get(_sorted, k + 1).t, false)), v -> v.i)"
    return dict(packed=packed, hits=hits, clash=clash, fast=covered(f"transform(_hits, v -> v & {low}L)"), by_words=by_words, slow=covered(slow))


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all of the input's columns as a struct), ``_text``, ``_words`` and the base features."""
    sql = _repeat_words()
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    out = out.withColumn("_words", F.expr(f"filter(split(_text, r'{WHITE}', -1), w -> w <> '')"))
    out = out.withColumn("_packed", F.expr(f"CASE WHEN size(_words) < {1 << PLACE_BITS} THEN {sql['packed']} END"))
    out = out.withColumn("_hits", F.expr(sql["hits"]))
    out = out.withColumn("_sorted", F.expr(f"CASE WHEN _packed IS NULL OR {sql['clash']} THEN {sql['by_words']} END"))
    out = out.select(
        "row",
        "_text",
        "_words",
        F.expr("size(_words)").cast("long").alias("_n_words"),
        F.expr("char_length(array_join(_words, ''))").cast("long").alias("_word_chars"),
        F.expr(f"regexp_count(_text, '{SYMBOLS}')").cast("long").alias("_n_symbols"),
        F.expr(f"filter(split(_text, '\\n', -1), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')").alias("_lines"),
        F.expr(f"CASE WHEN _sorted IS NOT NULL THEN {sql['slow']} ELSE {sql['fast']} END").cast("long").alias("_n_repeat_words"),
    ).select(
        "row", "_text", "_words", "_n_words", "_word_chars", "_n_symbols", "_n_repeat_words",
        F.expr("size(_lines) - size(array_distinct(_lines))").cast("long").alias("_n_dup_lines"),
    )
    # a filter on what a generator gives is not pushed below it, where each use of a feature would repeat its expression
    return out.select(F.inline(F.array(F.struct("*"))))


def base_failed() -> Column:
    return F.expr(f"_n_words < {MIN_WORDS} OR 100 * _n_repeat_words > {MAX_REPEAT_PERCENT} * _n_words")


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Each rule with its seconds per row and the share that it rejects, on a random sample of about ``sample_rows`` rows."""
    texts = docs.select(text)
    sample = with_features(texts.sample(min(1.0, sample_rows / max(texts.count(), 1)), seed=1), text).drop("row").cache()
    rows = max(sample.count(), 1) * REPEATS
    again = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def timed(condition: str) -> tuple[float, float]:
        began = time.perf_counter()
        share = again.agg(F.avg(F.expr(condition).cast("double"))).first()[0]
        return time.perf_counter() - began, share or 0.0

    timed("_n_words < 0")  # the first pass also starts workers and compiles
    empty, _ = timed("_n_words < 0")
    out = []
    for rule in rules:
        seconds, share = timed(rule.rejects)
        out.append((rule, max(seconds - empty, 0.0) / rows, share))
    sample.unpersist()
    return out


def by_rejection_per_cost(measured: list[tuple[Rule, float, float]]) -> list[Rule]:
    return [r for r, cost, share in sorted(measured, key=lambda x: (-x[2] / max(x[1], 1e-12), x[0].name))]


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, else null; later rules aren't evaluated."""
    out = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        out = out.when(F.expr(rule.rejects), F.lit(rule.name))
    return out


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: ``key``, the base features, ``base_failed``, ``kept`` and ``rejected_by`` (a rule's name, ``base``, or null)."""
    order = by_rejection_per_cost(measure(docs, rules, text))
    out = with_features(docs.select(key, text), text)
    out = out.withColumn("_failed", base_failed())
    out = out.withColumn("_by", F.when(F.col("_failed"), F.lit("base")).otherwise(cascade(order)))
    return out.select(
        F.col("row")[key].alias(key),
        *[F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("_failed").alias("base_failed"),
        F.col("_by").isNull().alias("kept"),
        F.col("_by").alias("rejected_by"),
    )


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows, with all their columns, that neither the base rule nor the cascade rejects."""
    order = by_rejection_per_cost(measure(docs, rules, text))
    verdict = ~base_failed() & cascade(order).isNull()
    return with_features(docs, text).where(verdict).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's columns; which rule rejected a document depends on the measured order and is left out."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rejected_by")


_W = r"'[ \t\n\x0B\f\r]+'"
#: DuckDB's version of :func:`query`; windows are counted by their words.
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), {_W}), lambda w: w <> '') AS w
  FROM documents),
win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c
  FROM (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM win WHERE c > 1) GROUP BY rid),
f AS (
  SELECT doc_id, t, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(string_split(t, chr(10))) AS n_lines,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ \t\n\x0B\f\r]')) AS lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid)),
g AS (
  SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.1 * n_words OR n_dup_lines > 0.4 * n_lines
            OR word_chars < 2.5 * n_words OR word_chars > 14 * n_words
            OR length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) > 0.4 * word_chars
            OR len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{{L}}'))) > 0.3 * n_words
            OR len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '^[ \t]*[-•*]'))) > 0.9 * n_lines) AS kept
FROM g
"""
