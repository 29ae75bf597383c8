"""URL filtering by association rules: FP-growth over URL tokens of labelled pages, matched by inverted index.

Listed rules decide the urls that they fit. Those decisions are the labels: a labelled url is a transaction of
its tokens and its label, Spark's FP-growth mines the frequent combinations, and rules "tokens -> block" that
reach the support and the confidence stay, without those that a more general rule implies. Every other url is
blocked if all tokens of some mined rule occur in it; an index from each rule's rarest token leads to the few
rules that can match.

Frequent combinations are bounded by the relative support, not by the corpus, so the rules and their index are
sent to tasks whole. Mining reads every labelled row.

Input contract: null urls, and urls without ``://``, have empty host and path and no tokens, fit no rule and
are allowed; urls of any length are read whole; of fitting rules the longest wins, of equally long ones the first;
repeated rows give a row each; an empty table, or labels of one kind only, mine nothing; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import arrow_schema, map_batches, written

ALLOW, BLOCK = "allow", "block"
#: The listed rules as (verdict, host and path).
RULES = ((ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"), (ALLOW, "com/fr/"), (BLOCK, "com/de/"))
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.95

_AFTER = re.compile(r"[/?#]")
_PATH_END = re.compile(r"[?#]")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_TOKEN = re.compile(r"[^/.?#&=_-]+")


def host_and_path(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = _AFTER.search(rest)
    cut = end.start() if end else len(rest)
    return rest[:cut].translate(_LOWER), _PATH_END.split(rest[cut:], maxsplit=1)[0]


def listed(host: str, path: str, rules: tuple[tuple[str, str], ...]) -> tuple[str | None, str | None]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    best = (None, None)
    for verdict, rule in rules:
        domain, _, start = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start) and (best[0] is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best


def tokens(host: str, path: str) -> list[str]:
    """Domain suffixes, host labels, path words with their depth, and a number's first digit; each once."""
    labels = host.split(".") if host else []
    found = ["." + ".".join(labels[i:]) for i in range(max(len(labels) - 3, 0), len(labels))] + [f"host:{x}" for x in labels]
    for depth, part in enumerate(path.split("/")[1:]):
        for word in _TOKEN.findall(part):
            found.append(f"number:{depth}:{word[0]}" if word.isdigit() else f"path:{depth}:{word}")
    return list(dict.fromkeys(found))


def parsed(pages: DataFrame, key: str, url: str, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """(k, host, path, rule, verdict, tokens); rule and verdict are null where no listed rule fits."""
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"))
    text = T.StringType()
    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType)] + [T.StructField(c, text) for c in ("host", "path", "rule", "verdict")] + [T.StructField("tokens", T.ArrayType(text))])
    arrow = arrow_schema(schema)

    def make():
        def each(batch: pa.RecordBatch):
            out: list[list] = [[] for _ in range(5)]
            for u in batch.column(1).to_pylist():
                host, path = host_and_path(u)
                for column, value in zip(out, (host, path, *listed(host, path, rules), tokens(host, path)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(x, f.type) for x, f in zip(out, list(arrow)[1:], strict=True)], schema=arrow)

        return each

    return map_batches(rows, make, schema)


@dataclass(frozen=True)
class MinedRule:
    tokens: tuple[str, ...]
    confidence: float
    support: float


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[MinedRule]:
    """Block rules from (tokens, verdict) rows, most general first; without those that a kept rule implies."""
    from pyspark.ml.fpm import FPGrowth

    kinds = {r["verdict"] for r in labelled.select("verdict").distinct().limit(3).collect()}
    if kinds != {ALLOW, BLOCK}:
        return []
    label = F.concat(F.lit("="), F.col("verdict"))
    items = labelled.select(F.array_distinct(F.concat("tokens", F.array(label))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit("=" + BLOCK))).select("antecedent", "confidence", "support").collect()
    kept: list[MinedRule] = []
    for rule in sorted((MinedRule(tuple(sorted(r["antecedent"])), r["confidence"], r["support"]) for r in found), key=lambda r: (len(r.tokens), r.tokens)):
        if not any(set(k.tokens) <= set(rule.tokens) for k in kept):
            kept.append(rule)
    return kept


def inverted_index(rules: list[MinedRule], frequency: dict[str, int]) -> dict[str, list[tuple[int, frozenset[str]]]]:
    """Each rule under its rarest token."""
    index: dict[str, list[tuple[int, frozenset[str]]]] = {}
    for number, rule in enumerate(rules):
        rarest = min(rule.tokens, key=lambda t: (frequency.get(t, 0), t))
        index.setdefault(rarest, []).append((number, frozenset(rule.tokens)))
    return index


def judged(rows: DataFrame, rules: list[MinedRule]) -> DataFrame:
    """Fills the verdict of parsed rows that no listed rule fits; ``mined_rule`` is the first mined rule that matches."""
    used = {t for r in rules for t in r.tokens}
    counts = rows.select(F.explode("tokens").alias("t")).where(F.col("t").isin(sorted(used))).groupBy("t").count().collect() if used else []
    index = inverted_index(rules, {r["t"]: r["count"] for r in counts})
    names = [" & ".join(r.tokens) for r in rules]
    schema = T.StructType([*rows.drop("tokens").schema, T.StructField("mined_rule", T.StringType())])
    arrow = arrow_schema(schema)

    def make():
        def each(batch: pa.RecordBatch):
            verdicts, mined = [], []
            for verdict, found in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                name = None
                if verdict is None:
                    own = set(found)
                    hits = [n for t in found for n, needed in index.get(t, ()) if needed <= own]
                    name = names[min(hits)] if hits else None
                    verdict = BLOCK if hits else ALLOW
                verdicts.append(verdict)
                mined.append(name)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdicts, pa.string()), pa.array(mined, pa.string())], schema=arrow)

        return each

    return map_batches(rows, make, schema)


def url_filter(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Per row: key, host, path, rule (the listed one, or null), verdict, mined_rule."""
    rows = written(parsed(pages, key, url, rules), "urls")
    mined = mine(rows.where("verdict IS NOT NULL"), min_support, min_confidence)
    return judged(rows, mined).withColumnRenamed("k", key)


def query(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))
