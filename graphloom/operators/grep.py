"""Line search over source files, with context, directories and the nearest symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X


def _terms(query: str) -> list[str]:
    import re

    return sorted({w.lower() for w in re.findall("[A-Z]*[a-z]+|[A-Z]+|[0-9]+", query)})


def line_matches(line: Column, query: str, regex: bool = False) -> Column:
    """A pattern as it is; else the text whatever its ASCII case, or all of its words anywhere in the line."""
    if regex:
        return line.rlike(query)
    needle = query.translate({c: c + 32 for c in range(65, 91)})
    terms = _terms(needle)
    literal = X.ascii_lower(line).contains(needle)
    return literal | (F.size(F.array_except(F.array(*map(F.lit, terms)), X.grep_terms(line))) == 0) if terms else literal


def grep(lines: DataFrame, query: str, regex: bool = False, path: str | None = None) -> DataFrame:
    """The matching (file_path, line, text)."""
    found = lines if path is None else lines.where(F.col("file_path").contains(path))
    return found.where(line_matches(F.col("text"), query, regex))


def with_context(lines: DataFrame, matched: DataFrame, around: int) -> DataFrame:
    """(file_path, line, text, matched): matching lines and those up to ``around`` away, each once."""
    near = matched.select("file_path", F.explode(F.sequence(F.col("line") - around, F.col("line") + around)).alias("line"), F.col("line").alias("at"))
    wanted = near.groupBy("file_path", "line").agg(F.max((F.col("line") == F.col("at")).cast("int")).alias("m"))
    return lines.join(wanted, ["file_path", "line"]).select("file_path", "line", "text", (F.col("m") == 1).alias("matched"))


def directories(matched: DataFrame) -> DataFrame:
    """(dir, matches) before any limit."""
    return matched.groupBy(X.first_segment(F.col("file_path")).alias("dir")).agg(F.count("*").alias("matches"))


def nearest_symbol(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """points (file_path, line) with the last symbol (id, start_line) that starts at or before, else the file's first."""
    order = F.struct("start_line", "id")
    starts = symbols.where("start_line IS NOT NULL").select("file_path", "start_line", "id")
    first = starts.groupBy("file_path").agg(F.min(order).alias("first"))
    marked = starts.select("file_path", F.col("start_line").alias("line"), F.lit(0).alias("is_point"), order.alias("s")).unionByName(points.select("file_path", "line").distinct().select("file_path", "line", F.lit(1).alias("is_point"), F.lit(None).cast("struct<start_line:int,id:string>").alias("s")))
    upto = Window.partitionBy("file_path").orderBy("line", "is_point", "s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = marked.withColumn("last", F.last("s", True).over(upto)).where("is_point = 1").select("file_path", "line", "last")
    rows = points.join(held, ["file_path", "line"], "left").join(first, "file_path", "left")
    got = F.coalesce("last", "first")
    return rows.select(*points.columns, got["id"].alias("symbol_id"), got["start_line"].alias("symbol_line"))


def search_code(lines: DataFrame, symbols: DataFrame, query: str, limit: int, around: int = 1, regex: bool = False, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, directories): a hit per file, by matches, path and line, with its symbol and its lines in context."""
    if not query.strip():
        limit = 0
    matched = grep(lines, query, regex, path)
    files = matched.groupBy("file_path").agg(F.count("*").alias("score"), F.min("line").alias("line"))
    hits = nearest_symbol(files, symbols)
    hits = hits.select("file_path", F.coalesce("symbol_id", F.concat(F.lit("file:"), "file_path")).alias("node_id"), F.coalesce("symbol_line", "line").alias("start_line"), "score")
    hits = hits.orderBy(F.desc("score"), "file_path", "start_line").limit(limit)
    shown = with_context(lines, matched.join(hits.select("file_path"), "file_path", "left_semi"), around)
    listed = shown.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("line", "text", "matched"))).alias("matches"))
    dirs = directories(matched).orderBy(F.desc("matches"), "dir") if limit else directories(matched.limit(0))
    return hits.join(listed, "file_path"), dirs
