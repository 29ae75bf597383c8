"""From a diff to changed ranges, to changed symbols, to affected flows; and renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import names as N


def diff_ranges(diff: DataFrame) -> DataFrame:
    """(file_path, start, end) of the new side's hunks of a unified diff given as (line, text).

    A hunk without a count has one line; one of no lines (a deletion) stands for its anchor line, 1 at least.
    A diff is one text, so its lines are ordered in one window.
    """
    name = F.regexp_extract("text", r"^\+\+\+ (?:b/)?([^\t]+)", 1)
    upto = Window.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = diff.withColumn("file_path", F.last(F.when(F.col("text").startswith("+++ "), name), True).over(upto))
    hunk = r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@"
    rows = rows.where(F.col("text").rlike(hunk) & (F.col("file_path") != "/dev/null"))
    start = F.regexp_extract("text", hunk, 1).cast("int")
    count = F.coalesce(F.nullif(F.regexp_extract("text", hunk, 2), F.lit("")).cast("int"), F.lit(1))
    low = F.greatest(start, F.lit(1))
    return rows.select("file_path", low.alias("start"), F.when(count == 0, low).otherwise(low + count - 1).alias("end"))


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """Overlapping and adjacent (file_path, start, end) joined."""
    before = Window.partitionBy("file_path").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file_path").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fresh = F.coalesce(F.col("start") > F.max("end").over(before) + 1, F.lit(True)).cast("int")
    marked = ranges.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(upto))
    return marked.groupBy("file_path", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def changed_symbols(ranges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Different defining nodes whose lines meet a range of their file."""
    defined = nodes.where(F.col("label").isin(*N.DEFINITION_LABELS) & F.col("start_line").isNotNull())
    last = F.coalesce("end_line", "start_line")
    r = ranges.select("file_path", F.col("start").alias("from"), F.col("end").alias("to"))
    met = defined.join(r, "file_path").where((last >= F.col("from")) & (F.col("start_line") <= F.col("to")))
    return met.select(nodes.columns).dropDuplicates(["id"])


def windows_around(points: DataFrame, lines: DataFrame, around: int = 2) -> DataFrame:
    """The different lines up to ``around`` from (file_path, line)."""
    near = points.select("file_path", F.explode(F.sequence(F.greatest(F.col("line") - around, F.lit(1)), F.col("line") + around)).alias("line")).distinct()
    return lines.join(near, ["file_path", "line"])


def whole_word(name: str) -> str:
    return rf"(?<![A-Za-z0-9_]){name}(?![A-Za-z0-9_])"


def rename_edits(points: DataFrame, lines: DataFrame, old: str, new: str, around: int = 2) -> DataFrame:
    """(file_path, line, column, before, after): one edit per line of the windows that holds the name as a whole word."""
    from graphloom.functions.scalars import is_identifier

    if not is_identifier(old) or not is_identifier(new):
        raise ValueError("names must be identifiers")
    found = windows_around(points, lines, around)
    column = F.regexp_instr("text", F.lit(whole_word(old)))
    return found.where(column > 0).select("file_path", "line", column.alias("column"), F.col("text").alias("before"), F.regexp_replace("text", whole_word(old), new).alias("after"))


def applied(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """(file_path, content) of edited files, as text to write; a file's last line end stays as it was."""
    changed = lines.join(edits.select("file_path").distinct(), "file_path").join(edits.select("file_path", "line", "after"), ["file_path", "line"], "left")
    rows = changed.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("line", F.coalesce("after", "text").alias("t")))).alias("l"))
    return rows.select("file_path", F.array_join(F.col("l.t"), "\n").alias("content"))


def overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    return (high_a >= low_b) & (low_a <= high_b)
