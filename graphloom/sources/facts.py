"""Facts files: JSON arrays of tagged records, bundles, plain batches and JSON lines, as tables of nodes, edges and chunks."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = (
    "kind string, contractVersion int, engineVersion string, commit string, generatedAt string, id string, label string, properties string, sourceId string, "
    "targetId string, type string, confidence double, reason string, step int, evidence string, nodeId string, chunkKind string, filePath string, "
    "startLine int, endLine int, text string, stats struct<files:long,nodes:long,edges:long,chunks:long>, bad string"
)
_ITEM = "id string, label string, properties string"
_EDGE = "id string, sourceId string, targetId string, type string, confidence double, reason string, step int, evidence string"
_CHUNK = "nodeId string, kind string, filePath string, startLine int, endLine int, text string"


@dataclass
class Facts:
    """Tables of one source; each row has ``ordinal``, its place in the source. ``stats`` has one row."""

    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    stats: DataFrame
    analyzer: str | None = None


def tagged(records: DataFrame, analyzer: str | None = None) -> Facts:
    """Tables of records (RECORD and ordinal); a chunk's own kind travels as ``chunkKind``."""
    nodes = records.where("kind = 'node'").select("ordinal", "id", "label", F.coalesce("properties", F.lit("{}")).alias("properties"))
    edges = records.where("kind = 'edge'").select("ordinal", "id", "sourceId", "targetId", "type", "confidence", "reason", "step", "evidence")
    chunks = records.where("kind = 'chunk'").select("ordinal", F.col("nodeId").alias("node_id"), F.col("chunkKind").alias("kind"), F.col("filePath").alias("file_path"), (F.col("startLine") + 1).alias("start_line"), (F.col("endLine") + 1).alias("end_line"), "text")
    said = records.where("kind IN ('done', 'manifest') AND stats IS NOT NULL").select(F.when(F.col("kind") == "done", 0).otherwise(1).alias("tier"), "stats.*")
    return Facts(nodes, edges, chunks, _stats(nodes, edges, chunks, said), analyzer)


def _stats(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, said: DataFrame) -> DataFrame:
    """The stats that the source names last, else its manifest's, else counts."""
    counted = nodes.agg(F.count_if(F.col("label") == "File").alias("files"), F.count("*").alias("nodes")).withColumn("tier", F.lit(2))
    for table, name in ((edges, "edges"), (chunks, "chunks")):
        counted = counted.join(table.agg(F.count("*").alias(name)).withColumn("tier", F.lit(2)), "tier")
    rows = said.select("tier", "files", "nodes", "edges", "chunks").unionByName(counted)
    return rows.orderBy("tier").limit(1).drop("tier")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, value) of the lines of text files in the order of their names, from 0.

    Each block of a file is numbered where it is read; the blocks' counts, a row each, give their offsets.
    """
    own = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = own.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return own.join(starts, ["file", "block"]).select((F.col("start") + F.col("at") - F.col("first")).alias("ordinal"), "value")


def read_jsonl(spark: SparkSession, path: str) -> Facts:
    """JSON lines; blank ones are skipped, a broken one is an error that names its line."""
    rows = _lines(spark, path).where(F.trim("value") != "")
    parsed = rows.select("ordinal", F.from_json("value", RECORD, {"columnNameOfCorruptRecord": "bad"}).alias("r")).select("ordinal", "r.*")
    broken = parsed.where("bad IS NOT NULL OR kind IS NULL").agg(F.min("ordinal")).first()[0]
    if broken is not None:
        raise ValueError(f"{path}: line {broken + 1} is no record")
    return tagged(parsed)


def read_array(spark: SparkSession, path: str) -> Facts:
    whole = spark.read.text(path, wholetext=True)
    items = whole.select(F.posexplode(F.from_json("value", f"array<struct<{_typed(RECORD)}>>", {"mode": "FAILFAST"})).alias("ordinal", "r"))
    return tagged(items.select("ordinal", "r.*"))


def _typed(ddl: str) -> str:
    import re

    return re.sub(r"(^|, )(\w+) ", lambda m: f"{m[1]}{m[2]}:", ddl)


def read_bundle(spark: SparkSession, path: str) -> Facts:
    """An object of arrays, with or without an analyzer; stats of nothing but zeros are counted anew if there is data."""
    kind = f"struct<analyzer:struct<id:string>,manifest:struct<stats:struct<files:long,nodes:long,edges:long,chunks:long>>,stats:struct<files:long,nodes:long,edges:long,chunks:long>,nodes:array<struct<{_typed(_ITEM)}>>,edges:array<struct<{_typed(_EDGE)}>>,chunks:array<struct<{_typed(_CHUNK)}>>>"
    one = spark.read.text(path, wholetext=True).select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("b")).select("b.*")
    part = lambda c: one.select(F.posexplode(c).alias("ordinal", "r")).select("ordinal", "r.*")
    nodes = part("nodes").withColumn("properties", F.coalesce("properties", F.lit("{}")))
    chunks = part("chunks").select("ordinal", F.col("nodeId").alias("node_id"), "kind", F.col("filePath").alias("file_path"), (F.col("startLine") + 1).alias("start_line"), (F.col("endLine") + 1).alias("end_line"), "text")
    named = one.select(F.coalesce("stats", "manifest.stats").alias("s")).where("s IS NOT NULL").select(F.lit(0).alias("tier"), "s.*").where("files + nodes + edges + chunks > 0")
    first = one.select("analyzer.id").first()
    return Facts(nodes, part("edges"), chunks, _stats(nodes, part("edges"), chunks, named), first and first[0])


def read(spark: SparkSession, path: str) -> Facts:
    """Tells the form by the first line: an array, an object over the whole file, or JSON lines; empty is an error."""
    head = spark.read.text(path).where(F.trim("value") != "").first()
    if head is None:
        raise ValueError(f"{path} is empty")
    text = head["value"].strip()
    if text.startswith("["):
        return read_array(spark, path)
    try:
        lines = "kind" in json.loads(text)
    except ValueError:
        lines = '"kind"' in text  # a broken record; the first line of an object over many lines names no kind
    return read_jsonl(spark, path) if lines or not text.startswith("{") else read_bundle(spark, path)


def read_optional(spark: SparkSession, path: str) -> Facts | None:
    """None where there is no such file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return read(spark, path)


# --- normalising what engines give ---------------------------------------------------------------------------


def engine_node(nodes: DataFrame) -> DataFrame:
    """Ids like ``cbm:7:a.b.c`` give the engine's number, the qualified name, and a name if there is none."""
    pattern = r"^cbm:(\d+):(.*)$"
    fits = F.col("id").rlike(pattern)
    qualified = F.regexp_extract("id", pattern, 2)
    from graphloom.functions.text import short_name

    named = F.coalesce(F.get_json_object("properties", "$.name"), F.when(fits, short_name(qualified)))
    return nodes.withColumns({"cbm_id": F.when(fits, F.regexp_extract("id", pattern, 1).cast("long")), "qualified_name": F.coalesce(F.get_json_object("properties", "$.qualifiedName"), F.when(fits, qualified)), "name": named})


def engine_id(number: Column, qualified: Column) -> Column:
    return F.concat_ws(":", F.lit("cbm"), number, qualified)


def engine_edge(edges: DataFrame) -> DataFrame:
    """Reason and step from the evidence if they are missing; the confidence whenever the evidence has one."""
    e = lambda k: F.get_json_object("evidence", f"$.{k}")
    return edges.withColumns({"reason": F.coalesce(F.nullif("reason", F.lit("")), e("reason"), F.lit("")), "step": F.coalesce("step", e("step").cast("int")), "confidence": F.coalesce(e("confidence").cast("double"), "confidence")})


CONTAINERS = ("File", "Folder", "Project", "Package", "Module", "Community", "Process", "Directory")


def synthesized_chunks(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """A chunk per node with lines that is no container: its source, and the kind ``ast-`` with its label."""
    own = nodes.where(~F.col("label").isin(*CONTAINERS) & F.col("start_line").isNotNull() & F.col("file_path").isNotNull())
    spans = own.select(F.col("id").alias("node_id"), "label", "file_path", "start_line", F.coalesce("end_line", "start_line").alias("end_line"))
    met = spans.join(lines.select("file_path", "line", F.col("text").alias("t")), "file_path").where("line BETWEEN start_line AND end_line")
    made = met.groupBy("node_id", "label", "file_path", "start_line", "end_line").agg(F.array_sort(F.collect_list(F.struct("line", "t"))).alias("l"))
    return made.select("node_id", F.concat(F.lit("ast-"), F.lower("label")).alias("kind"), "file_path", "start_line", "end_line", F.array_join(F.col("l.t"), "\n").alias("text"))
