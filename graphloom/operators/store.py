"""Graph tables: ingest, deletes, lookups and counts.

nodes: (rowid, id, label, name, file_path, start_line, end_line, props); edges: (src, dst, type, confidence, reason,
step, evidence, edge_id) by row numbers. Row numbers order every tie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.functions import text as X
from graphloom.session import written

#: Row numbers that are sent to the edges at most; more of them are joined.
FEW = 1_000_000


def first_by_id(facts: DataFrame, ordinal: str = "ordinal", key: str = "id") -> DataFrame:
    """The first fact of each id; one partial aggregate instead of a sort by id."""
    rest = [c for c in facts.columns if c != key]
    return facts.groupBy(key).agg(F.min_by(F.struct(*rest), ordinal).alias("f")).select(key, "f.*")


def numbered(rows: DataFrame, order: str, after: int = 0, name: str = "rowid") -> DataFrame:
    """Row numbers from ``after`` + 1 in the order of a column; each range of it is numbered in a task of its own.

    The sorted rows are written, so that the ranges' counts (a row per range, on the driver) and their rows agree.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    sorted_ = written(dealt, "numbered").withColumns({"_range": F.shiftright("_at", 33).cast("int"), "_n": F.col("_at").bitwiseAND((1 << 33) - 1) + 1})
    counts = sorted_.groupBy("_range").agg(F.count("*").alias("c")).orderBy("_range").collect()
    starts, at = [], after
    for r in counts:
        starts.append((r["_range"], at))
        at += r["c"]
    offsets = F.broadcast(spark.createDataFrame(starts, "_range int, _start long"))
    return sorted_.join(offsets, "_range").withColumn(name, F.col("_start") + F.col("_n")).select(*rows.columns, name)


def promoted(facts: DataFrame) -> DataFrame:
    """Node columns from the JSON properties; lines counted from 1, the path under either of its names."""
    props = F.col("properties")
    line = lambda key: F.get_json_object(props, f"$.{key}").cast("int") + 1
    return facts.select(
        "id", "label",
        F.get_json_object(props, "$.name").alias("name"),
        F.coalesce(F.get_json_object(props, "$.filePath"), F.get_json_object(props, "$.path")).alias("file_path"),
        line("startLine").alias("start_line"), line("endLine").alias("end_line"),
        props.alias("props"), "ordinal",
    )


def edge_key() -> Column:
    """An edge's own id, which is kept only if its evidence names a provenance."""
    return F.when((F.col("id") != "") & F.get_json_object("evidence", "$.provenance").isNotNull(), F.col("id"))


def ingest(node_facts: DataFrame, edge_facts: DataFrame, old_nodes: DataFrame | None = None, old_edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counts): new ids are added, known ids ignored, edges without both ends skipped and counted.

    Facts carry ``ordinal``. New row numbers follow the old ones in the facts' order. Edges with a kept id are
    unique; others stay as often as they come.
    """
    spark = node_facts.sparkSession
    fresh = first_by_id(promoted(node_facts))
    met = node_facts.count()
    last = 0
    if old_nodes is not None:
        fresh = fresh.join(old_nodes.select("id"), "id", "left_anti")
        last = old_nodes.agg(F.max("rowid")).first()[0] or 0
    fresh = numbered(fresh, "ordinal", last).drop("ordinal")
    added = fresh.count()
    nodes = fresh if old_nodes is None else old_nodes.unionByName(fresh)
    ends = nodes.select("id", "rowid")
    linked = (
        edge_facts.withColumn("edge_id", edge_key())
        .join(ends.toDF("sourceId", "src"), "sourceId", "left")
        .join(ends.toDF("targetId", "dst"), "targetId", "left")
    )
    dangling = linked.where("src IS NULL OR dst IS NULL").count()
    whole = linked.where("src IS NOT NULL AND dst IS NOT NULL").select("ordinal", "edge_id", "src", "dst", "type", "confidence", "reason", "step", "evidence")
    whole_count = whole.count()
    named = whole.where("edge_id IS NOT NULL").groupBy("edge_id").agg(F.min_by(F.struct("ordinal", "src", "dst", "type", "confidence", "reason", "step", "evidence"), "ordinal").alias("f")).select("f.ordinal", "edge_id", "f.src", "f.dst", "f.type", "f.confidence", "f.reason", "f.step", "f.evidence")
    if old_edges is not None:
        named = named.join(old_edges.where("edge_id IS NOT NULL").select("edge_id"), "edge_id", "left_anti").select(whole.columns)
    new_edges = whole.where("edge_id IS NULL").unionByName(named)
    kept = new_edges.count()
    edges = new_edges.drop("ordinal") if old_edges is None else old_edges.unionByName(new_edges.drop("ordinal"))
    counts = spark.createDataFrame([(added, met - added, kept, whole_count - kept, dangling)], "nodes long, duplicate_nodes long, edges long, duplicate_edges long, dangling_edges long")
    return nodes, edges, counts


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (source_id, target_id, ...) of which an end is missing."""
    ids = nodes.select("id")
    no_source = edges.join(ids, edges.source_id == ids.id, "left_anti")
    no_target = edges.join(ids, edges.source_id == ids.id, "left_semi").join(ids, edges.target_id == ids.id, "left_anti")
    return no_source.union(no_target)


def delete_file(nodes: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counts) without a file's nodes and the edges at them; positions must be laid out anew."""
    gone = nodes.where(F.col("file_path") == path).select("rowid")
    kept = edges.join(gone.withColumnRenamed("rowid", "src"), "src", "left_anti").join(gone.withColumnRenamed("rowid", "dst"), "dst", "left_anti").select(edges.columns)
    counts = gone.agg(F.count("*").alias("nodes")).withColumn("edges", F.lit(edges.count() - kept.count()))
    return nodes.where(F.col("file_path").isNull() | (F.col("file_path") != path)), kept, counts


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keyed latest-wins: rows of ``new`` replace those of ``old``."""
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(new)


# --- lookups -------------------------------------------------------------------------------------------------


def by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def by_name(nodes: DataFrame, prefix: str, limit: int) -> DataFrame:
    """Names that begin so, whatever their ASCII case: exact ones first, then shorter ones, then by name and row."""
    hit = X.ascii_lower(F.col("name")).startswith(prefix.translate({c: c + 32 for c in range(65, 91)}))
    return nodes.where(hit).orderBy((F.col("name") == prefix).desc(), F.length("name"), "name", "rowid").limit(limit)


def by_label(nodes: DataFrame, label: str, contains: str | None, limit: int) -> DataFrame:
    found = nodes.where(F.col("label") == label)
    if contains is not None:
        found = found.where(X.ascii_lower(F.col("name")).contains(contains.translate({c: c + 32 for c in range(65, 91)})))
    return found.orderBy(F.asc_nulls_first("name"), "rowid").limit(limit)


def in_file(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("file_path") == path).orderBy(F.asc_nulls_first("start_line"), "rowid")


def matches(uid: str | None = None, name: str | None = None, kind: str | None = None, path: str | None = None) -> Column:
    """A selector: exact id, exact name, kind whatever its case, path equal or a suffix at a ``/``."""
    out = F.lit(True)
    if uid is not None:
        out = out & (F.col("id") == uid)
    if name is not None:
        out = out & (F.col("name") == name)
    if kind is not None:
        out = out & (F.lower("label") == kind.lower())
    if path is not None:
        want = path.replace("\\", "/").removeprefix("./").lstrip("/")
        own = X.selector_path(F.col("file_path"))
        out = out & ((own == want) | own.endswith("/" + want))
    return F.coalesce(out, F.lit(False))


def select(nodes: DataFrame, uid: str | None = None, name: str | None = None, kind: str | None = None, path: str | None = None, limit: int = 100) -> DataFrame:
    if uid is not None:
        return by_id(nodes, uid).where(matches(None, name, kind, path))
    return by_name(nodes, name or "", limit).where(matches(None, name, kind, path))


def definitions(nodes: DataFrame, name: str, **selector: str | None) -> DataFrame:
    """Exact names with a defining label, or if there are none, all exact names."""
    found = nodes.where(matches(name=name, **selector)).withColumn("tier", F.when(F.col("label").isin(*N.DEFINITION_LABELS), 0).otherwise(1))
    best = found.agg(F.min("tier").alias("tier"))
    return found.join(F.broadcast(best), "tier", "left_semi").drop("tier")


def resolve(nodes: DataFrame, symbol: str) -> DataFrame:
    """One node: an exact definition, else an exact name, else the first that begins so."""
    tier = F.when((F.col("name") == symbol) & F.col("label").isin(*N.DEFINITION_LABELS), 0).when(F.col("name") == symbol, 1).otherwise(2)
    hit = X.ascii_lower(F.col("name")).startswith(symbol.translate({c: c + 32 for c in range(65, 91)}))
    return nodes.where(hit).orderBy(tier, F.length("name"), "name", "rowid").limit(1)


# --- counts --------------------------------------------------------------------------------------------------


def file_list(nodes: DataFrame) -> DataFrame:
    """Files with defined lines, and their nodes with lines."""
    return nodes.where("file_path IS NOT NULL AND start_line IS NOT NULL").groupBy("file_path").agg(F.count("*").alias("symbols"))


def searchable_file_list(nodes: DataFrame) -> DataFrame:
    return nodes.where("file_path IS NOT NULL AND file_path <> ''").groupBy("file_path").agg(F.count("*").alias("nodes"))


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("edges"))


def degree(edges: DataFrame) -> DataFrame:
    """(rowid, degree): both ends of every edge, repeated edges and self-loops counted each time.

    Ends are dealt out before they are counted: a count before the shuffle would hold a row for nearly every end.
    """
    return edges.select(F.explode(F.array("src", "dst")).alias("rowid")).repartition("rowid").groupBy("rowid").agg(F.count("*").alias("degree"))


def degree_of(few: DataFrame, edges: DataFrame, most: int = FEW) -> DataFrame:
    """(rowid, degree) of different nodes that have edges; up to ``most`` are sent to the edges, which stay where they are."""
    if few.limit(most + 1).count() > most:
        return degree(edges).join(few.select("rowid"), "rowid", "left_semi")
    return edges.select(F.explode(F.array("src", "dst")).alias("rowid")).join(F.broadcast(few.select("rowid")), "rowid", "left_semi").groupBy("rowid").agg(F.count("*").alias("degree"))


def batch_stats(nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    one = nodes.agg(F.count_if(F.col("label") == "File").alias("files"), F.count("*").alias("nodes"))
    return one.withColumns({"edges": F.lit(edges.count()).cast("long"), "chunks": F.lit(chunks.count()).cast("long")})


# --- joins ---------------------------------------------------------------------------------------------------


def linked(anchors: DataFrame, edges: DataFrame, nodes: DataFrame, types: Sequence[str] | None, outgoing: bool) -> DataFrame:
    """(anchor, type, reason, step, confidence, node columns) on the far side of the anchors' edges of some types, or any."""
    near, far = ("src", "dst") if outgoing else ("dst", "src")
    hops = (edges if types is None else edges.where(F.col("type").isin(*types))).join(anchors.select(F.col("rowid").alias("anchor")), F.col(near) == F.col("anchor"))
    return hops.select("anchor", F.col(far).alias("rowid"), "type", "reason", "step", "confidence").join(nodes, "rowid")


def neighbors(anchors: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One hop both ways, each edge on its own: (anchor, direction, type, rowid, id)."""
    named = nodes.select("rowid", "id")
    a = anchors.select(F.col("rowid").alias("anchor"))
    out = edges.join(a, F.col("src") == F.col("anchor")).select("anchor", F.lit("out").alias("direction"), "type", F.col("dst").alias("rowid"))
    into = edges.join(a, F.col("dst") == F.col("anchor")).select("anchor", F.lit("in").alias("direction"), "type", F.col("src").alias("rowid"))
    return out.union(into).join(named, "rowid")


def processes_of(anchors: DataFrame, edges: DataFrame, nodes: DataFrame, relation: str = "STEP_IN_PROCESS") -> DataFrame:
    """(anchor, process rowid, id, name, step) of the flows that nodes are steps of, or enter."""
    flows = nodes.where("label = 'Process'").select("rowid", "id", "name")
    hops = edges.where(F.col("type") == relation).select("src", "dst", "step")
    return hops.join(anchors.select(F.col("rowid").alias("anchor")), F.col("src") == F.col("anchor")).join(flows, F.col("dst") == F.col("rowid")).select("anchor", "rowid", "id", "name", "step")


def process_steps(edges: DataFrame, nodes: DataFrame, process: int) -> DataFrame:
    hops = edges.where((F.col("type") == "STEP_IN_PROCESS") & (F.col("dst") == process)).select(F.col("src").alias("rowid"), "step")
    return hops.join(nodes, "rowid").orderBy(F.asc_nulls_last("step"), "rowid")


def first_community(anchors: DataFrame | None, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(anchor, community rowid): the lowest one that a node is a member of; of any source without anchors."""
    communities = nodes.where("label = 'Community'").select(F.col("rowid").alias("dst"))
    hops = edges.where("type = 'MEMBER_OF'").join(communities, "dst")
    if anchors is not None:
        hops = hops.join(anchors.select(F.col("rowid").alias("src")), "src")
    return hops.groupBy(F.col("src").alias("anchor")).agg(F.min("dst").alias("community"))


def affected_processes(ids: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, name, hits, first_step) of the flows that pass through any of ``ids``."""
    found = processes_of(ids, edges, nodes)
    return found.groupBy("id", "name").agg(F.count("*").alias("hits"), F.min("step").alias("first_step"))
