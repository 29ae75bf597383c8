"""Whole answers: grouped search results, impact with flows, a symbol's context, details of a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.functions import scalars
from graphloom.functions import text as X
from graphloom.operators import changes, search, store, traverse


def context_score(terms: list[str], *parts: Column) -> Column:
    """0.05 for each term found in the parts, 0.25 at most."""
    text = F.lower(F.concat_ws(" ", *parts))
    hits = sum((text.contains(t).cast("int") for t in terms), F.lit(0))
    return F.least(F.lit(0.25), 0.05 * hits)


def hit_out(hits: DataFrame) -> DataFrame:
    """Hits as they are shown: empty strings and zeros for nulls, scores to three decimals."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return hits.select("node_id", F.round("score", 3).alias("score"), text("name"), text("file_path"), text("label"), F.coalesce("start_line", F.lit(0)).alias("start_line"))


def process_groups(hits: DataFrame, edges: DataFrame, nodes: DataFrame, terms: list[str] | None = None, limit: int = N.QUERY_LIMIT[0], cohesion: DataFrame | None = None) -> DataFrame:
    """(id, name, priority, symbols, place): the flows of hits (node_id, score rounded, place) by summed score.

    Priority adds a tenth of the best cohesion (cluster members' own) and the best context score; it sorts
    unrounded and is rounded when shown. Ties go to more symbols, then to the flow met first.
    """
    own = nodes.select("rowid", F.col("id").alias("node_id"), "label", F.coalesce("name", F.lit("")).alias("symbol"))
    named = hits.select("node_id", "score", "place").join(own, "node_id")
    flows = store.processes_of(named.select("rowid"), edges, nodes).select(F.col("anchor").alias("rowid"), F.col("rowid").alias("flow"), "id", F.col("name").alias("flow_name"))
    rows = named.join(flows, "rowid")
    rows = rows.withColumn("context", context_score(terms or [], F.col("flow_name"), F.col("symbol"), F.col("label")))
    if cohesion is not None:
        rows = rows.join(cohesion, "rowid", "left")
    best = F.max(F.coalesce("cohesion", F.lit(0.0))) if cohesion is not None else F.lit(0.0)
    groups = rows.groupBy("id", F.col("flow_name").alias("name")).agg((F.sum("score") + 0.1 * best + F.max("context")).alias("priority"), F.count("*").alias("symbols"), F.min(F.struct("place", "flow")).alias("first"))
    order = [F.desc(F.round("priority", 9)), F.desc("symbols"), F.col("first")]
    top = groups.orderBy(*order).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1).select("id", "name", F.round("priority", 3).alias("priority"), "symbols", "place")


def process_symbols(hits: DataFrame, groups: DataFrame, edges: DataFrame, nodes: DataFrame, most: int = N.PROCESS_SYMBOLS[0]) -> DataFrame:
    """(process_id, node_id, step, score): each flow's first ``most`` symbols by step (none first), score and id, then each once."""
    own = nodes.select("rowid", F.col("id").alias("node_id"))
    rows = hits.join(own, "node_id").select("node_id", "rowid", "score")
    found = store.processes_of(rows.select("rowid"), edges, nodes).select(F.col("anchor").alias("rowid"), F.col("id").alias("process_id"), "step")
    found = rows.join(found, "rowid").join(groups.select(F.col("id").alias("process_id")), "process_id", "left_semi")
    order = Window.partitionBy("process_id").orderBy(F.asc_nulls_first("step"), F.desc("score"), "node_id")
    kept = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    return kept.groupBy("process_id", "node_id").agg(F.min_by(F.struct("step", "score"), "r").alias("f")).select("process_id", "node_id", "f.step", "f.score")


def query(docs: DataFrame, posted: DataFrame, nodes: DataFrame, edges: DataFrame, text: str, limit: int | None = None, max_symbols: int | None = None, context: str | None = None, goal: str | None = None) -> dict[str, DataFrame]:
    """hits, processes, process_symbols and definitions of a question."""
    limit = scalars.clamp(limit, *N.QUERY_LIMIT)
    most = scalars.clamp(max_symbols, *N.PROCESS_SYMBOLS)
    found = search.search(docs, posted, scalars.expanded_query(text, context, goal), max(limit * most, limit))
    order = [F.desc("score"), F.asc_nulls_first("file_path"), F.asc_nulls_first("start_line"), F.col("node_id")]
    shown = hit_out(found.orderBy(*order)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "file_path", "start_line", "node_id")) - 1)
    groups = process_groups(shown, edges, nodes, scalars.ranking_terms(text, context, goal), limit)
    ids = nodes.select("rowid", F.col("id").alias("node_id"))
    flowing = store.processes_of(shown.join(ids, "node_id").select("rowid"), edges, nodes).select(F.col("anchor").alias("rowid")).distinct().join(ids, "rowid").select("node_id")
    return {
        "hits": shown.orderBy("place").limit(limit),
        "processes": groups,
        "process_symbols": process_symbols(shown, groups, edges, nodes, most),
        "definitions": shown.join(flowing, "node_id", "left_anti").orderBy("place").limit(20),
    }


def references(anchors: DataFrame, edges: DataFrame, nodes: DataFrame, limit: int = N.REFS_LIMIT) -> DataFrame:
    """Nodes with any edge to an anchor, each once per type, by path, line and id."""
    rows = store.linked(anchors, edges, nodes, None, False).select("id", "type", "name", "label", "file_path", "start_line").distinct()
    return rows.orderBy(F.asc_nulls_first("file_path"), F.asc_nulls_first("start_line"), "id").limit(limit)


def impact(nodes: DataFrame, edges: DataFrame, direction: str = "upstream", depth: int | None = None, limit: int | None = None, **selector: str | None) -> dict[str, DataFrame]:
    """Either ``ambiguous`` definitions, or targets, impacted nodes with depth, a histogram and affected flows."""
    depth = scalars.clamp(depth, *N.IMPACT_DEPTH)
    limit = N.IMPACT_LIMIT if limit is None else limit
    targets = store.select(nodes, **selector) if selector.get("uid") else store.definitions(nodes, **selector)
    narrowed = any(selector.get(k) for k in ("uid", "kind", "path"))
    if not narrowed and targets.limit(2).count() > 1:
        return {"ambiguous": targets}
    found = traverse.impact_each(targets.select("rowid"), edges, depth, direction, limit)
    rows = found.join(nodes, "rowid").orderBy("depth", F.asc_nulls_first("file_path"), F.asc_nulls_first("start_line"), "id").limit(limit)
    everyone = targets.select("rowid").union(rows.select("rowid")).distinct()
    flows = store.affected_processes(everyone, edges, nodes).orderBy(F.desc("hits"), "id")
    return {"targets": targets, "impacted": rows, "depths": traverse.depth_histogram(rows), "processes": flows}


def context(nodes: DataFrame, edges: DataFrame, name: str, **selector: str | None) -> dict[str, DataFrame]:
    """A symbol's definitions, direct callers and callees, references and flows."""
    found = store.definitions(nodes, name, **selector)
    a = found.select("rowid")
    near = lambda hops: hops.join(nodes, "rowid").orderBy("depth", F.asc_nulls_first("file_path"), F.asc_nulls_first("start_line"), "id")
    return {
        "definitions": found,
        "callers": near(traverse.closures(a, edges, 1, ("CALLS",), True, N.NEIGHBOR_CAP).select("rowid", "depth").distinct()),
        "callees": near(traverse.closures(a, edges, 1, ("CALLS",), False, N.NEIGHBOR_CAP).select("rowid", "depth").distinct()),
        "references": references(a, edges, nodes),
        "processes": store.processes_of(a, edges, nodes).orderBy("id"),
    }


def augment(docs: DataFrame, posted: DataFrame, nodes: DataFrame, edges: DataFrame, text: str, hits: int = 3) -> DataFrame:
    """(name, callers, callees) of the first hits, looked up by the hit's name."""
    found = search.search(docs, posted, text, hits).select(F.coalesce("name", F.lit("")).alias("asked"))
    tier = F.when((F.col("name") == F.col("asked")) & F.col("label").isin(*N.DEFINITION_LABELS), 0).when(F.col("name") == F.col("asked"), 1).otherwise(2)
    candidates = nodes.join(F.broadcast(found.distinct()), F.lower("name").startswith(F.lower("asked")) & (F.col("asked") != ""))
    order = F.struct(tier.alias("t"), F.length("name").alias("l"), "name", "rowid")
    start = candidates.groupBy("asked").agg(F.min(order)["rowid"].alias("rowid"))
    calls = edges.where("type = 'CALLS'")
    label = nodes.select("rowid", "name")
    side = lambda near, far, alias: start.join(calls, start.rowid == calls[near]).select("asked", F.col(far).alias("r")).join(label, F.col("r") == label.rowid).groupBy("asked").agg(F.array_sort(F.collect_set("name")).alias(alias))
    return start.join(side("dst", "src", "callers"), "asked", "left").join(side("src", "dst", "callees"), "asked", "left").drop("rowid")


def node_degrees(anchors: DataFrame, edges: DataFrame) -> DataFrame:
    """(rowid, callers, callees, references): calls in, calls out, edges in of any type. Few anchors are sent to the edges."""
    a = anchors.select("rowid")
    near = F.broadcast(a) if a.limit(store.FEW + 1).count() <= store.FEW else a
    into = edges.join(near, F.col("dst") == F.col("rowid")).groupBy("rowid").agg(F.count_if(F.col("type") == "CALLS").alias("callers"), F.count("*").alias("references"))
    out = edges.where("type = 'CALLS'").join(near, F.col("src") == F.col("rowid")).groupBy("rowid").agg(F.count("*").alias("callees"))
    return a.join(into, "rowid", "left").join(out, "rowid", "left").fillna(0)


def node_detail(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """A node with its degrees, and for flows the names of their ends."""
    one = store.by_id(nodes, node_id)
    rows = one.join(node_degrees(one, edges), "rowid")
    if "props" not in nodes.columns:
        return rows
    ends = nodes.select("id", "name")
    for prop in ("entryPointId", "terminalId"):
        named = ends.toDF(f"{prop}_", f"{prop}_name")
        rows = rows.join(named, X.string_prop(F.col("props"), prop) == F.col(f"{prop}_"), "left").drop(f"{prop}_")
    return rows


def detect_changes(diff: DataFrame, nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Changed ranges of a diff (line, text), the symbols that they meet, and the flows through those."""
    ranges = changes.merged_ranges(changes.diff_ranges(diff))
    symbols = changes.changed_symbols(ranges, nodes)
    return {
        "ranges": ranges,
        "symbols": symbols.orderBy("file_path", "start_line", "id"),
        "processes": store.affected_processes(symbols.select("rowid"), edges, nodes).orderBy(F.desc("hits"), "id"),
    }


def rename(nodes: DataFrame, edges: DataFrame, lines: DataFrame, old: str, new: str, **selector: str | None) -> DataFrame:
    """Edits of the lines about a symbol's definitions and references; nothing is written."""
    found = store.definitions(nodes, old, **selector)
    users = store.linked(found, edges, nodes, None, False)
    points = found.select("file_path", F.col("start_line").alias("line")).union(users.select("file_path", F.col("start_line").alias("line"))).where("file_path IS NOT NULL AND line IS NOT NULL").distinct()
    return changes.rename_edits(points, lines, old, new).orderBy("file_path", "line", "column")


def repositories(registered: DataFrame, jobs: DataFrame) -> DataFrame:
    """Registered repositories, and jobs of those not registered yet: (name, path, status)."""
    pending = jobs.join(registered.select("path"), "path", "left_anti").select("name", "path", "status")
    known = registered.join(jobs.select("path", F.col("status").alias("job")), "path", "left").select("name", "path", F.coalesce("job", F.lit("ready")).alias("status"))
    return known.unionByName(pending)


def file_symbols(nodes: DataFrame, path: str) -> DataFrame:
    """A file's nodes with lines: (id, name, label, start_line, end_line)."""
    found = store.in_file(nodes, path).where("start_line IS NOT NULL")
    return found.select("id", F.coalesce("name", "id").alias("name"), "label", "start_line", F.coalesce("end_line", "start_line").alias("end_line"))
