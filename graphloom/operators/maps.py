"""Routes, tools, operations and topics with those who handle, call, feed and read them; shape checks and risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.functions import text as X
from graphloom.operators import store

MOST = 500


def _listed(nodes: DataFrame, label: str, contains: str | None) -> DataFrame:
    found = store.by_label(nodes, label, contains, MOST)
    return found.withColumn("title", F.coalesce("name", X.string_prop(F.col("props"), "name"), "id"))


def _flows(anchors: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(anchor, flows): the flows that a node enters, or if none, those that it is a step of."""
    entry = store.processes_of(anchors, edges, nodes, "ENTRY_POINT_OF").withColumn("tier", F.lit(0))
    member = store.processes_of(anchors, edges, nodes).withColumn("tier", F.lit(1))
    rows = entry.unionByName(member).withColumn("best", F.min("tier").over(Window.partitionBy("anchor")))
    return rows.where("tier = best").groupBy("anchor").agg(F.array_sort(F.collect_set("name")).alias("flows"))


def _linked(anchors: DataFrame, edges: DataFrame, nodes: DataFrame, types: Sequence[str], outgoing: bool = False) -> DataFrame:
    return store.linked(anchors, edges, nodes, types, outgoing)


def _names(linked: DataFrame, alias: str) -> DataFrame:
    return linked.groupBy("anchor").agg(F.array_sort(F.collect_set(F.coalesce("name", "id"))).alias(alias))


def _empty() -> Column:
    return F.array().cast("array<string>")


def route_map(nodes: DataFrame, edges: DataFrame, contains: str | None = None) -> DataFrame:
    """(id, route, handler, middleware, response_keys, error_keys, consumers, flows), by route and id."""
    routes = _listed(nodes, "Route", contains)
    a = routes.select("rowid")
    handler = _linked(a, edges, nodes, N.ROUTE_HANDLERS).groupBy("anchor").agg(F.min_by(F.coalesce("file_path", "name"), "rowid").alias("h"))
    keys, count = X.fetch_reason(F.col("reason"))
    consumers = _linked(a, edges, nodes, N.ROUTE_CONSUMERS).select("anchor", F.struct(F.coalesce("name", "id").alias("name"), F.coalesce("file_path", F.lit("")).alias("file_path"), keys.alias("accessed_keys"), count.alias("fetch_count")).alias("c"), "rowid")
    consumers = consumers.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rowid", "c"))), lambda x: x["c"]).alias("consumers"))
    rows = routes
    for part in (handler, consumers, _flows(a, edges, nodes)):
        rows = rows.join(part, rows.rowid == part.anchor, "left").drop("anchor")
    props = F.col("props")
    none = F.array().cast("array<struct<name:string,file_path:string,accessed_keys:array<string>,fetch_count:int>>")
    return rows.select(
        "id", F.col("title").alias("route"), F.coalesce("h", "file_path", X.string_prop(props, "filePath"), F.lit("")).alias("handler"),
        X.array_prop(props, "middleware").alias("middleware"), X.array_prop(props, "responseKeys").alias("response_keys"), X.array_prop(props, "errorKeys").alias("error_keys"),
        F.coalesce("consumers", none).alias("consumers"), F.coalesce("flows", _empty()).alias("flows"),
    ).orderBy("route", "id")


def shape_check(routes: DataFrame) -> DataFrame:
    """Per consumer of routes with a shape: keys that no response has, keys of errors alone, and how sure that is.

    A consumer that follows one with a mismatch in its route's order shares its flag.
    """
    shaped = routes.where((F.size("consumers") > 0) & (F.size("response_keys") + F.size("error_keys") > 0))
    rows = shaped.select("id", "route", "response_keys", "error_keys", F.posexplode("consumers").alias("place", "c")).select("id", "route", "response_keys", "error_keys", "place", "c.*")
    known = F.array_union("response_keys", "error_keys")
    rows = rows.withColumn("mismatched", F.filter("accessed_keys", lambda k: ~F.array_contains(known, k)))
    rows = rows.withColumn("error_path_keys", F.filter("accessed_keys", lambda k: F.array_contains(known, k) & ~F.array_contains("response_keys", k)))
    upto = Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    leaked = F.max((F.size("mismatched") > 0).cast("int")).over(upto) == 1
    sure = F.when(leaked, F.when(F.coalesce("fetch_count", F.lit(1)) > 1, "low").otherwise("high"))
    status = F.when(F.max((F.size("mismatched") > 0).cast("int")).over(Window.partitionBy("id")) == 1, "MISMATCH")
    return rows.select("id", "route", "name", "file_path", "accessed_keys", "mismatched", "error_path_keys", sure.alias("confidence"), status.alias("status"))


def api_impact(routes: DataFrame) -> DataFrame:
    """(id, route, consumers, mismatches, risk): the risk rises with consumers, and by one level with a mismatch."""
    rows = routes.select("id", "route", "response_keys", "error_keys", F.explode_outer("consumers").alias("c"))
    known = F.array_union("response_keys", "error_keys")
    bad = F.size(F.array_except("c.accessed_keys", known)) > 0
    sums = rows.groupBy("id", "route").agg(F.count("c").alias("consumers"), F.count_if(F.col("c").isNotNull() & bad).alias("mismatches"))
    level = F.when(F.col("consumers") >= 10, 2).when(F.col("consumers") >= 4, 1).otherwise(0) + (F.col("mismatches") > 0).cast("int")
    return sums.withColumn("risk", F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), F.least(level, F.lit(2)) + 1))


def tool_map(nodes: DataFrame, edges: DataFrame, contains: str | None = None) -> DataFrame:
    tools = _listed(nodes, "Tool", contains)
    a = tools.select("rowid")
    rows = tools
    for part in (_names(_linked(a, edges, nodes, ("HANDLES_TOOL",)), "handlers"), _flows(a, edges, nodes)):
        rows = rows.join(part, rows.rowid == part.anchor, "left").drop("anchor")
    described = F.substring(X.string_prop(F.col("props"), "description"), 1, 200)
    return rows.select("id", F.col("title").alias("name"), "file_path", described.alias("description"), F.coalesce("handlers", _empty()).alias("handlers"), F.coalesce("flows", _empty()).alias("flows")).orderBy("name", "id")


def graphql_map(nodes: DataFrame, edges: DataFrame, contains: str | None = None) -> DataFrame:
    found = _listed(nodes, "GraphQL", contains)
    a = found.select("rowid")
    rows = found
    for part in (_names(_linked(a, edges, nodes, ("HANDLES_GRAPHQL", "RESOLVES")), "handlers"), _flows(a, edges, nodes)):
        rows = rows.join(part, rows.rowid == part.anchor, "left").drop("anchor")
    kind = F.coalesce(X.string_prop(F.col("props"), "operationType"), F.lit("unknown"))
    return rows.select("id", kind.alias("operation_type"), F.col("title").alias("name"), "file_path", F.coalesce("handlers", _empty()).alias("handlers"), F.coalesce("flows", _empty()).alias("flows")).orderBy("operation_type", "name", "id")


def topic_map(nodes: DataFrame, edges: DataFrame, contains: str | None = None, broker: str | None = None) -> DataFrame:
    """(id, broker, name, producers, consumers, groups, flows), by broker, name and id."""
    topics = _listed(nodes, "Topic", contains).withColumn("broker", F.coalesce(X.string_prop(F.col("props"), "broker"), F.lit("unknown")))
    if broker is not None:
        topics = topics.where(F.lower("broker") == broker.lower())
    a = topics.select("rowid")
    rows = topics
    for part in (_names(_linked(a, edges, nodes, N.TOPIC_PRODUCERS), "producers"), _names(_linked(a, edges, nodes, N.TOPIC_CONSUMERS), "consumers"), _flows(a, edges, nodes)):
        rows = rows.join(part, rows.rowid == part.anchor, "left").drop("anchor")
    return rows.select("id", "broker", F.col("title").alias("name"), F.coalesce("producers", _empty()).alias("producers"), F.coalesce("consumers", _empty()).alias("consumers"), X.array_prop(F.col("props"), "consumerGroups").alias("groups"), F.coalesce("flows", _empty()).alias("flows")).orderBy("broker", "name", "id")
