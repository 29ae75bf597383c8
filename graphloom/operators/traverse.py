"""Bounded closures and ego networks: a loop over levels, each a join and an anti-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.operators import store
from graphloom.session import written


def closures(start: DataFrame, edges: DataFrame, depth: int, types: Sequence[str] | None = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """(start, rowid, depth, place): for each start (rowid) on its own, the nodes within ``depth`` hops at their least depth.

    The start itself is left out, other starts are not. With a limit, each start's nodes count in order of discovery:
    by level, then by the discoverer's place and the edge's row (its far end's row number where edges have no
    ``ordinal``). The loop ends early when a level is empty.
    """
    return _walk(start.select(F.col("rowid").alias("start"), "rowid"), edges, depth, types, reverse, limit)


def bfs(start: DataFrame, edges: DataFrame, depth: int, types: Sequence[str] | None = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """(rowid, depth, place): one walk from all of ``start`` (rowid) together, each node once at its least depth, starts
    excluded; order and limit as in :func:`closures`."""
    return _walk(start.select(F.lit(0).cast("long").alias("start"), "rowid"), edges, depth, types, reverse, limit).drop("start")


def _walk(seeds: DataFrame, edges: DataFrame, depth: int, types: Sequence[str] | None, reverse: bool, limit: int | None) -> DataFrame:
    near, far = ("dst", "src") if reverse else ("src", "dst")
    hops = edges if types is None else edges.where(F.col("type").isin(*types))
    order = F.col("ordinal") if "ordinal" in edges.columns else F.col(far)
    hops = hops.select(F.col(near).alias("at"), F.col(far).alias("rowid"), order.alias("edge"))
    seen = frontier = written(seeds.distinct().select("start", "rowid", F.lit(0).alias("depth"), F.col("rowid").alias("place")), "level")
    for level in range(1, depth + 1):
        met = frontier.select("start", F.col("rowid").alias("at"), "place").join(hops, "at").groupBy("start", "rowid")
        # met nodes are put together before they are shuffled against the seen ones; without a limit the edge isn't asked for
        fresh = met.agg((F.min("place") if limit is None else F.min(F.struct("place", "edge"))).alias("by")).join(seen.select("start", "rowid"), ["start", "rowid"], "left_anti")
        place = F.col("by")
        if limit is not None:
            # a limit on row numbers is also applied before the shuffle, so no task sorts a whole level
            fresh = fresh.withColumn("n", F.row_number().over(Window.partitionBy("start").orderBy("by", "rowid"))).where(F.col("n") <= limit)
            place = F.col("n").cast("long")
        frontier = written(fresh.select("start", "rowid", F.lit(level).alias("depth"), place.alias("place")), "level")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    found = seen.where("depth > 0")
    if limit is not None:
        first = F.row_number().over(Window.partitionBy("start").orderBy("depth", "place"))
        found = found.withColumn("n", first).where(F.col("n") <= limit).drop("n")
    return found.select("start", "rowid", "depth", "place")


def callees(start: DataFrame, edges: DataFrame, depth: int, limit: int | None = None) -> DataFrame:
    return bfs(start, edges, depth, ("CALLS",), False, limit)


def callers(start: DataFrame, edges: DataFrame, depth: int, limit: int | None = None) -> DataFrame:
    return bfs(start, edges, depth, ("CALLS",), True, limit)


def impact(start: DataFrame, edges: DataFrame, depth: int, direction: str = "upstream", limit: int | None = None) -> DataFrame:
    """What a change reaches. Upstream goes against 17 edge types, downstream along calls; both keeps a row for each depth."""
    up = lambda: bfs(start, edges, depth, N.IMPACT_EDGE_TYPES, True, limit).select("rowid", "depth", F.lit("IMPACT").alias("edge_type"))
    down = lambda: bfs(start, edges, depth, ("CALLS",), False, limit).select("rowid", "depth", F.lit("CALLS").alias("edge_type"))
    if direction == "upstream":
        return up()
    if direction == "downstream":
        return down()
    return up().union(down()).dropDuplicates(["rowid", "edge_type", "depth"])


def impact_each(start: DataFrame, edges: DataFrame, depth: int, direction: str = "upstream", limit: int | None = None) -> DataFrame:
    """(rowid, depth, edge_type): :func:`impact` of each start on its own, with the limit for each; (rowid, edge_type,
    depth) come once, so a node may be at two depths, and a start in another's reach is in the answer."""
    sides = {"upstream": ((N.IMPACT_EDGE_TYPES, True, "IMPACT"),), "downstream": ((("CALLS",), False, "CALLS"),)}
    walks = [closures(start, edges, depth, t, back, limit).select("rowid", "depth", F.lit(name).alias("edge_type")) for t, back, name in sides.get(direction, sides["upstream"] + sides["downstream"])]
    found = walks[0]
    for more in walks[1:]:
        found = found.union(more)
    return found.distinct()


def depth_histogram(found: DataFrame) -> DataFrame:
    return found.groupBy("depth").agg(F.count("*").alias("nodes"))


def ego(center: int, edges: DataFrame, degrees: DataFrame | None = None, depth: int = N.EGO_DEPTH[0], budget: int = N.EGO_NODES) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) about a node: rings of undirected neighbours, each cut by falling degree to what the budget leaves.

    nodes: (i, rowid, ring, k, x, y, size); edges: different (s, t) places, self-loops dropped. Without ``degrees`` those
    of the met nodes alone are counted.
    """
    spark = edges.sparkSession
    both = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("at", "rowid")
    known = (lambda few: few.join(degrees, "rowid")) if degrees is not None else (lambda few: store.degree_of(few, edges))
    own = known(spark.createDataFrame([(center,)], "rowid long")).select("degree").first()
    seen = written(spark.createDataFrame([(center, 0, 0, own["degree"] if own else 0)], "rowid long, ring int, k int, degree long"), "ring")
    frontier, sizes = seen, [1]
    for ring in range(1, depth + 1):
        left = budget - sum(sizes)
        if left <= 0:
            break
        near = frontier.select(F.col("rowid").alias("at"))
        met = written(both.join(F.broadcast(near) if sizes[-1] <= store.FEW else near, "at").select("rowid").distinct().join(seen.select("rowid"), "rowid", "left_anti"), "met")
        ranked = met.join(known(met), "rowid", "left").select("rowid", F.coalesce("degree", F.lit(0)).alias("degree"))
        ranked = ranked.withColumn("order", F.struct((-F.col("degree")).alias("d"), "rowid"))
        if left <= N.RENDER_BUDGET[2]:
            k = F.row_number().over(Window.orderBy("order"))
            ranked = ranked.orderBy("order").limit(left).withColumn("k", k)
        else:
            ranked = store.numbered(ranked, "order", name="k").where(F.col("k") <= left)
        frontier = written(ranked.select("rowid", F.lit(ring).alias("ring"), (F.col("k") - 1).cast("int").alias("k"), "degree"), "ring")
        size = frontier.count()
        if not size:
            break
        seen = seen.union(frontier)
        sizes.append(size)
    seen = written(seen, "ego")
    of_ring = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("ring") + 1)
    angle = F.col("k") * 2 * F.pi() / of_ring(sizes) + F.col("ring") * N.GOLDEN_ANGLE
    placed = seen.select(
        (of_ring([sum(sizes[:r]) for r in range(len(sizes))]) + F.col("k")).alias("i"), "rowid", "ring", "k",
        (F.col("ring") * N.RING * F.cos(angle)).alias("x"), (F.col("ring") * N.RING * F.sin(angle)).alias("y"),
        F.log1p("degree").alias("size"),
    )
    return placed, induced(placed.select("i", "rowid"), edges)


def induced(subset: DataFrame, edges: DataFrame) -> DataFrame:
    """Different (s, t) places of the edges between nodes (i, rowid), without self-loops."""
    s, t = subset.toDF("s", "src"), subset.toDF("t", "dst")
    return edges.select("src", "dst").join(s, "src").join(t, "dst").where("s <> t").select("s", "t").distinct()
