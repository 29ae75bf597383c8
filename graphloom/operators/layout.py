"""Clusters, deterministic layout, level of detail, and cluster roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.functions import text as X
from graphloom.operators import store, traverse
from graphloom.session import written

#: Row numbers of a block are told apart by so many bits; so many mixed blocks (64 KB each) are broadcast at most, and
#: so many in all.
BLOCK_BITS, MIXED_BLOCKS, BLOCKS = 15, 512, 100_000


def membership(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rowid, cluster label, origin, pinned): the lowest community, else flows together, else the top folder, else the root."""
    communities = nodes.where("label = 'Community'").select(F.col("rowid").alias("own"), F.coalesce("name", "id").alias("own_label"))
    first = store.first_community(None, edges, nodes)
    joined = (
        nodes.select("rowid", "label", "file_path")
        .join(first, F.col("rowid") == F.col("anchor"), "left").drop("anchor")
        .withColumn("community", F.when(F.col("label") == "Community", F.col("rowid")).otherwise(F.col("community")))
        .join(F.broadcast(communities) if communities.limit(10_001).count() <= 10_000 else communities, F.col("community") == F.col("own"), "left")
    )
    folder = F.nullif(X.layout_dir(F.col("file_path")), F.lit(""))
    label = F.when(F.col("community").isNotNull(), F.col("own_label")).when(F.col("label") == "Process", F.lit("Processes")).otherwise(F.coalesce(folder, F.lit("(root)")))
    return joined.select("rowid", label.alias("cluster_label"), F.coalesce("community", F.lit(0)).alias("origin"), (F.col("label") == "Community").alias("pinned"))


def clusters(members: DataFrame) -> DataFrame:
    """(cluster, label, origin, members, radius, cx, cy): numbered by size, then label, then origin.

    A cluster's distance from the middle grows with the area of those before it, so one window runs over all
    clusters; they are few, as communities and folders are.
    """
    sizes = members.groupBy("cluster_label", "origin").agg(F.count("*").alias("members"))
    order = Window.orderBy(F.desc("members"), "cluster_label", "origin")
    radius = N.SPACING * F.sqrt("members") + N.SPACING
    made = sizes.withColumns({"cluster": F.row_number().over(order) - 1, "radius": radius})
    area = F.sum(F.pow(N.PACK * F.col("radius"), 2)).over(Window.orderBy("cluster").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    angle = F.col("cluster") * N.GOLDEN_ANGLE
    return made.withColumn("reach", F.sqrt(area)).select("cluster", "cluster_label", "origin", "members", "radius", (F.col("reach") * F.cos(angle)).alias("cx"), (F.col("reach") * F.sin(angle)).alias("cy"))


def assigned(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((rowid, cluster, pinned), clusters): each node's cluster, which depends on memberships and folders alone."""
    members = written(membership(nodes, edges), "members")
    found = written(clusters(members), "clusters")
    few = found.select("cluster_label", "origin", "cluster")
    return members.join(F.broadcast(few) if found.limit(10_001).count() <= 10_000 else few, ["cluster_label", "origin"]).select("rowid", "cluster", "pinned"), found


def positions(nodes: DataFrame, edges: DataFrame, given: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(positions, clusters): members spiral about their cluster's centre, the community first, then by falling degree.

    A cluster can hold most nodes, so places in it are numbered by ranges of all clusters' order. ``given``: what
    :func:`assigned` gives, if it is stored.
    """
    members, found = given or assigned(nodes, edges)
    ranked = written(members.join(store.degree(edges), "rowid", "left").withColumn("degree", F.coalesce("degree", F.lit(0))), "ranked")  # sampled, then dealt
    order = F.struct("cluster", (~F.col("pinned")).alias("p"), (-F.col("degree")).alias("d"), "rowid")
    numbered = store.numbered(ranked.select("cluster", "rowid", "degree", order.alias("order")), "order", name="n").drop("order")
    first = numbered.groupBy("cluster").agg(F.min("n").alias("first"))
    starts = written(found.select("cluster", "cx", "cy").join(first, "cluster"), "starts")
    placed = numbered.join(F.broadcast(starts) if starts.limit(10_001).count() <= 10_000 else starts, "cluster").withColumn("k", (F.col("n") - F.col("first")).cast("int"))
    r, angle = N.SPACING * F.sqrt("k"), F.col("k") * N.GOLDEN_ANGLE
    out = placed.select("rowid", "cluster", "k", (F.col("cx") + r * F.cos(angle)).alias("x"), (F.col("cy") + r * F.sin(angle)).alias("y"), F.log1p("degree").alias("size"), "degree")
    return out, found


def is_laid_out(nodes: DataFrame, placed: DataFrame) -> bool:
    """Whether every node has a place; an empty or older layout has to be made anew."""
    return nodes.join(placed, "rowid", "left_anti").isEmpty()


def exported(numbered: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lod): one JSON text of a level of detail: columns of the numbered nodes, and edges as pairs, as viewers read it.

    A level of detail has a bounded number of nodes, so one row holds it.
    """
    rows = numbered.join(nodes.select("rowid", "id", "label", F.coalesce("name", "id").alias("name")), "rowid")
    node = F.struct("i", "id", "label", "name", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.round("size", 3).alias("size"), "cluster")
    listed = rows.agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    pairs = edges.agg(F.array_sort(F.collect_list(F.array("s", "t"))).alias("edges"))
    column = lambda c: F.col(f"nodes.{c}").alias(c)
    return listed.crossJoin(pairs).select(F.to_json(F.struct(*[column(c) for c in ("id", "label", "name", "x", "y", "size", "cluster")], "edges")).alias("lod"))


def lod(placed: DataFrame, edges: DataFrame, nodes: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the largest ``nodes`` nodes, numbered by size and row, with the edges between them."""
    top = placed.orderBy(F.desc("size"), "rowid").limit(nodes)
    numbered = top.withColumn("i", F.row_number().over(Window.orderBy(F.desc("size"), "rowid")) - 1)
    return numbered, traverse.induced(numbered.select("i", "rowid"), edges)


def _blocks(placed: DataFrame) -> DataFrame | None:
    """(block, one, each): by blocks of row numbers, the cluster of all, or the cluster of each by place, -1 for no node.

    None if row numbers repeat, or are too far apart or too mixed for a broadcast.
    """
    block = F.shiftright("rowid", BLOCK_BITS).alias("block")
    small = F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.count("*").alias("c")
    stats = placed.groupBy(block).agg(*small)
    mixed = (F.col("low") < F.col("high")) | (F.col("c") != 1 << BLOCK_BITS)
    sums = stats.agg(F.count("*").alias("blocks"), F.count_if(mixed).alias("mixed"), F.max("high").alias("high"), F.sum("c").alias("c")).first()
    if not sums["blocks"] or sums["blocks"] > BLOCKS or sums["mixed"] > MIXED_BLOCKS or sums["high"] >= 1 << 15:
        return None
    stats = written(stats.select("block", "low", mixed.alias("mixed")), "blocks")
    own = placed.select(block, F.col("rowid").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int").alias("at"), "cluster")
    # what is alike is looked at too: in a full block of one cluster row numbers can repeat, and others be missing
    seen = own.groupBy("block").agg(F.count_distinct("at").alias("d"), F.count("*").alias("c"))
    if not seen.where("d <> c").isEmpty():
        return None
    several = F.broadcast(stats.where("mixed").select("block"))
    none = several.select("block", F.explode(F.sequence(F.lit(0), F.lit((1 << BLOCK_BITS) - 1))).alias("at"), F.lit(-1).alias("cluster"))
    filled = own.join(several, "block").union(none).groupBy("block", "at").agg(F.max("cluster").cast("short").alias("cluster"))
    each = filled.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "cluster"))), lambda x: x["cluster"]).alias("each"))
    return written(stats.join(each, "block", "left").select("block", F.when(~F.col("mixed"), F.col("low").cast("short")).alias("one"), "each"), "blocks")


def _ends(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """(a, b, n): the number of edges from cluster to cluster; edges without both ends don't count."""
    blocks, ends = _blocks(placed), edges.select("src", "dst")
    if blocks is None:
        cluster = placed.select("rowid", "cluster")
        ends = ends.join(cluster.toDF("src", "a"), "src").join(cluster.toDF("dst", "b"), "dst")
    else:
        for end, name in (("src", "a"), ("dst", "b")):
            there = F.coalesce("one", F.get("each", F.col(end).bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")))
            ends = ends.join(F.broadcast(blocks), F.shiftright(end, BLOCK_BITS) == F.col("block")).withColumn(name, there.cast("int")).drop("block", "one", "each").where(F.col(name) >= 0)
    return ends.groupBy("a", "b").agg(F.count("*").alias("n"))


def cluster_edges(edges: DataFrame, placed: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(s, t, weight) between clusters, either way together."""
    ends = _ends(edges, placed) if ends is None else ends
    return ends.where("a <> b").groupBy(F.least("a", "b").alias("s"), F.greatest("a", "b").alias("t")).agg(F.sum("n").alias("weight"))


def incident_weight(weights: DataFrame) -> DataFrame:
    return weights.select(F.explode(F.array("s", "t")).alias("cluster"), "weight").groupBy("cluster").agg(F.sum("weight").alias("incident"))


def edge_stats(edges: DataFrame, placed: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(cluster, internal, external): an edge between clusters counts at both."""
    ends = _ends(edges, placed) if ends is None else ends
    inner = ends.where("a = b").select(F.col("a").alias("cluster"), F.col("n").alias("i"), F.lit(0).cast("long").alias("e"))
    outer = ends.where("a <> b").select(F.explode(F.array("a", "b")).alias("cluster"), F.lit(0).cast("long").alias("i"), F.col("n").alias("e"))
    return inner.union(outer).groupBy("cluster").agg(F.sum("i").alias("internal"), F.sum("e").alias("external"))


def is_cluster_symbol(label: Column) -> Column:
    return ~label.isin(*N.NOT_CLUSTER_SYMBOLS)


def symbol_score() -> Column:
    weight = F.lit(5)
    for w, labels in N.CLUSTER_WEIGHTS.items():
        weight = F.when(F.col("label").isin(*labels), w).otherwise(weight)
    return 3 * F.col("degree") + F.round(6 * F.greatest(F.col("size"), F.lit(0.0))).cast("long") + weight + F.when(F.col("start_line").isNotNull(), 4).otherwise(0)


def top_symbols(nodes: DataFrame, placed: DataFrame, most: int = 5) -> DataFrame:
    """(cluster, place, id, name, score): the symbols of a cluster by score."""
    rows = placed.select("rowid", "cluster", "degree", "size").join(nodes, "rowid").where(is_cluster_symbol(F.col("label")))
    rows = rows.select("cluster", "id", F.coalesce("name", "id").alias("name"), "label", "file_path", "start_line", symbol_score().alias("score"))
    order = Window.partitionBy("cluster").orderBy(F.desc("score"), "name", F.asc_nulls_first("file_path"), "id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def top_files(nodes: DataFrame, placed: DataFrame, most: int = 5) -> DataFrame:
    """(cluster, place, file_path, nodes, symbols): the files of a cluster; those without symbols only if none has any."""
    rows = placed.select("rowid", "cluster").join(nodes, "rowid").where(X.plausible_file(F.col("file_path")))
    files = rows.groupBy("cluster", "file_path").agg(F.count("*").alias("nodes"), F.count_if(is_cluster_symbol(F.col("label"))).alias("symbols"))
    some = F.max("symbols").over(Window.partitionBy("cluster"))
    order = Window.partitionBy("cluster").orderBy(F.desc("symbols"), F.desc("nodes"), "file_path")
    return files.withColumn("some", some).where("some = 0 OR symbols > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("some")


def quality(found: DataFrame, stats: DataFrame, files: DataFrame) -> DataFrame:
    """(cluster, cohesion, boundary_ratio, confidence, explanation)."""
    first = files.where("place = 1").select("cluster", F.col("file_path").alias("file"), F.col("nodes").alias("file_nodes"))
    rows = found.select("cluster", "members").join(stats, "cluster", "left").join(first, "cluster", "left").fillna(0, ["internal", "external", "file_nodes"])
    total = F.col("internal") + F.col("external")
    rows = rows.withColumns({
        "cohesion": F.when(total == 0, 1.0).otherwise(F.col("internal") / total),
        "boundary_ratio": F.when(total == 0, 0.0).otherwise(F.col("external") / total),
        "file_ratio": F.col("file_nodes") / F.greatest("members", F.lit(1)),
        "total": total,
    })
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.45 * F.col("cohesion") + 0.35 * F.col("file_ratio") + 0.20 * F.least(F.lit(1.0), F.col("members") / 20)))
    percent = lambda c: F.format_string("%.0f%%", F.col(c) * 100)
    said = (
        F.when((F.col("total") == 0) & F.col("file").isNull(), F.lit("No graph edges or source-file concentration available yet."))
        .when(F.col("total") == 0, F.concat(F.lit("No graph edges inside this community yet; "), percent("file_ratio"), F.lit(" of nodes come from "), "file", F.lit(".")))
        .when(F.col("file").isNull(), F.concat(percent("cohesion"), F.lit(" internal edges and "), percent("boundary_ratio"), F.lit(" boundary edges across this community.")))
        .otherwise(F.concat(percent("cohesion"), F.lit(" internal edges, "), percent("boundary_ratio"), F.lit(" boundary edges; strongest file signal is "), "file", F.lit(".")))
    )
    return rows.select("cluster", "internal", "external", "cohesion", "boundary_ratio", confidence.alias("confidence"), said.alias("explanation"))


def generic_label(label: Column) -> Column:
    low = F.lower(F.trim(label))
    return (low == "") | low.isin(*N.GENERIC_LABELS) | low.rlike("^(community|cluster)[a-z0-9_-]+$")


def display_labels(found: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(cluster, display): the own label, or if it says nothing, words of the first file and of the top symbols."""
    path = F.replace(F.col("file_path"), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    dull = lambda p: F.lower(F.trim(p)).isin(*N.GENERIC_PATH_PARTS)
    folders = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ~dull(p))
    component = F.when(~dull(stem), stem).otherwise(F.coalesce(F.try_element_at(folders, F.lit(-1)), stem))
    first = files.where("place = 1").select("cluster", X.compact(X.title_case(X.label_words(component))).alias("file_label"), (dull(stem) & (F.size(folders) == 0)).alias("file_dull"))
    words = symbols.select("cluster", F.explode(X.label_words(F.col("name"))).alias("word"), F.greatest("score", F.lit(1)).alias("score"))
    words = words.where((F.length("word") >= 3) & ~F.col("word").isin(*N.GENERIC_TOKENS)).groupBy("cluster", "word").agg(F.sum("score").alias("w"))
    best = words.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("w"), "word"))).where("r <= 2")
    named = best.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("r", "word"))).alias("b")).select("cluster", X.compact(X.title_case(F.col("b.word"))).alias("symbol_label"))
    rows = found.select("cluster", "cluster_label").join(first, "cluster", "left").join(named, "cluster", "left")
    own = F.coalesce(F.nullif(X.compact(X.title_case(X.label_words(F.col("cluster_label")))), F.lit("")), F.lit("Community"))
    file = F.nullif(F.col("file_label"), F.lit(""))
    overlap = F.arrays_overlap(X.label_words(F.col("file_label")), X.label_words(F.col("symbol_label")))
    display = (
        F.when(~generic_label(F.col("cluster_label")), own)
        .when(file.isNotNull() & F.col("file_dull"), F.coalesce("symbol_label", file))
        .when(file.isNotNull() & F.col("symbol_label").isNotNull() & ~overlap, X.compact(F.concat(file, F.lit(" "), F.col("symbol_label"))))
        .when(file.isNotNull(), file)
        .otherwise(F.coalesce("symbol_label", own))
    )
    return rows.select("cluster", display.alias("display"))


def overview(nodes: DataFrame, edges: DataFrame, layout: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row per cluster: place, members, incident weight, size on the map, display label and quality.

    ``layout``: positions and clusters as :func:`positions` gives them, if they are stored.
    """
    placed, found = layout or positions(nodes, edges)
    files, symbols = written(top_files(nodes, placed), "files"), written(top_symbols(nodes, placed), "symbols")
    ends = written(_ends(edges, placed), "ends")
    incident = incident_weight(cluster_edges(edges, placed, ends))
    rows = found.join(incident, "cluster", "left").fillna(0, ["incident"])
    size = 1 + 1.35 * F.log1p("members") + 0.35 * F.log1p("incident")
    return rows.withColumn("size", size).join(display_labels(found, files, symbols), "cluster").join(quality(found, edge_stats(edges, placed, ends), files), "cluster")
