"""What a viewer needs of a laid-out graph: bounds, a grid for picking, level of detail, labels, the file tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PER_CELL, LABELS = 12, 24


def bounds(points: DataFrame) -> DataFrame:
    return points.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.count("*").alias("n"))


def cell_size(points: DataFrame) -> float:
    """The side of square cells that hold about twelve points each."""
    b = bounds(points).first()
    if not b["n"]:
        return 1.0
    area = max(b["max_x"] - b["min_x"], 1e-9) * max(b["max_y"] - b["min_y"], 1e-9)
    return max((area * PER_CELL / b["n"]) ** 0.5, 1e-9)


def gridded(points: DataFrame, cell: float) -> DataFrame:
    return points.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})


def pick(points: DataFrame, clicks: DataFrame, radius: float) -> DataFrame:
    """(click, rowid, d2): the nearest point within ``radius`` of each click (click, x, y); an equi-join on grid cells.

    Of points at one place only the first can be picked, and clicks at one place pick the same: places are joined.
    """
    cell = max(radius, 1e-9)
    places = points.groupBy("x", "y").agg(F.min("rowid").alias("rowid"))
    own = gridded(places, cell).select("rowid", F.col("x").alias("px"), F.col("y").alias("py"), "cx", "cy")
    near = gridded(clicks.select("x", "y").distinct(), cell).withColumn("dx", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dy", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    near = near.select("x", "y", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    d2 = F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2)
    met = near.join(own, ["cx", "cy"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    best = met.groupBy("x", "y").agg(F.min(F.struct("d2", "rowid")).alias("m"))
    return clicks.join(best, ["x", "y"]).groupBy("click").agg(F.min("m").alias("m")).select("click", "m.rowid", "m.d2")


def in_rect(points: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    return points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def zoom_level(zoom: float) -> tuple[str, float]:
    """(level, share of edges drawn)."""
    return ("clusters", 0.0) if zoom < 0.15 else ("far", 0.25) if zoom < 0.5 else ("near", 0.6) if zoom < 1.2 else ("full", 1.0)


def visible_clusters(centers: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    return in_rect(centers, x0, y0, x1, y1).orderBy(F.desc("weight"), "cluster").limit(LABELS)


def weighted_degrees(edges: DataFrame) -> DataFrame:
    w = F.greatest(F.round("weight"), F.lit(1)).cast("long")
    return edges.select(F.explode(F.array("s", "t")).alias("i"), w.alias("w")).groupBy("i").agg(F.sum("w").alias("degree"))


def cluster_centers(placed: DataFrame) -> DataFrame:
    return placed.groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.sum("degree").alias("weight"))


def shuffled_edges(edges: DataFrame, seed: int = 1) -> DataFrame:
    """Edges in an order that depends on their ends and the seed alone, so that any prefix is an even sample."""
    return edges.orderBy(F.xxhash64(F.lit(seed), "s", "t"), "s", "t")


def ancestors(paths: DataFrame) -> DataFrame:
    """(path, ancestor, depth): the folders above a path."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("ancestor"), n.alias("depth")))
    return paths.where(F.size(parts) > 1).select("path", F.explode(ups).alias("a")).select("path", "a.*")


def file_tree(paths: DataFrame) -> DataFrame:
    """(folder, parent, files, folders, folded): folders with their direct entries; those with one folder alone are folded."""
    above = ancestors(paths)
    folders = above.select(F.col("ancestor").alias("folder"), "depth").distinct()
    parent = F.regexp_replace("folder", "/?[^/]*$", "")
    direct = paths.select(F.regexp_replace("path", "/?[^/]*$", "").alias("folder")).groupBy("folder").agg(F.count("*").alias("files"))
    inner = folders.select(parent.alias("folder"), F.col("folder").alias("child")).groupBy("folder").agg(F.count("*").alias("folders"))
    rows = folders.join(direct, "folder", "left").join(inner, "folder", "left").fillna(0)
    return rows.select("folder", parent.alias("parent"), "depth", "files", "folders", ((F.col("files") == 0) & (F.col("folders") == 1)).alias("folded"))


def dense_classes(rows: DataFrame, label: str = "label", place: str = "i") -> DataFrame:
    """A number for each label in order of first appearance."""
    first = rows.groupBy(label).agg(F.min(place).alias("first"))
    return first.select(label, (F.row_number().over(Window.orderBy("first")) - 1).alias("class"))
