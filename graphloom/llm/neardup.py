"""Near-duplicate groups from banded sketches: exact links, connected components, no pairs of a whole bucket.

An item that shares no bucket with another has no partner and goes. What is left is compared by its elements, in
rounds whose work follows the number of elements:

- An element is *shared* if items of different components hold it. An item's elements are ordered: unshared ones
  first, then the shared ones by how many items hold them. Two sets that are alike enough, in different components,
  have a shared element in common among the first ``n - ceil(percent * n / 100) + 1`` of each (the prefix), and at
  the first one they have in common the elements from there on must suffice for the intersection. Items without a
  shared element in their prefix are settled and go. Before elements are counted, items without one go by the same
  rule in the order of the elements' values.
- Of the items that hold an element in their prefix, the one that holds it earliest is its hub. Hubs are compared
  with the other holders, on the full sets, and components are formed anew: this settles groups of near copies.
- A round that has joined few items is the last: its holders in different components are then all compared, as far
  as the positions and sizes leave a link possible. So no link between components is missed, and of a group of near
  copies only what stands apart from its component is compared at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import drop_written, free_shuffles, written

#: Hubs of an element in a round. A round that links fewer than one in FACTOR of the items compared is the last one.
LEADERS, FACTOR = 1, 16
#: Ids up to this number, with what is beside them up to so many bytes, are sent to all executors instead of shuffling
#: what they name: the driver holds each such table several times over.
BROADCAST_IDS, BROADCAST_BYTES = 500_000, 32 << 20


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b); component is the least id reachable.

    Alternates large-star and small-star steps until no edge changes; each step is written to the shared folder.
    Self-loops and repeated edges are harmless; no edges give an empty table.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = written(edges.where("a <> b").select(high.alias("u"), low.alias("v")).distinct(), "edges")
    sign = _sign(now)
    while sign[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.union(least).distinct(), "edges")
        before, sign = sign, _sign(after)
        drop_written(now)
        now = after
        if sign == before:
            break
    return now.union(now.select("v", "v").distinct()).toDF("id", "component")


def _bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value in memory: a word and what it holds; values in an array's structs are a word each."""
    if isinstance(kind, T.ArrayType):
        each = 16 + 8 * len(kind.elementType) if isinstance(kind.elementType, T.StructType) else 8
        return 24 + each * F.coalesce(F.greatest(F.size(value), F.lit(0)), F.lit(0)).cast("long")
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind), F.lit(16))
    if isinstance(kind, T.StringType | T.BinaryType):
        return 8 + F.coalesce(F.octet_length(value), F.lit(0)).cast("long")
    return F.lit(8)


def _measured(ids: DataFrame) -> tuple[bool, bool]:
    """Whether a written table may be broadcast, and whether its ids alone may."""
    row = sum((_bytes(F.col(f.name), f.dataType) for f in ids.schema), F.lit(24))
    n, size = ids.agg(F.count("*"), F.coalesce(F.sum(row), F.lit(0))).first()
    return n <= BROADCAST_IDS and size <= BROADCAST_BYTES, n <= BROADCAST_IDS


def with_ids(table: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """``table`` joined to the (written, unique) ids; they are broadcast only if their counted number is within
    BROADCAST_IDS, and with all their columns only if these are within BROADCAST_BYTES."""
    whole, named = _measured(ids)
    if whole:
        return table.join(F.broadcast(ids), on)
    if named and len(ids.columns) > 1:
        table = table.join(F.broadcast(ids.select(on)), on, "left_semi")
    return table.join(ids.hint("merge"), on)


def beside(table: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """All of ``table``, with what the (written, unique) ids have beside them, else nulls; broadcast as by with_ids."""
    whole, named = _measured(ids)
    if whole or not named:
        return table.join(F.broadcast(ids) if whole else ids.hint("merge"), on, "left")
    alone = table.join(F.broadcast(ids.select(on)), on, "left_anti")
    return with_ids(table, ids, on).unionByName(alone, allowMissingColumns=True)


def repeated(rows: DataFrame, column: str) -> DataFrame:
    """The rows whose value of a column another row has too; counts alone are shuffled where the values are few."""
    values = written(rows.groupBy(column).agg(F.count("*").alias("m")).where("m > 1").select(column), "repeated")
    return with_ids(rows, values, column)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with ``100 * intersection >= percent * union``, on the full sets."""
    joined = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    joined = joined.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    shared = joined.select("a", "b", (F.size("set_a") + F.size("set_b")).alias("both"), F.size(F.array_intersect("set_a", "set_b")).alias("common"))
    return shared.where(f"100L * common >= {percent}L * (both - common)").select("a", "b")


def _holders(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(x, id, n, c, pos): the shared elements in the items' prefixes; ``pos`` counts from 0 in the item's order."""
    named = sets.join(groups.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
    shared = named.select("c", F.explode("set").alias("x")).groupBy("x").agg(F.count("*").alias("df"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("x", "df")
    own = Window.partitionBy("id")
    placed = sets.select("id", F.explode("set").alias("x")).join(shared, "x").select("x", "id", F.count("*").over(own).alias("held"), F.row_number().over(own.orderBy("df", "x")).alias("at"))
    placed = placed.join(named.select("id", "n", "c"), "id").select("x", "id", "n", "c", F.expr("n - held + at - 1").alias("pos"))
    return placed.where(f"100L * pos <= {100 - percent}L * n")


def _open(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(id): the items that can have a link to another component, by the least elements of each set alone.

    The least element that two sets have in common is among the prefixes of both in any order that all sets share, so
    also in that of the elements' values, which needs no counts. What this settles is not counted element by element.
    """
    named = sets.join(groups.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
    least = named.select("id", "c", F.explode(F.expr(f"slice(sort_array(set), 1, CAST({100 - percent} * n DIV 100 AS INT) + 1)")).alias("x"))
    shared = least.groupBy("x").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("x")
    return least.select("x", "id").join(shared, "x").select("id").distinct()


def _likely(percent: int) -> str:
    """Whether sets a and b, whose first common element is at pos_a and pos_b, can be alike enough."""
    return f"c_a <> c_b AND {100 + percent}L * least(n_a - pos_a, n_b - pos_b) >= {percent}L * (n_a + n_b)"


def _named(holders: DataFrame, side: str) -> DataFrame:
    return holders.select("x", *[F.col(c).alias(f"{side}_{c}" if c == "id" else f"{c}_{side}") for c in ("id", "n", "c", "pos")])


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()


def colliding(items: DataFrame) -> DataFrame:
    """(id), written: the items (id, bands: array of long) that share a bucket with another one."""
    return written(repeated(items.select("id", F.explode("bands").alias("bucket")), "bucket").select("id").distinct(), "met")


def near_duplicate_groups(items: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(id, component) of the items that are linked with others.

    items: (id long, unique; bands: array of long), one per different set. sets_of: gives (id, set) for a table of ids.
    """
    return groups_of(colliding(items), sets_of, percent)


def groups_of(met: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """:func:`near_duplicate_groups` of the items that :func:`colliding` gave."""
    sets = live = written(sets_of(met).withColumn("n", F.size("set")), "sets")
    spark = sets.sparkSession
    free_shuffles(spark)
    groups = spark.createDataFrame([], "id long, component long")
    last = False
    while not last:
        some = written(_open(live, groups, percent), "open")
        holders = written(_holders(with_ids(live, some, "id"), groups, percent), "holders")
        first = holders.groupBy("x", F.expr(f"pmod(xxhash64(id), {LEADERS}L)")).agg(F.min_by(F.struct("id", "n", "c", "pos"), F.struct(F.expr("pos / n"), "id")).alias("hub"))
        hubs = _named(first.select("x", "hub.*"), "a")
        pairs = _named(holders, "b").join(hubs, "x").where(_likely(percent))
        links = written(verified(_distinct(pairs), sets, percent), "links")
        still = written(holders.select("id").distinct(), "still")
        last = FACTOR * links.count() <= still.count()
        if last:
            # the shorter set a has its first common element in the shorter prefix, which two sets of its size need
            a = _named(holders, "a").where(f"{100 + percent}L * pos_a <= {100 - percent}L * n_a")
            pairs = a.join(_named(holders, "b"), "x").where(f"(n_a < n_b OR n_a = n_b AND a_id < b_id) AND {_likely(percent)}")
            links = links.union(verified(_distinct(pairs), sets, percent))
        groups = written(connected_components(groups.toDF("a", "b").union(links)), "groups")
        live = with_ids(sets, still, "id")
        drop_written(holders)
        free_shuffles(spark)
    drop_written(sets)
    return groups
