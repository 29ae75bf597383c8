"""Exact nearest neighbours by cosine, and reciprocal rank fusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import names as N


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def knn(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, similarity) of the ``k`` nearest; a vector of another dimension is an error."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    right = F.assert_true(F.size(vector) == len(query), F.lit("vectors differ in dimension"))
    length = sum(x * x for x in query) ** 0.5
    scored = vectors.select(key, F.coalesce(right.cast("double"), dot(F.col(vector), asked) / (norm(F.col(vector)) * F.lit(length))).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def knn_join(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", ask: int = 1024, hold: int = 8192) -> DataFrame:
    """(query_id, key, similarity) of the ``k`` nearest of every query, keys being longs; order is by similarity to nine
    digits, then key. Blocks of about ``ask`` queries meet blocks of about ``hold`` vectors, each giving ``k`` at most;
    a vector of another dimension is an error, one of length 0 comes last, with null."""
    asked, held = max(1, -(-queries.count() // ask)), max(1, -(-vectors.count() // hold))
    spark = vectors.sparkSession
    rows = lambda t: t.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("long")
    each = lambda n, name: F.broadcast(spark.range(n).toDF(name))
    left = rows(queries).withColumn("a", of(asked)).crossJoin(each(held, "b"))
    right = rows(vectors).withColumn("b", of(held)).crossJoin(each(asked, "a"))

    def nearest(q: pa.Table, t: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if q.num_rows and t.num_rows:
            x, y = (np.stack([np.asarray(v, float) for v in z["v"].to_pylist()]) for z in (q, t))
            ids = t["id"].to_numpy()
            with np.errstate(divide="ignore", invalid="ignore"):
                found = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])
            order = np.where(np.isfinite(found), np.round(found, 9), -2.0)
            least = np.partition(order, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(x), -2.0)
            for i, asked_id in enumerate(q["id"].to_pylist()):
                near = np.flatnonzero(order[i] >= least[i])
                near = near[np.lexsort((ids[near], -order[i, near]))][:k]
                out[0] += [asked_id] * len(near)
                out[1] += ids[near].tolist()
                out[2] += [v if np.isfinite(v) else None for v in found[i, near].tolist()]
        return pa.table([pa.array(c, kind) for c, kind in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", key, "similarity"])

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(nearest, f"query_id long, `{key}` long, similarity double")
    best = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc_nulls_last(), key)
    return found.withColumn("_place", F.row_number().over(best)).where(f"_place <= {k}").drop("_place")


def upsert_vectors(old: DataFrame, new: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Keyed latest-wins, with the dimension held."""
    size = old.select(F.size(vector).alias("n")).limit(1).first()
    checked = new if size is None else new.where(F.assert_true(F.size(vector) == size["n"], F.lit("vectors differ in dimension")).isNull())
    return old.join(checked.select(key), key, "left_anti").select(old.columns).unionByName(checked)


def rrf(ranked: DataFrame, semantic: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """(node_id, score): sums of 1 / (60 + rank + 1) over two lists (node_id, rank from 0).

    Ids of the semantic list alone that ``known`` lacks are dropped; ties go to the first to appear.
    """
    share = lambda c: F.coalesce(1.0 / (N.RRF_K + F.col(c) + 1), F.lit(0.0))
    both = ranked.withColumnRenamed("rank", "a").join(semantic.withColumnRenamed("rank", "b"), "node_id", "full_outer")
    there = both.join(known.select("node_id", F.lit(True).alias("known")), "node_id", "left").where("a IS NOT NULL OR known")
    scored = there.select("node_id", (share("a") + share("b")).alias("score"), "a", "b")
    return scored.orderBy(F.desc("score"), F.asc_nulls_last("a"), "b").limit(limit).select("node_id", "score")


def ranks(hits: DataFrame, order: list[Column]) -> DataFrame:
    return hits.select("node_id", (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"))
