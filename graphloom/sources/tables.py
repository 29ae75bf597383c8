"""A property graph with text derived from the star-schema tables, by arithmetic on keys alone."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import stored

#: Room for the keys of one kind of node in the row number space.
SPAN = 10**12
KINDS = {"region": 1, "nation": 2, "supplier": 3, "customer": 4, "part": 5, "order": 6}

NODES_SQL = f"""
SELECT {SPAN} + r_regionkey AS rowid, concat('region:', r_regionkey) AS id, 'Community' AS label, r_name AS name,
       CAST(NULL AS STRING) AS file_path, CAST(NULL AS INT) AS start_line, CAST(NULL AS INT) AS end_line FROM region
UNION ALL SELECT 2 * {SPAN} + n_nationkey, concat('nation:', n_nationkey), 'Class', n_name,
       concat('geo/r', n_regionkey, '/nation.rs'), CAST(n_nationkey * 10 + 1 AS INT), CAST(n_nationkey * 10 + 6 AS INT) FROM nation
UNION ALL SELECT 3 * {SPAN} + s_suppkey, concat('supplier:', s_suppkey), 'Function', s_name,
       concat('supply/n', s_nationkey, '/suppliers.rs'), CAST(s_suppkey % 500 * 20 + 1 AS INT), CAST(s_suppkey % 500 * 20 + 10 AS INT) FROM supplier
UNION ALL SELECT 4 * {SPAN} + c_custkey, concat('customer:', c_custkey), 'Method', c_name,
       concat('crm/', lower(c_mktsegment), '/customers.json'), CAST(c_custkey % 5000 * 12 + 1 AS INT), CAST(c_custkey % 5000 * 12 + 8 AS INT) FROM customer
UNION ALL SELECT 5 * {SPAN} + p_partkey, concat('part:', p_partkey), 'Struct', p_name,
       concat('catalog/', lower(replace(p_brand, '#', '')), '/parts.rs'), CAST(p_partkey % 9000 * 5 + 1 AS INT), CAST(p_partkey % 9000 * 5 + 4 AS INT) FROM part
UNION ALL SELECT 6 * {SPAN} + o_orderkey, concat('order:', o_orderkey), 'Process', concat('order ', o_orderkey), NULL, NULL, NULL FROM orders
"""

EDGES_SQL = f"""
SELECT 2 * {SPAN} + n_nationkey AS src, {SPAN} + n_regionkey AS dst, 'MEMBER_OF' AS type, CAST(NULL AS INT) AS step FROM nation
UNION ALL SELECT 3 * {SPAN} + s_suppkey, {SPAN} + n_regionkey, 'MEMBER_OF', NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 4 * {SPAN} + c_custkey, {SPAN} + n_regionkey, 'MEMBER_OF', NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 3 * {SPAN} + s_suppkey, 2 * {SPAN} + s_nationkey, 'EXTENDS', NULL FROM supplier
UNION ALL SELECT 4 * {SPAN} + c_custkey, 2 * {SPAN} + c_nationkey, 'EXTENDS', NULL FROM customer
UNION ALL SELECT DISTINCT 5 * {SPAN} + l_partkey, 3 * {SPAN} + l_suppkey, 'CALLS', CAST(NULL AS INT) FROM lineitem
UNION ALL SELECT DISTINCT 4 * {SPAN} + o_custkey, 5 * {SPAN} + l_partkey, 'CALLS', CAST(NULL AS INT) FROM orders JOIN lineitem ON o_orderkey = l_orderkey
UNION ALL SELECT DISTINCT 5 * {SPAN} + l_partkey, 6 * {SPAN} + l_orderkey, 'STEP_IN_PROCESS', l_linenumber FROM lineitem
UNION ALL SELECT 4 * {SPAN} + o_custkey, 6 * {SPAN} + o_orderkey, 'ENTRY_POINT_OF', NULL FROM orders
"""


def register(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rowid, id, label, name, file_path, start_line, end_line); rowid orders kinds, then keys."""
    found = register(spark, sf_dir, ("region", "nation", "supplier", "customer", "part", "orders"))
    sql = NODES_SQL
    for name in found:
        sql = sql.replace(f"FROM {name}", "FROM {" + name + "}")
    return spark.sql(sql, **found)


#: The edges whose DISTINCTs are shuffled: type, columns of the edge, keys from the tables.
CALLED = "SELECT 5 * {0} + a AS src, 3 * {0} + b AS dst, 'CALLS' AS type, CAST(NULL AS INT) AS step FROM {{supplied}} UNION ALL SELECT 4 * {0} + a, 5 * {0} + b, 'CALLS', CAST(NULL AS INT) FROM {{ordered}}".format(SPAN)
STEPS = f"SELECT 5 * {SPAN} + a AS src, 6 * {SPAN} + b AS dst, 'STEP_IN_PROCESS' AS type, c AS step FROM {{steps}}"
#: A task of a DISTINCT has about so many rows, however many there are in all.
TASK_ROWS = 500_000


def edges(spark: SparkSession, sf_dir: str, types: Sequence[str] | None = None) -> DataFrame:
    """(src, dst, type, step) by row numbers, all or those of some types.

    Calls and steps, which need DISTINCTs, are derived once in an application and stored, if they are asked for; the
    others are read off the tables.
    """
    parts = [_plain_edges(spark, sf_dir)]
    if types is None or "CALLS" in types:
        parts.append(stored(spark, "calls", sf_dir, lambda: _calls(spark, sf_dir)))
    if types is None or "STEP_IN_PROCESS" in types:
        parts.append(stored(spark, "steps", sf_dir, lambda: _steps(spark, sf_dir)))
    found = reduce(DataFrame.union, parts)
    if types is not None:
        found = found.where(F.col("type").isin(*types))
    return found.withColumns({"confidence": F.lit(1.0), "reason": F.lit("")})


def _plain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = register(spark, sf_dir, ("nation", "supplier", "customer", "orders"))
    sql = " UNION ALL ".join(part for part in EDGES_SQL.split("UNION ALL ") if "DISTINCT" not in part)
    for name in found:
        sql = sql.replace(f"FROM {name}", "FROM {" + name + "}").replace(f"JOIN {name}", "JOIN {" + name + "}")
    return spark.sql(sql, **found)


def different(rows: DataFrame, count: int) -> DataFrame:
    """Different rows of a table in which few are equal: dealt by all columns first, as hash tables before a shuffle
    would hold nearly every row and save none."""
    return rows.repartition(count // TASK_ROWS + 1, *rows.columns).distinct()


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = register(spark, sf_dir, ("orders", "lineitem"))
    count = found["lineitem"].count()
    supplied = found["lineitem"].selectExpr("l_partkey AS a", "l_suppkey AS b")
    ordered = spark.sql("SELECT o_custkey AS a, l_partkey AS b FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey", **found)
    return spark.sql(CALLED, supplied=different(supplied, count), ordered=different(ordered, count))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = register(spark, sf_dir, ("lineitem",))["lineitem"]
    return spark.sql(STEPS, steps=different(lineitem.selectExpr("l_partkey AS a", "l_orderkey AS b", "l_linenumber AS c"), lineitem.count()))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, line, text): the documents as source files, one row per line, counted from 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".txt"))
    return docs.select(path.alias("file_path"), F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)
