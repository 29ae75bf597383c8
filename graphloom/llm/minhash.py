"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Each whole text becomes the set of its five-word shingles. Equal sets are one item; items are banded by their
sketches (32 bands of 5 coordinates: a pair at the threshold 0.85 is missed with a probability of 7e-9), and
:mod:`graphloom.llm.neardup` links items that share a bucket, after verification on the full sets.

Input contract: null and empty texts, and those of white space only, have no shingles and are linked with
nothing; a text of fewer than five words is one shingle; texts of any length are read whole; ties go to the
smallest key; repeated rows give a row each, in one component; a row without a key
is linked with rows of an equal set alone; an empty table gives an empty table; further columns are ignored by ``near_duplicates``
and kept by ``one_of_each``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import sketch as S
from graphloom.llm.common import arrow_schema, map_batches, short_batches, written
from graphloom.llm.neardup import near_duplicate_groups, with_ids

PERCENT, BANDS, ROWS = 85, 32, 5


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, split at the six ASCII white-space characters."""
    return (text or "").encode().lower().split()


def fingerprints(rows: DataFrame, n_bands: int, n_rows: int) -> DataFrame:
    """(k, t) to (k, n, hi, lo, bands); n = 0 has null for the rest."""
    schema = T.StructType(
        [T.StructField("k", rows.schema["k"].dataType), T.StructField("n", T.IntegerType()), T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType(), False))]
    )
    arrow = arrow_schema(schema)

    def make():
        def each(batch: pa.RecordBatch):
            texts = [words_of(text) for text in batch.column(1).to_pylist()]
            length = np.array([len(words) for words in texts], np.int64)
            start = np.cumsum(length) - length
            elements, at = S.shingle_sets(S.word_hashes([w for words in texts for w in words]), start, length)
            some = np.flatnonzero(length)
            names = [S.identity(elements[at[i] : at[i + 1]]) if length[i] else (None, None) for i in range(len(texts))]
            banded: list = [None] * len(texts)
            if len(some):
                sizes = np.diff(at)[some]
                for i, row in zip(some, S.bands(S.sketches(elements, np.concatenate([[0], np.cumsum(sizes)]), n_bands * n_rows), n_rows), strict=True):
                    banded[i] = row
            columns = [np.diff(at).astype("int32"), [x[0] for x in names], [x[1] for x in names], banded]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(x, f.type) for x, f in zip(columns, list(arrow)[1:], strict=True)], schema=arrow)

        return each

    return map_batches(rows, make, schema)


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(id, hi, lo, t) to (id, set), of the rows whose text has the set that hi and lo name."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("set", T.ArrayType(T.LongType(), False))])
    arrow = arrow_schema(schema)

    def make():
        def each(batch: pa.RecordBatch):
            ids, sets = [], []
            for id_, hi, lo, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                found = S.shingle_set(S.word_hashes(words_of(text)))
                if S.identity(found) == (hi, lo):
                    ids.append(id_)
                    sets.append(found.view("int64"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, arrow.field(1).type)], schema=arrow)

        return each

    return map_batches(rows, make, schema)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, n_bands: int = BANDS, n_rows: int = ROWS) -> DataFrame:
    """Per row: key, n_shingles, component_id (smallest key reachable) and kept (it names its component)."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    prints = written(fingerprints(rows, n_bands, n_rows), "prints")
    items = prints.where("n > 0").groupBy("hi", "lo").agg(F.min("k").alias("k"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    items = written(items.withColumn("id", F.monotonically_increasing_id()), "items")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = written(items.select("id", "k", "hi", "lo").join(ids, "id"), "wanted")
        return shingle_sets(with_ids(rows, wanted, "k").select("id", "hi", "lo", "t"))

    groups = near_duplicate_groups(items.where("k IS NOT NULL").select("id", "bands"), sets_of, percent)
    named = items.select("id", "hi", "lo", "k").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("k").alias("component_id"))
    named = named.join(least, "component").select("hi", "lo", "component_id")
    out = prints.select("k", "n", "hi", "lo").join(named, ["hi", "lo"], "left").withColumn("component_id", F.coalesce("component_id", "k"))
    return out.select(F.col("k").alias(key), F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows, with all their columns, that name their component; rows of one key stay once, those without a key all."""
    kept = near_duplicates(docs, key, text, **options).where("kept").select(F.col(key).alias("_kept")).distinct()
    named = docs.join(kept, docs[key] == kept["_kept"], "left_semi").dropDuplicates([key])
    return named.union(docs.where(docs[key].isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB's version of :func:`query`: all pairs that share a shingle, and reachability.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w
  FROM documents),
s AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
e AS (SELECT rid, doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.rid < b.rid
  GROUP BY a.rid, b.rid, a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM p UNION SELECT b, a FROM p) l ON l.a = r.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.c AS component_id, m.c = s.doc_id AS kept
FROM s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = s.doc_id
"""
