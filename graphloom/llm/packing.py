"""Packing by non-negative least squares over shallow length combinations.

A document's ids are cut into whole windows, a piece of ``q`` units, and a tail shorter than a unit. The
histogram of ``q`` has one bin per unit count, however large the corpus. Combinations of at most two
different lengths (repeated) or three lengths that fill a window exactly are enumerated, non-negative
least squares gives how often each is repeated, and the counts are rounded within the supply. Pieces beyond
the plan, unit by unit, and then the tails are packed greedily in one stream that is cut at window ends;
its last, unfilled part is cut into powers of two, which need no padding.

Places come from prefix sums over (task, row) numbers kept in a written table: no group is collected.

Input contract: a null text counts as empty, which still has its end id; texts of any length are cut; repeated
rows and null keys are packed like others; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import wordbpe
from graphloom.llm.common import arrow_schema, map_batches, short_batches, written

WINDOW, UNIT, END_ID = 4096, 64, 2


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 500) -> np.ndarray:
    """The non-negative ``x`` that makes ``|a x - b|`` least (active-set method)."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    scale = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[free] = -np.inf
        k = int(gain.argmax())
        if gain[k] <= scale:
            break
        free[k] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (s <= 0)
            if not low.any():
                x = s
                break
            step = float(np.min(x[low] / np.maximum(x[low] - s[low], 1e-300)))
            x = x + step * (s - x)
            free &= x > 1e-12 * max(1.0, x.max())
            x[~free] = 0
            if not free.any():
                break
    return x


def combinations(units: int) -> list[dict[int, int]]:
    """Multisets of lengths that fill a window: at most two different lengths, or three lengths."""
    found: dict[tuple, dict[int, int]] = {}
    for a in range(1, units):
        if units % a == 0:
            found[((a, units // a),)] = {a: units // a}
        for b in range(a + 1, units):
            for j in range(1, (units - a) // b + 1):
                i, rest = divmod(units - j * b, a)
                if i and not rest:
                    found[((a, i), (b, j))] = {a: i, b: j}
    for a, b in combinations_with_replacement(range(1, units), 2):
        c = units - a - b
        if c > b > a:
            found[((a, 1), (b, 1), (c, 1))] = {a: 1, b: 1, c: 1}
    return list(found.values())


def plan(histogram: dict[int, int], units: int) -> list[tuple[dict[int, int], int]]:
    """(combination, times), within the histogram's supply."""
    total = sum(histogram.values())
    if not total:
        return []
    ways = combinations(units)
    a = np.zeros((units - 1, len(ways)))
    for k, way in enumerate(ways):
        for length, n in way.items():
            a[length - 1, k] = n
    b = np.array([histogram.get(q, 0) for q in range(1, units)], float)
    weight = np.sqrt(np.arange(1, units))[:, None]  # leftover of long pieces weighs more
    times = nnls(a * weight, b * weight[:, 0])
    left, out = dict(histogram), []
    for k in sorted(np.flatnonzero(times > 0), key=lambda k: (-times[k], k)):
        n = min([int(round(times[k])), *(left.get(q, 0) // m for q, m in ways[k].items())])
        if n > 0:
            out.append((ways[k], n))
            for q, m in ways[k].items():
                left[q] -= n * m
    return out


def cut_documents(docs: DataFrame, key: str, text: str, window: int, unit: int, end_id: int, vocabulary: str | None) -> DataFrame:
    """A row per document: its ids' number and checksums by window and unit, and the ids of its tail."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    longs = T.ArrayType(T.LongType(), False)
    schema = T.StructType(
        [T.StructField("k", rows.schema["k"].dataType), T.StructField("task", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("n", T.LongType()), T.StructField("full_crc", longs), T.StructField("piece_crc", T.LongType()), T.StructField("unit_crc", longs), T.StructField("tail", T.BinaryType())]
    )
    arrow = arrow_schema(schema)
    end = end_id.to_bytes(4, "little")

    def make():
        tool, task, row = wordbpe.encoder(vocabulary), TaskContext.get().partitionId(), 0

        def each(batch: pa.RecordBatch):
            nonlocal row
            out: list[list] = [[] for _ in range(6)]
            for ids in tool.encode(batch.column(1).to_pylist()):
                ids += end
                n, view = len(ids) // 4, memoryview(ids)
                full, q = n // window, n % window // unit
                start, tail = 4 * window * full, 4 * (window * full + unit * q)
                out[0].append(n)
                out[1].append([zlib.crc32(view[4 * window * i : 4 * window * (i + 1)]) for i in range(full)])
                out[2].append(zlib.crc32(view[start:tail]))
                out[3].append([zlib.crc32(view[start + 4 * unit * i : start + 4 * unit * (i + 1)]) for i in range(q)])
                out[4].append(bytes(view[tail:]))
                out[5].append(row)
                row += 1
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([task] * size, pa.int32()), pa.array(out[5], pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], arrow.field(4).type), pa.array(out[2], pa.int64()), pa.array(out[3], arrow.field(6).type), pa.array(out[4], pa.binary())], schema=arrow
            )

        return each

    return written(map_batches(rows, make, schema), "packing")


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    unit: int = UNIT,
    end_id: int = END_ID,
    vocabulary: str | None = None,
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``unit`` divides ``window``, both powers of two."""
    spark, units = docs.sparkSession, window // unit
    cut = cut_documents(docs, key, text, window, unit, end_id, vocabulary)
    cut = cut.withColumns({"full": F.col("n").cast("long") - F.col("n") % window, "q": F.size("unit_crc"), "s": (F.length("tail") / 4).cast("long")})
    cut = cut.withColumn("full", (F.col("full") / window).cast("long"))

    # bounded by the unit count: the histogram, and from it the plan
    counts = {r["q"]: (r["c"], r["f"] or 0, r["s"] or 0) for r in cut.groupBy("q").agg(F.count("*").alias("c"), F.sum("full").alias("f"), F.sum("s").alias("s")).collect()}
    made = plan({q: c for q, (c, _, _) in counts.items() if q}, units)
    whole = sum(f for _, f, _ in counts.values())
    slots, used, sequence = [], dict.fromkeys(range(units), 0), whole
    for way, times in made:
        at = 0
        for q, copies in way.items():
            for _ in range(copies):
                slots.append((q, used[q], used[q] + times, sequence, at * unit))
                used[q] += times
                at += q
        sequence += times
    left_from, stream = {}, 0
    for q in range(1, units):
        left_from[q] = stream
        stream += (counts.get(q, (0, 0, 0))[0] - used[q]) * q * unit
    tails_from, total = stream, stream + sum(s for _, _, s in counts.values())
    last = total - total % window
    ends, at = [], last
    for bit in reversed(range(window.bit_length() - 1)):
        if (total - last) >> bit & 1:
            at += 1 << bit
            ends.append(at)

    # prefix sums: over tasks, then within each task
    per_task = cut.groupBy("task").agg(F.sum("full").alias("full_all"), F.sum("s").alias("s_all"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = per_task.select("task", F.coalesce(F.sum("full_all").over(before), F.lit(0)).alias("full_at"), F.coalesce(F.sum("s_all").over(before), F.lit(0)).alias("s_at"))
    per_bin = cut.groupBy("task", "q").agg(F.count("*").alias("c"))
    before_q = Window.partitionBy("q").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = per_bin.select("task", "q", F.coalesce(F.sum("c").over(before_q), F.lit(0)).alias("rank_at"))
    own = Window.partitionBy("task").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        cut.withColumns({"full_in": F.coalesce(F.sum("full").over(own), F.lit(0)), "s_in": F.coalesce(F.sum("s").over(own), F.lit(0)), "rank_in": F.row_number().over(Window.partitionBy("task", "q").orderBy("row")) - 1})
        .join(per_task, "task")
        .join(per_bin, ["task", "q"])
        .withColumns({"full_at": F.col("full_at") + F.col("full_in"), "s_at": F.col("s_at") + F.col("s_in") + F.lit(tails_from), "rank": F.col("rank_at") + F.col("rank_in")})
    )
    # at most one row per part of a planned combination, which the unit count bounds
    slot = spark.createDataFrame(slots, "slot_q int, rank_from long, rank_to long, slot_sequence long, slot_offset int")
    placed = placed.join(F.broadcast(slot), (F.col("q") == F.col("slot_q")) & F.col("rank").between(F.col("rank_from"), F.col("rank_to") - 1), "left")
    table = lambda d: "map(" + ",".join(f"{k},{v}L" for k, v in {0: 0, **d}.items()) + ")"
    bounds = "array(" + ",".join(f"{e}L" for e in ends) + ")" if ends else "cast(array() as array<bigint>)"
    start_of = lambda p: f"CASE WHEN {p} < {last} THEN {p} - {p} % {window} ELSE array_max(concat(array({last}L), filter({bounds}, e -> e <= {p}))) END"
    number_of = lambda p: f"{sequence}L + CASE WHEN {p} < {last} THEN {p} DIV {window} ELSE {last // window} + size(filter({bounds}, e -> e <= {p})) END"
    piece = lambda start, length, crc, number, offset: f"named_struct('start', cast({start} AS bigint), 'length', cast({length} AS bigint), 'ids_crc32', cast({crc} AS bigint), 'sequence_id', cast({number} AS bigint), 'offset', cast({offset} AS bigint))"
    kind = "array<struct<start:bigint,length:bigint,ids_crc32:bigint,sequence_id:bigint,offset:bigint>>"
    placed = (
        placed.withColumn("left_at", F.expr(f"{table(left_from)}[q] + (rank - {table(used)}[q]) * q * {unit}"))
        .withColumn("cuts", F.expr(f"array_distinct(array_sort(concat(array(s_at, s_at + s), filter(concat(array((s_at DIV {window} + 1) * {window}), {bounds}), e -> e > s_at AND e < s_at + s))))"))
        .withColumn("windows", F.expr(f"transform(full_crc, (c, i) -> {piece(f'i * {window}', window, 'c', 'full_at + i', '0')})"))
        .withColumn("planned", F.expr(f"CASE WHEN slot_q IS NOT NULL THEN array({piece(f'full * {window}', f'q * {unit}', 'piece_crc', 'slot_sequence + rank - rank_from', 'slot_offset')}) ELSE transform(unit_crc, (c, i) -> {piece(f'full * {window} + i * {unit}', unit, 'c', number_of(f'(left_at + i * {unit})'), f'(left_at + i * {unit}) - ({start_of(f'(left_at + i * {unit})')})')}) END"))
        .withColumn("tails", F.expr(f"transform(slice(cuts, 1, greatest(size(cuts) - 1, 0)), (p, i) -> {piece(f'full * {window} + q * {unit} + p - s_at', 'cuts[i + 1] - p', 'crc32(substring(tail, cast(4 * (p - s_at) + 1 AS int), cast(4 * (cuts[i + 1] - p) AS int)))', number_of('p'), f'p - ({start_of('p')})')})"))
        .withColumn("piece", F.explode(F.expr(f"concat(cast(windows AS {kind}), cast(planned AS {kind}), cast(CASE WHEN s > 0 THEN tails ELSE array() END AS {kind}))")))
    )
    return placed.select(F.col("k").alias(key), "piece.start", "piece.length", "piece.ids_crc32", F.col("n").alias("doc_tokens"), "piece.sequence_id", "piece.offset")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
