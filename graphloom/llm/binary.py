"""Packed id matrices: best-fit-decreasing with a segment tree over free capacities.

Documents (with an end id) longer than a row are cut losslessly into whole rows and a rest. Rests are packed
best-fit-decreasing within blocks of a task: a segment tree over capacities finds the fullest open row that
still takes a piece, in steps of the logarithm of the row length. Rows are written with their id vector, the
cumulative segment lengths, and positions that start again at each segment.

Input contract: a null text counts as empty (its row holds the end id alone); texts of any length are cut;
repeated rows and null keys are packed like others; an empty table gives an empty table; further columns are
ignored. Blocks are bounded in ids, so memory is; the last row of a block may be partly filled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import wordbpe
from graphloom.llm.common import arrow_schema, scratch_path, short_batches

WIDTH, END_ID = 4096, 2
#: Ids that a task gathers before it packs.
BLOCK_IDS = 4_000_000


class CapacityTree:
    """Open rows by free capacity; ``best(n)`` is the least capacity of at least ``n`` that some row has."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def take(self, capacity: int) -> int:
        self._add(capacity, -1)
        return self.rows[capacity].pop()

    def best(self, least: int) -> int | None:
        node = self.leaves + least
        if self.count[node]:
            return least
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of piece numbers; each row's lengths sum to ``width`` at most."""
    tree, rows = CapacityTree(width), []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        capacity = tree.best(lengths[piece])
        if capacity is None:
            row, capacity = len(rows), width
            rows.append([])
        else:
            row = tree.take(capacity)
        rows[row].append(piece)
        if capacity > lengths[piece]:
            tree.put(capacity - lengths[piece], row)
    return rows


def packed_rows(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, end_id: int = END_ID, vocabulary: str | None = None
) -> DataFrame:
    """One row per packed row: row_id, keys, starts (in the key's document), cu_seqlens, ids (padded with 0) and
    position_ids (0 in the padding) as little-endian unsigned 16-bit vectors of ``width``."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = T.StructType(
        [T.StructField("row_id", T.LongType()), T.StructField("keys", T.ArrayType(rows.schema["k"].dataType)), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())), T.StructField("ids", T.BinaryType()), T.StructField("position_ids", T.BinaryType())]
    )
    arrow = arrow_schema(schema)
    ramp = np.arange(width, dtype="<u2")

    def emit(pieces: list[tuple], first: int) -> Iterator[pa.RecordBatch]:
        packed = best_fit_decreasing([len(p[2]) for p in pieces], width)
        for at in range(0, len(packed), 256):
            out: list[list] = [[] for _ in range(6)]
            for n, row in enumerate(packed[at : at + 256]):
                ids, positions, ends = np.zeros(width, "<u2"), np.zeros(width, "<u2"), [0]
                for piece in row:
                    part = pieces[piece][2]
                    ids[ends[-1] : ends[-1] + len(part)] = part
                    positions[ends[-1] : ends[-1] + len(part)] = ramp[: len(part)]
                    ends.append(ends[-1] + len(part))
                made = (first + at + n, [pieces[p][0] for p in row], [pieces[p][1] for p in row], ends, ids.tobytes(), positions.tobytes())
                for column, value in zip(out, made, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, first = wordbpe.encoder(vocabulary), TaskContext.get().partitionId() << 32
        pieces: list[tuple] = []
        held = 0
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for k, ids in zip(keys, tool.encode(batch.column(1).to_pylist()), strict=True):
                wide = np.frombuffer(ids + end, "<u4")
                if wide.max() > 0xFFFF:
                    raise ValueError("ids beyond 65535 don't fit the stored 16 bits")
                small = wide.astype("<u2")
                for start in range(0, len(small), width):
                    pieces.append((k, start, small[start : start + width]))
                held += len(small)
                if held >= BLOCK_IDS:
                    for made in emit(pieces, first):
                        first += made.num_rows
                        yield made
                    pieces, held = [], 0
        if pieces:
            yield from emit(pieces, first)

    return rows.mapInArrow(run, schema)


def write_matrices(docs: DataFrame, path: str, **options) -> DataFrame:
    """Writes the packed rows as Parquet (one fixed-width id vector per row) and returns the written table."""
    rows = packed_rows(docs, **options)
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    """Per written row: its documents and starts, segment ends, and digests of the stored vectors."""
    made = write_matrices(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_path(spark, "matrices"))
    return made.select(
        "row_id",
        F.col("keys").alias("doc_ids"),
        "starts",
        "cu_seqlens",
        F.element_at("cu_seqlens", -1).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("position_ids", 256).alias("positions_sha256"),
    )
