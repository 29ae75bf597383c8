"""Exact substring dedup: maximal repeats from the common-prefix interval tree of a sparse suffix array.

Every string of ``length`` bytes is owned by its minimizer, the ``K``-gram with the least hash in it (leftmost
of equal ones), so equal strings have equal minimizers at equal places. Suffixes are therefore taken at
minimizers only, and equal minimizers share a partition; texts never meet as wholes.

Per minimizer value the suffixes, sorted, with the lengths of common prefixes of neighbours, are an enhanced
suffix array. A stack scan lists its common-prefix intervals; within an interval of depth ``l`` the left contexts,
sorted backwards, give each occurrence its longest common left extension ``e`` with another one, and whether the
interval is left-diverse (else a longer repeat, found at an earlier minimizer, holds it). ``e + l >= length`` makes
the occurrence a repeat of ``e + l`` bytes, with all occurrences of the interval, not only neighbours.

Equal surroundings (copies) are merged, with their number, before anything is shuffled for sorting. A minimizer
with more than ``HOT`` different surroundings is split instead: offset ranges are halved until all that share a
range's common part also share its full extent, so no hot group meets in one task.

Input contract: nulls count as empty; texts shorter than ``length`` have no repeats; texts of any length are
read whole, in overlapping parts; a repeated row repeats its text, so both are removed; null keys are documents like
others; documents are told apart by key and text; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import arrow_schema, map_batches, short_batches, written
from graphloom.llm.sketch import mix

LENGTH, K = 200, 32
#: Different surroundings of one minimizer that a task may sort.
HOT = 50_000
#: Bytes hashed at a time.
PART = 1 << 21

_U64 = np.uint64
_STEP = 0x9E3779B97F4A7C15 | 1
_PLACE = _U64((1 << 24) - 1)


class Hasher:
    """Polynomial hashes of all ranges of a byte string, from one prefix sum."""

    def __init__(self, size: int):
        self.size = 0
        self._grow(size)

    def _grow(self, size: int) -> None:
        if size > self.size:
            self.powers, self.inverses = np.full(size + 1, _STEP, _U64), np.full(size + 1, pow(_STEP, -1, 1 << 64), _U64)
            self.powers[0] = self.inverses[0] = 1
            self.powers, self.inverses = np.cumprod(self.powers), np.cumprod(self.inverses)
            self.size = size

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        out = np.zeros(len(data) + 1, _U64)
        np.cumsum((data.astype(_U64) + _U64(1)) * self.powers[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.inverses[start])


def sliding_least(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` successive values."""
    n = len(values)
    padded = np.full(-(-n // w) * w, _U64(np.iinfo(_U64).max), _U64)
    padded[:n] = values
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def minimizers(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hasher: Hasher, length: int, k: int):
    """Of documents laid end to end: (document, place, least and greatest offset of owned strings, value, surroundings' hash)."""
    w = length - k + 1
    empty = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, _U64)] * 2
    if len(data) < length:
        return empty
    sums = hasher.sums(data)
    at = np.arange(len(data) - k + 1)
    grams = hasher.of(sums, at, at + k)
    least = sliding_least((grams & ~_PLACE) | at.astype(_U64), w) & _PLACE
    doc_of = np.repeat(np.arange(len(starts)), np.maximum(sizes - length + 1, 0))
    if not len(doc_of):
        return empty
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(np.maximum(sizes - length + 1, 0))[:-1]]), np.maximum(sizes - length + 1, 0))
    begin = np.arange(len(doc_of)) + first
    anchor = least[begin].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc_of[1:] != doc_of[:-1])]))
    last = np.concatenate([new[1:], [len(begin)]]) - 1
    doc, place = doc_of[new], anchor[new]
    left = np.maximum(starts[doc], place - (w - 1))
    right = np.minimum(starts[doc] + sizes[doc], place + length)
    around = hasher.of(sums, left, right) ^ mix(((place - left) * 1024 + right - place).astype(_U64))
    return [doc, place - starts[doc], place - begin[last], place - begin[new], grams[place], around]


def _anchors(rows: DataFrame, length: int, k: int) -> DataFrame:
    """(k, d, t) to (v: minimizer, s: surroundings, k, d, place, own: least offset * 256 + greatest)."""
    schema = T.StructType(
        [T.StructField("v", T.LongType()), T.StructField("s", T.LongType()), T.StructField("k", rows.schema["k"].dataType), T.StructField("d", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("own", T.IntegerType())]
    )
    arrow = arrow_schema(schema)

    def long_text(data: np.ndarray, hasher: Hasher):
        """The parts of one long document overlap by all that surrounds a minimizer; owned offsets are merged."""
        margin, found = 2 * length, []
        for at in range(0, len(data), PART):
            low, high = max(0, at - margin), min(len(data), at + PART + 2 * margin)
            doc, place, least, most, value, around = minimizers(data[low:high], np.array([0]), np.array([high - low]), hasher, length, k)
            begin, end = place - most, place - least  # starts of the first and the last owned string
            inside = (begin + low < at + PART) & (end + low >= at)
            # offsets are clipped to this part's strings; surroundings reach over the margins alone
            most = np.minimum(most, place + low - at) if at else most
            least = np.maximum(least, place + low - (at + PART - 1))
            keep = inside & (least <= most)
            found.append((place[keep] + low, least[keep], most[keep], value[keep], around[keep]))
        place, least, most, value, around = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((least, place))
        place, least, most, value, around = (x[order] for x in (place, least, most, value, around))
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.intp)
        if len(new):
            least, most = np.minimum.reduceat(least, new), np.maximum.reduceat(most, new)
        return place[new], least, most, value[new], around[new]

    def make():
        hasher = Hasher(1 << 16)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = [(i, t.encode()) for i, t in enumerate(batch.column(2).to_pylist()) if t]
            texts = [(i, t) for i, t in texts if len(t) >= length]

            def out(rows_, place, least, most, value, around):
                take = pa.array(rows_)
                return pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(around.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(place.astype(np.int32)), pa.array((least * 256 + most).astype(np.int32))], schema=arrow
                )

            group: list[tuple[int, bytes]] = []
            held = 0
            for i, t in [*texts, (-1, b"")]:
                if group and (i < 0 or held + len(t) > PART):
                    sizes = np.array([len(x) for _, x in group])
                    doc, *rest = minimizers(np.frombuffer(b"".join(x for _, x in group), np.uint8), np.cumsum(sizes) - sizes, sizes, hasher, length, k)
                    yield out(np.array([j for j, _ in group])[doc], *rest)
                    group, held = [], 0
                if len(t) > PART:
                    place, *rest = long_text(np.frombuffer(t, np.uint8), hasher)
                    yield out(np.full(len(place), i), place, *rest)
                elif i >= 0:
                    group.append((i, t))
                    held += len(t)

        return each

    return map_batches(rows, make, schema)


def _surroundings(rows: DataFrame, length: int, k: int) -> DataFrame:
    """(t, wanted) to (v, s, c, n, own, before: left context backwards, after: suffix)."""
    schema = T.StructType(
        [T.StructField("v", T.LongType()), T.StructField("s", T.LongType()), T.StructField("c", T.LongType()), T.StructField("n", T.LongType()), T.StructField("own", T.IntegerType()), T.StructField("before", T.BinaryType()), T.StructField("after", T.BinaryType())]
    )
    arrow = arrow_schema(schema)
    w = length - k + 1

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out: list[list] = [[] for _ in range(7)]
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode()
                for x in wanted:
                    at = x["place"]
                    made = (x["v"], x["s"], x["c"], x["n"], x["own"], data[max(0, at - w + 1) : at][::-1], data[at : at + length])
                    for column, value in zip(out, made, strict=True):
                        column.append(value)
                if len(out[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)
                    out = [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)

        return each

    return map_batches(rows, make, schema)


def _table(strings: list[bytes], width: int) -> np.ndarray:
    """Rows of codes 1..256, 0 beyond a string's end."""
    out = np.zeros((len(strings), width), np.uint16)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    out[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
    return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows; ends of strings equal nothing."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def prefix_intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, depth) of the common-prefix intervals of depth ``least`` or more, by a stack scan of neighbours' lengths."""
    stack: list[tuple[int, int]] = []  # depth, first
    for i, depth in enumerate([*common, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            held, first = stack.pop()
            yield first, i, held
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def repeats_of(before: list[bytes], after: list[bytes], length: int, k: int) -> Iterator[tuple[int, int, int, list[int], bool]]:
    """(occurrence, depth, left extension, all occurrences of its interval, left-diverse) for sorted suffixes of one minimizer."""
    suffixes, lefts = _table(after, length), _table(before, length - k)
    common = _common(suffixes[1:], suffixes[:-1])
    for first, last, depth in prefix_intervals(common.tolist(), k):
        members = sorted(range(first, last + 1), key=before.__getitem__)
        near = _common(lefts[members[1:]], lefts[members[:-1]])
        diverse = bool(near.min() < length - k)
        best = np.maximum(np.concatenate([near, [0]]), np.concatenate([[0], near]))
        for at in np.flatnonzero(best + depth >= length).tolist():
            yield members[at], depth, int(best[at]), members, diverse


def _interval_tree(found: DataFrame, length: int, k: int) -> DataFrame:
    """Rows of equal v in one partition, sorted by suffix, to (v, s, ranges): repeated offsets (least, greatest, ...)."""
    schema = T.StructType([T.StructField("v", T.LongType()), T.StructField("s", T.LongType()), T.StructField("ranges", T.ArrayType(T.IntegerType(), False))])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]
        group: list[tuple] = []

        def close() -> None:
            if len(group) < 2:
                return
            ranges: dict[int, list[int]] = {}
            for i, depth, left, _, _ in repeats_of([x[2] for x in group], [x[3] for x in group], length, k):
                low, high = divmod(group[i][1], 256)
                low, high = max(low, length - depth), min(high, left)
                if low <= high:
                    ranges.setdefault(i, []).extend((low, high))
            for i, x in ranges.items():
                for column, value in zip(out, (group[i][4], group[i][0], x), strict=True):
                    column.append(value)

        for batch in batches:
            for v, s, own, before, after in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if group and group[-1][4] != v:
                    close()
                    group = []
                group.append((s, own, before, after, v))
            if len(out[0]) > 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)
                out = [[], [], []]
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)

    sorted_ = found.select("v", "s", "own", "before", "after").repartition("v").sortWithinPartitions("v", "after")
    return sorted_.mapInArrow(run, schema)


def _halved(found: DataFrame, length: int) -> DataFrame:
    """The same for hot minimizers: halves offset ranges until the strings of a range are all shared or all single."""
    now = found.select("v", "s", "c", "own", "before", "after", F.lit(0).alias("x"), F.lit(255).alias("y"))
    done = None
    for level in range(9):
        part = lambda a, b: f"md5(concat(cast(concat_ws(',', v, x, y) AS binary), substring(before, 1, {a}), x'00', substring(after, 1, greatest({length} - ({b}), 0))))"
        now = now.where("y >= own DIV 256 AND x <= own % 256").withColumn("core", F.expr(part("x", "y"))).withColumn("extent", F.expr(part("y", "x")))
        full = f"(octet_length(before) >= least(y, own % 256) AND octet_length(after) >= {length} - greatest(x, own DIV 256))"
        shared = now.groupBy("core").agg(F.sum("c").alias("all"), F.min("extent").alias("e0"), F.max("extent").alias("e1")).where("all > 1")
        now = written(now.join(shared, "core").withColumn("same", F.expr(f"e0 = e1 AND ({full} OR x = y)")), "halves")
        got = now.where("same").select("v", "s", F.expr("array(greatest(x, own DIV 256), least(y, own % 256))").alias("ranges"))
        done = got if done is None else done.union(got)
        now = now.where("NOT same AND x < y").select("v", "s", "c", "own", "before", "after", F.explode(F.expr("array(struct(x, x + (y - x) DIV 2 AS y), struct(x + (y - x) DIV 2 + 1 AS x, y))")).alias("half"))
        now = now.select("v", "s", "c", "own", "before", "after", "half.x", "half.y")
    return done


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = K, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(rows: k, d, t), and (k, d, spans): byte ranges covered by strings of ``length`` bytes that also start elsewhere."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(key, text).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    anchors = _anchors(rows, length, k)
    again = anchors.groupBy("v").agg(F.count("*").alias("m")).where("m > 1").drop("m")
    shared = written(anchors.join(again, "v"), "anchors")
    merged = shared.groupBy("v", "s").agg(F.count("*").alias("c"), F.min(F.struct("k", "d", "place", "own")).alias("one"))
    merged = written(merged.select("v", "s", "c", "one.*"), "merged")
    mixed = merged.groupBy("v").agg(F.count("*").alias("n"), F.min("c").alias("c0")).where("n > 1 AND c0 = 1").select("v", "n")
    wanted = merged.join(mixed, "v").groupBy("k", "d").agg(F.collect_list(F.struct("v", "s", "c", "n", "own", "place")).alias("wanted"))
    same_row = lambda a, b: a["d"].eqNullSafe(b["d"]) & a["k"].eqNullSafe(b["k"])
    found = _surroundings(rows.join(wanted, same_row(rows, wanted)).select("t", "wanted"), length, k)
    most = mixed.agg(F.max("n")).first()[0] or 0
    if most > hot:
        found = written(found, "surroundings")
        ranges = _interval_tree(found.where(f"n <= {hot}"), length, k).union(_halved(found.where(f"n > {hot}"), length))
    else:
        ranges = _interval_tree(found, length, k)
    whole = merged.where("c > 1").select("v", "s", F.expr("array(own DIV 256, own % 256)").alias("ranges"))
    ranges = whole.union(ranges)
    spans = shared.select("v", "s", "k", "d", "place").join(ranges, ["v", "s"])
    # offsets a..b of an anchor are the strings that start at place - b .. place - a
    pairs = f"transform(sequence(0, size(ranges) DIV 2 - 1), i -> struct(place - ranges[2 * i + 1] AS start, place - ranges[2 * i] + {length} AS end))"
    spans = spans.withColumn("found", F.expr(pairs)).groupBy("k", "d").agg(F.flatten(F.collect_list("found")).alias("spans"))
    return rows, spans


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("kept", "spans"), **options) -> DataFrame:
    """Per row: key and ``outputs`` of kept (binary: what stays), spans (merged, start and end), n_bytes, n_removed, n_spans, kept_sha256."""
    rows, spans = repeated_spans(docs, key, text, **options)
    joined = rows.join(spans.withColumnsRenamed({"k": "k2", "d": "d2"}), F.col("d").eqNullSafe(F.col("d2")) & F.col("k").eqNullSafe(F.col("k2")), "left").select("k", "t", "spans")
    kinds = {"kept": T.BinaryType(), "spans": T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])), "n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType()}
    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType)] + [T.StructField(o, kinds[o]) for o in outputs])
    arrow = arrow_schema(schema)

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out: dict[str, list] = {o: [] for o in outputs}
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            start, end = (lists.values.field(i).to_numpy() for i in range(2))
            for i, t in enumerate(batch.column(1).to_pylist()):
                data = t.encode()
                low, high = (np.sort(x[offsets[i] : offsets[i + 1]]) for x in (start, end))
                if len(low):
                    # sorted apart, starts and ends still tell where nothing is covered
                    cut = np.flatnonzero(low[1:] > high[:-1])
                    firsts, lasts = low[np.concatenate([[0], cut + 1])], high[np.concatenate([cut, [len(high) - 1]])]
                    merged = list(zip(firsts.tolist(), lasts.tolist(), strict=True))
                else:
                    merged = []
                kept, at = [], 0
                for a, b in merged:
                    kept.append(data[at:a])
                    at = b
                left = b"".join([*kept, data[at:]])
                made = {"kept": left, "spans": [{"start": a, "end": b} for a, b in merged] if "spans" in out else None, "n_bytes": len(data), "n_removed": len(data) - len(left), "n_spans": len(merged), "kept_sha256": hashlib.sha256(left).hexdigest()}
                for o in outputs:
                    out[o].append(made[o])
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(out[f.name], f.type) for f in list(arrow)[1:]], schema=arrow)

        return each

    return map_batches(joined, make, schema).withColumnRenamed("k", key)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return without_repeats(docs, outputs=("n_bytes", "n_removed", "n_spans", "kept_sha256"))
