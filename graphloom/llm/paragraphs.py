"""Substring dedup by paragraph MinHash banding, with exact verification and clustered removal.

Three kinds of paragraph are compared. Lines, and blocks (lines joined up to a blank one, so that hard-wrapped text is
seen), of ``MIN_WORDS`` words or more are sketched and banded, each kind for itself (16 bands of 3 coordinates: a pair
at the threshold 0.8 is missed with a probability of 1e-5), colliding ones are verified by the exact Jaccard
similarity of their five-word shingles, and linked ones form components. A line that stays for others' sake stays
though its block is cut. So that a passage is
found wherever it stands within lines, runs of ``SPAN`` words at content-chosen places (the least hash of ``CHOICE``
neighbouring runs) of what then stays are paragraphs too; any passage of ``SPAN + CHOICE - 1`` = 50 words that two places share has
at least one chosen run in common, with equal shingle sets. Runs are seeds: each is extended to both sides, over
the words between runs and up to ``CHOICE`` words beyond the outermost, as far as an earlier place agrees, so a
shared passage is cut whole. Of each component the paragraph with the smallest key, there the first one, stays;
the others are cut out.

Input contract: null and empty texts have no paragraphs; texts of any length are read whole; ties go to the
smallest key and place; rows that repeat a key and text are one document and come out alike, while rows of one key with
different texts are different documents; rows without a key
are passed through unchanged; an empty table gives an empty table; further columns are ignored by
``repeated_paragraphs`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import sketch as S
from graphloom.llm.common import arrow_schema, drop_written, free_shuffles, map_batches, short_batches, written
from graphloom.llm.neardup import beside, colliding, groups_of, repeated, with_ids

PERCENT, BANDS, ROWS = 80, 16, 3
MIN_WORDS, SPAN, CHOICE = 20, 20, 31


def block_ends(sizes: list[int]) -> dict[int, int]:
    """The first line of each block, and the line after its last one; ``sizes`` are the lines' numbers of words."""
    out, start = {}, None
    for i, size in enumerate([*sizes, 0]):
        if size and start is None:
            start = i
        elif not size and start is not None:
            out[start], start = i, None
    return out


def cut_lines(sizes: list[int], parts: list[dict] | None, blocks: list[dict] | None) -> set[int]:
    """Lines that go: linked ones and those of linked blocks, but for lines that stay for others' sake."""
    out, ends = set(), block_ends(sizes) if blocks else {}
    for one in blocks or []:
        if not one["stays"]:
            out.update(range(one["part"], ends.get(one["part"], one["part"])))
    out.difference_update(one["part"] for one in parts or [] if one["stays"])
    out.update(one["part"] for one in parts or [] if not one["stays"] and one["part"] < len(sizes))
    return out


def staying(sizes: list[int], gone: set[int]) -> list[tuple[int, int]]:
    """Ranges of words between the lines that go."""
    out, start, at = [], 0, 0
    for i, size in enumerate(sizes):
        if i in gone:
            out.append((start, at))
            start = at + size
        at += size
    return [x for x in [*out, (start, at)] if x[0] < x[1]]


def _gone(words: S.Words, parts: pa.Array, blocks: pa.Array) -> dict[int, set[int]]:
    """The lines that go, of each text that has linked lines or blocks."""
    both = enumerate(zip(parts.to_pylist(), blocks.to_pylist(), strict=True))
    return {i: cut_lines(words.sizes(i), p, b) for i, (p, b) in both if p or b}


def _ranges(words: S.Words, parts: pa.Array, blocks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the ranges of words, of all texts' words, that stay."""
    gone = _gone(words, parts, blocks)
    out = []
    for i, (first, end) in enumerate(itertools.pairwise(words.text_words.tolist())):
        if i in gone:
            out += [(first + a, first + b) for a, b in staying(words.sizes(i), gone[i])]
        elif first < end:
            out.append((first, end))
    both = np.array(out, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def chosen_runs(runs: np.ndarray, start: np.ndarray, end: np.ndarray, choice: int = CHOICE) -> np.ndarray:
    """Places of the runs of words that are the least (leftmost) of ``choice`` neighbours within one of the ranges of runs,
    which are in order and apart."""
    count = np.maximum(end - start - choice + 1, 0)
    start, count = start[count > 0], count[count > 0]
    if not len(start):
        return np.zeros(0, np.int64)
    key = (runs & ~_PLACES) | np.arange(len(runs), dtype=np.uint64)
    whole = np.concatenate([key, np.full(-len(key) % choice, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, choice)
    upto = np.minimum.accumulate(whole, axis=1).ravel()
    since = np.minimum.accumulate(whole[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(runs) - choice + 1
    inside = np.zeros(n + 1, np.int8)
    inside[start] += 1
    inside[start + count] -= 1
    at = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    places = (np.minimum(since[at], upto[at + choice - 1]) & _PLACES).astype(np.int64)
    # neighbours' least runs follow each other in the order of places
    return places[np.diff(places, prepend=-1) > 0]


#: Low bits of a run's hash that give way to its place while the least of neighbours is sought.
_PLACES = np.uint64((1 << 28) - 1)


def _lines(rows: DataFrame, n_bands: int, n_rows: int, min_words: int) -> DataFrame:
    """(k, t) to (k, block, part, n, hi, lo, bands) for each line and block with enough words.

    Equal ones of a task have their bands once.
    """
    schema = T.StructType(
        [T.StructField("k", rows.schema["k"].dataType), T.StructField("block", T.BooleanType()), T.StructField("part", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType(), False))]
    )
    arrow = arrow_schema(schema)

    def make():
        seen: set = set()

        def each(batch: pa.RecordBatch):
            words = S.words_in(batch.column(1))
            lines = np.flatnonzero(np.diff(words.line_words) >= min_words)
            first, after = S.stretches(np.diff(words.line_words) > 0, words.text_lines)
            wide = words.line_words[after] - words.line_words[first] >= min_words
            part, end = np.concatenate([lines, first[wide]]), np.concatenate([lines + 1, after[wide]])
            if not len(part):
                return
            block = np.arange(len(part)) >= len(lines)
            row = np.searchsorted(words.text_lines, part, "right") - 1
            start = words.line_words[part]
            elements, at = S.shingle_sets(S.hashes_of(words), start, words.line_words[end] - start)
            part = part - words.text_lines[row]
            names, fresh = [], []
            for i in range(len(part)):
                name = S.identity(elements[at[i] : at[i + 1]])
                names.append(name)
                if (block[i], name) not in seen:
                    if len(seen) > 20_000:
                        seen.clear()
                    seen.add((block[i], name))
                    fresh.append(i)
            known = np.ones(len(part), bool)
            known[fresh] = False
            made = np.zeros((0, n_bands), np.int64)
            if fresh:
                sizes = np.diff(at)[fresh]
                kept = np.concatenate([elements[at[i] : at[i + 1]] for i in fresh])
                made = S.bands(S.sketches(kept, np.concatenate([[0], np.cumsum(sizes)]), n_bands * n_rows), n_rows) ^ block[fresh].astype(np.int64)[:, None]
            ends = np.concatenate([[0], np.cumsum(np.where(known, 0, n_bands))])
            banded = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(made.ravel()), mask=pa.array(known)).cast(arrow.field(6).type)
            columns = [block, part.astype("int32"), np.diff(at).astype("int32"), [x[0] for x in names], [x[1] for x in names], banded]
            keys = batch.column(0).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([keys] + [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, list(arrow)[1:], strict=True)], schema=arrow)

        return each

    return map_batches(rows, make, schema)


_BLOCK = np.uint64(0xC2B2AE3D27D4EB4F)


def _line_sets(rows: DataFrame) -> DataFrame:
    """(t, wanted: array of (id, block, part, hi, lo)) to (id, set)."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("set", T.ArrayType(T.LongType(), False))])
    arrow = arrow_schema(schema)

    def make():
        def each(batch: pa.RecordBatch):
            ids, sets = [], []
            words = S.words_in(batch.column(0))
            hashes = S.hashes_of(words)
            for i, wanted in enumerate(batch.column(1).to_pylist()):
                sizes, line = words.sizes(i), words.text_lines[i]
                ends = block_ends(sizes)
                for one in wanted:
                    part = one["part"]
                    end = ends.get(part, part) if one["block"] else min(part + 1, len(sizes))
                    found = S.shingle_set(hashes[words.line_words[line + min(part, end)] : words.line_words[line + end]])
                    if S.identity(found) == (one["hi"], one["lo"]):
                        ids.append(one["id"])
                        # a block has its own lines' shingles, and is not to be compared with them
                        sets.append((found ^ _BLOCK if one["block"] else found).view("int64"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, arrow.field(1).type)], schema=arrow)

        return each

    return map_batches(rows, make, schema)


def _prefixes(hashes: np.ndarray) -> np.ndarray:
    """Sums from which :func:`_fragments` gets the hash of any stretch of words."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(len(hashes))[0][: len(hashes)])])


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64; ``n`` of them at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0x9E3779B97F4A7C15
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n + 4096, x, np.uint64)])) for x in (base, pow(base, -1, 2**64))]
    return _POWERS


def _fragments(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words from ``start`` up to ``end``, wherever they stand."""
    return S.mix((sums[end] - sums[start]) * _powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def _runs(rows: DataFrame, span: int, choice: int) -> DataFrame:
    """(k, t, parts, blocks) to (k, place, h, s, r, a, b): the content-chosen runs of each range of words that stays.

    ``s`` names the words from ``a``, where the run before starts (or the range), to the run's end, ``r`` those from
    the run's start to ``b``, where the run after ends (or the range).
    """
    kinds = [("place", T.IntegerType()), ("h", T.LongType()), ("s", T.LongType()), ("r", T.LongType()), ("a", T.IntegerType()), ("b", T.IntegerType())]
    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), *[T.StructField(*x) for x in kinds]])
    arrow = arrow_schema(schema)

    def make():
        def each(batch: pa.RecordBatch):
            words = S.words_in(batch.column(1))
            start, end = _ranges(words, batch.column(2), batch.column(3))
            sums = _prefixes(S.hashes_of(words))
            places = np.arange(max(len(words.start) - span + 1, 0))
            every = _fragments(sums, places, places + span)
            at = chosen_runs(every, start, end - span + 1, choice)
            if len(at):
                row = np.searchsorted(words.text_words, at, "right") - 1
                of = np.searchsorted(start, at, "right") - 1
                a, b, same = start[of], end[of], of[1:] == of[:-1]
                a[1:] = np.where(same, at[:-1], a[1:])
                b[:-1] = np.where(same, at[1:] + span, b[:-1])
                first = words.text_words[row]
                columns = (at - first, every[at], _fragments(sums, a, at + span), _fragments(sums, at, b), a - first, b - first)
                keys = batch.column(0).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([keys] + [pa.array(x.view(np.int64), f.type) for x, f in zip(columns, list(arrow)[1:], strict=True)], schema=arrow)

        return each

    return map_batches(rows, make, schema)


#: Runs whose contexts are made at once.
_AT_ONCE = 1 << 13


def _contexts(rows: DataFrame, span: int, reach: int) -> DataFrame:
    """(k, t, parts, blocks, wanted: array of (place, h, l, r)) to (k, place, h, side, next, c): hashes ``c`` of the 1, 2, ... ``reach`` words
    before (side 0) or after (side 1) the run, within what stays; ``next`` is the first of them."""
    kinds = [("place", T.IntegerType()), ("h", T.LongType()), ("side", T.IntegerType()), ("next", T.LongType()), ("c", T.ArrayType(T.LongType(), False))]
    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), *[T.StructField(*x) for x in kinds]])
    arrow = arrow_schema(schema)

    def make():
        def each(batch: pa.RecordBatch):
            words = S.words_in(batch.column(1))
            starts, ends = _ranges(words, batch.column(2), batch.column(3))
            sums = _prefixes(S.hashes_of(words))
            asked, rows = batch.column(4).flatten(), pc.list_parent_indices(batch.column(4)).to_numpy()
            fields = [asked.field(j).to_numpy(zero_copy_only=False) for j in range(4)]
            for part in range(0, len(rows) if len(starts) else 0, _AT_ONCE):
                row, (place, h, left, right) = rows[part : part + _AT_ONCE], [x[part : part + _AT_ONCE] for x in fields]
                p = words.text_words[row] + place
                at = np.searchsorted(starts, p, side="right") - 1
                low, high = starts[at], ends[at]
                fits = (at >= 0) & (p + span <= high) & (words.text_words[row] <= low) & (high <= words.text_words[row + 1])
                fits[fits] = _fragments(sums, p[fits], p[fits] + span).view(np.int64) == h[fits]
                row, place, h, p, low, high = (x[fits] for x in (row, place, h, p, low, high))
                for side, want in enumerate((left[fits], right[fits])):
                    edge = p + span if side else p
                    n = np.where(want.astype(bool), np.minimum(reach, high - edge if side else edge - low), 0)
                    some = n > 0
                    if some.any():
                        n = n[some]
                        first = np.cumsum(n) - n
                        edges = np.repeat(edge[some], n)
                        steps = np.arange(len(edges)) - np.repeat(first, n) + 1
                        c = (_fragments(sums, edges, edges + steps) if side else _fragments(sums, edges - steps, edges)).view(np.int64)
                        listed = pa.ListArray.from_arrays(pa.array(np.append(first, len(c)), pa.int32()), pa.array(c)).cast(arrow.field(5).type)
                        columns = (place[some], h[some], np.full(len(n), side), c[first])
                        made = [pa.array(x, f.type) for x, f in zip(columns, list(arrow)[1:5], strict=True)]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[some])), *made, listed], schema=arrow)

        return each

    return map_batches(rows, make, schema)


def _extents(contexts: DataFrame, span: int) -> DataFrame:
    """(k, place, side, n): by how many words a run and an earlier place of it agree further; in one text the two
    places don't overlap. Contexts come together by run, side and first word, in the order of places."""
    schema = T.StructType([contexts.schema["k"], *[T.StructField(x, T.IntegerType()) for x in ("place", "side", "n")]])
    arrow = arrow_schema(schema)

    def make():
        group, seen = None, {}

        def each(batch: pa.RecordBatch):
            nonlocal group
            out: list[list] = [[] for _ in arrow]
            offsets, values = batch.column(5).offsets.to_pylist(), batch.column(5).values.to_numpy().tolist()
            for i, (k, place, *own) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(5)), strict=True)):
                c = values[offsets[i] : offsets[i + 1]]
                if group != own:
                    group = own
                    seen.clear()
                # what some place has before, all its shorter stretches have too
                met, none = 0, len(c)
                while met < none:
                    n = (met + none + 1) // 2
                    met, none = (n, none) if c[n - 1] in seen else (met, n - 1)
                low, high = 0, met
                while low < high:
                    n = (low + high + 1) // 2
                    k0, p0 = seen[c[n - 1]]
                    if k0 != k or (p0 + span + n <= place if own[1] else p0 + span <= place - n):
                        low = n
                    else:
                        high = n - 1
                here = (k, place)
                seen.update(dict.fromkeys(c[met:], here))
                if low:
                    for column, value in zip(out, (k, place, own[1], low), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)

        return each

    by = ("h", "side", "next")
    return map_batches(contexts.repartition(*by).sortWithinPartitions(*by, "k", "place"), make, schema)


def _passages(rows: DataFrame, parts: DataFrame, span: int, choice: int) -> DataFrame:
    """(k, runs: array of (lo, hi)): the words that a chosen run of an earlier place and what agrees around it repeat."""
    marked = beside(rows, parts, "k").select("k", "t", "parts", "blocks")
    runs, me = written(_runs(marked, span, choice), "runs"), F.struct("k", "place")
    met = written(repeated(runs, "h"), "met")
    drop_written(runs)
    first = met.groupBy("h").agg(F.min(me).alias("first"))
    again = written(met.join(first, "h").withColumn("later", F.col("first") < me).drop("first"), "again")
    drop_written(met)
    free_shuffles(rows.sparkSession)
    at = {x: again.groupBy(x).agg(F.count("*").alias("c"), F.min(me).alias(f"{x}_at")).where("c > 1").drop("c") for x in ("s", "r")}
    marked = again.where("later").join(at["s"], "s", "left").join(at["r"], "r", "left")
    left = (F.col("s_at") < me) & F.expr(f"s_at.k <> k OR s_at.place + {span} <= a")
    right = (F.col("r_at") < me) & F.expr("r_at.k <> k OR r_at.place + b - place <= place")
    marked = written(marked.select("k", "place", "h", "a", "b", F.coalesce(left, F.lit(False)).alias("l"), F.coalesce(right, F.lit(False)).alias("r")), "marked")
    edges = marked.where("NOT (l AND r)").groupBy("h").agg(F.max(~F.col("l")).alias("l"), F.max(~F.col("r")).alias("r"))
    wanted = again.select("k", "place", "h").join(edges, "h").groupBy("k").agg(F.collect_set(F.struct("place", "h", "l", "r")).alias("wanted"))
    wanted = written(wanted.join(parts, "k", "left"), "wanted")
    further = _extents(_contexts(with_ids(rows, wanted, "k").select("k", "t", "parts", "blocks", "wanted"), span, choice), span)
    cut = marked.selectExpr("k", "IF(l, a, place) AS lo", f"IF(r, b, place + {span}) AS hi")
    more = further.selectExpr("k", f"IF(side = 0, place - n, place + {span}) AS lo", f"IF(side = 0, place, place + {span} + n) AS hi")
    return cut.union(more).groupBy("k").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))


def _cuts(words: S.Words, parts: pa.Array, blocks: pa.Array, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end): byte ranges, of all texts' bytes, to remove, merged: lines and blocks of which another stays,
    and words that an earlier place has."""
    lines = np.array([words.text_lines[i] + line for i, gone in _gone(words, parts, blocks).items() for line in gone], np.int64)
    row, flat = pc.list_parent_indices(runs).to_numpy(), runs.flatten()
    lo, hi = (words.text_words[row] + flat.field(j).to_numpy() for j in range(2))
    fits = hi <= words.text_words[row + 1]
    start = np.concatenate([words.lines[lines], words.start[lo[fits]]])
    end = np.concatenate([words.lines[lines + 1], words.end[hi[fits] - 1]])
    order = np.argsort(start)
    start, far = start[order], np.maximum.accumulate(end[order])
    text = np.searchsorted(words.texts, start, "right") - 1
    # what is parted by one white-space character is one range
    met, then = far[:-1], start[1:]
    new = np.ones(len(start), bool)
    new[1:] = (text[1:] != text[:-1]) | (then > met + 1) | (then == met + 1) & ~S.SPACE[words.data[np.minimum(met, len(words.data) - 1)]]
    first = np.flatnonzero(new)
    return text[first], start[first], far[np.append(first[1:], len(start)) - 1] if len(first) else far


def _without(column: pa.Array, words: S.Words, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts without the byte ranges."""
    marks = np.zeros(len(words.data) + 1, np.int8)
    marks[start] += 1
    marks[end] -= 1
    stays = np.cumsum(marks[:-1], dtype=np.int8) == 0
    gone = np.concatenate([[0], np.cumsum(end - start)])
    offsets = words.texts - gone[np.searchsorted(start, words.texts)]
    kept = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets), pa.py_buffer(words.data[stays]))
    return pc.if_else(column.is_valid(), kept.cast(pa.string()), None) if column.null_count else kept.cast(pa.string())


def repeated_paragraphs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, n_bands: int = BANDS, n_rows: int = ROWS, min_words: int = MIN_WORDS, span: int = SPAN, choice: int = CHOICE
) -> DataFrame:
    """(key, _text, parts, blocks, runs): for each document with linked paragraphs its lines and blocks (part: the first
    line, stays: it is the first of its component), and runs (lo, hi), the words that an earlier place has. ``_text`` is
    the text's hash where some key has several texts, else null."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    hashed = F.xxhash64("t")
    clash = not rows.groupBy("k").agg(F.min(hashed).alias("a"), F.max(hashed).alias("b")).where("a <> b").isEmpty()
    if clash:  # documents are told apart by their texts too, which costs room in every table below
        rows = rows.withColumn("k", F.struct("k", hashed.alias("d")))

    banded = written(_lines(rows, n_bands, n_rows, min_words), "banded")
    ordered, name = F.struct("k", "part"), ["block", "hi", "lo"]
    found = banded.groupBy(*name).agg(F.min(ordered).alias("at"), F.max(ordered).alias("to"), F.first("bands", ignorenulls=True).alias("bands"))
    found = written(found.select(F.monotonically_increasing_id().alias("id"), *name, "at", (F.col("at") != F.col("to")).alias("again"), "bands"), "found")
    # bands are long, and read once
    lines = written(banded.select("k", "part", *name), "lines")
    drop_written(banded)
    met = colliding(found)
    items = written(found.drop("bands"), "items")
    drop_written(found)
    free_shuffles(docs.sparkSession)

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = items.join(ids, "id").groupBy(F.col("at.k").alias("k")).agg(F.collect_list(F.struct("id", "block", F.col("at.part").alias("part"), "hi", "lo")).alias("wanted"))
        return _line_sets(with_ids(rows, wanted, "k").select("t", "wanted"))

    groups = groups_of(met, sets_of, percent)
    named = items.select("id", *name, "at", "again").join(groups, "id", "left")
    named = named.where("again OR component IS NOT NULL").withColumn("component", F.coalesce("component", "id"))
    first = named.groupBy("component").agg(F.min("at").alias("first"))
    named = named.join(first, "component").select(*name, "first")
    linked = lines.join(named, name).select("k", "block", F.struct("part", (F.col("first") == ordered).alias("stays")).alias("one"))
    of = lambda block: F.collect_set(F.when(block, F.col("one")))
    parts = written(linked.groupBy("k").agg(of(~F.col("block")).alias("parts"), of(F.col("block")).alias("blocks")), "parts")
    drop_written(lines, items)
    free_shuffles(docs.sparkSession)
    found = parts.join(_passages(rows, parts, span, choice), "k", "full")
    name = [F.col("k.k").alias(key), F.col("k.d").alias("_text")] if clash else [F.col("k").alias(key), F.lit(None).cast("long").alias("_text")]
    return found.select(*name, "parts", "blocks", "runs")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All rows and columns, with repeated paragraphs cut out of the text; adds ``_spans`` (bytes removed: start, end)."""
    found = repeated_paragraphs(docs, key, text, **options).withColumnRenamed(key, "_k")
    own = (F.col("row")[key] == F.col("_k")) & F.coalesce(F.xxhash64(F.col("row")[text]) == F.col("_text"), F.lit(True))
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(found, own, "left")
    # the text goes to Python and back once, the other columns beside it
    others = F.struct(*[F.col("row")[c].alias(c) for c in docs.columns if c != text])
    listed = joined.select(others.alias("row"), F.col("row")[text].alias("_t"), "parts", "blocks", "runs")
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([listed.schema["row"], T.StructField("_t", T.StringType()), T.StructField("_spans", spans)])
    arrow = arrow_schema(schema)

    def make():
        def each(batch: pa.RecordBatch):
            column = batch.column(1)
            words = S.words_in(column)
            text, start, end = _cuts(words, *batch.columns[2:5])
            ends = pa.array(np.searchsorted(text, np.arange(len(column) + 1)), pa.int32())
            cut = pa.StructArray.from_arrays([pa.array(x - words.texts[text]) for x in (start, end)], ["start", "end"])
            cut = pa.ListArray.from_arrays(ends, cut).cast(arrow.field(2).type)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), _without(column, words, start, end).cast(arrow.field(1).type), cut], schema=arrow)

        return each

    made = map_batches(listed, make, schema)
    return made.select(*[F.col("_t").alias(text) if c == text else F.col("row")[c].alias(c) for c in docs.columns], "_spans")


def query(spark, sf_dir: str) -> DataFrame:
    """Per document: bytes, bytes removed, spans removed, and the digest of the text that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = without_repeats(docs)
    removed = F.expr("cast(aggregate(_spans, 0L, (s, x) -> s + x.end - x.start) AS bigint)")
    kept = F.coalesce("text", F.lit(""))
    return cut.select(
        "doc_id",
        (F.octet_length(kept) + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("_spans").cast("long").alias("n_spans"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )
