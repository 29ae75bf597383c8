import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import minhash, neardup, paragraphs
from graphloom.llm import sketch as S


def _set(text, words=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def _roots(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


def _expected(rows, percent=85):
    sets = [(k, _set(t)) for k, t in rows]
    index = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            index[x].append(i)
    pairs = {(i, j) for found in index.values() for i in found for j in found if i < j}
    links = []
    for i, j in pairs:
        both = len(sets[i][1] & sets[j][1])
        if None not in (sets[i][0], sets[j][0]) and 100 * both >= percent * len(sets[i][1] | sets[j][1]) or sets[i][1] == sets[j][1]:
            links.append((i, j))
    root = _roots(links)
    least = {}
    for i, (k, _) in enumerate(sets):
        r = root.get(i, i)
        if k is not None:
            least[r] = min(least.get(r, k), k)
    out = []
    for i, (k, s) in enumerate(sets):
        c = least.get(root.get(i, i), k) if s else k
        out.append((k, len(s), c, k == c))
    return sorted(out, key=str)


def _near_copies(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, k = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 300))]
        for _ in range(rng.choice([1, 2, 3, 40])):
            words = list(base)
            for _ in range(rng.randrange(0, 7)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((k, " ".join(words)))
            k += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("which", ["odd_texts", "small_texts", "near", "none"])
def test_components_by_brute_force(which, table, request):
    rows = {"near": _near_copies(), "none": []}.get(which) if which in ("near", "none") else request.getfixturevalue(which)
    got = minhash.near_duplicates(table(rows)).collect()
    assert sorted(map(tuple, got), key=str) == _expected(rows)


def test_later_rounds_settle_what_the_hub_leaves(spark, monkeypatch):
    """One bucket of several groups, none of which the hub belongs to."""
    monkeypatch.setattr(neardup, "LEADERS", 1)
    monkeypatch.setattr(neardup, "FACTOR", 2)
    sets = {i: set(range(1000 * (i // 5), 1000 * (i // 5) + 100)) | {10**6 + i} for i in range(40)}
    items = spark.createDataFrame([(i, len(s), [7]) for i, s in sets.items()], "id long, n int, bands array<long>")
    full = spark.createDataFrame([(i, list(s)) for i, s in sets.items()], "id long, set array<long>")
    got = neardup.near_duplicate_groups(items, lambda ids: full.join(ids, "id"), 85).collect()
    assert {r.id: r.component for r in got} == {i: i - i % 5 for i in range(40)}


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)]
    got = {r.id: r.component for r in neardup.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in _roots([e for e in edges if e[0] != e[1]]).items()}


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    for n in (1, 3, 20, 160, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        assert (S.sketch(a, 160) != np.iinfo(np.uint64).max).all()
    equal = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 300).astype(np.uint64)
        equal.append((S.sketch(x[:250], 160) == S.sketch(x[50:], 160)).mean())
    assert abs(np.mean(equal) - 2 / 3) < 0.03


def test_one_of_each(table, odd_texts):
    docs = table(odd_texts)
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {k for k, _, _, stays in _expected(odd_texts) if stays and k is not None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want)


def test_passages_are_found_within_lines(table):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage, line = prose(52), prose(45)
    near = " ".join(["changed", *line.split()[1:]])
    rows = [(i, prose(60)) for i in range(30)]
    rows += [(100, prose(20) + " " + passage + " " + prose(15)), (101, prose(9) + " " + passage + "\n" + prose(8)), (102, passage)]
    rows += [(200, prose(30) + "\n" + line), (201, near + "\n" + prose(30)), (202, line + "\n" + line), (300, None), (301, ""), (None, passage)]
    docs = table(rows)
    got = {r.doc_id: r for r in paragraphs.without_repeats(docs).collect()}
    before = dict(rows)
    changed = {k for k in got if got[k].text != before[k]}
    assert changed == {101, 102, 201, 202}
    assert set(paragraphs.without_repeats(docs).columns) == {*docs.columns, "_spans"}
    for k, r in got.items():
        data = (before[k] or "").encode()
        for s in reversed(r._spans):
            data = data[: s.start] + data[s.end :]
        assert data.decode() == (r.text or "")
    assert sum(s.end - s.start for s in got[101]._spans) >= 20 * 6 and got[202].text == ""


def test_paragraphs_of_odd_texts(table, odd_texts):
    got = paragraphs.without_repeats(table(odd_texts)).collect()
    assert len(got) == len(odd_texts)
    assert paragraphs.without_repeats(table([])).collect() == []


def test_line_groups_by_brute_force(table, small_texts):
    """Exactly the lines of MIN_WORDS words and more that are linked with an earlier one go (runs aside)."""
    lines = [(k, p, line) for k, t in small_texts for p, line in enumerate((t or "").split("\n")) if len(line.split()) >= paragraphs.MIN_WORDS]
    sets = [_set(x) for *_, x in lines]
    index = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    links = {(i, j) for f in index.values() for i in f for j in f if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    root = _roots(links)
    want = {(lines[i][0], lines[i][1]) for i in root}
    got = paragraphs.repeated_paragraphs(table(small_texts)).collect()
    assert {(r.doc_id, p.part) for r in got for p in r.parts or []} == want


def test_shared_passages_are_cut_whole(table):
    """All words of a passage of over 50 words, and what any earlier place shares, go; the words around stay."""
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows, want = [], {}
    for n in (51, 60, 100, 300, 51, 51, 60, 100):
        passage, before, after = prose(n), prose(25), prose(30)
        rows += [(len(rows), prose(40) + " " + passage + " " + prose(12)), (len(rows) + 1, before + " " + passage + " " + after)]
        want[rows[-1][0]] = before.split() + after.split()
    inner, outer, lead, end = prose(60), prose(20), prose(15), prose(15)
    rows += [(100, prose(20) + " " + inner + " " + prose(20)), (101, lead + " " + outer + " " + inner), (102, end + " " + outer + " " + inner)]
    want |= {101: lead.split() + outer.split(), 102: end.split()}
    twice, middle = prose(80), prose(9)
    rows += [(103, twice + " " + middle + " " + twice)]
    want[103] = twice.split() + middle.split()
    got = {r.doc_id: r.text.split() for r in paragraphs.without_repeats(table(rows)).collect()}
    assert got == {k: want.get(k, t.split()) for k, t in rows}
    assert sum(len(got[k]) for k in want if k < 100) == 8 * 55


def test_short_lines_and_wrapped_blocks(table):
    """Lines of 20 words, equal or near, and near blocks of short lines, go; what stays for others' sake stays."""
    rng = random.Random(6)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    prose = lambda n: " ".join(words(n))
    wrapped = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    short, near, block, long = prose(20), words(39), words(120), words(120)
    rows = [(1, prose(60) + "\n" + short + "\n" + prose(30)), (2, prose(30) + "\n" + short), (3, prose(50) + "\n" + " ".join(near)), (4, " ".join(["new", *near[1:]]) + "\n" + prose(45))]
    changed = [w if i % 45 else "new" for i, w in enumerate(block)]
    rows += [(5, prose(30) + "\n\n" + wrapped(block, 12) + "\n\n" + prose(25)), (6, prose(25) + "\n\n" + wrapped(changed, 11) + "\n \n" + prose(30))]
    fresh = prose(22)
    rows += [(7, " ".join(long) + "\n" + prose(9)), (8, " ".join(long) + "\n" + fresh), (9, prose(80) + "\n" + fresh)]
    got = {r.doc_id: r.text for r in paragraphs.without_repeats(table(rows)).collect()}
    before = dict(rows)
    assert {k for k in got if got[k] != before[k]} == {2, 4, 6, 8, 9}
    assert got[2].strip() == before[2].split("\n")[0] and got[4] == before[4].split("\n")[1]
    assert got[6].split() == (before[6].split("\n")[0] + " " + before[6].split("\n")[-1]).split()
    assert got[8] == fresh and got[9].strip() == before[9].split("\n")[0]


def test_lines_of_twenty_words_are_compared(table, small_texts):
    """Every line of 20 words and more that recurs exactly is linked, whatever the module's constants are."""
    at = defaultdict(set)
    for k, t in small_texts:
        for p, line in enumerate((t or "").split("\n")):
            if len(line.split()) >= 20:
                at[line].add((k, p))
    got = paragraphs.repeated_paragraphs(table(small_texts)).collect()
    assert {x for f in at.values() if len(f) > 1 for x in f} <= {(r.doc_id, p.part) for r in got for p in r.parts or []}


def test_rows_of_one_key_with_different_texts(table):
    """What repeats in one text of a key is cut there alone."""
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    line, a, b = prose(40), prose(30), prose(35)
    rows = [(1, prose(50) + "\n" + line), (2, a + "\n" + line), (2, b + "\n" + prose(33)), (2, b + "\n" + prose(9))]
    got = sorted(r.text.strip() for r in paragraphs.without_repeats(table(rows)).collect() if r.doc_id == 2)
    assert a in got and sum(b in t for t in got) == 1 and len(got) == 3
    assert any(t.endswith(rows[2][1].split("\n")[1]) for t in got) and any(t.endswith(rows[3][1].split("\n")[1]) for t in got)


def test_wide_rows_are_not_broadcast(spark, monkeypatch):
    """Few ids with long arrays beside them (here 224 MB) would fill the driver; their ids alone are sent."""
    ids = spark.range(2000).selectExpr("id AS k", "transform(sequence(1, 2000), x -> struct(x AS place, x AS h, true AS l, true AS r, x AS s)) AS wanted")
    table = spark.range(5000).withColumnRenamed("id", "k")
    got = neardup.with_ids(table, ids, "k")
    assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 2000
    all_ = neardup.beside(table, ids, "k")
    assert "LeftSemi" in all_._jdf.queryExecution().optimizedPlan().toString()
    assert all_.columns == ["k", "wanted"] and all_.count() == 5000 and all_.where("size(wanted) = 2000").count() == 2000
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 10)
    assert neardup.with_ids(table, ids, "k").count() == 2000 and neardup.beside(table, ids, "k").count() == 5000


@pytest.mark.parametrize("few", [0, 500_000])
def test_paragraphs_without_broadcasts(table, small_texts, monkeypatch, few):
    """Tables too large to be sent to all executors give the same results, by joins with or without their ids."""
    rows = small_texts[:120]
    cut = lambda: sorted((str(r.doc_id), r.text or "", str(r._spans)) for r in paragraphs.without_repeats(table(rows)).collect())
    want = cut()
    monkeypatch.setattr(neardup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", few)
    assert cut() == want


def test_items_without_a_link_are_settled_by_their_least_elements(spark):
    """What shares its larger elements alone is settled before elements are counted; no linked item is."""
    rng = random.Random(4)
    common = list(range(10**6, 10**6 + 60))
    sets = {i: rng.sample(range(10**6), 40) + common for i in range(30)}
    for i in range(30, 60):
        base = sets[i] = rng.sample(range(2 * 10**6), rng.randrange(5, 90))
        sets[i + 100] = [*base[: len(base) - len(base) // 9], 3 * 10**6 + i]
    alike = {i for i in sets for j in sets if i != j and 100 * len({*sets[i]} & {*sets[j]}) >= 80 * len({*sets[i]} | {*sets[j]})}
    full = spark.createDataFrame([(i, x, len(x)) for i, x in sets.items()], "id long, set array<long>, n int")
    none = spark.createDataFrame([], "id long, component long")
    got = {r.id for r in neardup._open(full, none, 80).collect()}
    assert alike and alike <= got and not got & set(range(30))
    one = spark.createDataFrame([(i, 30) for i in sets], "id long, component long")
    assert neardup._open(full, one, 80).isEmpty()


def test_words_of_a_column_by_brute_force(odd_texts):
    """Words, lines and hashes of all texts at once are those of each text, also where texts meet without a space."""
    texts = [t for _, t in odd_texts] + ["end", "Start\n", "\n\nx", "a" * 8, "A" * 9, "b" * 64, "B" * 65, "b" * 64 + "c", "a\x00", "a", ""]
    words = S.words_in(pa.array(texts, pa.string()).slice(0))
    hashes = S.hashes_of(words)
    data, got, by_hash = words.data.tobytes(), [], {}
    for i, t in enumerate(texts):
        lines = [line.split() for line in (t or "").encode().split(b"\n")]
        own = range(words.text_words[i], words.text_words[i + 1])
        assert [data[words.start[j] : words.end[j]] for j in own] == [w for line in lines for w in line]
        assert words.sizes(i) == [len(line) for line in lines]
        at = words.lines[words.text_lines[i] : words.text_lines[i + 1] + 1]
        assert b"".join(data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)) == (t or "").encode() and at[-1] == words.texts[i + 1]
        got += own
        for j in own:
            word = data[words.start[j] : words.end[j]].lower()
            assert by_hash.setdefault(hashes[j], word) == word
    assert len(got) == len(hashes) and len(by_hash) == len(set(by_hash.values()))
    part = S.words_in(pa.array(texts, pa.string()).slice(3, 12))
    first, end = words.text_words[3], words.text_words[15]
    assert (S.hashes_of(part) == hashes[first:end]).all() and not len(S.words_in(pa.array([], pa.string())).start)


def test_no_word_is_hashed_alone(spark, small_texts, monkeypatch):
    """op8 reads all words in several steps: word by word they took most of its Python CPU seconds."""
    monkeypatch.setattr(paragraphs, "map_batches", lambda rows, make, schema: make())
    monkeypatch.delattr(S, "word_hashes")
    rows = spark.createDataFrame([], "k long, t string")
    keys, texts = (pa.array(x) for x in zip(*small_texts, strict=True))
    none = pa.nulls(len(keys), pa.list_(pa.struct([("part", pa.int32()), ("stays", pa.bool_())])))
    batch = pa.RecordBatch.from_arrays([keys, texts, none, none], ["k", "t", "parts", "blocks"])
    for each in (paragraphs._lines(rows, 16, 3, 20), paragraphs._runs(rows, 20, 31)):
        assert sum(out.num_rows for out in each(batch)) > len(keys)


def test_cuts_of_a_batch():
    """Merged byte ranges of each text alone: neighbouring texts' ranges stay apart, null texts stay null."""
    texts = ["a b c d\ne f", None, "", "x y", "z", "p  q r"]
    column = pa.array(texts, pa.string())
    linked = pa.list_(pa.struct([("part", pa.int32()), ("stays", pa.bool_())]))
    parts = pa.array([[{"part": 1, "stays": False}], None, None, None, None, None], linked)
    blocks = pa.array([None, None, None, [{"part": 0, "stays": False}], None, None], linked)
    runs = pa.array([[{"lo": 2, "hi": 4}, {"lo": 0, "hi": 1}, {"lo": 3, "hi": 9}], None, None, None, [{"lo": 0, "hi": 1}], [{"lo": 1, "hi": 2}, {"lo": 0, "hi": 1}]], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))
    words = S.words_in(column)
    text, start, end = paragraphs._cuts(words, parts, blocks, runs)
    got = [(int(i), int(a - words.texts[i]), int(b - words.texts[i])) for i, a, b in zip(text, start, end, strict=True)]
    assert got == [(0, 0, 1), (0, 4, 11), (3, 0, 3), (4, 0, 1), (5, 0, 1), (5, 3, 4)]
    assert paragraphs._without(column, words, start, end).to_pylist() == [" b ", None, "", "", "", "   r"]
