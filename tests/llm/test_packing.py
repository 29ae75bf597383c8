import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from graphloom.llm import binary, packing
from graphloom.llm.common import tokenizer_path
from graphloom.llm.wordbpe import VOCABULARY


def _ids(rows):
    tool = Tokenizer.from_file(tokenizer_path(VOCABULARY))
    return [(k, np.array(tool.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for k, t in rows]


@pytest.mark.parametrize("which", ["odd_texts", "small_texts", "none"])
def test_every_id_lies_in_one_piece(which, table, request):
    rows = [] if which == "none" else request.getfixturevalue(which)
    pieces = packing.pack(table(rows)).collect()
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append(p)
    want = defaultdict(list)
    for k, ids in _ids(rows):
        want[k, len(ids)].append(ids)
    assert set(by_doc) == set(want)
    for at, docs in want.items():
        found = sorted((p.start, p.length) for p in by_doc[at])
        assert sum(n for _, n in found) == sum(len(d) for d in docs)
        if len(docs) == 1:
            end = 0
            for p in sorted(by_doc[at], key=lambda p: p.start):
                assert p.start == end and p.ids_crc32 == zlib.crc32(docs[0][p.start : p.start + p.length].tobytes())
                end += p.length
            assert end == len(docs[0])
    fill = defaultdict(list)
    for p in pieces:
        fill[p.sequence_id].append((p.offset, p.length))
    assert sorted(fill) == list(range(len(fill)))
    padding = 0
    for parts in fill.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
        padding += 0 if end & (end - 1) == 0 else 4096 - end
    assert padding == 0


def test_nnls_finds_the_least_squares():
    rng = np.random.default_rng(3)
    a, x = rng.random((12, 30)), np.maximum(rng.normal(size=30), 0)
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.linalg.norm(a @ got - a @ x) < 1e-6


def test_combinations_fill_windows():
    ways = packing.combinations(64)
    assert all(sum(q * n for q, n in w.items()) == 64 for w in ways) and len(ways) == len({tuple(sorted(w.items())) for w in ways})


def test_plan_stays_within_supply():
    supply = {q: 1000 // q for q in range(1, 64)}
    used = defaultdict(int)
    for way, times in packing.plan(supply, 64):
        for q, n in way.items():
            used[q] += n * times
    assert all(used[q] <= supply[q] for q in used)
    assert sum(q * n for q, n in used.items()) > 0.9 * sum(q * n for q, n in supply.items())


@pytest.mark.parametrize("which", ["odd_texts", "small_texts", "none"])
def test_matrices_hold_every_document(which, table, tmp_path, request):
    rows = [] if which == "none" else request.getfixturevalue(which)
    made = binary.write_matrices(table(rows), str(tmp_path / "m")).collect()
    parts = []
    for r in made:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == binary.WIDTH and not ids[r.cu_seqlens[-1] :].any()
        for k, start, a, b in zip(r["keys"], r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            parts.append((k, start, ids[a:b].tolist()))
            assert positions[a:b].tolist() == list(range(b - a))
    want = [(k, s, ids[s : s + 4096].tolist()) for k, ids in _ids(rows) for s in range(0, len(ids), 4096)]
    assert sorted(parts, key=str) == sorted(want, key=str)


def test_best_fit_decreasing_against_a_scan():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 101, 400).tolist()
    rows, free = [], []
    for i in sorted(range(400), key=lambda i: (-lengths[i], i)):
        fits = [(f, r) for r, f in enumerate(free) if f >= lengths[i]]
        if fits:
            least = min(f for f, _ in fits)
            r = next(r for f, r in fits if f == least)
        else:
            r = len(rows)
            rows.append([])
            free.append(100)
        rows[r].append(i)
        free[r] -= lengths[i]
    got = binary.best_fit_decreasing(lengths, 100)
    assert len(got) == len(rows) and sorted(sum(lengths[i] for i in r) for r in got) == sorted(sum(lengths[i] for i in r) for r in rows)
