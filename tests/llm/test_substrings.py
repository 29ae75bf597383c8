import hashlib
import random

import pytest

from graphloom.llm import substrings


def _expected(rows, length=200):
    seen, out = {}, []
    for i, (_, t) in enumerate(rows):
        data = (t or "").encode()
        for p in range(len(data) - length + 1):
            seen.setdefault(data[p : p + length], []).append((i, p))
    covered = [bytearray(len((t or "").encode())) for _, t in rows]
    for found in seen.values():
        if len(found) > 1:
            for i, p in found:
                covered[i][p : p + length] = b"\x01" * length
    for (k, t), c in zip(rows, covered, strict=True):
        data = (t or "").encode()
        kept = bytes(x for x, gone in zip(data, c, strict=True) if not gone)
        runs = sum(1 for p in range(len(c)) if c[p] and (p == 0 or not c[p - 1]))
        out.append((k, len(data), sum(c), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _passages(seed=4):
    """Repeats of every length about the limit, at text ends, nested, overlapping, periodic."""
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = []
    core = noise(400)
    for n in (198, 199, 200, 201, 230, 260, 336, 400):
        at = rng.randrange(0, 401 - n)
        rows.append(noise(rng.randrange(0, 300)) + core[at : at + n] + noise(rng.randrange(0, 300)))
    rows += [core[:250], core[150:], core[:230] + core[170:], "ab" * 500, "abc" * 300, noise(150) * 3, "q" * 450, "q" * 199, noise(64) * 9 + core[:220]]
    for _ in range(25):
        rows.append(noise(rng.randrange(0, 120)) + core[30:280] + noise(rng.randrange(0, 120)))
    return list(enumerate(rows))


OUT = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("which", ["odd_texts", "small_texts", "passages", "none"])
def test_removed_bytes_by_brute_force(which, table, request):
    rows = {"passages": _passages(), "none": []}[which] if which in ("passages", "none") else request.getfixturevalue(which)
    got = substrings.without_repeats(table(rows), outputs=OUT).collect()
    assert sorted(map(tuple, got), key=str) == _expected(rows)


def test_hot_minimizers_are_halved(table, monkeypatch):
    rows = _passages(5)
    got = substrings.without_repeats(table(rows), outputs=OUT, hot=3).collect()
    assert sorted(map(tuple, got), key=str) == _expected(rows)


def test_long_texts_in_parts(table, monkeypatch):
    import numpy as np

    rng = random.Random(1)
    noise = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    text = noise(3000) + "zz" * 400 + noise(2000)
    data = np.frombuffer(text.encode(), np.uint8)
    whole = substrings.minimizers(data, np.array([0]), np.array([len(data)]), substrings.Hasher(16), 200, 64)
    monkeypatch.setattr(substrings, "PART", 700)
    rows = [(1, text), (2, text[:2500]), (3, text[700:1500] + noise(300))]
    got = substrings.without_repeats(table(rows), outputs=OUT).collect()
    assert sorted(map(tuple, got), key=str) == _expected(rows) and len(whole[0])


def test_prefix_intervals():
    common = [3, 5, 5, 2, 0, 4]
    want = {(i, j, min(common[i:j])) for i in range(7) for j in range(i + 1, 7) if min(common[i:j]) >= 2 and (i == 0 or common[i - 1] < min(common[i:j])) and (j == 6 or common[j] < min(common[i:j]))}
    assert set(substrings.prefix_intervals(common, 2)) == want


def test_repeat_groups_name_all_occurrences():
    after = sorted([b"x" * 64 + b"a" * 136, b"x" * 64 + b"a" * 136, b"x" * 64 + b"b" * 136])
    groups = list(substrings.repeats_of([b"l" * 136, b"m" + b"l" * 135, b"l" * 136], after, 200, 64))
    assert {(i, d, e) for i, d, e, _, _ in groups} == {(0, 64, 136), (2, 64, 136), (0, 200, 0), (1, 200, 0)}
    assert all(sorted(m) == ([0, 1, 2] if d == 64 else [0, 1]) and diverse for _, d, _, m, diverse in groups)
