"""Word shingles, and fast similarity sketching.

A set is sketched in rounds: in each of the first ``t`` rounds every element is hashed to a bin and a value, in
the next ``t`` rounds round ``t + i`` puts every element in bin ``i``, so every coordinate fills. A coordinate is
the least (round, value) that reached its bin; a set with ``t ln t`` elements fills in one round, and the share of
equal coordinates is concentrated about the Jaccard similarity as for fully independent hashing.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

WORDS = 5
_U64 = np.uint64
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


#: Odd multipliers of the words of a shingle.
_MULTIPLIERS = mix(np.arange(1, 65, dtype=_U64)) | _U64(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; hashing is as fast as remembering, and needs no memory."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), _U64, len(words))


#: By byte: whether it is one of the white-space characters that end words.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class Words(NamedTuple):
    """Where the words and lines of a column of texts stand; offsets have the end of the last one behind them."""

    data: np.ndarray  #: the bytes of all texts
    texts: np.ndarray  #: the first byte of each text
    lines: np.ndarray  #: the first byte of each line; a text has a line more than line feeds
    start: np.ndarray  #: the first byte of each word
    end: np.ndarray  #: the byte after each word
    text_lines: np.ndarray  #: the first line of each text
    text_words: np.ndarray  #: the first word of each text
    line_words: np.ndarray  #: the first word of each line

    def sizes(self, text: int) -> list[int]:
        """The number of words of each line of a text."""
        return np.diff(self.line_words[self.text_lines[text] : self.text_lines[text + 1] + 1]).tolist()


def stretches(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches of true places; new ones start at each place of ``at``."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins, ends = at[at < len(inside)], at[at > 0] - 1
    first[begins], last[ends] = inside[begins], inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words_in(column: pa.Array) -> Words:
    """The words, parted by white space, of all texts of a column at once; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    texts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[texts[0] : texts[-1]]
    texts = texts - texts[0]
    start, end = stretches(~SPACE[data], texts)
    feeds = np.flatnonzero(data == 0x0A)
    text_lines = np.searchsorted(feeds, texts) + np.arange(n + 1)
    lines = np.empty(len(feeds) + n + 1, np.int64)
    lines[text_lines] = texts
    lines[np.arange(len(feeds)) + np.searchsorted(texts, feeds, "right")] = feeds + 1
    return Words(data, texts, lines, start, end, text_lines, np.searchsorted(start, texts), np.searchsorted(start, lines))


#: By number of bytes: those of a word of 8 bytes that are the first ones.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], _U64)
#: Words with more bytes are hashed one by one.
_LONG = 64


def hashes_of(words: Words) -> np.ndarray:
    """64-bit hashes of all words in lower case (A-Z), eight bytes of each at a time; not those of :func:`word_hashes`."""
    data = np.zeros(len(words.data) + 8, np.uint8)
    data[:-8] = words.data | (((words.data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    length = words.end - words.start
    total = mix((eight[words.start] & _FIRST[np.minimum(length, 8)]) + length.astype(_U64) * _MULTIPLIERS[0])
    at = np.arange(len(length))
    for done in range(8, _LONG, 8):
        at = at[length[at] > done]
        total[at] = mix(total[at] ^ (eight[words.start[at] + done] & _FIRST[np.minimum(length[at] - done, 8)]))
    for i in at[length[at] > _LONG]:
        total[i] = xxhash.xxh64_intdigest(data[words.start[i] : words.end[i]])
    return total


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words."""
    n = len(hashes) - k + 1
    total = np.zeros(max(n, 0), _U64)
    if n > 0:
        for j in range(k):
            total += hashes[j : j + n] * _MULTIPLIERS[j]
    return mix(total)


def shingle_set(hashes: np.ndarray, k: int = WORDS) -> np.ndarray:
    """The sorted different shingles; fewer than ``k`` words are one shingle, none are none."""
    if len(hashes) >= k:
        return np.unique(windows(hashes, k))
    if len(hashes):
        return mix(windows(hashes, len(hashes)) + _U64(len(hashes)))
    return np.zeros(0, _U64)


def shingle_sets(hashes: np.ndarray, start: np.ndarray, length: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(elements, offsets): :func:`shingle_set` of many stretches of words at once, one after the other.

    Stretch ``i`` has ``length[i]`` words from ``start[i]``; its elements are ``elements[offsets[i] : offsets[i + 1]]``.
    """
    count = np.where(length >= k, length - k + 1, (length > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(start)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
    whole = windows(hashes, k)
    values = whole[np.minimum(place, max(len(whole) - 1, 0))] if len(whole) else np.zeros(len(owner), _U64)
    for i in np.flatnonzero((length > 0) & (length < k)):
        values[np.searchsorted(owner, i)] = shingle_set(hashes[start[i] : start[i] + length[i]], k)[0]
    ends = np.cumsum(count)
    for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(len(start) + 1))


def sketches(elements: np.ndarray, offsets: np.ndarray, t: int) -> np.ndarray:
    """The ``t`` coordinates of many non-empty sets, a row each."""
    none = np.iinfo(_U64).max
    sizes = np.diff(offsets)
    out = np.full((len(sizes), t), none, _U64)
    flat, open_ = out.reshape(-1), np.arange(len(sizes))
    owner, values = np.repeat(open_, sizes), elements
    for at in range(2 * t):
        hashed = mix(values + mix(np.array([at + 1], _U64)))
        value = (_U64(at) << _U64(32)) | (hashed & _U64(0xFFFFFFFF))
        bins = ((hashed >> _U64(32)) % _U64(t)).astype(np.int64) if at < t else at - t
        np.minimum.at(flat, owner * t + bins, value)
        left = (out[open_] == none).any(axis=1)
        if not left.all():
            keep = np.zeros(len(sizes), bool)
            keep[open_[left]] = True
            open_, stays = open_[left], keep[owner]
            owner, values = owner[stays], values[stays]
        if not len(open_):
            break
    return out


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """The ``t`` coordinates of a non-empty set."""
    return sketches(elements, np.array([0, len(elements)]), t)[0]


def bands(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each run of ``rows`` coordinates (along the last axis), with the run's number in it."""
    table = coordinates.reshape(*coordinates.shape[:-1], -1, rows)
    total = np.broadcast_to(mix(np.arange(1, table.shape[-2] + 1, dtype=_U64)), table.shape[:-1])
    for j in range(rows):
        total = mix(total ^ (table[..., j] * _MULTIPLIERS[j]))
    return total.view(np.int64)


def identity(elements: np.ndarray) -> tuple[int, int]:
    """128 bits that name a sorted set, as two signed longs."""
    digest = xxhash.xxh3_128_digest(elements.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
