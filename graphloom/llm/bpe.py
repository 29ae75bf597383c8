"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The last token of the encoding of a prefix, together with the encoding of what stands before that
token, is the whole encoding of the prefix. So one token per trie node suffices: the words that a
batch adds are put in a trie, a depth-first walk gives each node its last token, and prefixes that
many words share are encoded once. A token may end at a node if it is a suffix of the node's path
and stands next to the last token of the node where it begins without merging over the seam.

Input contract: nulls count as empty texts; empty texts give no ids; texts of any length are encoded
whole (a word beyond ``LONG_WORD`` characters is walked alone, without trie nodes); repeated rows give
a row each; an empty table gives an empty table. Only the two named columns are read, so further
columns may have any name.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import arrow_schema, map_batches, short_batches, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
#: Words longer than this are walked as a single path.
LONG_WORD = 512
#: Text pieces (and words) remembered per Python worker; a memory is emptied when full, so it is bounded.
MEMORY = 500_000
#: New words inserted in one trie.
TRIE_WORDS = 20_000

#: Fixed value: the splitting pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A space within a longer run of white space; such runs are not cut.
_RUN = re.compile(r"\s \s|  ")
_LONE_SPACE = re.compile(r"(?<=\S)(?= \S)")
_INFINITE = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(plain))
    return [table[b] for b in range(256)]


class TrieEncoder:
    """Encodes and decodes with the vocabulary and merges of a byte-level tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocabulary: dict[str, int] = spec["model"]["vocab"]
        size = max(max(self.vocabulary.values()), *(t["id"] for t in spec["added_tokens"])) + 1
        #: Rank, left and right part of the merge that makes a token; rank -1: a base symbol.
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merges: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, whole = self.vocabulary[a], self.vocabulary[b], self.vocabulary[a + b]
            self.merges[left, right] = rank
            self.rank[whole], self.left[whole], self.right[whole] = rank, left, right
        to_byte = {c: b for b, c in enumerate(byte_alphabet())}
        self.bytes = [b""] * size
        for token, i in self.vocabulary.items():
            self.bytes[i] = bytes(to_byte[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        #: First characters of special tokens; a text without them has none.
        self.marks = {t[0] for t in self.special}
        self.pattern = regex.compile(PATTERN)
        self.spelling = dict(enumerate(byte_alphabet()))
        self.words_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.pair_holds: dict[tuple[int, int], bool] = {}
        self.right_edge = [self._spine(i, self.right) for i in range(size)]
        self.left_edge = [self._spine(i, self.left) for i in range(size)]
        whole: dict[int, bool] = {}
        for i in sorted(self.vocabulary.values(), key=self.rank.__getitem__):
            a, b = self.left[i], self.right[i]
            whole[i] = self.rank[i] < 0 or (whole[a] and whole[b] and not self._seam_merges(a, b, (a, b)))
        self._automaton({token: i for token, i in self.vocabulary.items() if whole[i]})
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.words: dict[str, bytes] = {}
        #: Encodings of text pieces: those that begin a text, and those that follow a space (kept without it).
        self.firsts: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _spine(self, token: int, side: list[int]) -> list[tuple[int, int]]:
        """The symbols at one edge of a token while it grows, with the rank at which each is merged away."""
        out, until = [], _INFINITE
        while token >= 0:
            out.append((token, until))
            until, token = self.rank[token], side[token]
        return out

    def _seam_merges(self, a: int, b: int, besides: tuple[int, int] | None = None) -> bool:
        merges = self.merges
        for x, x_until in self.right_edge[a]:
            for y, y_until in self.left_edge[b]:
                rank = merges.get((x, y))
                # of equal ranks the merge further left comes first
                if rank is not None and rank < x_until and rank <= y_until and (x, y) != besides:
                    return True
        return False

    def may_follow(self, a: int, b: int) -> bool:
        held = self.pair_holds.get((a, b))
        if held is None:
            if len(self.pair_holds) > 1_000_000:
                self.pair_holds.clear()
            held = self.pair_holds[a, b] = not self._seam_merges(a, b)
        return held

    def _automaton(self, tokens: dict[str, int]) -> None:
        """Suffix automaton of the vocabulary: a state knows all tokens, longest first, that end where it stands."""
        self.steps: list[dict[str, int]] = [{}]
        self.shorter, own = [0], [-1]
        for token, i in tokens.items():
            state = 0
            for c in token:
                after = self.steps[state].get(c)
                if after is None:
                    after = self.steps[state][c] = len(self.steps)
                    self.steps.append({})
                    self.shorter.append(0)
                    own.append(-1)
                state = after
            own[state] = i
        self.ending: list[tuple] = [()] * len(own)
        level = [(0, 0)]
        while level:
            deeper = []
            for state, depth in level:
                mine = ((depth, own[state]),) if own[state] >= 0 else ()
                self.ending[state] = mine + (self.ending[self.shorter[state]] if state else ())
                for c, after in self.steps[state].items():
                    self.shorter[after] = self._step(self.shorter[state], c) if state else 0
                    deeper.append((after, depth + 1))
            level = deeper

    def _step(self, state: int, c: str) -> int:
        steps = self.steps
        while (after := steps[state].get(c)) is None and state:
            state = self.shorter[state]
        return after or 0

    def _walk(self, words: list[str]) -> None:
        """Inserts distinct words in a trie; one depth-first traversal encodes every node's path once."""
        root: dict = {}
        for word in words:
            if len(word) > LONG_WORD:
                self.words[word] = self._along(word)
                continue
            node = root
            for c in word:
                after = node.get(c)
                if after is None:
                    after = node[c] = {}
                node = after
            node[""] = word
        ending, packed, step, holds, out = self.ending, self.packed, self._step, self.pair_holds, self.words
        last, made = [0] * (LONG_WORD + 1), [b""] * (LONG_WORD + 1)
        stack = [(1, step(0, c), node) for c, node in root.items()]
        while stack:
            depth, state, node = stack.pop()
            for size, token in ending[state]:
                at = depth - size
                if at:
                    before = last[at]
                    held = holds.get((before, token))
                    if held is None:
                        held = self.may_follow(before, token)
                    if not held:
                        continue
                last[depth] = token
                made[depth] = made[at] + packed[token]
                break
            for c, child in node.items():
                if c:
                    stack.append((depth + 1, step(state, c), child))
                else:
                    out[child] = made[depth]

    def _along(self, word: str) -> bytes:
        """One long word: its prefixes' last tokens, then the way back."""
        last, size, state = [0] * (len(word) + 1), [0] * (len(word) + 1), 0
        for depth, c in enumerate(word, 1):
            state = self._step(state, c)
            for n, token in self.ending[state]:
                if n == depth or self.may_follow(last[depth - n], token):
                    last[depth], size[depth] = token, n
                    break
        ids, depth = [], len(word)
        while depth:
            ids.append(self.packed[last[depth]])
            depth -= size[depth]
        return b"".join(reversed(ids))

    def _split(self, text: str) -> tuple[str, list[str]]:
        """Pieces whose encodings, put together, are that of ``text``: cut before spaces that stand alone."""
        if self.at_special and self.at_special.search(text):
            return text, []
        if _RUN.search(text):
            first, *rest = _LONE_SPACE.split(text)
            return first, [x[1:] for x in rest]
        first, *rest = text.split(" ")
        return first, rest

    def _words(self, text: str) -> list[str]:
        """The splitter's words, in the byte alphabet."""
        if max(text) < "\u0250":  # Latin letters, whose classes all pattern engines agree on
            return [w.encode().decode("latin-1").translate(self.spelling) for w in self.pattern.findall(text)]
        return [word for word, _ in self.words_of(text)]

    def _learn(self, pieces: Iterable[str], space: str, known: dict[str, bytes]) -> None:
        parts: list[tuple[str, list]] = []
        new: dict[str, None] = {}
        words = self.words
        for piece in pieces:
            text = space + piece
            if not text:
                known[piece] = b""
                continue
            if self.marks.isdisjoint(text):
                out = self._words(text)
            else:
                out = []
                for part in self.at_special.split(text):
                    if part in self.special:
                        words[part] = self.packed[self.special[part]]
                        out.append(part)
                    elif part:
                        out += self._words(part)
            parts.append((piece, out))
            for word in out:
                if word not in words:
                    new[word] = None
        fresh = list(new)
        for k in range(0, len(fresh), TRIE_WORDS):
            self._walk(fresh[k : k + TRIE_WORDS])
        for piece, out in parts:
            known[piece] = words[out[0]] if len(out) == 1 else b"".join([words[x] for x in out])
        for token in self.special:
            words.pop(token, None)

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        for memory in (self.words, self.firsts, self.spaced):
            if len(memory) > MEMORY:
                memory.clear()
        split = [self._split(t) for t in texts]
        collecting = gc.isenabled()
        gc.disable()  # tries hold no cycles, and there are many new objects
        self._learn({first for first, _ in split} - self.firsts.keys(), "", self.firsts)
        self._learn(set().union(*[rest for _, rest in split]) - self.spaced.keys(), " ", self.spaced)
        if collecting:
            gc.enable()
        firsts, spaced = self.firsts, self.spaced.__getitem__
        return [firsts[first] + b"".join(map(spaced, rest)) for first, rest in split]

    def decode(self, ids: Iterable[int]) -> str:
        spelled = self.bytes
        return b"".join([spelled[i] for i in ids]).decode("utf-8", "replace")


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """One encoder per Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def bpe(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    vocabulary: str | None = None,
    outputs: tuple[str, ...] = ("ids", "decoded"),
) -> DataFrame:
    """Encodes every whole text, decodes the ids again, and returns ``key`` with the asked ``outputs``.

    outputs: of ``ids`` (array of int), ``decoded`` (string), ``n_tokens`` (long), ``ids_sha256`` and
    ``decoded_sha256`` (lowercase hex). One narrow map over the table; nothing is shuffled.
    """
    import numpy as np

    path = vocabulary or tokenizer_path(VOCABULARY)
    short_batches(docs.sparkSession)
    kinds = {"ids": T.ArrayType(T.IntegerType(), False), "decoded": T.StringType(), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType)] + [T.StructField(o, kinds[o]) for o in outputs])
    arrow = arrow_schema(schema)
    back = "decoded" in outputs or "decoded_sha256" in outputs

    def make():
        tool = encoder(path)

        def each(batch: pa.RecordBatch):
            got = tool.encode(batch.column(1).to_pylist())
            made: dict[str, list] = {o: [] for o in outputs}
            for ids in got:
                if back:
                    plain = tool.decode(np.frombuffer(ids, "<u4").tolist())
                for o in outputs:
                    made[o].append(
                        np.frombuffer(ids, "<i4") if o == "ids"
                        else plain if o == "decoded"
                        else len(ids) // 4 if o == "n_tokens"
                        else hashlib.sha256(ids if o == "ids_sha256" else plain.encode()).hexdigest()
                    )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(made[f.name], f.type) for f in list(arrow)[1:]], schema=arrow
            )

        return each

    return map_batches(rows, make, schema).withColumnRenamed("k", key)


def decode_table(ids: DataFrame, column: str = "ids", key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """``key`` and the ``decoded`` text of stored id arrays; null arrays count as empty."""
    path = vocabulary or tokenizer_path(VOCABULARY)
    rows = ids.select(F.col(key).alias("k"), F.coalesce(F.col(column), F.array().cast("array<int>")).alias("ids"))
    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), T.StructField("decoded", T.StringType())])
    arrow = arrow_schema(schema)

    def make():
        tool = encoder(path)

        def each(batch: pa.RecordBatch):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([tool.decode(x) for x in batch.column(1).to_pylist()], pa.string())], schema=arrow
            )

        return each

    return map_batches(rows, make, schema).withColumnRenamed("k", key)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
