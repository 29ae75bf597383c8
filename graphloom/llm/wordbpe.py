"""Ids of the word-level public tokenizer, by whitespace-separated piece, with memories of pieces and words.

Its normalizer and splitter never look across white space, so a text's ids are those of its pieces in order, and
a piece's those of its words. Each distinct piece is split once; each distinct word of a Latin piece is given to
the library's model, any other piece to the whole library. Texts are cut at the six ASCII white-space characters
only; other white space stays inside a piece and is left to the library.
"""

from __future__ import annotations

from array import array

import regex

from graphloom.llm.bpe import byte_alphabet
from graphloom.llm.common import tokenizer_path

VOCABULARY = "word_bpe_49k.json"
MEMORY = 600_000
#: Fixed value: the splitting pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class PieceEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.pattern = regex.compile(PATTERN)
        self.spelling = dict(enumerate(byte_alphabet()))
        self.known: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            spelled = word if word.isalpha() and word.isascii() else word.encode().decode("latin-1").translate(self.spelling)
            ids = self.words[word] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return ids

    def _learn(self, new: list[bytes]) -> None:
        other = []
        for piece in new:
            text = piece.decode()
            if max(text) < "ɐ" and "<|" not in text:  # composed, and lower-cased character by character, by any engine
                text = text.lower()
                self.known[piece] = self._word(text) if text.isalpha() else b"".join(map(self._word, self.pattern.findall(text)))
            else:
                other.append(piece)
        for k in range(0, len(other), 20_000):
            part = other[k : k + 20_000]
            got = self.tokenizer.encode_batch([x.decode() for x in part], add_special_tokens=False)
            for piece, ids in zip(part, got, strict=True):
                self.known[piece] = array("I", ids.ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        for memory in (self.known, self.words):
            if len(memory) > MEMORY:
                memory.clear()
        split = [(t or "").encode().split() for t in texts]
        known = self.known
        self._learn(list(set().union(*split) - known.keys()))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str | None = None) -> PieceEncoder:
    """One encoder per Python worker and vocabulary."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    path = path or tokenizer_path(VOCABULARY)
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
