import hashlib
import struct

from tokenizers import Tokenizer

from graphloom.llm import bpe
from graphloom.llm.common import tokenizer_path


def _expected(rows):
    tool = Tokenizer.from_file(tokenizer_path(bpe.VOCABULARY))
    tool.no_truncation()
    tool.no_padding()
    out = []
    for k, t in rows:
        ids = tool.encode(t or "", add_special_tokens=False).ids
        plain = tool.decode(ids, skip_special_tokens=False)
        out.append((k, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=str)


def test_ids_and_text_are_those_of_the_library(table, odd_texts, small_texts):
    for rows in (odd_texts, small_texts, []):
        got = bpe.bpe(table(rows), outputs=("n_tokens", "ids_sha256", "decoded_sha256")).collect()
        assert sorted(map(tuple, got), key=str) == _expected(rows)


def test_general_outputs_round_trip(table, odd_texts):
    ids = bpe.bpe(table(odd_texts), outputs=("ids",))
    back = bpe.decode_table(ids).collect()
    assert sorted(((r.doc_id, r.decoded) for r in back), key=str) == sorted(((k, t or "") for k, t in odd_texts), key=str)


def test_random_pieces_against_the_library():
    import random

    import numpy as np

    rng = random.Random(1)
    parts = ["  ", " ", "\n", "\t", "a", "b", "the", "'s", "'", "é", "́", "中", "1", "23", "<|endoftext|>", "\xa0", " ", "!!", "--", "\U0001f600", "\x00", "\x1c", "\x85", "aaaa", "ing", "   ", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + ["a" * 5000, "ab" * 3000, "-" * 700]
    tool = Tokenizer.from_file(tokenizer_path(bpe.VOCABULARY))
    mine = bpe.TrieEncoder(tokenizer_path(bpe.VOCABULARY)).encode(texts)
    for text, ids, want in zip(texts, mine, tool.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
