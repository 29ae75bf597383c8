"""The subpackage's queries, by name, and their DuckDB versions."""

from __future__ import annotations

import corpus_pipeline
from graphloom.llm import binary, bpe, media, minhash, packing, paragraphs, quality, substrings, urls, warc

QUERIES = {
    "op1_bpe": bpe.query,
    "op2_suffix_dedup": substrings.query,
    "op3_warc": warc.query,
    "op4_quality": quality.query,
    "op5_urls": urls.query,
    "op6_minhash": minhash.query,
    "op7_media": media.query,
    "op8_paragraphs": paragraphs.query,
    "op9_packing": packing.query,
    "op10_matrices": binary.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op3_warc": warc.ORACLE,
    "op4_quality": quality.ORACLE,
    "op6_minhash": minhash.ORACLE,
}
