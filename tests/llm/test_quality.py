import re
from collections import Counter

import duckdb

from graphloom.llm import quality


def _expected(k, t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    count, places = Counter(zip(words, words[1:], words[2:], strict=False)), set()
    for i in range(len(words) - 2):
        if count[tuple(words[i : i + 3])] > 1:
            places |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (k, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(places), n < 50 or 100 * len(places) > 50 * n)


def test_base_features_by_brute_force(table, odd_texts, small_texts):
    for rows in (odd_texts, small_texts, []):
        got = quality.quality(table(rows)).collect()
        assert sorted((tuple(r)[:7] for r in got), key=str) == sorted((_expected(k, t) for k, t in rows), key=str)
        assert all(r.kept == (r.rejected_by is None) and (r.rejected_by == "base") == r.base_failed for r in got)


def test_verdict_is_that_of_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = {r[0]: r[7] for r in con.execute("SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM (" + quality.ORACLE + ")").fetchall()}
    assert {r.doc_id: r.kept for r in quality.query(spark, path).collect()} == want


def test_long_texts_are_sorted_by_words(table, small_texts, monkeypatch):
    monkeypatch.setattr(quality, "PLACE_BITS", 5)
    got = quality.quality(table(small_texts[:60])).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted(_expected(k, t) for k, t in small_texts[:60])


def test_order_is_rejection_per_cost():
    a, b, c = (quality.Rule(x, "true") for x in "abc")
    assert quality.by_rejection_per_cost([(a, 1.0, 0.1), (b, 0.1, 0.1), (c, 0.1, 0.0)]) == [b, a, c]


def test_keep_good_carries_all_columns(table, odd_texts):
    docs = table(odd_texts)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in quality.quality(docs).where("kept").collect())


def test_filters_leave_the_plan_small(table, small_texts):
    """A filter on the verdict doesn't repeat the features' expressions."""
    made = quality.quality(table(small_texts[:3]))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(made.where("kept")) < 2 * size(made)


def test_query_has_the_columns_of_its_sql(spark):
    assert quality.query(spark, "/root/testdata/sf0.001").columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
