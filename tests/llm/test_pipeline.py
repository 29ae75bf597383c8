import random

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import minhash
from graphloom.llm.common import tokenizer_path
from graphloom.llm.wordbpe import VOCABULARY
from tests.llm import test_neardup, test_quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, passage = [], prose(55)
    for _ in range(40):
        rows.append(prose(rng.randrange(60, 200)) + ".\n" + prose(45))
    rows += [rows[0], rows[1].replace(rows[1].split()[3], "changed"), prose(40) + " " + passage + " " + prose(30), prose(30) + " " + passage, prose(10), None, "", "same line here\n" * 60, prose(60) + " #### $$$$ %%%% " * 30]
    rows += [prose(70) + "\n" + rows[5].split("\n")[1], prose(3000)]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in _corpus()], COLUMNS).repartition(3).write.parquet(str(base / "documents.parquet"))
    docs, out = spark.read.parquet(str(base / "documents.parquet")), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(base)).write.parquet(str(base / name))
        docs = out[name] = spark.read.parquet(str(base / name))
        if n + 1 < len(corpus_pipeline.STAGES):
            assert [c.lower() for c in docs.columns] == ["doc_id", "text", "lang", "source", "n_chars"]
    return str(base), out


def _texts(table):
    return {r.doc_id: r.text for r in table.collect()}


def test_each_stage_against_its_own_input(stages):
    base, out = stages
    good = _texts(out["quality"])
    for k, t in _corpus():
        failed = test_quality._expected(k, t)[-1] or (t or "").count("#") > 5
        assert (k in good) == (not failed)
    kept = _texts(out["near_duplicates"])
    assert set(kept) == {k for k, _, _, stays in test_neardup._expected(sorted(good.items())) if stays}
    cut = _texts(out["passages"])
    assert cut[42] == kept[42] and cut[43] != kept[43] and len(cut[43].split()) <= len(kept[43].split()) - 20
    assert "\n" not in cut[49].strip("\n") and {k for k in cut if cut[k] != kept[k]} == {43, 49}
    shared = {}
    for k, t in cut.items():
        w = t.split()
        for i in range(len(w) - 49):
            assert shared.setdefault(tuple(w[i : i + 50]), k) == k
    tool = Tokenizer.from_file(tokenizer_path(VOCABULARY))
    want = {k: len(tool.encode(t, add_special_tokens=False).ids) + 1 for k, t in cut.items()}
    got = {}
    for p in out["packing"].collect():
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
        assert p.doc_tokens == want[p.doc_id]
    assert got == want


def test_run_gives_the_last_stage(spark, stages):
    base, out = stages
    assert sorted(map(tuple, corpus_pipeline.run(spark, base).select("doc_id", "start", "length", "ids_crc32").collect()))[:3] and corpus_pipeline.run(spark, base).agg({"length": "sum"}).first()[0] == out["packing"].agg({"length": "sum"}).first()[0]


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_duplicates_against_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = sorted(con.execute("SELECT doc_id, n_shingles, component_id, kept FROM (" + minhash.ORACLE + ")").fetchall())
    assert sorted(map(tuple, minhash.query(spark, path).collect())) == want


def test_near_duplicates_from_eighty_percent(spark):
    """Documents that are 0.80 to 0.85 alike don't both pass."""
    words = [f"w{i}" for i in range(1004)]
    texts = {1: words, 2: words[:834]}
    rows = [(k, " ".join(w)) for k, w in texts.items()]
    assert 800 <= len(texts[2]) - 4 < 850
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], COLUMNS)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert kept == {k for k, _, _, stays in test_neardup._expected(rows, percent=80) if stays} == {1}
