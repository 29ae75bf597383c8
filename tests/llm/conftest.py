import random

import pytest

SMALL = "/root/testdata/sf0.001"
ROWS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, `_words` string"


@pytest.fixture(scope="session")
def small_texts(spark):
    """(doc_id, text) of the smallest table."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty, very long, tied and repeated rows, special marks and odd white space."""
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma,", "straße", "été", "x", "12", "|", "don't", "中文", "<|endoftext|>", "#", "\U0001f600"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(90)) for _ in range(n))
    long = "\n".join(prose(60) for _ in range(400))
    shared = prose(70)
    texts = [None, "", " ", "\n \t\x0b\x0c\r", "one", "a b c d", prose(30), prose(60), long, long, shared, "lead " + shared + " tail", prose(40) + " " + shared + "\n" + prose(5), "ab" * 3000, "  two  spaces \n\n end ", "\xa0 \xa0\n x", shared.upper(), "same line of text\n" * 80, "x" * 199, "y" * 200, "z" * 201]
    return [*enumerate(texts), (None, shared), (None, None), (7, texts[7]), (5, "a b c d")]


@pytest.fixture(scope="session")
def table(spark):
    """A documents table with further columns whose names clash with inner ones."""

    def make(rows):
        return spark.createDataFrame([(k, t, "en", "s", len(t or ""), True, "r", "w") for k, t in rows], ROWS).repartition(3)

    return make
