import hashlib
import io
import zipfile
from collections import Counter

import pytest

from graphloom.llm import warc

PAGES = "page_id long, url string, html string, digest string, k long"


def _rows():
    big, other = "<p>" + "x" * 1200, "é" * 500
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (9, None, big), (3, "http://c/", "short"), (4, "http://d/", "short"), (5, "http://e/", None), (6, "http://f/", ""), (7, "http://g/", other), (8, "http://h/", other), (10, "u", "y" * 999), (11, "u", "y" * 999), (12, "u", "\r\n\r\n" * 400), (9, "u", big), (None, "u", other), (13, "long", "z" * 3_000_000)]
    return [(a, b, c, "d", 0) for a, b, c in rows]


def _expected(rows):
    most = {}
    for k, _, h, *_ in rows:
        if len((h or "").encode()) >= 1000 and k is not None:
            most[h] = max(most.get(h, k), k)
    out = []
    for k, _, h, *_ in rows:
        body = (h or "").encode()
        answers = most.get(h) if len(body) >= 1000 else None
        revisits = answers is not None and answers != k
        out.append((k, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisits else "response", answers if revisits else None))
    return Counter(out)


@pytest.mark.parametrize("zip64", [False, True])
def test_archives_read_back(spark, tmp_path, zip64):
    rows = _rows()
    packages = warc.archive(spark.createDataFrame(rows, PAGES).repartition(3), str(tmp_path / "w"), zip64=zip64)
    got = warc.read_packages(spark, packages, str(tmp_path / "w")).collect()
    assert all(r.verified for r in got)
    as_key = lambda x: None if x in (None, "null") else int(x)
    assert Counter((as_key(r.key), r.payload_bytes, r.payload_digest, r.record_type, as_key(r.refers_to)) for r in got) == _expected(rows)
    bodies = {r.payload_digest: bytes(r.payload) for r in got if r.record_type == "response"}
    assert all(hashlib.sha1(b).hexdigest() == d for d, b in bodies.items())
    for r in packages.collect():
        with zipfile.ZipFile(r.path) as z:  # another reader agrees
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {0}


def test_empty_table(spark, tmp_path):
    packages = warc.archive(spark.createDataFrame([], PAGES), str(tmp_path / "w"))
    assert packages.collect() == [] and warc.read_packages(spark, packages, str(tmp_path / "w")).collect() == []


def test_directory_agrees_with_zipfile():
    for wide in (False, True):
        data = b"".join(warc.zip_package([("a", [b"12", b"345"]), ("b/c", [b""])], wide))
        members = warc.central_directory(io.BytesIO(data), len(data))
        assert {n: m[1] for n, m in members.items()} == {"a": 5, "b/c": 0}
        start = warc.member_start(io.BytesIO(data), members["a"])
        assert data[start : start + 5] == b"12345" == zipfile.ZipFile(io.BytesIO(data)).read("a")


def test_query_against_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet'")
    want = Counter(con.execute("SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM (" + warc.ORACLE + ")").fetchall())
    assert Counter(map(tuple, warc.query(spark, path).collect())) == want
