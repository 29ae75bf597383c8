import hashlib
import zlib
from collections import Counter

from graphloom.llm import media


def test_payloads_read_back(table, odd_texts, small_texts, spark, tmp_path):
    for n, rows in enumerate((odd_texts, small_texts, [])):
        stored = media.store(table(rows), str(tmp_path / str(n)))
        assert stored.count() == len(rows)
        by_digest = {r.digest: r for r in media.described(stored).collect()}
        pages = media.interleaved(stored.select("k", "html"), "k")
        flat = media.resolved(pages, media.described(stored), "k").collect()
        media_rows = [r for r in flat if r.kind == "media"]
        want = Counter()
        for k, t in rows:
            data = (t or "").encode()
            payload = data + bytes(-len(data) % 64) if data else bytes(64)
            image = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
            want[k, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest()] += 1
            assert by_digest[hashlib.sha256(payload).hexdigest()].feature == media.feature(payload)
        assert Counter((r.k, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in media_rows) == want
        assert all(r.position == 1 and r.caption.startswith(f"document {r.k},") for r in media_rows)


def test_query_columns(spark):
    got = media.query(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got.collect()) == Counter((d.doc_id, len((d.text or "").encode())) for d in docs)


def test_segments_keep_order_and_captions():
    html = """<p>one <b>two</b></p><script>no</script><figure><img src="media:aa" alt="A"><img src=media:bb><figcaption>both &amp; more</figcaption></figure>
    tail<img src="http://x/y.png" alt="far"><figure>in<img src="media:cc"></figure><p>end"""
    got = [(s["position"], s["kind"], s["text"], s["digest"], s["caption"]) for s in media.segments(html)]
    assert got == [(0, "text", "one two", None, None), (1, "media", "A", "aa", "both & more"), (2, "media", None, "bb", "both & more"), (3, "text", "tail", None, None), (4, "media", "far", None, None), (5, "text", "in", None, None), (6, "media", None, "cc", None), (7, "text", "end", None, None)]
    assert media.segments(None) == media.segments("") == [] and media.segments("<p>a<p>b<figcaption>c</figcaption>")[1]["text"] == "b"


def test_absent_payloads_stay(spark):
    pages = spark.createDataFrame([(1, '<img src="media:zz"> x'), (None, None)], "page_id long, html string")
    none = spark.createDataFrame([], "digest string, feature string")
    got = media.resolved(media.interleaved(pages), none, "page_id").collect()
    assert [(r.kind, r.feature) for r in sorted(got, key=lambda r: r.position)] == [("media", None), ("text", None)]


def test_captions_before_media_unclosed_and_alone():
    shown = lambda html: [(s["kind"], s["text"], s["caption"], s["source"]) for s in media.segments(html)]
    assert shown("<figure><figcaption>first</figcaption><img src=media:aa></figure>") == [("media", None, "first", "media:aa")]
    assert shown("<figure><img src=a.png><figcaption>open</figure>tail") == [("media", None, "open", "a.png"), ("text", "tail", None, None)]
    assert shown("<figure><figcaption>alone</figcaption></figure>x") == [("text", "alone", None, None), ("text", "x", None, None)]
    assert shown("<figcaption>never closed <p>all <b>text") == [("text", "never closed all text", None, None)]
    nested = "<figure><img src=a><figure><img src=b><figcaption>inner</figcaption></figure><figcaption>outer</figcaption></figure>"
    assert shown(nested) == [("media", None, "outer", "a"), ("media", None, "inner", "b")]
