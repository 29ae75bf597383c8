"""Interleaved document sequences: HTML to ordered text and media-reference structs, payloads by digest.

An HTML parser walks a page once and yields its segments in order: runs of text, and references to media with
the alternative text and the caption of the figure they stand in. A reference ``media:<sha256>`` names a payload by
its digest; a join on the digest resolves it, and the segment's position keeps text, media and captions aligned.

Payloads are stored as binary PGM images, 64 samples of 8 bits a row, in a written table, and are read back
from it before anything is computed of them.

Input contract: null and empty texts have a payload of 64 zero bytes; null pages have no segments; texts and pages of
any length are read whole; equal payloads are one media entry, however many pages refer to it; references to absent
payloads stay, unresolved; repeated rows and null keys give a row each; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import arrow_schema, map_batches, scratch_path, short_batches

ROW = 64
SCHEME = "media:"

SEGMENT = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("caption", T.StringType()), T.StructField("source", T.StringType())])


def to_pgm(payload: bytes) -> bytes:
    """A payload of whole rows as a binary 8-bit PGM image."""
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def from_pgm(stored: bytes) -> bytes:
    """The samples of a stored image, as its header describes them."""
    kind, size, most, samples = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or most != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit PGM image")
    return samples


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + b"\0" * (-len(data) % ROW or (0 if data else ROW)), len(data)


def feature(samples: bytes) -> str:
    """A 64-bit average hash over 64 equal stretches, and the mean sample."""
    sums = np.frombuffer(samples, np.uint8).reshape(64, -1).sum(axis=1, dtype=np.int64)
    bits = np.packbits(sums * 64 > sums.sum()).tobytes().hex()
    return f"ahash:{bits};mean:{int(sums.sum()) // len(samples)}"


class _Segments(HTMLParser):
    """Collects segments; a figure's caption belongs to all media in it."""

    QUIET = frozenset(("script", "style", "template", "noscript"))
    BLOCKS = frozenset(("p", "div", "br", "li", "ul", "ol", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "nav", "header", "footer", "title", "blockquote", "pre", "figure", "figcaption"))
    MEDIA = frozenset(("img", "audio", "video", "source", "embed"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.text: list[str] = []
        self.quiet = 0
        self.figures: list[list] = []  # place of the first segment, captions
        self.caption: list[str] | None = None

    def end_text(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.found.append({"kind": "text", "text": text, "digest": None, "caption": None, "source": None})

    def handle_starttag(self, tag, attrs):
        if tag in self.QUIET:
            self.quiet += 1
        if tag in self.BLOCKS or tag in self.MEDIA:
            self.end_text()
        if tag == "figure":
            self.end_caption()
            self.figures.append([len(self.found), []])
        elif tag == "figcaption":
            self.end_caption()
            self.caption = []
        elif tag in self.MEDIA:
            named = dict(attrs)
            source = named.get("src") or ""
            self.found.append({"kind": "media", "text": named.get("alt"), "digest": source[len(SCHEME) :] if source.startswith(SCHEME) else None, "caption": None, "source": source or None})

    def handle_endtag(self, tag):
        if tag in self.QUIET:
            self.quiet = max(0, self.quiet - 1)
        if tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            self.end_figure()
        elif tag in self.BLOCKS:
            self.end_text()

    def end_caption(self) -> None:
        """A caption waits for its figure's end, as it may stand before the media; one outside figures is text."""
        if self.caption is None:
            return
        words, self.caption = " ".join("".join(self.caption).split()), None
        if words and self.figures:
            self.figures[-1][1].append(words)
        elif words:
            self.found.append({"kind": "text", "text": words, "digest": None, "caption": None, "source": None})

    def end_figure(self) -> None:
        self.end_caption()
        self.end_text()
        if not self.figures:
            return
        first, captions = self.figures.pop()
        media = [x for x in self.found[first:] if x["kind"] == "media" and x["caption"] is None]
        for segment in media:
            segment["caption"] = " ".join(captions) or None
        if captions and not media:
            self.found.append({"kind": "text", "text": " ".join(captions), "digest": None, "caption": None, "source": None})

    def end_page(self) -> None:
        """What a page leaves open ends with it."""
        self.end_caption()
        self.end_text()
        while self.figures:
            self.end_figure()

    def handle_data(self, data):
        if not self.quiet:
            (self.text if self.caption is None else self.caption).append(data)


def segments(html: str | None) -> list[dict]:
    parser = _Segments()
    parser.feed(html or "")
    parser.close()
    parser.end_page()
    return [{"position": i, **x} for i, x in enumerate(parser.found)]


def interleaved(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, segments): each page's ordered text and media references."""
    rows = pages.select(F.col(key).alias("k"), F.col(html).alias("h"))
    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), T.StructField("segments", T.ArrayType(SEGMENT))])
    arrow = arrow_schema(schema)

    def make():
        def each(batch: pa.RecordBatch):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([segments(h) for h in batch.column(1).to_pylist()], arrow.field(1).type)], schema=arrow)

        return each

    return map_batches(rows, make, schema).withColumnRenamed("k", key)


def resolved(sequences: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """A row per segment, with the media table's columns where its digest is found; media has one row per digest."""
    flat = sequences.select(F.col(key).alias("k"), F.explode("segments").alias("s")).select("k", "s.*")
    return flat.join(media.withColumnRenamed("digest", "_digest"), F.col("digest") == F.col("_digest"), "left").drop("_digest").withColumnRenamed("k", key)


def store(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes each text's payload as an image, with a page that refers to it: (k, n_bytes, digest, html, image)."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("html", T.StringType()), T.StructField("image", T.BinaryType())])
    arrow = arrow_schema(schema)

    def make():
        def each(batch: pa.RecordBatch):
            out: list[list] = [[] for _ in range(4)]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload, size = padded(t)
                digest = hashlib.sha256(payload).hexdigest()
                title = escape(f"document {k}")
                html = f'<article><h1>{title}</h1><figure><img src="{SCHEME}{digest}" alt="{size} bytes"><figcaption>{title}, {len(payload) // ROW} rows</figcaption></figure></article>'
                for column, value in zip(out, (size, digest, html, to_pgm(payload)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(x, f.type) for x, f in zip(out, list(arrow)[1:], strict=True)], schema=arrow)

        return each

    map_batches(rows, make, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def described(stored: DataFrame) -> DataFrame:
    """One row per digest: sizes, digests, tail checksum and feature, all of the stored bytes as read back."""
    fields = [("digest", T.StringType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    arrow = arrow_schema(schema)

    def make():
        def each(batch: pa.RecordBatch):
            rows = []
            for digest, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                samples = from_pgm(image)
                rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        return each

    found = map_batches(stored.select("digest", "image"), make, schema)
    return found.groupBy("digest").agg(*[F.first(n).alias(n) for n, _ in fields[1:]])


def query(spark, sf_dir: str) -> DataFrame:
    stored = store(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_path(spark, "media"))
    pages = stored.select(F.struct("k", "n_bytes").alias("page"), "html")
    found = resolved(interleaved(pages, "page"), described(stored), "page").where("kind = 'media'")
    return found.select(F.col("page.k").alias("doc_id"), F.col("page.n_bytes").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
