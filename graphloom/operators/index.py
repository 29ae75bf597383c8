"""A repository's index on disk: graph, layout, documents, postings and vectors, as the tables of one version.

A version is a folder below the root, and the small file ``current`` names the one that readers open. A build, a
delete or an enrichment writes its version beside the others; putting it in place is the renaming of that one file,
so readers see the old tables or the new ones, and whatever breaks off before leaves the old ones in place.
"""

from __future__ import annotations

import time
import uuid
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import incremental, layout, search
from graphloom.session import written
from graphloom.sources.facts import Facts

#: Postings lie in this many folders by term, so a query reads those of its terms.
BUCKETS = 64
#: Postings of one bucket in a task; ids of documents that are sent to the postings; postings that a short document has.
BUCKET_ROWS, FEW, SHORT = 1_000_000, 1_000_000, 16


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def bucket_of(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    root: str
    version: str

    def has(self, name: str) -> bool:
        path = f"{self.root}/{self.version}/{name}"
        return _system(self.spark, path).exists(_path(self.spark, path))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.version}/{name}")

    def postings(self, terms: Iterable[str]) -> DataFrame:
        """The postings of these terms; other terms' folders aren't read."""
        terms = list(terms)
        return self.table("postings").where(F.col("bucket").isin(sorted({bucket_of(t) for t in terms})) & F.col("term").isin(terms))

    def bm25(self, terms: list[str], boosts: dict[str, float] | None = None) -> DataFrame:
        """(doc_id, score) by the stored statistics."""
        stats = self.table("stats")
        count = stats.first()["docs"]
        return search.bm25(self.postings(terms), terms, count, boosts, stats.where("field IS NOT NULL").select("field", "avgdl"))


def open_index(spark: SparkSession, root: str) -> Index | None:
    """The version that is in place; none before the first build."""
    current = f"{root}/current"
    if not _system(spark, current).exists(_path(spark, current)):
        return None
    return Index(spark, root, spark.read.text(current).first()["value"])


def _put(spark: SparkSession, root: str, version: str) -> Index:
    """Renames a small file onto ``current``."""
    jvm, staged = spark._jvm, _path(spark, f"{root}/current.{version}")
    out = _system(spark, root).create(staged, True)
    out.write(bytearray(version.encode()))
    out.close()
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, root).toUri(), spark._jsc.hadoopConfiguration()).rename(staged, _path(spark, f"{root}/current"), options)
    return Index(spark, root, version)


def build(spark: SparkSession, root: str, nodes: DataFrame, edges: DataFrame, chunks: DataFrame | None = None, vectors: DataFrame | None = None) -> Index:
    """Writes nodes, edges, layout, documents and postings, and vectors if there are any, then puts the version in place."""
    index = Index(spark, root, "v" + uuid.uuid4().hex)
    put = lambda name, df: df.write.parquet(f"{root}/{index.version}/{name}")
    put("nodes", nodes)
    put("edges", edges)
    placed, found = layout.positions(index.table("nodes"), index.table("edges"))
    put("positions", placed)
    put("clusters", found)
    put("documents", search.documents(index.table("nodes"), chunks))
    _write_postings(index, search.postings(index.table("documents")))
    if vectors is not None:
        put("vectors", vectors)
    return _put(spark, root, index.version)


def _write_postings(index: Index, posted: DataFrame, sizes: DataFrame | None = None) -> None:
    """Postings by bucket, and a row per field with its mean length and the number of documents.

    A bucket is dealt by document to as many tasks as its share of the postings asks for. ``sizes``: stored postings whose
    buckets are about as large.
    """
    where = f"{index.root}/{index.version}"
    if sizes is None:
        sizes = posted = written(posted.withColumn("bucket", F.crc32(F.col("term").cast("binary")) % BUCKETS), "postings")
    shares = {r["bucket"]: r["count"] // BUCKET_ROWS + 1 for r in sizes.groupBy("bucket").count().collect()}
    share = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("bucket")), F.lit(1)) if shares else F.lit(1)
    posted.repartition(max(BUCKETS, sum(shares.values())), "bucket", F.pmod(F.xxhash64("doc_id"), share)).write.partitionBy("bucket").parquet(f"{where}/postings")
    docs, table = index.table("documents").count(), index.table("postings").drop("bucket")
    stats = search.field_stats(table, table.count() < SHORT * docs).withColumn("docs", F.lit(docs).cast("long"))
    none = index.spark.createDataFrame([(None, None, docs)], "field string, avgdl double, docs long")
    stats.unionByName(none).coalesce(1).write.parquet(f"{where}/stats")


def without_paths(index: Index, paths: DataFrame) -> tuple[Index, int]:
    """The index without the documents at exactly these paths (path), and their number; 0 leaves it as it is."""
    gone = written(index.table("documents").join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("doc_id"), "gone")
    count = gone.count()
    if not count:
        return index, 0
    after = Index(index.spark, index.root, "v" + uuid.uuid4().hex)
    for name in ("nodes", "edges", "positions", "clusters", "vectors"):
        if index.has(name):
            index.table(name).write.parquet(f"{after.root}/{after.version}/{name}")
    few = count <= FEW
    index.table("documents").join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").write.parquet(f"{after.root}/{after.version}/documents")
    posted = index.table("postings")
    _write_postings(after, posted.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(posted.columns), posted)
    return _put(index.spark, index.root, after.version), count


# --- enrichment ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Provider:
    """Something that may add facts: ``produce`` gives (nodes, edges) with provenance, or none."""

    id: str
    analyzer: str
    produce: Callable[[SparkSession], tuple[DataFrame, DataFrame] | None]


@dataclass
class Report:
    """What became of each provider, and how much was added in all."""

    rows: list[tuple[str, str]] = field(default_factory=list)
    nodes: int = 0
    edges: int = 0


def enriched(nodes: DataFrame, edges: DataFrame, providers: Iterable[Provider], seconds: float = 30.0) -> tuple[DataFrame, DataFrame, Report]:
    """Nodes and edges with what accepted providers add; each fails alone, and none is started after the deadline.

    nodes and edges: (id, ..., provenance as JSON of what providers give); a provider with a fact that breaks a rule of
    provenance, or with an analyzer that isn't accepted, adds nothing.
    """
    report, end = Report(), time.monotonic() + seconds
    for provider in providers:
        if time.monotonic() > end:
            report.rows.append((provider.id, "deadline"))
            continue
        if provider.analyzer not in incremental.ANALYZERS:
            report.rows.append((provider.id, "not accepted"))
            continue
        try:
            made = provider.produce(nodes.sparkSession)
            if made is None:
                report.rows.append((provider.id, "nothing"))
                continue
            bad = [incremental.provenance_violations(t).limit(1).first() for t in made]
            if any(bad):
                report.rows.append((provider.id, next(b for b in bad if b)["violation"]))
                continue
            more_nodes, more_edges = (t.drop("provenance") for t in made)
            after_nodes, after_edges = incremental.merged_enrichment(nodes, edges, more_nodes, more_edges)
            report.nodes += after_nodes.count() - nodes.count()
            report.edges += after_edges.count() - edges.count()
        except Exception as failed:  # noqa: BLE001  a provider's failure is its own
            report.rows.append((provider.id, f"failed: {type(failed).__name__}"))
            continue
        nodes, edges = after_nodes, after_edges
        report.rows.append((provider.id, "merged"))
    return nodes, edges, report


# --- sources and sinks ---------------------------------------------------------------------------------------


class Sink(Protocol):
    """Takes facts in this order: nodes, edges, chunks, and the end with its stats."""

    def nodes(self, rows: DataFrame) -> None: ...
    def edges(self, rows: DataFrame) -> None: ...
    def chunks(self, rows: DataFrame) -> None: ...
    def done(self, stats: DataFrame) -> None: ...


class TableSink:
    """Writes what it takes as tables below a folder; ``facts`` gives a source that can be replayed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def nodes(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.root}/nodes")

    def edges(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.root}/edges")

    def chunks(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.root}/chunks")

    def done(self, stats: DataFrame) -> None:
        stats.write.parquet(f"{self.root}/stats")

    def facts(self) -> Facts:
        return Facts(*(self.spark.read.parquet(f"{self.root}/{t}") for t in ("nodes", "edges", "chunks", "stats")))


def replay(source: Facts, sink: Sink) -> None:
    """Gives a sink all that a source has; a source of tables can be replayed as often as asked."""
    sink.nodes(source.nodes)
    sink.edges(source.edges)
    sink.chunks(source.chunks)
    sink.done(source.stats)


# --- vectors -------------------------------------------------------------------------------------------------


def vector_shape(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(len, dim): the number of vectors and their dimension; none have dimension 0."""
    return vectors.agg(F.count("*").alias("len"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("dim"))


# --- several repositories ------------------------------------------------------------------------------------


def merged_search(hits: DataFrame, limit: int) -> DataFrame:
    """Hits (repo, place, score, ...) of several repositories by falling score alone; equal ones stay in the order of
    repositories and places."""
    return hits.orderBy(F.desc("score"), "repo", "place").limit(limit)


def merged_directories(found: DataFrame) -> DataFrame:
    """(dir, matches) of several repositories, added up, by falling number, then name."""
    return found.groupBy("dir").agg(F.sum("matches").alias("matches")).orderBy(F.desc("matches"), "dir")


def existing_files(listed: DataFrame, files: DataFrame) -> DataFrame:
    """The listed rows (file_path, ...) whose file is there (path)."""
    return listed.join(files.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")
