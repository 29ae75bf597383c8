"""Snapshots of files, their differences, and graphs kept up to date by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import store

MOST_CHANGED = 64
#: Labels that a whole-repository pass derives, so that a changed file cannot be replaced alone.
DERIVED_LABELS = ("Community", "Process", "Project")
#: Accepted analyzers and other names for them.
ANALYZERS = {"scip": "scip", "scip-index": "scip", "stack-graphs": "stack-graphs", "stack_graphs": "stack-graphs", "pyright": "pyright-lsp", "pyright-lsp": "pyright-lsp", "typescript": "typescript-lsp", "typescript-lsp": "typescript-lsp", "gopls": "gopls-lsp", "gopls-lsp": "gopls-lsp", "jdtls": "jdtls-lsp", "jdtls-lsp": "jdtls-lsp", "rust-analyzer": "rust-analyzer-lsp", "rust-analyzer-lsp": "rust-analyzer-lsp"}


def delta(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status) of two snapshots (path, hash): added, modified, deleted or unchanged."""
    both = previous.select("path", F.col("hash").alias("old")).join(current.select("path", F.col("hash").alias("new")), "path", "full_outer")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    return both.select("path", status.alias("status"))


def summary(found: DataFrame) -> DataFrame:
    """One line: +added ~modified -deleted =unchanged."""
    n = lambda s: F.count_if(F.col("status") == s).cast("string")
    return found.agg(F.concat(F.lit("+"), n("added"), F.lit(" ~"), n("modified"), F.lit(" -"), n("deleted"), F.lit(" ="), n("unchanged")).alias("summary"))


def reusable(previous: DataFrame, current: DataFrame, settings_equal: bool) -> bool:
    """Whether an index can be kept as it is: equal versions and settings, and no file differs."""
    return settings_equal and delta(previous, current).where("status <> 'unchanged'").isEmpty()


def preflight(found: DataFrame, metadata_equal: bool, index_exists: bool) -> str:
    """``incremental``, ``none`` or ``full``: a full build if too much changed or something else did."""
    changed = found.where("status <> 'unchanged'").limit(MOST_CHANGED + 1).count()
    if not index_exists or not metadata_equal or changed > MOST_CHANGED:
        return "full"
    return "incremental" if changed else "none"


def slice_of(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, chunks, unsafe): the facts of added and modified files; unsafe rows ask for a full build.

    nodes: (id, label, file_path, ...), edges: (source_id, target_id, ...). An edge belongs to the slice if either
    end does; it is unsafe if an end has no file or a derived label.
    """
    fresh = found.where("status IN ('added', 'modified')").select(F.col("path").alias("file_path"))
    part = nodes.join(fresh, "file_path", "left_semi")
    ids = part.select("id")
    touching = edges.join(ids, edges.source_id == ids.id, "left_semi").union(edges.join(ids, edges.target_id == ids.id, "left_semi")).dropDuplicates(["id"])
    ends = touching.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct().join(nodes, "id")
    unsafe = ends.where(F.col("label").isin(*DERIVED_LABELS) | F.col("file_path").isNull()).select("id", "label")
    return part, touching, chunks.join(fresh, "file_path", "left_semi"), unsafe


def replaced(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with those of changed and deleted files replaced; edges at removed nodes go."""
    gone = found.where("status IN ('modified', 'deleted')").select(F.col("path").alias("file_path"))
    kept = old_nodes.join(gone, "file_path", "left_anti").select(old_nodes.columns)
    removed = old_nodes.join(gone, "file_path", "left_semi").select("id")
    nodes = kept.unionByName(new_nodes.join(kept.select("id"), "id", "left_anti").select(new_nodes.columns))
    left = old_edges.join(removed, old_edges.source_id == removed.id, "left_anti").join(removed, old_edges.target_id == removed.id, "left_anti")
    fresh = new_edges.join(left.select("id"), "id", "left_anti").select(new_edges.columns)
    return nodes, left.unionByName(fresh)


def file_stats(nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_path, nodes, edges, chunks): an edge counts once in each different file of its ends."""
    at = nodes.where("file_path IS NOT NULL").select("id", "file_path")
    ends = edges.join(at.toDF("source_id", "a"), "source_id", "left").join(at.toDF("target_id", "b"), "target_id", "left")
    files = ends.select(F.explode(F.array_distinct(F.array_compact(F.array("a", "b")))).alias("file_path"))
    parts = [t.groupBy("file_path").agg(F.count("*").alias(n)) for t, n in ((at, "nodes"), (files, "edges"), (chunks, "chunks"))]
    return parts[0].join(parts[1], "file_path", "full_outer").join(parts[2], "file_path", "full_outer").fillna(0)


def _first(rows: DataFrame) -> DataFrame:
    """The first row of each id, by ``ordinal`` where there is one, else by the other columns."""
    rest = [c for c in rows.columns if c != "id"]
    return store.first_by_id(rows.withColumn("_order", F.col("ordinal") if "ordinal" in rest else F.struct(*rest)), "_order").select(rows.columns)


def merged_enrichment(nodes: DataFrame, edges: DataFrame, more_nodes: DataFrame, more_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append-only: nodes whose ids are new, and edges whose ends are there and whose ids are new."""
    fresh = _first(more_nodes).join(nodes.select("id"), "id", "left_anti").select(nodes.columns)
    everyone = nodes.unionByName(fresh)
    ids = everyone.select("id")
    links = _first(more_edges)
    linked = links.join(ids, links.source_id == ids.id, "left_semi").join(ids, links.target_id == ids.id, "left_semi").join(edges.select("id"), "id", "left_anti")
    return everyone, edges.unionByName(linked.select(edges.columns))


def canonical_analyzer(name):
    """A column of canonical analyzer names; null for those not accepted."""
    table = F.create_map(*[F.lit(x) for pair in ANALYZERS.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(name)))


def provenance_violations(facts: DataFrame, column: str = "provenance") -> DataFrame:
    """(id, violation): the first rule that a fact's JSON provenance breaks."""
    p = lambda k: F.get_json_object(column, f"$.{k}")
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    why = (
        F.when(F.col(column).isNull(), "missing provenance")
        .when(canonical_analyzer(p("analyzer")).isNull(), "unknown analyzer")
        .when(blank(p("source")), "missing source")
        .when(blank(p("toolVersion")), "missing toolVersion")
        .when(blank(p("adapterVersion")), "missing adapterVersion")
        .when(F.coalesce(p("oss"), F.lit("")) != "true", "not open source")
    )
    return facts.select("id", why.alias("violation")).where("violation IS NOT NULL")


def stamped(evidence, provenance: str):
    """JSON evidence with a provenance object; evidence that is no object is put under ``value``."""
    own = F.when(evidence.isNull(), F.lit("{}")).when(F.substring(F.ltrim(evidence), 1, 1) == "{", evidence).otherwise(F.concat(F.lit('{"value":'), evidence, F.lit("}")))
    head = F.regexp_replace(F.rtrim(own), r"\}$", "")
    comma = F.when(F.regexp_replace(head, r"\s", "") == "{", F.lit("")).otherwise(F.lit(","))
    return F.concat(head, comma, F.lit('"provenance":'), F.lit(provenance), F.lit("}"))
