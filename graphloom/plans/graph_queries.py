"""Lookups, joins, closures, layout and roll-ups over the graph of the star-schema tables."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.operators import layout, store, traverse
from graphloom.plans.registry import query
from graphloom.session import stored
from graphloom.sources.tables import EDGES_SQL, NODES_SQL, SPAN, edges, nodes

G = f"WITH RECURSIVE nodes AS ({NODES_SQL}), edges AS ({EDGES_SQL})"
IMPACT = "('CALLS','IMPORTS','EXTENDS','INHERITS','IMPLEMENTS','HAS_METHOD','HAS_PROPERTY','MEMBER_OF','READS','WRITES','ACCESSES','OVERRIDES','METHOD_OVERRIDES','METHOD_IMPLEMENTS','HTTP_CALLS','ACCESSES_RESOURCE','FETCHES')"


def _rows(spark, kind: int, low: int, high: int):
    """Row numbers of keys ``low`` to ``high`` of a kind."""
    return spark.range(kind * SPAN + low, kind * SPAN + high + 1).toDF("rowid")


def _between(kind: int, low: int, high: int) -> str:
    return f"BETWEEN {kind * SPAN + low} AND {kind * SPAN + high}"


@query(f"{G} SELECT * FROM nodes WHERE id = 'supplier:7'")
def node_by_id(spark, sf_dir):
    return store.by_id(nodes(spark, sf_dir), "supplier:7")


@query(f"{G} SELECT * FROM nodes WHERE lower(name) LIKE 'small%' ORDER BY (name = 'small') DESC, length(name), name, rowid LIMIT 50")
def nodes_by_name_prefix(spark, sf_dir):
    return store.by_name(nodes(spark, sf_dir), "small", 50)


@query(f"{G} SELECT * FROM nodes WHERE label = 'Struct' AND contains(lower(name), 'ring') ORDER BY name, rowid LIMIT 200")
def nodes_by_label_contains(spark, sf_dir):
    return store.by_label(nodes(spark, sf_dir), "Struct", "RING", 200)


@query(f"{G} SELECT * FROM nodes WHERE file_path = 'supply/n3/suppliers.rs'")
def nodes_in_file(spark, sf_dir):
    return store.in_file(nodes(spark, sf_dir), "supply/n3/suppliers.rs")


@query(f"{G} SELECT file_path, count(*) AS symbols FROM nodes WHERE file_path IS NOT NULL AND start_line IS NOT NULL GROUP BY 1")
def file_list(spark, sf_dir):
    return store.file_list(nodes(spark, sf_dir))


@query(f"{G} SELECT file_path, count(*) AS nodes FROM nodes WHERE file_path <> '' GROUP BY 1")
def searchable_file_list(spark, sf_dir):
    return store.searchable_file_list(nodes(spark, sf_dir))


@query(f"{G} SELECT type, count(*) AS edges FROM edges GROUP BY 1")
def edge_type_counts(spark, sf_dir):
    return store.edge_type_counts(edges(spark, sf_dir))


@query(f"{G} SELECT rowid, count(*) AS degree FROM (SELECT src AS rowid FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1")
def degree(spark, sf_dir):
    return store.degree(edges(spark, sf_dir))


@query("""
WITH n AS (SELECT concat('part:', p_partkey) AS id FROM part WHERE p_size <= 40 UNION ALL SELECT concat('order:', o_orderkey) FROM orders WHERE o_orderstatus <> 'P')
SELECT concat('order:', l_orderkey) AS source_id, concat('part:', l_partkey) AS target_id FROM lineitem
WHERE concat('order:', l_orderkey) NOT IN (SELECT id FROM n) OR concat('part:', l_partkey) NOT IN (SELECT id FROM n)""")
def dangling_edges(spark, sf_dir):
    part, orders, lineitem = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "orders", "lineitem"))
    ids = part.where("p_size <= 40").selectExpr("concat('part:', p_partkey) AS id").union(orders.where("o_orderstatus <> 'P'").selectExpr("concat('order:', o_orderkey)"))
    facts = lineitem.selectExpr("concat('order:', l_orderkey) AS source_id", "concat('part:', l_partkey) AS target_id")
    return store.dangling(facts, ids)


@query("SELECT user_id AS id, min(event_id) AS ordinal, arg_min(event_type, event_id) AS label FROM events GROUP BY 1")
def dedup_ingest(spark, sf_dir):
    facts = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id AS id", "event_id AS ordinal", "event_type AS label")
    return store.first_by_id(facts)


@query(f"{G} SELECT dst AS anchor, n.rowid, type, id, name FROM edges JOIN nodes n ON src = n.rowid WHERE dst {_between(3, 1, 5)} AND type IN ('CALLS')")
def linked_nodes_in(spark, sf_dir):
    return store.linked(_rows(spark, 3, 1, 5), edges(spark, sf_dir), nodes(spark, sf_dir), ("CALLS",), False).select("anchor", "rowid", "type", "id", "name")


@query(f"{G} SELECT src AS anchor, n.rowid, type, id, name FROM edges JOIN nodes n ON dst = n.rowid WHERE src {_between(4, 1, 3)} AND type IN ('CALLS', 'EXTENDS')")
def linked_nodes_out(spark, sf_dir):
    return store.linked(_rows(spark, 4, 1, 3), edges(spark, sf_dir), nodes(spark, sf_dir), ("CALLS", "EXTENDS"), True).select("anchor", "rowid", "type", "id", "name")


@query(f"""{G} SELECT src AS anchor, 'out' AS direction, type, n.rowid, id FROM edges JOIN nodes n ON dst = n.rowid WHERE src {_between(5, 1, 3)}
UNION ALL SELECT dst, 'in', type, n.rowid, id FROM edges JOIN nodes n ON src = n.rowid WHERE dst {_between(5, 1, 3)}""")
def neighbors(spark, sf_dir):
    return store.neighbors(_rows(spark, 5, 1, 3), edges(spark, sf_dir), nodes(spark, sf_dir)).select("anchor", "direction", "type", "rowid", "id")


def _closure(start: str, near: str, far: str, types: str, depth: int, name: str = "walk") -> str:
    return f"""{name} AS (SELECT rowid, 0 AS depth FROM nodes WHERE rowid {start}
UNION SELECT e.{far}, w.depth + 1 FROM {name} w JOIN edges e ON e.{near} = w.rowid WHERE w.depth < {depth} AND e.type IN {types})"""


def _least(name: str = "walk") -> str:
    return f"SELECT rowid, min(depth) AS depth FROM {name} GROUP BY 1 HAVING min(depth) > 0"


@query(f"{G}, {_closure(_between(4, 1, 2), 'src', 'dst', "('CALLS')", 2)} {_least()}")
def callees(spark, sf_dir):
    return traverse.callees(_rows(spark, 4, 1, 2), edges(spark, sf_dir, ("CALLS",)), 2).select("rowid", "depth")


@query(f"{G}, {_closure(_between(3, 1, 1), 'dst', 'src', "('CALLS')", 2)} {_least()}")
def callers(spark, sf_dir):
    return traverse.callers(_rows(spark, 3, 1, 1), edges(spark, sf_dir, ("CALLS",)), 2).select("rowid", "depth")


@query(f"{G}, {_closure(_between(2, 1, 2), 'dst', 'src', IMPACT, 3)} {_least()}")
def impact_upstream(spark, sf_dir):
    return traverse.impact(_rows(spark, 2, 1, 2), edges(spark, sf_dir, N.IMPACT_EDGE_TYPES), 3).select("rowid", "depth")


@query(f"""{G}, {_closure(_between(5, 3, 3), 'dst', 'src', IMPACT, 2, 'up')}, {_closure(_between(5, 3, 3), 'src', 'dst', "('CALLS')", 2, 'down')}
SELECT rowid, depth, 'IMPACT' AS edge_type FROM ({_least('up')}) UNION SELECT rowid, depth, 'CALLS' FROM ({_least('down')})""")
def impact_both(spark, sf_dir):
    return traverse.impact(_rows(spark, 5, 3, 3), edges(spark, sf_dir, N.IMPACT_EDGE_TYPES), 2, "both").select("rowid", "depth", "edge_type")


@query(f"{G}, {_closure(_between(1, 0, 0), 'dst', 'src', IMPACT, 3)} SELECT depth, count(*) AS nodes FROM ({_least()}) GROUP BY 1")
def impact_depth_histogram(spark, sf_dir):
    return traverse.depth_histogram(traverse.impact(_rows(spark, 1, 0, 0), edges(spark, sf_dir, N.IMPACT_EDGE_TYPES), 3))


@query(f"{G} SELECT id, name, count(*) AS hits, min(step) AS first_step FROM edges JOIN nodes n ON dst = n.rowid WHERE type = 'STEP_IN_PROCESS' AND src {_between(5, 1, 20)} AND label = 'Process' GROUP BY 1, 2")
def affected_processes(spark, sf_dir):
    return store.affected_processes(_rows(spark, 5, 1, 20), edges(spark, sf_dir), nodes(spark, sf_dir))


@query(f"{G} SELECT src AS anchor, n.rowid, id, name, step FROM edges JOIN nodes n ON dst = n.rowid WHERE type = 'STEP_IN_PROCESS' AND src {_between(5, 1, 10)} AND label = 'Process'")
def processes_of_node(spark, sf_dir):
    return store.processes_of(_rows(spark, 5, 1, 10), edges(spark, sf_dir), nodes(spark, sf_dir))


@query(f"{G} SELECT src AS anchor, n.rowid, id, name, step FROM edges JOIN nodes n ON dst = n.rowid WHERE type = 'ENTRY_POINT_OF' AND src {_between(4, 1, 50)} AND label = 'Process'")
def entry_processes_of_node(spark, sf_dir):
    return store.processes_of(_rows(spark, 4, 1, 50), edges(spark, sf_dir), nodes(spark, sf_dir), "ENTRY_POINT_OF")


@query(f"{G} SELECT step, n.* FROM edges JOIN nodes n ON src = n.rowid WHERE type = 'STEP_IN_PROCESS' AND dst = {6 * SPAN + 5}")
def process_steps(spark, sf_dir):
    return store.process_steps(edges(spark, sf_dir), nodes(spark, sf_dir), 6 * SPAN + 5)


@query(f"{G} SELECT src AS anchor, min(dst) AS community FROM edges JOIN nodes n ON dst = n.rowid WHERE type = 'MEMBER_OF' AND label = 'Community' GROUP BY 1")
def community_first(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return store.first_community(n, edges(spark, sf_dir, ("MEMBER_OF",)), n)


@query(f"""{G} SELECT n.rowid, (SELECT count(*) FROM edges WHERE dst = n.rowid AND type = 'CALLS') AS callers,
(SELECT count(*) FROM edges WHERE dst = n.rowid) AS "references", (SELECT count(*) FROM edges WHERE src = n.rowid AND type = 'CALLS') AS callees
FROM nodes n WHERE label IN ('Struct', 'Function')""")
def node_detail_degree(spark, sf_dir):
    return store_degrees(nodes(spark, sf_dir).where("label IN ('Struct', 'Function')"), edges(spark, sf_dir))


def store_degrees(anchors, e):
    from graphloom.operators.answers import node_degrees

    return node_degrees(anchors, e)


# --- layout --------------------------------------------------------------------------------------------------

L = f"""{G}, deg AS (SELECT rowid, count(*) AS degree FROM (SELECT src AS rowid FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1),
first_c AS (SELECT src, min(dst) AS c FROM edges JOIN nodes n ON dst = n.rowid WHERE type = 'MEMBER_OF' AND label = 'Community' GROUP BY 1),
memb AS (SELECT n.rowid, label = 'Community' AS pinned, CASE WHEN label = 'Community' THEN n.rowid ELSE f.c END AS c,
  CASE WHEN label = 'Community' THEN n.name WHEN f.c IS NOT NULL THEN (SELECT name FROM nodes m WHERE m.rowid = f.c)
       WHEN label = 'Process' THEN 'Processes' WHEN contains(file_path, '/') THEN split_part(file_path, '/', 1) ELSE '(root)' END AS cluster_label
  FROM nodes n LEFT JOIN first_c f ON f.src = n.rowid),
sizes AS (SELECT cluster_label, coalesce(c, 0) AS origin, count(*) AS members FROM memb GROUP BY 1, 2),
cl AS (SELECT *, row_number() OVER (ORDER BY members DESC, cluster_label, origin) - 1 AS cluster, 10.0 * sqrt(members) + 10.0 AS radius FROM sizes),
ctr AS (SELECT *, sqrt(sum(pow(2.0 * radius, 2)) OVER (ORDER BY cluster)) * cos(cluster * 2.399963229728653) AS cx, sqrt(sum(pow(2.0 * radius, 2)) OVER (ORDER BY cluster)) * sin(cluster * 2.399963229728653) AS cy FROM cl),
ranked AS (SELECT m.rowid, t.cluster, cx, cy, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY t.cluster ORDER BY pinned DESC, coalesce(degree, 0) DESC, m.rowid) - 1 AS k
  FROM memb m JOIN ctr t ON m.cluster_label = t.cluster_label AND coalesce(m.c, 0) = t.origin LEFT JOIN deg d ON d.rowid = m.rowid),
pos AS (SELECT rowid, cluster, k, cx + 10.0 * sqrt(k) * cos(k * 2.399963229728653) AS x, cy + 10.0 * sqrt(k) * sin(k * 2.399963229728653) AS y, ln(1.0 + degree) AS size, degree FROM ranked),
ends AS (SELECT a.cluster AS a, b.cluster AS b FROM edges JOIN pos a ON src = a.rowid JOIN pos b ON dst = b.rowid)"""
STATS = """SELECT cluster, sum(i)::BIGINT AS internal, sum(e)::BIGINT AS external FROM (
SELECT a AS cluster, 1 AS i, 0 AS e FROM ends WHERE a = b UNION ALL SELECT a, 0, 1 FROM ends WHERE a <> b UNION ALL SELECT b, 0, 1 FROM ends WHERE a <> b) GROUP BY 1"""
FILES = """SELECT cluster, file_path, nodes, symbols, row_number() OVER (PARTITION BY cluster ORDER BY symbols DESC, nodes DESC, file_path) AS place FROM (
SELECT *, max(symbols) OVER (PARTITION BY cluster) AS most FROM (SELECT cluster, file_path, count(*) AS nodes, count(*) FILTER (label NOT IN ('Community', 'File', 'Folder', 'Project', 'Directory', 'Module', 'Package')) AS symbols
FROM pos JOIN nodes n ON n.rowid = pos.rowid WHERE file_path IS NOT NULL GROUP BY 1, 2)) WHERE most = 0 OR symbols > 0"""
SYMBOLS = """SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, name, file_path NULLS FIRST, id) AS place FROM (
SELECT cluster, id, coalesce(name, id) AS name, file_path, (3 * degree + round(6 * size)::BIGINT + CASE WHEN label = 'Process' THEN 22 WHEN label IN ('Class', 'Struct') THEN 18 WHEN label IN ('Function', 'Method') THEN 14 ELSE 5 END
+ CASE WHEN start_line IS NOT NULL THEN 4 ELSE 0 END)::BIGINT AS score FROM pos JOIN nodes n ON n.rowid = pos.rowid WHERE label <> 'Community')"""


def _assigned(spark, sf_dir):
    """Nodes, their clusters, and the clusters, which are computed once in an application and written."""
    n = nodes(spark, sf_dir)
    made = cache(lambda: layout.assigned(n, edges(spark, sf_dir, ("MEMBER_OF",))))
    return n, *[stored(spark, name, sf_dir, lambda part=part: made()[part]) for part, name in enumerate(("assigned", "clusters"))]


def _placed(spark, sf_dir):
    """Nodes, edges, and the layout, which is computed once in an application and written back."""
    (n, *given), e = _assigned(spark, sf_dir), edges(spark, sf_dir)
    return n, e, stored(spark, "positions", sf_dir, lambda: layout.positions(n, e, tuple(given))[0]), given[1]


@query(f"{L} SELECT rowid, cluster, k, round(x, 4) AS x, round(y, 4) AS y, round(size, 6) AS size FROM pos")
def layout_positions(spark, sf_dir):
    _, _, placed, _ = _placed(spark, sf_dir)
    r = lambda c, n: F.round(c, n).alias(c)
    return placed.select("rowid", F.col("cluster").cast("long").alias("cluster"), F.col("k").cast("long").alias("k"), r("x", 4), r("y", 4), r("size", 6))


@query(f"{L} SELECT least(a, b) AS s, greatest(a, b) AS t, count(*) AS weight FROM ends WHERE a <> b GROUP BY 1, 2")
def cluster_edge_weights(spark, sf_dir):
    _, placed, _ = _assigned(spark, sf_dir)
    return layout.cluster_edges(edges(spark, sf_dir), placed).select(F.col("s").cast("long").alias("s"), F.col("t").cast("long").alias("t"), "weight")


@query(f"{L} {STATS}")
def cluster_internal_external(spark, sf_dir):
    _, placed, _ = _assigned(spark, sf_dir)
    return layout.edge_stats(edges(spark, sf_dir), placed).withColumn("cluster", F.col("cluster").cast("long"))


@query(f"{L} SELECT cluster, place, file_path, nodes, symbols FROM ({FILES}) WHERE place <= 5")
def cluster_top_files(spark, sf_dir):
    n, placed, _ = _assigned(spark, sf_dir)
    return layout.top_files(n, placed).select(F.col("cluster").cast("long").alias("cluster"), F.col("place").cast("long").alias("place"), "file_path", "nodes", "symbols")


@query(f"{L} SELECT cluster, place, id, name, score FROM ({SYMBOLS}) WHERE place <= 5")
def cluster_top_symbols(spark, sf_dir):
    n, _, placed, _ = _placed(spark, sf_dir)
    return layout.top_symbols(n, placed).select(F.col("cluster").cast("long").alias("cluster"), F.col("place").cast("long").alias("place"), "id", "name", "score")


@query(f"""{L}, st AS ({STATS}), fi AS (SELECT * FROM ({FILES}) WHERE place = 1)
SELECT cluster, internal, external, round(coh, 6) AS cohesion, round(bnd, 6) AS boundary_ratio, round(least(1.0, greatest(0.0, 0.45 * coh + 0.35 * fr + 0.2 * least(1.0, members / 20.0))), 6) AS confidence FROM (
SELECT cl.cluster, coalesce(internal, 0) AS internal, coalesce(external, 0) AS external, members, coalesce(nodes, 0) / greatest(members, 1)::DOUBLE AS fr,
CASE WHEN coalesce(internal, 0) + coalesce(external, 0) = 0 THEN 1.0::DOUBLE ELSE internal / (internal + external)::DOUBLE END AS coh,
CASE WHEN coalesce(internal, 0) + coalesce(external, 0) = 0 THEN 0.0::DOUBLE ELSE external / (internal + external)::DOUBLE END AS bnd
FROM cl LEFT JOIN st USING (cluster) LEFT JOIN fi USING (cluster))""")
def cluster_quality(spark, sf_dir):
    n, placed, found = _assigned(spark, sf_dir)
    rows = layout.quality(found, layout.edge_stats(edges(spark, sf_dir), placed), layout.top_files(n, placed))
    return rows.select(F.col("cluster").cast("long").alias("cluster"), "internal", "external", *[F.round(c, 6).alias(c) for c in ("cohesion", "boundary_ratio", "confidence")])


@query(f"{L} SELECT row_number() OVER (ORDER BY size DESC, rowid) - 1 AS i, rowid, cluster, degree FROM pos ORDER BY size DESC, rowid LIMIT 500")
def lod_nodes(spark, sf_dir):
    _, e, placed, _ = _placed(spark, sf_dir)
    found, _ = layout.lod(placed, e, 500)
    return found.select(F.col("i").cast("long").alias("i"), "rowid", F.col("cluster").cast("long").alias("cluster"), "degree")


@query(f"""{L}, top AS (SELECT row_number() OVER (ORDER BY size DESC, rowid) - 1 AS i, rowid FROM pos ORDER BY size DESC, rowid LIMIT 500)
SELECT DISTINCT a.i AS s, b.i AS t FROM edges JOIN top a ON src = a.rowid JOIN top b ON dst = b.rowid WHERE a.i <> b.i""")
def lod_edges(spark, sf_dir):
    _, e, placed, _ = _placed(spark, sf_dir)
    _, found = layout.lod(placed, e, 500)
    return found.select(F.col("s").cast("long").alias("s"), F.col("t").cast("long").alias("t"))


@query(f"""{G}, und AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), walk AS (SELECT {3 * SPAN + 1}::BIGINT AS rowid, 0 AS ring
UNION SELECT b, ring + 1 FROM walk JOIN und ON a = walk.rowid WHERE ring < 2), rings AS (SELECT rowid, min(ring) AS ring FROM walk GROUP BY 1),
deg AS (SELECT rowid, count(*) AS degree FROM (SELECT src AS rowid FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1)
SELECT rowid, ring::INT AS ring, row_number() OVER (PARTITION BY ring ORDER BY degree DESC, rowid) - 1 AS k, round(ln(1.0 + degree), 6) AS size FROM rings JOIN deg USING (rowid)""")
def ego_rings(spark, sf_dir):
    found, _ = traverse.ego(3 * SPAN + 1, edges(spark, sf_dir), None, 2, 10**9)
    return found.select("rowid", "ring", F.col("k").cast("long").alias("k"), F.round("size", 6).alias("size"))
