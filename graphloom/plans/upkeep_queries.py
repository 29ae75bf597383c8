"""Maps of routes and topics, snapshots and merges, facts, sessions, and what a viewer asks."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import incremental, maps, viewer
from graphloom.plans.registry import query
from graphloom.sources.tables import SPAN
from graphloom.streaming import debounce, progress

KINDS = "SELECT event_type, row_number() OVER (ORDER BY event_type) AS n FROM (SELECT DISTINCT event_type FROM {events})"
WEB_NODES = f"""
SELECT 10 * {SPAN} + n AS rowid, concat('route:', event_type) AS id, 'Route' AS label, concat('/', event_type) AS name, CAST(NULL AS STRING) AS file_path, '{{{{"responseKeys":["k"],"errorKeys":["err"],"middleware":["auth"]}}}}' AS props FROM ({KINDS})
UNION ALL SELECT 11 * {SPAN} + user_id, concat('user:', user_id), 'Function', concat('user ', user_id), concat('web/u', user_id % 10, '.ts'), '{{{{}}}}' FROM (SELECT DISTINCT user_id FROM {{events}})
UNION ALL SELECT 12 * {SPAN} + n, concat('handler:', event_type), 'Function', concat('handle_', event_type), concat('api/', event_type, '.rs'), '{{{{}}}}' FROM ({KINDS})
UNION ALL SELECT 13 * {SPAN} + n, concat('flow:', event_type), 'Process', concat('flow of ', event_type), NULL, '{{{{}}}}' FROM ({KINDS})
UNION ALL SELECT 14 * {SPAN} + n, concat('topic:', event_type), 'Topic', event_type, NULL, CASE WHEN n % 2 = 0 THEN '{{{{"broker":"Kafka","consumerGroups":["g1","g2"]}}}}' ELSE '{{{{}}}}' END FROM ({KINDS})"""
WEB_EDGES = f"""
SELECT 12 * {SPAN} + n AS src, 10 * {SPAN} + n AS dst, 'HANDLES_ROUTE' AS type, '' AS reason FROM ({KINDS})
UNION ALL SELECT 11 * {SPAN} + user_id, 10 * {SPAN} + n, 'FETCHES', concat('keys:k', CASE WHEN user_id % 7 = 0 THEN ',missing' WHEN user_id % 5 = 0 THEN ', err' ELSE '' END, '|fetches:', c)
  FROM (SELECT user_id, event_type, count(*) AS c FROM {{events}} WHERE user_id % 4 = 0 GROUP BY user_id, event_type) e JOIN ({KINDS}) k ON e.event_type = k.event_type
UNION ALL SELECT 10 * {SPAN} + n, 13 * {SPAN} + n, 'ENTRY_POINT_OF', '' FROM ({KINDS}) WHERE n % 2 = 1
UNION ALL SELECT 12 * {SPAN} + n, 14 * {SPAN} + n, 'EMITS', '' FROM ({KINDS})
UNION ALL SELECT 11 * {SPAN} + user_id, 14 * {SPAN} + n, 'LISTENS_ON', '' FROM (SELECT DISTINCT user_id, event_type FROM {{events}} WHERE user_id % 9 = 0) e JOIN ({KINDS}) k ON e.event_type = k.event_type"""
W = f"WITH nodes AS ({WEB_NODES.format(events='events').replace('{{', '{').replace('}}', '}')}), edges AS ({WEB_EDGES.format(events='events')})"


def _web(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = spark.sql(WEB_NODES, events=events)
    return n, spark.sql(WEB_EDGES, events=events).withColumns({"step": F.lit(None).cast("int"), "confidence": F.lit(1.0)})


_USERS = """users AS (SELECT dst, n.rowid, n.name, regexp_extract(reason, 'keys:([^|]*)', 1) AS keys, regexp_extract(reason, 'fetches:([0-9]+)', 1)::INT AS fetch_count FROM edges JOIN nodes n ON src = n.rowid WHERE type = 'FETCHES'),
flags AS (SELECT *, contains(keys, 'missing') AS bad FROM users)"""


@query(f"""{W}, {_USERS} SELECT r.id, r.name AS route, concat('api/', substr(r.name, 2), '.rs') AS handler, 'auth' AS middleware, 'k' AS response_keys, 'err' AS error_keys,
(SELECT count(*) FROM users WHERE dst = r.rowid) AS consumers, (SELECT min_by(name, rowid) FROM users WHERE dst = r.rowid) AS first_consumer,
coalesce((SELECT n.name FROM edges JOIN nodes n ON dst = n.rowid WHERE type = 'ENTRY_POINT_OF' AND src = r.rowid), '') AS flows FROM nodes r WHERE label = 'Route'""")
def route_map(spark, sf_dir):
    found = maps.route_map(*_web(spark, sf_dir))
    joined = [F.array_join(c, ",").alias(c) for c in ("middleware", "response_keys", "error_keys")]
    return found.select("id", "route", "handler", *joined, F.size("consumers").cast("long").alias("consumers"), F.get("consumers", F.lit(0))["name"].alias("first_consumer"), F.array_join("flows", ",").alias("flows"))


@query(f"""{W}, {_USERS} SELECT r.id, f.name, CASE WHEN bad THEN 'missing' ELSE '' END AS mismatched, CASE WHEN contains(keys, 'err') THEN 'err' ELSE '' END AS error_path_keys,
CASE WHEN bool_or(bad) OVER (PARTITION BY r.id ORDER BY f.rowid) THEN CASE WHEN fetch_count > 1 THEN 'low' ELSE 'high' END END AS confidence,
CASE WHEN bool_or(bad) OVER (PARTITION BY r.id) THEN 'MISMATCH' END AS status FROM nodes r JOIN flags f ON f.dst = r.rowid""")
def shape_check(spark, sf_dir):
    found = maps.shape_check(maps.route_map(*_web(spark, sf_dir)))
    return found.select("id", "name", F.array_join("mismatched", ",").alias("mismatched"), F.array_join("error_path_keys", ",").alias("error_path_keys"), "confidence", "status")


@query(f"""{W}, {_USERS} SELECT id, route, consumers, mismatches, CASE least(2, CASE WHEN consumers >= 10 THEN 2 WHEN consumers >= 4 THEN 1 ELSE 0 END + (mismatches > 0)::INT) WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM (
SELECT r.id, r.name AS route, count(f.name) AS consumers, count(*) FILTER (bad) AS mismatches FROM nodes r LEFT JOIN flags f ON f.dst = r.rowid WHERE r.label = 'Route' GROUP BY 1, 2)""")
def api_impact(spark, sf_dir):
    return maps.api_impact(maps.route_map(*_web(spark, sf_dir)))


@query(f"""{W} SELECT t.id, CASE WHEN contains(t.props, 'Kafka') THEN 'Kafka' ELSE 'unknown' END AS broker, t.name, concat('handle_', t.name) AS producers,
(SELECT count(*) FROM edges WHERE type = 'LISTENS_ON' AND dst = t.rowid) AS consumers, CASE WHEN contains(t.props, 'Kafka') THEN 'g1,g2' ELSE '' END AS groups FROM nodes t WHERE label = 'Topic'""")
def topic_map(spark, sf_dir):
    found = maps.topic_map(*_web(spark, sf_dir))
    return found.select("id", "broker", "name", F.array_join("producers", ",").alias("producers"), F.size("consumers").cast("long").alias("consumers"), F.array_join("groups", ",").alias("groups"))


# --- snapshots -----------------------------------------------------------------------------------------------

_OLD = "SELECT concat(source, '/', doc_id) AS path, sha256(text) AS hash FROM documents WHERE doc_id % 2 = 0"
_NEW = "SELECT concat(source, '/', doc_id) AS path, CASE WHEN doc_id % 10 = 0 THEN sha256(concat(text, 'x')) ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 3 <> 0"


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT path, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'deleted' WHEN o.hash <> n.hash THEN 'modified' ELSE 'unchanged' END AS status FROM o FULL JOIN n USING (path)")
def index_delta(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat("source", F.lit("/"), "doc_id").alias("path")
    old = docs.where("doc_id % 2 = 0").select(path, F.sha2("text", 256).alias("hash"))
    new = docs.where("doc_id % 3 <> 0").select(path, F.when(F.col("doc_id") % 10 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256)).alias("hash"))
    return incremental.delta(old, new)


_FACTS = {
    "nodes": "SELECT concat('p', p_partkey) AS id, concat('f', p_partkey % 97) AS file_path, 'Struct' AS label FROM {part} UNION ALL SELECT concat('s', s_suppkey), concat('f', s_suppkey % 89), 'Function' FROM {supplier}",
    "edges": "SELECT DISTINCT concat('e', l_partkey, '-', l_suppkey) AS id, concat('p', l_partkey) AS source_id, concat('s', l_suppkey) AS target_id FROM {lineitem}",
    "chunks": "SELECT concat('f', p_size) AS file_path, concat('p', p_partkey) AS node_id FROM {part}",
}


def _facts(spark, sf_dir, which: str):
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "supplier", "lineitem") if "{" + t + "}" in _FACTS[which]}
    return spark.sql(_FACTS[which], **tables)


_F = "WITH " + ", ".join(f"{k} AS ({v.replace('{', '').replace('}', '')})" for k, v in _FACTS.items())


@query(f"""{_F}, ef AS (SELECT unnest(list_distinct([a.file_path, b.file_path])) AS file_path FROM edges e JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id),
x AS (SELECT file_path, 1 AS n, 0 AS e, 0 AS c FROM nodes UNION ALL SELECT file_path, 0, 1, 0 FROM ef UNION ALL SELECT file_path, 0, 0, 1 FROM chunks)
SELECT file_path, sum(n)::BIGINT AS nodes, sum(e)::BIGINT AS edges, sum(c)::BIGINT AS chunks FROM x GROUP BY 1""")
def parse_manifest_counts(spark, sf_dir):
    return incremental.file_stats(*(_facts(spark, sf_dir, x) for x in ("nodes", "edges", "chunks")))


_DELTA = "SELECT DISTINCT file_path AS path, CASE WHEN file_path IN ('f1', 'f2', 'f3') THEN 'deleted' WHEN file_path LIKE 'f5%' THEN 'modified' ELSE 'unchanged' END AS status FROM nodes"
_FRESH = "SELECT concat(id, CASE WHEN length(id) % 2 = 0 THEN '' ELSE '_new' END) AS id, file_path, label FROM nodes WHERE file_path LIKE 'f5%'"


@query(f"""{_F}, d AS ({_DELTA}), gone AS (SELECT id FROM nodes WHERE file_path IN (SELECT path FROM d WHERE status <> 'unchanged')),
kept AS (SELECT id, file_path FROM nodes WHERE id NOT IN (SELECT id FROM gone)), now AS (SELECT id, file_path FROM kept UNION ALL SELECT id, file_path FROM ({_FRESH}) WHERE id NOT IN (SELECT id FROM kept))
SELECT 'node' AS kind, id, file_path FROM now UNION ALL SELECT 'edge', id, NULL FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)""")
def incremental_replace(spark, sf_dir):
    n, e = _facts(spark, sf_dir, "nodes"), _facts(spark, sf_dir, "edges")
    found = spark.sql(_DELTA.replace("FROM nodes", "FROM {n}"), n=n)
    fresh = spark.sql(_FRESH.replace("FROM nodes", "FROM {n}"), n=n)
    after, left = incremental.replaced(n, e, fresh, e.limit(0), found)
    return after.select(F.lit("node").alias("kind"), "id", "file_path").union(left.select(F.lit("edge"), "id", F.lit(None).cast("string")))


@query(f"{_F} SELECT id, file_path, label FROM nodes UNION ALL SELECT concat('n', n_nationkey), 'geo', 'Class' FROM nation")
def enrichment_antijoin(spark, sf_dir):
    n, e = _facts(spark, sf_dir, "nodes"), _facts(spark, sf_dir, "edges")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("concat('n', n_nationkey) AS id", "'geo' AS file_path", "'Class' AS label")
    more = nation.union(nation).union(n.where("id LIKE 's%'").select("id", F.lit("other"), F.lit("other")))
    return incremental.merged_enrichment(n, e, more, e)[0]


_PROVENANCE = """CASE user_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '{{"analyzer":"odd","source":"s","toolVersion":"1","adapterVersion":"1","oss":true}}' WHEN 2 THEN '{{"analyzer":" GoPls ","source":" ","toolVersion":"1","adapterVersion":"1","oss":true}}'
WHEN 3 THEN '{{"analyzer":"scip","source":"s","adapterVersion":"1","oss":true}}' WHEN 4 THEN '{{"analyzer":"scip","source":"s","toolVersion":"1","adapterVersion":"","oss":true}}'
WHEN 5 THEN '{{"analyzer":"scip","source":"s","toolVersion":"1","adapterVersion":"1","oss":false}}' ELSE '{{"analyzer":"scip","source":"s","toolVersion":"1","adapterVersion":"1","oss":true}}' END"""


@query("""SELECT event_id AS id, ['missing provenance', 'unknown analyzer', 'missing source', 'missing toolVersion', 'missing adapterVersion', 'not open source'][user_id % 7 + 1] AS violation
FROM events WHERE user_id % 7 < 6""")
def provenance_violations(spark, sf_dir):
    facts = spark.sql("SELECT event_id AS id, " + _PROVENANCE + " AS provenance FROM {events}", events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return incremental.provenance_violations(facts)


@query("""SELECT concat('file:', source, '/', lang) AS id, 'File' AS label, concat(source, '/', lang) AS name FROM documents GROUP BY source, lang
UNION ALL SELECT concat('doc:', doc_id), CASE WHEN doc_id % 2 = 0 THEN 'Function' ELSE 'Symbol' END, concat('doc:', doc_id) FROM documents""")
def facts_lower(spark, sf_dir):
    from graphloom.sources.semantic import lowered

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat("source", F.lit("/"), "lang")
    files = docs.select(path.alias("path"), F.col("lang").alias("language"), F.lit(None).cast("string").alias("digest")).distinct()
    symbol = F.concat(F.lit("doc:"), "doc_id").alias("symbol")
    none = F.lit(None).cast("int")
    symbols = docs.select(symbol, F.lit(None).cast("string").alias("display_name"), F.when(F.col("doc_id") % 2 == 0, "Function").alias("kind"), path.alias("file_path"), none.alias("start_line"), none.alias("end_line"))
    met = docs.select(symbol, F.lit("Definition").alias("role"), path.alias("file_path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.col("doc_id").alias("ordinal"))
    relations = docs.select(symbol, symbol.alias("target"), F.lit("calls").alias("kind")).toDF("source", "target", "kind")
    found, _ = lowered(files, symbols, met, relations)
    return found.select("id", "label", X.string_prop(F.col("properties"), "name").alias("name"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.absent'), '') AS absent FROM events")
def json_props_extract(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", X.string_prop(F.col("props"), "k").alias("k"), F.coalesce(X.string_prop(F.col("props"), "absent"), F.lit("")).alias("absent"))


# --- sessions and logs ---------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM f)
SELECT user_id, session::BIGINT AS session, min(ts) AS start, max(ts) AS "end", count(*) AS events FROM s GROUP BY 1, 2""")
def debounce_sessions(spark, sf_dir):
    return debounce.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), gap="1 HOUR")


@query("""SELECT user_id, event_id, event_type, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS percent FROM events
QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type""")
def log_dedup(spark, sf_dir):
    logs = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("percent", F.col("value"))
    return progress.log_dedup(logs, "user_id", "event_id", "event_type").select("user_id", "event_id", "event_type", "percent")


# --- the viewer's questions ----------------------------------------------------------------------------------

_POINTS = "SELECT p_partkey AS rowid, CAST(p_partkey * 7919 % 1000 AS DOUBLE) AS x, CAST(p_partkey * 104729 % 1000 AS DOUBLE) AS y FROM {part}"
_CLICKS = "SELECT s_suppkey AS click, CAST(s_suppkey * 31 % 1000 AS DOUBLE) AS x, CAST(s_suppkey * 57 % 1000 AS DOUBLE) AS y FROM {supplier}"


@query(f"""WITH p AS ({_POINTS.replace('{', '').replace('}', '')}), c AS ({_CLICKS.replace('{', '').replace('}', '')}),
m AS (SELECT click, rowid, pow(c.x - p.x, 2) + pow(c.y - p.y, 2) AS d2 FROM c JOIN p ON pow(c.x - p.x, 2) + pow(c.y - p.y, 2) <= 900)
SELECT click, rowid, d2 FROM m QUALIFY row_number() OVER (PARTITION BY click ORDER BY d2, rowid) = 1""")
def grid_pick(spark, sf_dir):
    points = spark.sql(_POINTS, part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    clicks = spark.sql(_CLICKS, supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    return viewer.pick(points, clicks, 30.0)


@query("""WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages), s AS (SELECT path, string_split(path, '/') AS l FROM p)
SELECT path, array_to_string(l[1:d], '/') AS ancestor, d::INT AS depth FROM (SELECT path, l, unnest(range(1, len(l))) AS d FROM s)""")
def path_ancestors(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    paths = pages.select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path")).distinct()
    return viewer.ancestors(paths)
