"""Store queries: lookups, updates, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.graph import Graph, top_by
from graphloom.operators import store
from graphloom.plans.registry import TRIM, Registry
from graphloom.session import load, plain

R = Registry()
query = R.query
HUB = "function:platform-core:platform-core/shared/telemetry.py:record_event"
_T = ", ".join(f"('{t}', '{tier}')" for tier, ts in schema.TIERS.items() for t in ts)


@query(f"SELECT source_id, target_id, type, ord, weight, confidence FROM e")
def edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    return Graph.load(spark, d).edges.select("source_id", "target_id", "type", "ord", "weight", "confidence")


@query(f"""SELECT id, arg_max(name, record_id) AS name, arg_max(version, record_id) AS version, min(record_id) AS ord FROM (SELECT DISTINCT {TRIM.format('node_id')} AS id, name, version, record_id FROM node_records) GROUP BY id""", ctes="")
def node_upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.graph import upsert

    r = load(spark, d, "node_records").select(plain("node_id").alias("id"), "name", "version", F.col("record_id").alias("ord"))
    return upsert(r, ["id"])


@query(f"SELECT id, type, name, confidence, tier FROM n WHERE id = '{HUB}'")
def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    return Graph.load(spark, d).nodes.where(F.col("id") == HUB).select("id", "type", "name", "confidence", "tier")


@query("SELECT id, name FROM n WHERE type = 'Endpoint'")
def nodes_by_type(spark: SparkSession, d: str) -> DataFrame:
    return Graph.load(spark, d).nodes.where("type = 'Endpoint'").select("id", "name")


@query("SELECT id, type FROM n WHERE tier = 'meso'")
def nodes_by_tier(spark: SparkSession, d: str) -> DataFrame:
    return Graph.load(spark, d).nodes.where("tier = 'meso'").select("id", "type")


@query("SELECT id, name FROM n WHERE list_contains(tags, 'deprecated')")
def nodes_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return Graph.load(spark, d).nodes.where(F.array_contains("tags", "deprecated")).select("id", "name")


@query("SELECT parent_id, count(*) AS n_children FROM n WHERE parent_id IS NOT NULL GROUP BY parent_id")
def nodes_by_parent(spark: SparkSession, d: str) -> DataFrame:
    return Graph.load(spark, d).nodes.where("parent_id is not null").groupBy("parent_id").agg(F.count(F.lit(1)).alias("n_children"))


@query(f"SELECT source_id, type, ord FROM e WHERE target_id = '{HUB}'")
def edges_to(spark: SparkSession, d: str) -> DataFrame:
    return Graph.load(spark, d).edges.where(F.col("target_id") == HUB).select("source_id", "type", "ord")


@query("SELECT source_id, target_id FROM e WHERE source_id LIKE 'workspace:%'")
def edges_from(spark: SparkSession, d: str) -> DataFrame:
    return Graph.load(spark, d).edges.where(F.col("source_id").startswith("workspace:")).select("source_id", "target_id")


@query("SELECT source_id, target_id, weight FROM e WHERE type = 'IMPORTS'")
def edges_by_type(spark: SparkSession, d: str) -> DataFrame:
    return Graph.load(spark, d).edges.where("type = 'IMPORTS'").select("source_id", "target_id", "weight")


@query("SELECT source_id, target_id, list_sort(list(type)) AS types FROM e GROUP BY source_id, target_id HAVING count(*) > 1")
def edges_between(spark: SparkSession, d: str) -> DataFrame:
    return Graph.load(spark, d).edges.groupBy("source_id", "target_id").agg(F.sort_array(F.collect_list("type")).alias("types")).where(F.size("types") > 1)


@query(f"SELECT (SELECT count(*) FROM n WHERE id <> '{HUB}') AS n_nodes, (SELECT count(*) FROM e WHERE source_id <> '{HUB}' AND target_id <> '{HUB}') AS n_edges")
def delete_node_cascade(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.load(spark, d).without_nodes(spark.createDataFrame([(HUB,)], "id string"))
    return g.nodes.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(g.edges.agg(F.count(F.lit(1)).alias("n_edges")))


@query("SELECT type, count(*) AS n_edges FROM e WHERE type <> 'TESTS' OR weight < 0.5 GROUP BY type")
def remove_edges(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.load(spark, d)
    left = g.without_edges(g.edges.where("type = 'TESTS' and weight >= 0.5"))
    return left.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"))


@query("SELECT type, count(*) FILTER (WHERE is_stale OR confidence < 0.5) AS n_stale FROM n GROUP BY type")
def mark_stale(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.load(spark, d)
    return g.mark_stale(g.nodes.where("confidence < 0.5")).nodes.groupBy("type").agg(F.count(F.when(F.col("is_stale"), 1)).alias("n_stale"))


@query("SELECT id, confidence FROM n WHERE confidence >= 0.95")
def filter_confidence(spark: SparkSession, d: str) -> DataFrame:
    return Graph.load(spark, d).nodes.where("confidence >= 0.95").orderBy(F.desc("confidence"), F.asc("ord")).select("id", "confidence")


@query("SELECT id, name, confidence FROM n WHERE contains(lower(name), 'invoice') OR contains(lower(coalesce(description, '')), 'invoice') ORDER BY confidence DESC, ord LIMIT 20")
def search_nodes(spark: SparkSession, d: str) -> DataFrame:
    return store.search_nodes(Graph.load(spark, d), "Invoice").select("id", "name", "confidence")


@query("SELECT id FROM n WHERE contains(lower(name), 'telemetry') OR contains(id, 'telemetry')")
def find_by_name_or_id(spark: SparkSession, d: str) -> DataFrame:
    return store.find_by_name_or_id(Graph.load(spark, d), "telemetry").select("id")


@query(", m AS (SELECT * FROM n WHERE contains(lower(name), 'user')) SELECT id, name, confidence, least(10, (SELECT count(*) FROM m)) AS total_matches, (SELECT count(*) FROM m) AS total_before_limit FROM m ORDER BY confidence DESC, name, ord LIMIT 10")
def search_entity(spark: SparkSession, d: str) -> DataFrame:
    return store.search_entity(Graph.load(spark, d), "user").select("id", "name", "confidence", "total_matches", "total_before_limit")


_AT = "CASE WHEN location.file_path IS NOT NULL THEN location.file_path || ':' || coalesce(location.start_line::VARCHAR, '?') || '-' || coalesce(location.end_line::VARCHAR, '?') END"


@query("SELECT id, type, name, tier FROM n")
def project_l1(spark: SparkSession, d: str) -> DataFrame:
    return store.project(Graph.load(spark, d), 1)


@query(f"SELECT id, type, name, tier, coalesce(description, '') AS description, {_AT} AS at, confidence, is_stale FROM n")
def project_l2(spark: SparkSession, d: str) -> DataFrame:
    return store.project(Graph.load(spark, d), 2)


@query(f"SELECT id, type, name, tier, coalesce(description, '') AS description, {_AT} AS at, confidence, is_stale, provenance, version, language, source_hash, tags, metadata, parent_id FROM n")
def project_l3(spark: SparkSession, d: str) -> DataFrame:
    return store.project(Graph.load(spark, d), 3)


@query(f""", t(type, tier) AS (VALUES {_T}), c AS (SELECT 'node_type' AS kind, type AS name, count(*) AS n, count(*) FILTER (WHERE is_stale) AS n_stale FROM n GROUP BY type
UNION ALL SELECT 'tier', t.tier, count(*), count(*) FILTER (WHERE is_stale) FROM n JOIN t USING (type) GROUP BY t.tier UNION ALL SELECT 'edge_type', type, count(*), count(*) FILTER (WHERE is_stale) FROM e GROUP BY type
UNION ALL SELECT 'total', 'nodes', count(*), count(*) FILTER (WHERE is_stale) FROM n UNION ALL SELECT 'total', 'edges', count(*), count(*) FILTER (WHERE is_stale) FROM e
UNION ALL SELECT 'node_type', type, 0, 0 FROM t UNION ALL SELECT DISTINCT 'tier', tier, 0, 0 FROM t UNION ALL SELECT 'edge_type', x, 0, 0 FROM (VALUES {schema.sql_values([(t,) for t in schema.EDGE_TYPES])}) v(x))
SELECT kind, name, sum(n)::BIGINT AS n, sum(n_stale)::BIGINT AS n_stale FROM c GROUP BY kind, name""")
def stats(spark: SparkSession, d: str) -> DataFrame:
    return store.stats(Graph.load(spark, d), spark)


@query("SELECT type AS name, count(*) AS n FROM n GROUP BY type")
def nonzero_stats(spark: SparkSession, d: str) -> DataFrame:
    return store.stats(Graph.load(spark, d), spark).where("kind = 'node_type' and n > 0").select("name", "n")


@query(", c AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT coalesce(is_stale, false)) AS n_fresh FROM n) SELECT n, n_fresh, round(n_fresh * 100.0 / n, 4)::DOUBLE AS fresh_pct, CASE WHEN n_fresh * 100.0 / n >= 90 THEN 'HEALTHY' WHEN n_fresh * 100.0 / n >= 70 THEN 'DEGRADED' ELSE 'STALE' END AS status FROM c")
def health(spark: SparkSession, d: str) -> DataFrame:
    return store.health(Graph.load(spark, d))


@query(", c AS (SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges) SELECT n_nodes, n_edges, round(n_edges / (n_nodes::DOUBLE * (n_nodes - 1)), 10) AS density FROM c")
def density(spark: SparkSession, d: str) -> DataFrame:
    return store.density(Graph.load(spark, d))


@query("SELECT id, count(*) AS n_edges FROM (SELECT source_id AS id FROM e UNION ALL SELECT target_id FROM e) GROUP BY id ORDER BY n_edges DESC, id LIMIT 10")
def top_connected(spark: SparkSession, d: str) -> DataFrame:
    return top_by(store.degrees(Graph.load(spark, d)), 10, F.desc("n_edges"), F.asc("id"))


@query("SELECT tier, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM n), 4)::DOUBLE AS pct FROM n GROUP BY tier")
def tier_pct(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = Graph.load(spark, d).nodes.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4).cast("double"))


@query("SELECT type, count(*) AS n, count(*) FILTER (WHERE is_stale) AS n_stale, round(count(*) FILTER (WHERE is_stale) * 100.0 / count(*), 1)::DOUBLE AS stale_pct FROM n GROUP BY type")
def stale_summary(spark: SparkSession, d: str) -> DataFrame:
    stale = F.count(F.when(F.col("is_stale"), 1))
    n = F.count(F.lit(1))
    return Graph.load(spark, d).nodes.groupBy("type").agg(n.alias("n"), stale.alias("n_stale"), F.round(stale * F.lit(100.0) / n, 1).cast("double").alias("stale_pct"))


_DEGREE = """, v AS (SELECT id, 0 AS i, 0 AS o FROM n UNION ALL SELECT source_id, 0, 1 FROM s UNION ALL SELECT target_id, 1, 0 FROM s), dg AS (SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM v GROUP BY id)"""


@query(f"{_DEGREE} SELECT *, round(in_degree / ((SELECT count(*) FROM dg) - 1), 10)::DOUBLE AS centrality FROM dg")
def degree(spark: SparkSession, d: str) -> DataFrame:
    return store.simple_degrees(Graph.load(spark, d))


@query(f"{_DEGREE} SELECT id, round(in_degree::DOUBLE / (SELECT max(in_degree) FROM dg), 10) AS score FROM dg")
def max_norm(spark: SparkSession, d: str) -> DataFrame:
    x = store.simple_degrees(Graph.load(spark, d))
    most = F.broadcast(x.agg(F.max("in_degree").alias("most")))
    return x.crossJoin(most).select("id", F.when(F.col("most") > 0, F.round(F.col("in_degree") / F.col("most"), 10)).otherwise(F.lit(0.0)).alias("score"))


@query("SELECT DISTINCT id, list_sort(list(DISTINCT provenance)) AS provenances FROM (SELECT source_id AS id, provenance FROM e UNION ALL SELECT target_id, provenance FROM e) WHERE provenance IS NOT NULL GROUP BY id")
def provenance_sets(spark: SparkSession, d: str) -> DataFrame:
    return Graph.load(spark, d).incident().where("provenance is not null").groupBy("id").agg(F.sort_array(F.collect_set("provenance")).alias("provenances"))


@query("SELECT bool_or(parent_id IS NOT NULL) AS has_hierarchy, bool_or(len(tags) > 0) AS has_tags, bool_or(last_updated IS NOT NULL) AS has_time, (SELECT list_sort(list(DISTINCT type)) FROM e) AS edge_types FROM n")
def capabilities(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.load(spark, d)
    n = g.nodes.agg(F.bool_or(F.col("parent_id").isNotNull()).alias("has_hierarchy"), F.bool_or(F.size("tags") > 0).alias("has_tags"), F.bool_or(F.col("last_updated").isNotNull()).alias("has_time"))
    return n.crossJoin(g.edges.agg(F.sort_array(F.collect_set("type")).alias("edge_types")))


@query("SELECT source_id, target_id, type, 'source' AS missing FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = source_id) UNION ALL SELECT source_id, target_id, type, 'target' FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = target_id)")
def dangling(spark: SparkSession, d: str) -> DataFrame:
    return Graph.load(spark, d).dangling().drop("ord")


@query("SELECT source_id, target_id, type FROM e WHERE source_id IN (SELECT id FROM n WHERE type = 'Function') AND target_id IN (SELECT id FROM n WHERE type = 'Function')")
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.load(spark, d)
    return g.induced(g.nodes.where("type = 'Function'")).select("source_id", "target_id", "type")


_SNAP = f"""sn AS (SELECT * FROM (SELECT *, {TRIM.format('id')} AS nid, row_number() OVER (PARTITION BY snapshot_no, {TRIM.format('id')} ORDER BY last_updated DESC, version DESC, confidence DESC, name DESC NULLS LAST, type DESC NULLS LAST, language DESC NULLS LAST, source_hash DESC NULLS LAST, parent_id DESC NULLS LAST) AS k FROM node_snapshots) WHERE k = 1)"""


@query(f""", f AS (SELECT min(ord) + (max(ord) - min(ord)) // 2 AS m FROM e), o AS (SELECT e.*, source_id || '->' || target_id || ':' || type AS key FROM e, f WHERE ord <= m), w AS (SELECT e.* REPLACE (CASE WHEN ord % 7 = 0 THEN weight / 2 ELSE weight END AS weight), source_id || '->' || target_id || ':' || type AS key FROM e WHERE ord % 5 <> 0)
SELECT 'edge' AS kind, coalesce(o.key, w.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN w.key IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL JOIN w ON o.key = w.key WHERE o.key IS NULL OR w.key IS NULL OR o.weight IS DISTINCT FROM w.weight""")
def graph_diff(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.load(spark, d)
    f = g.edges.agg((F.min("ord") + F.floor((F.max("ord") - F.min("ord")) / 2)).alias("m"))
    old = g.edges.crossJoin(F.broadcast(f)).where("ord <= m").drop("m")
    new = g.edges.where("ord % 5 <> 0").withColumn("weight", F.when(F.col("ord") % 7 == 0, F.col("weight") / 2).otherwise(F.col("weight")))
    return store.diff(Graph(g.nodes, old), Graph(g.nodes, new))


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.sql
