"""Traversal, impact and context queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.graph import Graph, top_by
from graphloom.operators import impact, traverse
from graphloom.plans.registry import Registry
from graphloom.plans.store_queries import HUB
from graphloom.session import load

R = Registry()
query = R.query
_S = ", ".join(f"'{t}'" for t in schema.STRUCTURAL)
_X = ", ".join(f"'{t}'" for t in schema.EXECUTABLE)


def seed(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _reach(depth: int, forward: bool) -> str:
    a, b = ("source_id", "target_id") if forward else ("target_id", "source_id")
    return f", r(id, depth) AS (SELECT '{{seed}}', 0 UNION SELECT e.{b}, depth + 1 FROM r JOIN e ON e.{a} = r.id WHERE depth < {depth})"


def _projects() -> str:
    return "SELECT id FROM n WHERE type = 'Project'"


@query(_reach(2, False).format(seed=HUB) + " SELECT id, min(depth) AS depth FROM r GROUP BY id HAVING min(depth) > 0", recursive=True)
def upstream_k(spark: SparkSession, d: str) -> DataFrame:
    return traverse.upstream(Graph.load(spark, d), seed(spark, HUB), 2)


@query(", r(id, depth) AS (SELECT id, 0 FROM n WHERE type = 'Project' UNION SELECT e.target_id, depth + 1 FROM r JOIN e ON e.source_id = r.id WHERE depth < 3) SELECT id, min(depth) AS depth FROM r GROUP BY id HAVING min(depth) > 0", recursive=True)
def downstream_k(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.load(spark, d)
    return traverse.downstream(g, g.nodes.where("type = 'Project'"), 3)


@query(f"SELECT DISTINCT source_id AS id, 1 AS depth FROM e WHERE target_id = '{HUB}' AND source_id <> '{HUB}'")
def upstream_effective(spark: SparkSession, d: str) -> DataFrame:
    return traverse.upstream(Graph.load(spark, d), seed(spark, HUB), 5, compat=True)


@query(", r(id, depth) AS (SELECT id, 0 FROM n WHERE type = 'Workspace' UNION SELECT e.target_id, depth + 1 FROM r JOIN e ON e.source_id = r.id WHERE depth < 2), u(id, depth) AS (SELECT id, 0 FROM n WHERE type = 'Workspace' UNION SELECT e.source_id, depth + 1 FROM u JOIN e ON e.target_id = u.id WHERE depth < 2), near AS (SELECT id FROM r UNION SELECT id FROM u) SELECT source_id, target_id, type FROM e WHERE source_id IN (SELECT id FROM near) AND target_id IN (SELECT id FROM near)", recursive=True)
def subgraph_k(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.load(spark, d)
    return traverse.subgraph(g, g.nodes.where("type = 'Workspace'"), 2).edges.select("source_id", "target_id", "type")


def _far(g: Graph) -> tuple[str, str]:
    first = g.nodes.where("type = 'Workspace'").agg(F.min("id")).first()[0]
    return first, HUB


@query(f", r(id, depth) AS (SELECT min(id), 0 FROM n WHERE type = 'Workspace' UNION SELECT e.target_id, depth + 1 FROM r JOIN e ON e.source_id = r.id WHERE depth < 8 AND r.id <> '{HUB}') SELECT coalesce(min(depth), -1) AS length FROM r WHERE id = '{HUB}'", recursive=True)
def shortest_path_len(spark: SparkSession, d: str) -> DataFrame:
    """Of any length; its SQL ends at 8 edges and gives -1 beyond."""
    g = Graph.load(spark, d)
    path = traverse.shortest_path(g.edges, *_far(g))
    return spark.createDataFrame([(len(path) - 1,)], "length int")


@query(""", u AS (SELECT source_id AS a, target_id AS b FROM e UNION SELECT target_id, source_id FROM e),
c(id, label) AS (SELECT id, id FROM (SELECT id FROM n UNION SELECT a FROM u) UNION SELECT u.b, c.label FROM c JOIN u ON u.a = c.id WHERE c.label < u.b) SELECT id, min(label) AS component FROM c GROUP BY id""", recursive=True)
def component(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.load(spark, d)
    return traverse.components(g.edges, g.nodes)


@query(f", u AS (SELECT source_id AS a, target_id AS b FROM e UNION SELECT target_id, source_id FROM e), r(id, depth) AS (SELECT id, 0 FROM n WHERE type = 'Project' UNION SELECT u.b, depth + 1 FROM r JOIN u ON u.a = r.id WHERE depth < 2) SELECT id, min(depth) AS depth FROM r GROUP BY id", recursive=True)
def cascade_ball(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.load(spark, d)
    return traverse.reach(g.edges, g.nodes.where("type = 'Project'"), 2, both=True)


_CASCADE = f""", tr AS (SELECT id FROM n WHERE type = 'Endpoint' AND is_stale), i AS (SELECT source_id AS id, target_id AS other, false AS late, type IN ({_S}) AS st, ord FROM e UNION ALL SELECT target_id, source_id, true, type IN ({_S}), ord FROM e),
f AS (SELECT tr.id AS trigger, other AS id, arg_min(st, (late::INT)::BIGINT * 1000000000000 + ord) AS st FROM tr JOIN i ON i.id = tr.id WHERE other <> tr.id GROUP BY ALL),
c2 AS (SELECT DISTINCT f.trigger, i.other AS id FROM f JOIN i ON i.id = f.id WHERE NOT f.st AND NOT i.st),
seen AS (SELECT id AS trigger, id, 0 AS depth FROM tr UNION ALL SELECT trigger, id, 1 FROM f UNION ALL SELECT trigger, id, 2 FROM c2 WHERE c2.id <> c2.trigger AND NOT EXISTS (SELECT 1 FROM f WHERE f.trigger = c2.trigger AND f.id = c2.id))"""


@query(f"{_CASCADE} SELECT trigger, id, depth FROM seen")
def smart_cascade(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.load(spark, d)
    return traverse.smart_cascade(g, g.nodes.where("type = 'Endpoint' and is_stale"), 2)


@query(f"{_CASCADE}, ow AS (SELECT id, min(trigger) AS owner FROM seen GROUP BY id) SELECT trigger, count(*) AS n_seen, count(*) FILTER (WHERE trigger = owner AND NOT coalesce(n.is_stale, false) AND n.id IS NOT NULL) AS n_newly, count(*) FILTER (WHERE n.is_stale) AS n_already FROM seen JOIN ow USING (id) LEFT JOIN n USING (id) GROUP BY trigger")
def propagate(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.load(spark, d)
    return traverse.propagate_staleness(g, g.nodes.where("type = 'Endpoint' and is_stale"), 2)[0]


@query(f"{_CASCADE} SELECT source_id, target_id, type, min(a.trigger) AS owner FROM e JOIN seen a ON a.id = source_id JOIN seen b ON b.id = target_id AND b.trigger = a.trigger GROUP BY ALL")
def propagate_edges(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.load(spark, d)
    return traverse.propagate_staleness(g, g.nodes.where("type = 'Endpoint' and is_stale"), 2)[1]


@query(f", r(entry, id, depth) AS (SELECT id, id, 0 FROM n WHERE type = 'Endpoint' UNION SELECT r.entry, e.target_id, depth + 1 FROM r JOIN e ON e.source_id = r.id AND e.type = 'CALLS' JOIN n ON n.id = e.target_id AND n.type IN ({_X}) WHERE depth < 3) SELECT entry, count(DISTINCT id) AS n_steps FROM r GROUP BY entry", recursive=True)
def trace_flow(spark: SparkSession, d: str) -> DataFrame:
    """Three levels deep, as far as its SQL goes; trace_flow_full has the whole flows."""
    g = Graph.load(spark, d)
    return traverse.trace_flow(g, g.nodes.where("type = 'Endpoint'"), 3).groupBy("entry").agg(F.count(F.lit(1)).alias("n_steps"))


@query()
def trace_flow_full(spark: SparkSession, d: str) -> DataFrame:
    """Flows to the operator's own depth, without SQL: unrolled to ten levels it holds every way to every node."""
    g = Graph.load(spark, d)
    return traverse.trace_flow(g, g.nodes.where("type = 'Endpoint'")).groupBy("entry").agg(F.count(F.lit(1)).alias("n_steps"))


@query(", dn AS (SELECT source_id, target_id FROM e WHERE type = 'CONTAINS'), r(id, depth) AS (SELECT DISTINCT source_id, 0 FROM dn WHERE source_id NOT IN (SELECT target_id FROM dn) UNION SELECT dn.target_id, depth + 1 FROM r JOIN dn ON dn.source_id = r.id WHERE depth < 60), m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id) SELECT coalesce(max(depth), 0) AS depth FROM m", recursive=True)
def containment_depth(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(traverse.containment_depth(Graph.load(spark, d)),)], "depth int")


@query()
def import_cycles(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(traverse.import_cycles(Graph.load(spark, d)),)], "n_cycles int")


@query(_reach(2, False).format(seed=HUB) + ", near AS (SELECT DISTINCT id FROM r) SELECT source_id, target_id FROM e WHERE type = 'CALLS' AND source_id IN (SELECT id FROM near) AND target_id IN (SELECT id FROM near)", recursive=True)
def traverse_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The edge type filters the edges that come out, not the ways taken."""
    g = Graph.load(spark, d)
    near = traverse.reach(g.edges, seed(spark, HUB), 2, forward=False)
    return g.induced(near).where("type = 'CALLS'").select("source_id", "target_id")


_IMPACT = _reach(2, False).format(seed=HUB) + f", dn(id, depth) AS (SELECT '{HUB}', 0 UNION SELECT e.target_id, depth + 1 FROM dn JOIN e ON e.source_id = dn.id WHERE depth < 2), im AS (SELECT 'upstream' AS direction, id FROM r WHERE id <> '{HUB}' UNION SELECT 'downstream', id FROM dn WHERE id <> '{HUB}'), bt AS (SELECT direction, type, tier, count(*) AS n, count(*) FILTER (WHERE is_stale) AS n_stale FROM im JOIN n USING (id) GROUP BY ALL)"


@query(f"{_IMPACT} SELECT direction, type, tier, n, n_stale FROM bt", recursive=True)
def impact_by_type(spark: SparkSession, d: str) -> DataFrame:
    return impact.impact(Graph.load(spark, d), seed(spark, HUB), 2)


@query(f"{_IMPACT}, t AS (SELECT coalesce(sum(n) FILTER (WHERE direction = 'upstream'), 0)::BIGINT AS n_up, coalesce(sum(n) FILTER (WHERE direction = 'downstream'), 0)::BIGINT AS n_down FROM bt) SELECT n_up, n_down, CASE WHEN n_up = 0 AND n_down = 0 THEN 'ISOLATED' WHEN n_up > 10 THEN 'HIGH' WHEN n_up > 5 THEN 'MEDIUM' ELSE 'LOW' END AS cli, CASE WHEN n_up > 10 THEN 'CRITICAL' WHEN n_up > 5 THEN 'HIGH' WHEN n_up > 2 THEN 'MEDIUM' ELSE 'LOW' END AS tool, CASE WHEN n_up > 5 THEN 'High' WHEN n_down > 10 THEN 'Medium' END AS context FROM t", recursive=True)
def impact_risk(spark: SparkSession, d: str) -> DataFrame:
    return impact.risk_of(impact.impact(Graph.load(spark, d), seed(spark, HUB), 2))


@query("SELECT id, length('{\"id\":\"' || id || '\",\"type\":\"' || type || '\",\"name\":\"' || name || '\"}') // 4 AS tokens FROM n WHERE name IS NOT NULL AND type IS NOT NULL")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    n = Graph.load(spark, d).nodes.where("name is not null and type is not null")
    return n.select("id", impact.tokens(F.to_json(F.struct("id", "type", "name"))).alias("tokens"))


@query(", c AS (SELECT id, type, ord, confidence, length(id) + length(name) AS cost FROM n), w AS (SELECT *, sum(cost) OVER (PARTITION BY type ORDER BY confidence DESC, ord ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT type, id FROM w WHERE run <= 4000")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("type").orderBy(F.desc("confidence"), F.asc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    n = Graph.load(spark, d).nodes.withColumn("run", F.sum(F.length("id") + F.length("name")).over(w))
    return n.where("run <= 4000").select("type", "id")


@query()
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    return impact.within_budget(impact.pack(Graph.load(spark, d), HUB), 4000).select("section", "id", "line", "cost")


@query()
def pack_text(spark: SparkSession, d: str) -> DataFrame:
    rows = [r.asDict() for r in impact.within_budget(impact.pack(Graph.load(spark, d), HUB, 1), 1000).collect()]
    level = impact.fitting_level(rows, 1000)
    return spark.createDataFrame([(level, impact.truncate(impact.render(rows, level), 1000))], "level string, text string")


@query()
def context_levels(spark: SparkSession, d: str) -> DataFrame:
    """The pack of the hub at each detail level: how many nodes its budget keeps, edges among them, and the risk."""
    from graphloom import api

    g = Graph.load(spark, d)
    packs = [api.context(g, HUB, level, 2) for level in impact.LEVEL_TOKENS]
    rows = [(p["level"], len(p["relevant_nodes"]), len(p["upstream"]), len(p["downstream"]), len(p["edges"]), p.get("risk_assessment")) for p in packs]
    return spark.createDataFrame(rows, "level string, n_target int, n_upstream int, n_downstream int, n_edges int, risk string")


_FILE = "replace(location.file_path, '\\', '/')"


@query(f", ch AS (SELECT file_path AS path FROM source_files WHERE committed_at >= TIMESTAMP '2025-09-01'), f AS (SELECT id, {_FILE} AS file, regexp_extract({_FILE}, '[^/]*$') AS base FROM n WHERE location.file_path IS NOT NULL) SELECT path, id FROM f JOIN ch ON regexp_extract(path, '[^/]*$') = base WHERE ends_with(file, path) OR ends_with(path, file)")
def detect_changes(spark: SparkSession, d: str) -> DataFrame:
    paths = load(spark, d, "source_files").where("committed_at >= timestamp'2025-09-01'").select(F.col("file_path").alias("path"))
    return impact.changed_nodes(Graph.load(spark, d), paths)


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.sql
