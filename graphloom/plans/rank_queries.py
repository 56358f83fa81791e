"""Ranking, community and architecture queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph, top_by
from graphloom.operators import rank
from graphloom.plans.registry import Registry
from graphloom.plans.store_queries import _DEGREE

R = Registry()
query = R.query
_HOLD = "'CONTAINS', 'DEFINES'"


def _pagerank_sql(rounds: int) -> str:
    out = """, vx AS (SELECT id FROM n UNION SELECT source_id FROM s UNION SELECT target_id FROM s), cn AS (SELECT count(*)::DOUBLE AS c FROM vx), ow AS (SELECT source_id, sum(coalesce(weight, 0.5)) AS a FROM s GROUP BY 1 HAVING sum(coalesce(weight, 0.5)) > 0),
lk AS MATERIALIZED (SELECT s.source_id, s.target_id, coalesce(weight, 0.5) / a AS w FROM s JOIN ow USING (source_id)), r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / c AS r FROM vx, cn)"""
    for k in range(rounds):
        out += f""", l{k} AS MATERIALIZED (SELECT coalesce(sum(r), 0) AS x FROM r{k} WHERE id NOT IN (SELECT source_id FROM ow)), g{k} AS MATERIALIZED (SELECT target_id AS id, sum(r * w) AS g FROM lk JOIN r{k} ON r{k}.id = source_id GROUP BY 1),
r{k + 1} AS MATERIALIZED (SELECT vx.id, 0.85 * (coalesce(g, 0) + l{k}.x / c) + 0.15 / c AS r FROM vx LEFT JOIN g{k} USING (id), l{k}, cn)"""
    return out


@query(_pagerank_sql(12) + " SELECT id, round(r, 9) AS rank FROM r12 JOIN n USING (id)")
def pagerank_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Twelve rounds, so that the SQL can be unrolled; the operator itself runs to convergence."""
    return rank.graph_pagerank(Graph.load(spark, d), rounds=12, tol=0).select("id", F.round("rank", 9).alias("rank"))


_TOP = "v0 AS (SELECT id FROM n WHERE type IN ('Workspace', 'Project', 'Module')), "


@query(""", v AS MATERIALIZED (SELECT id FROM n WHERE type = 'Module' AND starts_with(id, 'module:platform-core')), l AS MATERIALIZED (SELECT DISTINCT source_id, target_id FROM s WHERE source_id <> target_id AND source_id IN (SELECT id FROM v) AND target_id IN (SELECT id FROM v)),
w(a, b, d) AS (SELECT id, id, 0 FROM v UNION SELECT w.a, l.target_id, d + 1 FROM w JOIN l ON l.source_id = w.b WHERE d < 40), ds AS MATERIALIZED (SELECT a, b, min(d) AS d FROM w GROUP BY a, b),
sg(a, b, d, c) AS (SELECT id, id, 0, 1::DOUBLE FROM v UNION ALL SELECT a, b, d, c FROM (SELECT sg.a, l.target_id AS b, sg.d + 1 AS d, sum(sg.c) AS c FROM sg JOIN l ON l.source_id = sg.b JOIN ds ON ds.a = sg.a AND ds.b = l.target_id AND ds.d = sg.d + 1 GROUP BY 1, 2, 3)),
sm AS (SELECT a, b, d, sum(c) AS c FROM sg GROUP BY ALL),
x AS (SELECT p.b AS id, sum(p.c * q.c / t.c) AS bw FROM sm p JOIN sm q ON q.a = p.b JOIN sm t ON t.a = p.a AND t.b = q.b WHERE p.a <> p.b AND q.a <> q.b AND p.d + q.d = t.d AND p.a <> q.b GROUP BY 1), c AS (SELECT count(*) AS c FROM v)
SELECT v.id, round(coalesce(bw, 0) / ((c.c - 1) * (c.c - 2)), 8) AS betweenness FROM v LEFT JOIN x USING (id), c""", recursive=True)
def betweenness_modules(spark: SparkSession, d: str) -> DataFrame:
    """The modules of the largest project and the edges between them."""
    g = Graph.load(spark, d)
    mods = g.nodes.where("type = 'Module' and startswith(id, 'module:platform-core')").select("id")
    return rank.betweenness(mods, g.induced(mods)).withColumn("betweenness", F.round("betweenness", 8))


@query()
def betweenness_all(spark: SparkSession, d: str) -> DataFrame:
    """All nodes and the edges between them, exact."""
    g = Graph.load(spark, d)
    return rank.betweenness(g.nodes, g.simple())


@query()
def importance(spark: SparkSession, d: str) -> DataFrame:
    return rank.importance(Graph.load(spark, d)).select("id", F.round("pagerank", 6).alias("pagerank"), "betweenness", "centrality", "score")


@query()
def top_nodes(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.load(spark, d)
    return top_by(rank.importance(g).join(g.nodes.select("id", "tier"), "id").where("tier = 'micro'"), 10, F.desc("score"), F.asc("ord")).select("id", "score")


@query(f"{_DEGREE} SELECT n.id, row_number() OVER (ORDER BY dg.in_degree DESC NULLS LAST, ord) AS place FROM n LEFT JOIN dg USING (id) WHERE type = 'Endpoint'")
def rank_for_context(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    from graphloom.operators.store import simple_degrees

    g = Graph.load(spark, d)
    ids = g.nodes.where("type = 'Endpoint'").select("id", F.col("ord").alias("pos"))
    scores = simple_degrees(g).select("id", F.col("in_degree").alias("score"))
    return rank.in_order_of_score(ids, scores).withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "pos"))).select("id", "place")


@query(f"SELECT id FROM n WHERE type NOT IN ('Workspace', 'Project') AND id NOT IN (SELECT source_id FROM s WHERE type NOT IN ({_HOLD})) AND id NOT IN (SELECT target_id FROM s WHERE type NOT IN ({_HOLD}))")
def semantic_orphans(spark: SparkSession, d: str) -> DataFrame:
    return rank.semantic_orphans(Graph.load(spark, d)).select("id")


@query("SELECT id FROM n WHERE type NOT IN ('Workspace', 'Project') AND id NOT IN (SELECT source_id FROM e) AND id NOT IN (SELECT target_id FROM e)")
def degree_orphans(spark: SparkSession, d: str) -> DataFrame:
    return rank.degree_orphans(Graph.load(spark, d)).select("id")


_MOD = ", m AS (SELECT id, parent_id AS module FROM n WHERE parent_id IS NOT NULL)"


@query(f"""{_MOD}, k AS (SELECT a.module AS ms, b.module AS mt FROM e JOIN m a ON a.id = source_id JOIN m b ON b.id = target_id WHERE e.type NOT IN ({_HOLD})), t AS (SELECT count(*) AS n_semantic, count(*) FILTER (WHERE ms <> mt) AS n_cross FROM k)
SELECT n_semantic, n_cross, round(n_cross / n_semantic, 6)::DOUBLE AS ratio, round(CASE WHEN n_cross / n_semantic <= 0.3 THEN 100.0 WHEN n_cross / n_semantic >= 0.6 THEN greatest(0.0, 100 - n_cross / n_semantic * 100) ELSE 100 - (n_cross / n_semantic - 0.3) * 200 END, 6)::DOUBLE AS score FROM t""")
def coupling(spark: SparkSession, d: str) -> DataFrame:
    return rank.coupling(Graph.load(spark, d))


@query(f"""{_MOD}, sz AS (SELECT module, count(*) AS c FROM m GROUP BY 1 HAVING count(*) > 1), i AS (SELECT a.module, count(*) AS k FROM (SELECT DISTINCT source_id, target_id FROM e WHERE type NOT IN ({_HOLD}) AND source_id <> target_id) x JOIN m a ON a.id = source_id JOIN m b ON b.id = target_id WHERE a.module = b.module GROUP BY 1),
t AS (SELECT count(*) AS n_modules, avg(coalesce(k, 0) / (c * (c - 1.0))::DOUBLE) AS average FROM sz LEFT JOIN i USING (module)) SELECT n_modules, round(average, 6) AS average, round(least(100.0, 30.0 + 116.7 * average), 4)::DOUBLE AS score FROM t""")
def module_cohesion(spark: SparkSession, d: str) -> DataFrame:
    return rank.module_cohesion(Graph.load(spark, d))


@query()
def architecture(spark: SparkSession, d: str) -> DataFrame:
    a = rank.architecture(Graph.load(spark, d))
    return spark.createDataFrame([tuple(float(v) for v in a.values())], ", ".join(f"{k} double" for k in a))


@query()
def louvain_files(spark: SparkSession, d: str) -> DataFrame:
    members, links = rank.cluster_links(Graph.load(spark, d), ["Module", "File"], None)
    return rank.communities(members, links)


@query()
def louvain_semantic(spark: SparkSession, d: str) -> DataFrame:
    members, links = rank.cluster_links(Graph.load(spark, d), rank.CLUSTER_NODES, rank.CLUSTER_EDGES)
    return rank.communities(members, links)


_PROJECT = "split_part(id, ':', 2)"


@query(f""", f AS (SELECT id, {_PROJECT} AS community FROM n), z AS (SELECT community, count(*) AS size FROM f GROUP BY 1), i AS (SELECT a.community, count(*) AS k FROM (SELECT DISTINCT source_id, target_id FROM e WHERE source_id <> target_id) x JOIN f a ON a.id = source_id JOIN f b ON b.id = target_id WHERE a.community = b.community GROUP BY 1)
SELECT community, size, coalesce(k, 0) AS n_inner, CASE WHEN size = 1 THEN 1.0 ELSE round(coalesce(k, 0) / (size * (size - 1.0)), 6) END::DOUBLE AS cohesion FROM z LEFT JOIN i USING (community)""")
def cluster_cohesion(spark: SparkSession, d: str) -> DataFrame:
    """Projects as clusters."""
    g = Graph.load(spark, d)
    return rank.cohesion(g.nodes.select("id", F.split_part("id", F.lit(":"), F.lit(2)).alias("community")), g.edges)


@query(rf""", w AS (SELECT {_PROJECT} AS community, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(name, '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: length(x) > 2)) AS word FROM n), c AS (SELECT community, word, count(*) AS k FROM w GROUP BY ALL)
SELECT community, word AS label FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY k DESC, word) AS place FROM c) WHERE place = 1""")
def cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.load(spark, d)
    return rank.cluster_labels(g.nodes.select("id", F.split_part("id", F.lit(":"), F.lit(2)).alias("community")), g.nodes)


@query(f", f AS (SELECT {_PROJECT} AS community, count(*) AS size FROM n GROUP BY 1) SELECT community, size FROM f WHERE size >= 3 ORDER BY size DESC, community LIMIT 20")
def list_clusters(spark: SparkSession, d: str) -> DataFrame:
    n = Graph.load(spark, d).nodes.groupBy(F.split_part("id", F.lit(":"), F.lit(2)).alias("community")).agg(F.count(F.lit(1)).alias("size")).where("size >= 3")
    return top_by(n, 20, F.desc("size"), F.asc("community"))


@query()
def cluster_report(spark: SparkSession, d: str) -> DataFrame:
    """The semantic communities with size, cohesion and label."""
    from graphloom import api

    return api.clusters(Graph.load(spark, d)).select("community", "size", "n_inner", "cohesion", "label")


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.sql
