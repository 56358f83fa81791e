"""Validation, flow and merge queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.graph import Graph
from graphloom.operators import merge, quality
from graphloom.plans.registry import GRAPH, TRIM, Registry
from graphloom.session import load, plain

R = Registry()
query = R.query
_KEY = "source_id || '->' || target_id || ':' || type"
_CON = ", con(type, src, tgt) AS (VALUES " + schema.sql_values([(t, f" {' '.join(a)} ", f" {' '.join(b)} ") for t, (a, b) in schema.CONSTRAINTS.items()]) + ")"
_PAIR = ", pr(i, type) AS (VALUES " + schema.sql_values([(i, t) for i, ab in enumerate(schema.PAIRS) for t in ab]) + ")"
_ORPHAN = "SELECT 'warning' AS severity, 'orphan' AS category, id AS subject, 'no edges' AS detail FROM n WHERE type NOT IN ('Workspace', 'Project') AND id NOT IN (SELECT source_id FROM e) AND id NOT IN (SELECT target_id FROM e)"
_DANGLING = f"SELECT 'error' AS severity, 'dangling' AS category, {_KEY} AS subject, 'no source' AS detail FROM e WHERE source_id NOT IN (SELECT id FROM n) UNION ALL SELECT 'error', 'dangling', {_KEY}, 'no target' FROM e WHERE target_id NOT IN (SELECT id FROM n)"
_ENDS = "(SELECT e.*, a.type AS st, b.type AS tt, src, tgt FROM e JOIN con USING (type) LEFT JOIN n a ON a.id = source_id LEFT JOIN n b ON b.id = target_id)"
_CONSTRAINT = f"SELECT 'warning' AS severity, 'constraint' AS category, {_KEY} AS subject, 'source ' || st AS detail FROM {_ENDS} WHERE NOT contains(src, ' ' || st || ' ') UNION ALL SELECT 'warning', 'constraint', {_KEY}, 'target ' || tt FROM {_ENDS} WHERE NOT contains(tgt, ' ' || tt || ' ')"
_BIDIR = "SELECT 'info' AS severity, 'bidirectional' AS category, target_id AS subject, 'only ' || min(e.type) AS detail FROM e JOIN pr USING (type) GROUP BY target_id, i HAVING count(DISTINCT e.type) = 1"


@query(_ORPHAN)
def orphan_issues(spark: SparkSession, d: str) -> DataFrame:
    return quality.orphan_issues(Graph.load(spark, d))


@query(_DANGLING)
def dangling_issues(spark: SparkSession, d: str) -> DataFrame:
    return quality.dangling_issues(Graph.load(spark, d))


@query(f"{_CON} {_CONSTRAINT}")
def constraint_issues(spark: SparkSession, d: str) -> DataFrame:
    return quality.constraint_issues(Graph.load(spark, d))


@query(f"{_PAIR} {_BIDIR}")
def bidirectional_issues(spark: SparkSession, d: str) -> DataFrame:
    return quality.pair_issues(Graph.load(spark, d))


@query(f"{_CON}{_PAIR}, iss AS ({_ORPHAN} UNION ALL {_DANGLING} UNION ALL {_CONSTRAINT} UNION ALL {_BIDIR}) SELECT category, severity, count(*) AS n FROM iss GROUP BY ALL")
def issue_tally(spark: SparkSession, d: str) -> DataFrame:
    return quality.issues(Graph.load(spark, d)).groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source_id, target_id, type, (SELECT type FROM n WHERE id = source_id) AS source_type, (SELECT type FROM n WHERE id = target_id) AS target_type FROM e")
def validate_join(spark: SparkSession, d: str) -> DataFrame:
    return Graph.load(spark, d).typed_ends().select("source_id", "target_id", "type", "source_type", "target_type")


_ADJ = """, ps AS (SELECT id, bool_or(provenance = 'scanner') AS sc, bool_or(provenance = 'llm') AS ll FROM (SELECT source_id AS id, provenance FROM e UNION ALL SELECT target_id, provenance FROM e) GROUP BY 1),
ad AS (SELECT id, confidence, (CASE WHEN (provenance = 'scanner' AND coalesce(ll, false)) OR (provenance = 'llm' AND coalesce(sc, false)) THEN 0.1 ELSE 0.0 END)::DOUBLE + (CASE WHEN provenance = 'llm' AND NOT coalesce(sc, false) THEN -0.1 ELSE 0.0 END)::DOUBLE + (CASE WHEN is_stale THEN -0.2 ELSE 0.0 END)::DOUBLE AS ch FROM n LEFT JOIN ps USING (id)),
aj AS (SELECT id, confidence, CASE WHEN ch = 0 THEN confidence ELSE greatest(0.0, least(1.0, confidence + ch)) END AS adjusted FROM ad)"""


@query(f"{_ADJ} SELECT id, round(adjusted, 9) AS adjusted FROM aj")
def confidence_node(spark: SparkSession, d: str) -> DataFrame:
    return quality.adjusted_confidence(Graph.load(spark, d)).select("id", F.round("adjusted", 9).alias("adjusted"))


@query(f"""{_ADJ}, hi AS (SELECT id FROM aj WHERE adjusted >= 0.8), sl AS (SELECT id, count(*) AS k FROM (SELECT unnest([source_id, target_id]) AS id FROM e WHERE source_id IN (SELECT id FROM hi) AND target_id IN (SELECT id FROM hi)) GROUP BY 1)
SELECT id, round(CASE WHEN k > 0 THEN least(1.0, adjusted + 0.05 * least(k, 6)) ELSE adjusted END, 9)::DOUBLE AS boosted, coalesce(k, 0) AS slots FROM aj LEFT JOIN sl USING (id)""")
def confidence_boost(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.load(spark, d)
    return quality.boosted_confidence(g, quality.adjusted_confidence(g)).withColumn("boosted", F.round("boosted", 9))


@query(f"""{_CON}{_PAIR}, iss AS ({_ORPHAN} UNION ALL {_DANGLING} UNION ALL {_CONSTRAINT} UNION ALL {_BIDIR}){_ADJ}, hi AS (SELECT id FROM aj WHERE adjusted >= 0.8), sl AS (SELECT id, count(*) AS k FROM (SELECT unnest([source_id, target_id]) AS id FROM e WHERE source_id IN (SELECT id FROM hi) AND target_id IN (SELECT id FROM hi)) GROUP BY 1)
SELECT category, severity, count(*) AS n FROM iss GROUP BY ALL UNION ALL SELECT 'checks', 'total', 2 * (SELECT count(*) FROM n) + 2 * (SELECT count(*) FROM e) + 10
UNION ALL SELECT 'adjusted', 'total', (SELECT count(*) FROM aj WHERE adjusted <> confidence) + (SELECT count(*) FROM aj JOIN sl USING (id) WHERE adjusted < 1.0)""")
def validate_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.report(Graph.load(spark, d), fix=True)


_PAT = ", pt(i, p, sc) AS (VALUES " + schema.sql_values([(i, p, s) for i, (p, s) in enumerate(quality.ENTRY_PATTERNS.items())]) + ")"
_ENTRY = f"""{_PAT}, bp AS (SELECT id, arg_max(p, sc * 1000 - i) AS p, max(sc) AS sc FROM n JOIN pt ON contains(lower(name), p) WHERE type = 'Function' GROUP BY id),
es AS (SELECT id, ord, sc::DOUBLE AS score, 'name matches ''' || p || '''' AS reason FROM n JOIN bp USING (id) WHERE (metadata->>'$.is_exported') IS DISTINCT FROM 'true'
UNION ALL SELECT id, ord, least(coalesce(sc + 0.1, 0.6), 1.0)::DOUBLE, CASE WHEN p IS NULL THEN 'exported function' ELSE 'name matches ''' || p || '''' END FROM n LEFT JOIN bp USING (id) WHERE type = 'Function' AND (metadata->>'$.is_exported') = 'true'
UNION ALL SELECT id, ord, 0.5, 'uncalled function with outgoing calls' FROM n WHERE type = 'Function' AND (metadata->>'$.is_exported') IS DISTINCT FROM 'true' AND id NOT IN (SELECT id FROM bp) AND id NOT IN (SELECT target_id FROM e WHERE type = 'CALLS') AND id IN (SELECT source_id FROM e WHERE type = 'CALLS')
UNION ALL SELECT id, ord, CASE type WHEN 'Endpoint' THEN 1.0 WHEN 'AsyncHandler' THEN 0.85 ELSE 0.7 END, CASE type WHEN 'Endpoint' THEN 'HTTP endpoint' WHEN 'AsyncHandler' THEN 'async handler' ELSE 'middleware' END FROM n WHERE type IN ('Endpoint', 'AsyncHandler', 'Middleware'))"""


@query(f"{_ENTRY} SELECT id, round(score, 6) AS score, reason, ord FROM es")
def entry_scores(spark: SparkSession, d: str) -> DataFrame:
    return quality.entry_scores(Graph.load(spark, d))


@query()
def flows(spark: SparkSession, d: str) -> DataFrame:
    return quality.flows(Graph.load(spark, d)).select("entry", "kind", "name", "n_steps", "place")


@query()
def flow_nodes(spark: SparkSession, d: str) -> DataFrame:
    return quality.flow_graph(quality.flows(Graph.load(spark, d)), 0)[0]


@query()
def flow_edges(spark: SparkSession, d: str) -> DataFrame:
    return quality.flow_graph(quality.flows(Graph.load(spark, d)), 0)[1]


@query()
def list_flows(spark: SparkSession, d: str) -> DataFrame:
    f = quality.flow_graph(quality.flows(Graph.load(spark, d)), 0)[0]
    return f.select("id", "name", F.get_json_object("metadata", "$.step_count").cast("int").alias("steps"), F.get_json_object("metadata", "$.flow_type").alias("kind")).orderBy(F.desc("steps"), "id").limit(20)


FIELDS = ["type", "name", "description", "language", "source_hash", "confidence", "provenance", "tags"]


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The stored nodes, and for each node the record delivered last."""
    g = Graph.load(spark, d)
    r = load(spark, d, "node_records").withColumns({"id": plain("node_id"), "provenance": plain("provenance")})
    last = r.groupBy("id").agg(F.max(F.struct("record_id", *FIELDS, "version")).alias("v")).select("id", *[F.col(f"v.{f}").alias(f) for f in [*FIELDS, "version"]])
    return g.nodes.select("id", *FIELDS, "version"), last


_SPEC = {t: schema.TIER_SPECIFICITY[tier] + schema.TYPE_BONUS.get(t, 0) for tier, ts in schema.TIERS.items() for t in ts}
_case = lambda c, table: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " END"
_CHAIN = f"""CASE WHEN round(ic - ec, 9) > 0.1 THEN 'use_incoming' WHEN round(ic - ec, 9) < -0.1 THEN 'keep_existing' WHEN coalesce(it <> et, false) AND {_case('it', _SPEC)} > {_case('et', _SPEC)} THEN 'use_incoming' WHEN coalesce(it <> et, false) AND {_case('it', _SPEC)} < {_case('et', _SPEC)} THEN 'keep_existing'
WHEN {_case('ip', schema.TRUST)} > {_case('ep', schema.TRUST)} THEN 'use_incoming' WHEN {_case('ip', schema.TRUST)} < {_case('ep', schema.TRUST)} THEN 'keep_existing' ELSE 'flag_review' END"""
_MERGE = f""", rc AS (SELECT DISTINCT {TRIM.format('node_id')} AS id, record_id, type, name, description, language, source_hash, confidence, {TRIM.format('provenance')} AS provenance, tags FROM node_records),
rl AS (SELECT * FROM rc WHERE (id, record_id) IN (SELECT (id, max(record_id)) FROM rc GROUP BY id)),
mj AS (SELECT a.id, a.type AS et, b.type AS it, a.confidence AS ec, CASE WHEN isnan(b.confidence) THEN NULL ELSE b.confidence END AS ic, a.provenance AS ep, b.provenance AS ip, a.name AS en, b.name AS inm, a.description AS ed, b.description AS idd, a.language AS el, b.language AS il, a.source_hash AS eh, b.source_hash AS ih, a.tags AS eg, b.tags AS ig FROM n a JOIN rl b USING (id)),
mc AS (SELECT id AS node_id, 'type' AS field, et AS existing_value, it AS incoming_value, {_CHAIN} AS resolution FROM mj WHERE et IS DISTINCT FROM it
UNION ALL SELECT id, 'name', en, inm, {_CHAIN} FROM mj WHERE en IS DISTINCT FROM inm
UNION ALL SELECT id, 'description', ed, idd, CASE WHEN ed IS NULL THEN 'use_incoming' WHEN idd IS NULL THEN 'keep_existing' ELSE {_CHAIN} END FROM mj WHERE ed IS DISTINCT FROM idd
UNION ALL SELECT id, 'language', el, il, CASE WHEN el IS NULL THEN 'use_incoming' WHEN il IS NULL THEN 'keep_existing' ELSE {_CHAIN} END FROM mj WHERE el IS DISTINCT FROM il
UNION ALL SELECT id, 'source_hash', eh, ih, CASE WHEN eh IS NULL THEN 'use_incoming' WHEN ih IS NULL THEN 'keep_existing' ELSE {_CHAIN} END FROM mj WHERE eh IS DISTINCT FROM ih
UNION ALL SELECT id, 'confidence', ec::VARCHAR, ic::VARCHAR, CASE WHEN coalesce(ic > ec, ec IS NULL) THEN 'use_incoming' ELSE 'keep_existing' END FROM mj WHERE ec IS DISTINCT FROM ic
UNION ALL SELECT id, 'provenance', ep, ip, CASE WHEN coalesce({_case('ip', schema.TRUST)}, 0) > coalesce({_case('ep', schema.TRUST)}, 0) THEN 'use_incoming' WHEN coalesce({_case('ip', schema.TRUST)}, 0) < coalesce({_case('ep', schema.TRUST)}, 0) THEN 'keep_existing' ELSE 'flag_review' END FROM mj WHERE ep IS DISTINCT FROM ip
UNION ALL SELECT id, 'tags', to_json(eg)::VARCHAR, to_json(ig)::VARCHAR, 'merge' FROM mj WHERE len(list_filter(coalesce(ig, []), lambda x: NOT list_contains(coalesce(eg, []), x))) > 0)"""
_FEW = FIELDS


@query(f"{_MERGE} SELECT node_id, field, existing_value, incoming_value, resolution FROM mc")
def field_conflicts(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return merge.field_conflicts(a, b, _FEW)


_PICK = lambda field, e, i: f"CASE WHEN r.id IS NULL THEN n.{field} WHEN n.id IS NULL THEN r.{field} WHEN n.{field} IS DISTINCT FROM r.{field} AND {_RES(field)} = 'use_incoming' THEN r.{field} ELSE n.{field} END AS {field}"
_SUBST = {"ic": "r.confidence", "ec": "n.confidence", "it": "r.type", "et": "n.type", "ip": "r.provenance", "ep": "n.provenance"}


def _RES(field: str) -> str:
    chain = re.sub(r"\b(ic|ec|it|et|ip|ep)\b", lambda m: _SUBST[m[1]], _CHAIN)
    if field == "confidence":
        return "CASE WHEN coalesce(r.confidence > n.confidence, n.confidence IS NULL) THEN 'use_incoming' ELSE 'keep_existing' END"
    if field == "provenance":
        return f"CASE WHEN coalesce({_case('r.provenance', schema.TRUST)}, 0) > coalesce({_case('n.provenance', schema.TRUST)}, 0) THEN 'use_incoming' ELSE 'keep_existing' END"
    if field in merge.PREFER_FILLED:
        return f"CASE WHEN n.{field} IS NULL THEN 'use_incoming' WHEN r.{field} IS NULL THEN 'keep_existing' ELSE {chain} END"
    return chain


_MERGED = f""", rr AS (SELECT DISTINCT {TRIM.format('node_id')} AS id, record_id, type, name, description, language, source_hash, CASE WHEN isnan(confidence) THEN NULL ELSE confidence END AS confidence, {TRIM.format('provenance')} AS provenance, tags, version FROM node_records),
r AS (SELECT * FROM rr WHERE (id, record_id) IN (SELECT (id, max(record_id)) FROM rr GROUP BY id)),
mg AS (SELECT coalesce(n.id, r.id) AS id, n.version AS nv, r.version AS rv, n.id IS NOT NULL AND r.id IS NOT NULL AS both_in, n.type AS t0, n.name AS n0, n.description AS d0, n.language AS l0, n.source_hash AS h0, n.confidence AS c0, n.provenance AS p0, n.tags AS g0, {', '.join(_PICK(f, '', '') for f in FIELDS if f != 'tags')},
  CASE WHEN r.id IS NULL THEN n.tags WHEN n.id IS NULL THEN r.tags ELSE list_concat(list_distinct(coalesce(n.tags, [])), list_filter(list_distinct(coalesce(r.tags, [])), lambda x: NOT list_contains(coalesce(n.tags, []), x))) END AS tags FROM n FULL JOIN r ON r.id = n.id),
ch AS (SELECT *, both_in AND (type IS DISTINCT FROM t0 OR name IS DISTINCT FROM n0 OR description IS DISTINCT FROM d0 OR language IS DISTINCT FROM l0 OR source_hash IS DISTINCT FROM h0 OR confidence IS DISTINCT FROM c0 OR provenance IS DISTINCT FROM p0 OR list_sort(tags) IS DISTINCT FROM list_sort(g0)) AS modified FROM mg)"""


@query(f"{_MERGED} SELECT id, (coalesce(nv, rv) + modified::INT)::INT AS version, modified, type, name, description, language, source_hash, confidence, provenance, list_sort(tags) AS tags FROM ch")
def merge_apply(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return merge.merged_nodes(a, b, FIELDS).withColumn("tags", F.array_sort("tags"))


@query(f"{_MERGE}, up AS (SELECT count(DISTINCT node_id) AS k FROM mc WHERE resolution = 'merge' OR resolution = 'use_incoming' AND incoming_value IS DISTINCT FROM existing_value) SELECT (SELECT count(*) FROM mc) AS n_conflicts, (SELECT count(*) FROM mc WHERE resolution <> 'flag_review') AS n_auto, (SELECT count(*) FROM mc WHERE resolution = 'flag_review') AS n_flagged, k AS n_updated FROM up")
def merge_counts(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return merge.merge_counts(merge.field_conflicts(a, b, _FEW), merge.merged_nodes(a, b, _FEW))


@query(f", rl AS (SELECT id, arg_max(tags, record_id) AS tags FROM (SELECT {TRIM.format('node_id')} AS id, tags, record_id FROM node_records) GROUP BY 1) SELECT id, list_sort(list_distinct(list_concat(coalesce(a.tags, []), coalesce(b.tags, [])))) AS tags FROM n a JOIN rl b USING (id)")
def tag_union(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    merged = merge.merged_nodes(a, b, ["type", "confidence", "provenance", "tags"])
    return merged.join(a.select("id"), "id", "left_semi").join(b.select("id"), "id", "left_semi").select("id", F.sort_array("tags").alias("tags"))


@query()
def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    n = Graph.load(spark, d).nodes
    return n.select("id", merge.merge_json(F.col("metadata"), F.to_json(F.struct(F.col("version").alias("v"), F.col("tier")))).alias("metadata"))


@query(f"{_MERGE}, up AS (SELECT count(DISTINCT node_id) AS k FROM mc WHERE resolution = 'merge' OR resolution = 'use_incoming' AND incoming_value IS DISTINCT FROM existing_value) SELECT (SELECT count(*) FROM mc) AS n_conflicts, (SELECT count(*) FROM mc WHERE resolution <> 'flag_review') AS n_auto, (SELECT count(*) FROM mc WHERE resolution = 'flag_review') AS n_flagged, k AS n_updated, (SELECT count(*) FROM e WHERE ord % 3 = 0 AND source_id IN (SELECT id FROM n UNION SELECT id FROM rl) AND target_id IN (SELECT id FROM n UNION SELECT id FROM rl)) AS edges_added FROM up")
def merge_totals(spark: SparkSession, d: str) -> DataFrame:
    """The counts of a merge with its edges: two thirds of the edges are there, all come in."""
    a, b = _sides(spark, d)
    g = Graph.load(spark, d)
    merged = merge.merged_nodes(a, b, _FEW)
    return merge.merge_counts(merge.field_conflicts(a, b, _FEW), merged, merge.new_edges(Graph(g.nodes, g.edges.where("ord % 3 <> 0")), merged, g.edges))


@query(", o AS (SELECT * FROM e WHERE ord % 3 <> 0) SELECT source_id, target_id, type FROM e WHERE (source_id, target_id, type) NOT IN (SELECT (source_id, target_id, type) FROM o) AND source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)")
def edge_merge(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.load(spark, d)
    return merge.new_edges(Graph(g.nodes, g.edges.where("ord % 3 <> 0")), g.nodes, g.edges).select("source_id", "target_id", "type")


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.sql
