"""Queries on references, hierarchies and snapshots, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import hierarchy, orphans, snapshots
from graphloom.session import BLANKS, load, plain


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.edge_orphans(load(spark, d, "graph_nodes"), load(spark, d, "graph_edges"), plain).select("edge_id", "endpoint")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(load(spark, d, "graph_nodes"), load(spark, d, "graph_edges"), plain)


def forest(spark: SparkSession, d: str, paths: bool = False) -> hierarchy.Forest:
    return hierarchy.build_forest(load(spark, d, "graph_nodes"), plain("id"), plain("parent_id"), F.col("name"), paths)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cyclic_nodes(forest(spark, d))


def p6_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy_table(forest(spark, d, paths=True))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """The descendants of all projects and workspaces."""
    tops = load(spark, d, "graph_nodes").where("type in ('Project', 'Workspace')").select(plain("id").alias("id"))
    return hierarchy.descendants(forest(spark, d), tops)


def p6_descendants_all(spark: SparkSession, d: str) -> DataFrame:
    """The descendants of each node that reaches a root."""
    return hierarchy.descendants(forest(spark, d))


def _fields() -> list[Column]:
    digest = F.btrim(F.regexp_replace(plain("source_hash"), "^sha256:", ""), F.lit(BLANKS))
    return [*(plain(c) for c in ("type", "name", "parent_id", "language")), digest]


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(load(spark, d, "node_snapshots"), "snapshot_no", plain("id"), [F.col("last_updated")], _fields())


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).select("snapshot_no", "id", "change")


def p7_run_check(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.run_disagreements(_changes(spark, d), F.split_part(F.col("id"), F.lit(":"), F.lit(2)), load(spark, d, "reindex_runs"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_report, p6_found, p6_hierarchy, p6_descendants, p6_descendants_all, p7_found, p7_run_check)}


TRIM = "lower(trim({0}, ' \t\n\r\x0b\x0c\xa0'))"
_ORPHANS = f"""ends AS (
  SELECT edge_id, 'source_id' AS endpoint, {TRIM.format('source_id')} AS ref, indexed_at FROM graph_edges WHERE source_id IS NOT NULL
  UNION ALL SELECT edge_id, 'target_id', {TRIM.format('target_id')}, indexed_at FROM graph_edges WHERE target_id IS NOT NULL),
marked AS (SELECT *, NOT EXISTS (SELECT 1 FROM graph_nodes n WHERE n.id = ref AND n.first_seen <= indexed_at AND (n.removed_at IS NULL OR n.removed_at > indexed_at)) AS orphan FROM ends)"""
_WALK = f"""links AS (SELECT n.id, n.name, p.id AS parent FROM graph_nodes n LEFT JOIN graph_nodes p ON p.id = {TRIM.format('n.parent_id')}),
walk(id, cur) AS (SELECT id, parent FROM links WHERE parent IS NOT NULL UNION SELECT w.id, l.parent FROM walk w JOIN links l ON l.id = w.cur WHERE l.parent IS NOT NULL),
ring AS (SELECT DISTINCT id FROM walk WHERE id = cur),
ringed AS (SELECT r.id, min(w.cur) AS cycle_id FROM ring r JOIN walk w ON w.id = r.id GROUP BY r.id),
hung AS (SELECT id, cycle_id FROM ringed UNION SELECT w.id, r.cycle_id FROM walk w JOIN ringed r ON r.id = w.cur)"""
_TREE = f"""{_WALK},
tree AS (SELECT id, 0 AS depth, id AS root_id, coalesce(name, '') AS path, [id] AS line FROM links WHERE parent IS NULL
  UNION ALL SELECT l.id, t.depth + 1, t.root_id, t.path || '/' || coalesce(l.name, ''), list_append(t.line, l.id) FROM tree t JOIN links l ON l.parent = t.id),
counted AS (SELECT a AS id, count(*) AS n FROM (SELECT unnest(line) AS a FROM tree) GROUP BY a),
numbered AS (SELECT t.*, c.n, row_number() OVER (ORDER BY line) - 1 AS lo FROM tree t JOIN counted c ON c.id = t.id)"""
_CHANGES = f"""plain AS (
  SELECT snapshot_no, {TRIM.format('id')} AS id, {TRIM.format('type')} AS a, {TRIM.format('name')} AS b, {TRIM.format('parent_id')} AS c, {TRIM.format('language')} AS d,
    trim(regexp_replace({TRIM.format('source_hash')}, '^sha256:', ''), ' \t\n\r\x0b\x0c\xa0') AS e, last_updated FROM node_snapshots),
ranked AS (SELECT *, row_number() OVER (PARTITION BY snapshot_no, id ORDER BY last_updated DESC, a DESC NULLS LAST, b DESC NULLS LAST, c DESC NULLS LAST, d DESC NULLS LAST, e DESC NULLS LAST) AS k FROM plain),
last AS (SELECT * FROM ranked WHERE k = 1),
numbers AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT snapshot_no FROM node_snapshots)),
new AS (SELECT l.*, n.before FROM last l JOIN numbers n USING (snapshot_no) WHERE n.before IS NOT NULL),
old AS (SELECT l.*, n.snapshot_no AS later FROM last l JOIN numbers n ON n.before = l.snapshot_no),
changes AS (
  SELECT coalesce(n.snapshot_no, o.later) AS snapshot_no, coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM new n FULL JOIN old o ON o.id = n.id AND o.later = n.snapshot_no
  WHERE o.id IS NULL OR n.id IS NULL OR n.a IS DISTINCT FROM o.a OR n.b IS DISTINCT FROM o.b OR n.c IS DISTINCT FROM o.c OR n.d IS DISTINCT FROM o.d OR n.e IS DISTINCT FROM o.e)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_ORPHANS} SELECT edge_id, endpoint FROM marked WHERE orphan",
        "p1_report": f"WITH {_ORPHANS} SELECT endpoint, strftime(indexed_at, '%Y-%m') AS period, count(*) AS n_refs, count(*) FILTER (WHERE orphan) AS n_orphans, count(DISTINCT ref) FILTER (WHERE orphan) AS orphan_ids FROM marked GROUP BY ALL",
        "p6_found": f"WITH RECURSIVE {_WALK} SELECT id, cycle_id FROM hung",
        "p6_hierarchy": f"WITH RECURSIVE {_TREE} SELECT id, depth, root_id, path, lo, lo + n - 1 AS hi, n - 1 AS n_descendants FROM numbered",
        "p6_descendants": f"WITH RECURSIVE {_TREE} SELECT u.a AS ancestor, t.id, t.depth - s.depth AS distance FROM tree t, unnest(t.line) AS u(a) JOIN tree s ON s.id = u.a JOIN graph_nodes g ON g.id = u.a WHERE g.type IN ('Project', 'Workspace') AND t.id <> u.a",
        "p6_descendants_all": f"WITH RECURSIVE {_TREE} SELECT u.a AS ancestor, t.id, t.depth - s.depth AS distance FROM tree t, unnest(t.line) AS u(a) JOIN tree s ON s.id = u.a WHERE t.id <> u.a",
        "p7_found": f"WITH {_CHANGES} SELECT snapshot_no, id, change FROM changes",
        "p7_run_check": f"""WITH {_CHANGES},
found AS (SELECT split_part(id, ':', 2) AS project, snapshot_no, count(*) FILTER (WHERE change = 'added') AS a, count(*) FILTER (WHERE change = 'changed') AS c, count(*) FILTER (WHERE change = 'removed') AS r FROM changes GROUP BY ALL),
told AS (SELECT project, snapshot_no, sum(coalesce(nodes_added, 0))::BIGINT AS a, sum(coalesce(nodes_updated, 0))::BIGINT AS c, sum(coalesce(nodes_removed, 0))::BIGINT AS r FROM reindex_runs GROUP BY ALL)
SELECT project, snapshot_no, coalesce(f.a, 0) AS found_added, coalesce(t.a, 0) AS reported_added, coalesce(f.c, 0) AS found_changed, coalesce(t.c, 0) AS reported_changed, coalesce(f.r, 0) AS found_removed, coalesce(t.r, 0) AS reported_removed
FROM found f FULL JOIN told t USING (project, snapshot_no)
WHERE coalesce(f.a, 0) <> coalesce(t.a, 0) OR coalesce(f.c, 0) <> coalesce(t.c, 0) OR coalesce(f.r, 0) <> coalesce(t.r, 0)""",
    }
