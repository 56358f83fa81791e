"""Sources, sinks, incremental and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.functions.extract import call_costs
from graphloom.operators import incremental, store
from graphloom.plans.registry import Registry
from graphloom.plans.store_queries import HUB
from graphloom.schema import lookup, sql_values
from graphloom.session import load, shared_dir
from graphloom.sources import graphs, workspace
from graphloom.streaming import watch

R = Registry()
query = R.query
LISTING = ["package.json", "turbo.json", ".github/workflows/ci.yml", "apps/web/package.json", "apps/web/src/index.ts", "apps/web/Dockerfile", "apps/api/pyproject.toml", "apps/api/setup.py", "apps/api/terraform/main.tf", "apps/api/inner/go.mod", "apps/node_modules/x/package.json", "tools/Tool.csproj", "docs/readme.md"]


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "source_files").select(F.col("file_path").alias("path"))


@query("SELECT * FROM (VALUES ('', 'nodejs', true), ('apps/api', 'python', false), ('apps/web', 'nodejs', false), ('tools', 'dotnet', false)) t(folder, project_type, is_monorepo)", ctes="")
def project_scan(spark: SparkSession, d: str) -> DataFrame:
    listing = spark.createDataFrame([(p,) for p in LISTING], "path string").unionByName(_paths(spark, d))
    return workspace.projects(listing).select("folder", "project_type", "is_monorepo")


@query("SELECT * FROM (VALUES ('workspace:my_ws:my_ws', 'Workspace'), ('project:my_ws:', 'Project'), ('project:my_ws:api', 'Project'), ('project:my_ws:web', 'Project'), ('project:my_ws:tools', 'Project'), ('infraconfig:my_ws:apps_web_Dockerfile', 'InfraConfig'), ('infraconfig:my_ws:apps_api_terraform', 'InfraConfig')) t(id, type)", ctes="")
def workspace_bridge(spark: SparkSession, d: str) -> DataFrame:
    listing = spark.createDataFrame([(p,) for p in LISTING], "path string")
    return workspace.bridge(workspace.projects(listing), "my ws")[0].select("id", "type")


_TREE = "ps AS (SELECT string_split(file_path, '/') AS p FROM source_files), ex AS (SELECT DISTINCT array_to_string(list_slice(p, 1, k), '/') AS path, p[k] AS name, k = len(p) AS is_file FROM (SELECT p, unnest(generate_series(1, len(p))) AS k FROM ps))"


@query("SELECT CASE WHEN is_file THEN 'file:' ELSE 'module:' END || path AS id, name, CASE WHEN contains(path, '/') THEN 'module:' || regexp_replace(path, '/[^/]*$', '') END AS parent_id FROM ex", ctes=_TREE)
def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    return workspace.tree_nodes(_paths(spark, d)).select("id", "name", "parent_id")


@query("SELECT file_path AS path, CASE regexp_extract(lower(file_path), '\\.([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' END AS language FROM source_files WHERE NOT list_has_any(string_split(file_path, '/'), [" + ", ".join(f"'{s}'" for s in workspace.SKIP) + "])", ctes="")
def source_collector(spark: SparkSession, d: str) -> DataFrame:
    return workspace.source_paths(_paths(spark, d))


@query("SELECT * FROM (VALUES ('a.py', 'added', NULL), ('b.py', 'modified', NULL), ('c.py', 'deleted', NULL), ('e.py', 'renamed', 'd.py'), ('g.py', 'added', NULL)) t(path, change_type, old_path)", ctes="")
def git_diff(spark: SparkSession, d: str) -> DataFrame:
    lines = ["A\ta.py", "M\tb.py", "D\tc.py", "R100\td.py\te.py", "C75\tf.py\tg.py", "", "X\tz.py", "R100\tonly.py"]
    return workspace.parse_diff(spark.createDataFrame([(x,) for x in lines], "value string"))


_CHANGES = "ch AS (SELECT file_path AS path, CASE file_id % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'deleted' ELSE 'renamed' END AS change_type FROM source_files WHERE committed_at >= TIMESTAMP '2025-09-01')"


def _changes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("file_id") % 4 == 0, "added").when(F.col("file_id") % 4 == 1, "modified").when(F.col("file_id") % 4 == 2, "deleted").otherwise("renamed")
    return load(spark, d, "source_files").where("committed_at >= timestamp'2025-09-01'").select(F.col("file_path").alias("path"), kind.alias("change_type"))


@query("SELECT change_type, count(*) AS n, list_sort(list(DISTINCT path)) AS paths FROM ch GROUP BY change_type", ctes=_CHANGES)
def change_groups(spark: SparkSession, d: str) -> DataFrame:
    return incremental.change_groups(_changes(spark, d))


_FILE = "replace(location.file_path, '\\', '/')"
_HITN = f", {_CHANGES}, fl AS (SELECT id, {_FILE} AS file FROM n WHERE location.file_path IS NOT NULL), hn AS (SELECT DISTINCT id FROM fl JOIN ch ON regexp_extract(path, '[^/]*$') = regexp_extract(file, '[^/]*$') WHERE (ends_with(file, path) OR ends_with(path, file)) AND change_type = 'deleted')"


@query(f"{_HITN} SELECT (SELECT count(*) FROM n WHERE id NOT IN (SELECT id FROM hn)) AS n_nodes, (SELECT count(*) FROM e WHERE source_id NOT IN (SELECT id FROM hn) AND target_id NOT IN (SELECT id FROM hn)) AS n_edges")
def remove_file(spark: SparkSession, d: str) -> DataFrame:
    g = incremental.remove_files(Graph.load(spark, d), _changes(spark, d).where("change_type = 'deleted'"))
    return g.nodes.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(g.edges.agg(F.count(F.lit(1)).alias("n_edges")))


@query(f""", rn AS (SELECT file_path AS old_path, 'moved/' || file_path AS path FROM source_files), ky AS (SELECT n.id, replace(n.id, lower(old_path), lower(path)) AS nid FROM n JOIN rn ON {_FILE} = old_path)
SELECT coalesce(ky.nid, n.id) AS id, coalesce(kp.nid, n.parent_id) AS parent_id FROM n LEFT JOIN ky ON ky.id = n.id LEFT JOIN ky kp ON kp.id = n.parent_id""")
def rename_rekey(spark: SparkSession, d: str) -> DataFrame:
    """Every file moves."""
    r = load(spark, d, "source_files").select(F.col("file_path").alias("old_path"), F.concat(F.lit("moved/"), "file_path").alias("path"))
    return incremental.rename_files(Graph.load(spark, d), r).nodes.select("id", "parent_id")


@query(f"{_HITN} SELECT count(*) AS n_nodes, count(*) FILTER (WHERE version = 99) AS n_new FROM (SELECT id, version FROM n WHERE id NOT IN (SELECT id FROM hn) UNION ALL SELECT id, 99 FROM hn)")
def selective_upsert(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.load(spark, d)
    paths = _changes(spark, d).where("change_type = 'deleted'")
    again = g.nodes.join(incremental.changed_nodes(g, paths).select("id").distinct(), "id", "left_semi").withColumn("version", F.lit(99))
    out = incremental.selective_upsert(g, paths, again, g.edges.limit(0))
    return out.nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.count(F.when(F.col("version") == 99, 1)).alias("n_new"))


@query("SELECT id, type, name, confidence, tags, ord FROM n")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.load(spark, d)
    folder = f"{shared_dir(spark)}/graphloom-json-{uuid.uuid4().hex}"
    graphs.save_json(g, folder)
    return graphs.read_json(spark, folder, g).nodes.select("id", "type", "name", "confidence", "tags", "ord")


@query("SELECT id, type, name, tier, confidence, is_stale, array_to_string(tags, ';') AS tags FROM n")
def csv_export(spark: SparkSession, d: str) -> DataFrame:
    return graphs.csv_export(Graph.load(spark, d))[0]


_SHAPE = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in graphs.SHAPES.items()) + " ELSE 'box' END"


@query(f"""SELECT '  "' || replace(id, '"', '\\"') || '" [label="' || replace(coalesce(name || CASE WHEN is_stale THEN ' [STALE]' ELSE '' END, ''), '"', '\\"') || '", shape=' || {_SHAPE} || '];' AS value FROM n UNION ALL SELECT '  "' || replace(source_id, '"', '\\"') || '" -> "' || replace(target_id, '"', '\\"') || '" [label="' || type || '"' || CASE WHEN is_stale THEN ', style=dashed' ELSE '' END || '];' FROM e""")
def dot_export(spark: SparkSession, d: str) -> DataFrame:
    return graphs.dot_lines(Graph.load(spark, d))


@query("SELECT id, CASE WHEN id = '" + HUB + "' THEN 'Function' ELSE 'Module' END AS type FROM (SELECT source_id AS id FROM e UNION SELECT target_id FROM e) UNION SELECT '" + HUB + "', 'Function' WHERE false")
def csv_edge_list(spark: SparkSession, d: str) -> DataFrame:
    t = Graph.load(spark, d).edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "type", F.col("weight").cast("string").alias("weight"), F.when(F.col("source_id") == HUB, "Function").otherwise("Module").alias("source_type"), F.when(F.col("target_id") == HUB, "Function").otherwise("Module").alias("target_type"))
    return graphs.csv_edges(t).nodes.select("id", "type")


@query("SELECT parent_id AS source_id, id AS target_id FROM n WHERE parent_id IS NOT NULL AND parent_id <> ''")
def csv_node_list(spark: SparkSession, d: str) -> DataFrame:
    t = Graph.load(spark, d).nodes.select("id", "name", "type", F.col("parent_id").alias("parent"), F.array_join("tags", ";").alias("categories"))
    return graphs.csv_nodes(t).edges.select("source_id", "target_id")


@query("SELECT * FROM (VALUES ('a', 'Module', 'Alpha'), ('b', 'File', 'b')) t(id, type, name)", ctes="")
def json_import(spark: SparkSession, d: str) -> DataFrame:
    import json

    folder = f"{shared_dir(spark)}/graphloom-doc-{uuid.uuid4().hex}"
    doc = {"nodes": [{"id": "a", "label": "Alpha"}, {"id": "b", "kind": "File"}], "links": [{"from": "a", "to": "b"}]}
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.text(folder)
    return graphs.json_document(spark, folder).nodes.select("id", "type", "name")


_KINDS = {"view": "modified", "signup": "created", "error": "deleted", "click": "modified", "purchase": "modified"}


def _events(spark: SparkSession, d: str, stream: bool = False) -> DataFrame:
    e = load(spark, d, "events")
    e = watch.event_stream(spark, f"{d}/events.parquet*", e.schema) if stream else e
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")


_SESSIONS = """g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), ss AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS end_ts, count(*) AS n FROM r GROUP BY user_id, k)"""


@query(' SELECT user_id, start, end_ts AS "end", n FROM ss', ctes=_SESSIONS)
def debounce_batch(spark: SparkSession, d: str) -> DataFrame:
    return watch.sessions(_events(spark, d), "user_id", "6 hours")


@query(""", cl AS (SELECT max(ts) - INTERVAL '5 seconds' AS mark FROM events) SELECT user_id, start, end_ts AS "end", n FROM ss, cl WHERE end_ts <= mark""", ctes=_SESSIONS)
def debounce_stream(spark: SparkSession, d: str) -> DataFrame:
    """The sessions that the watermark has closed."""
    return watch.run_to_table(watch.sessions(_events(spark, d, stream=True).withWatermark("ts", "5 seconds"), "user_id", "6 hours"), "debounce")


def _throttle(seconds: int) -> str:
    return f"""f AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1), t(user_id, ts) AS (SELECT user_id, ts FROM f UNION ALL SELECT user_id, ts FROM (SELECT t.user_id, (SELECT min(x.ts) FROM events x WHERE x.user_id = t.user_id AND x.ts >= t.ts + INTERVAL '{seconds} seconds') AS ts FROM t) WHERE ts IS NOT NULL)"""


@query(" SELECT user_id, ts FROM t", ctes=_throttle(5), recursive=True)
def throttle_5s(spark: SparkSession, d: str) -> DataFrame:
    return watch.run_to_table(watch.throttle_stream(_events(spark, d, stream=True), "user_id", 5), "throttle")


@query(" SELECT user_id, ts FROM t", ctes=_throttle(3600), recursive=True)
def throttle_1h(spark: SparkSession, d: str) -> DataFrame:
    """An hour apart, which refuses more of these events than five seconds do."""
    return watch.run_to_table(watch.throttle_stream(_events(spark, d, stream=True), "user_id", 3600), "throttle")


_FOLD = """k AS (SELECT user_id, ts, event_id % 50 AS p, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS kind, event_id FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, p ORDER BY ts, event_id) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM k), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, p ORDER BY ts, event_id) AS s FROM g)"""


@query("SELECT user_id::VARCHAR AS workspace, p::VARCHAR AS path, min(ts) AS start, CASE arg_max(kind, epoch_us(ts)::VARCHAR || kind) FILTER (WHERE kind <> 'modified') WHEN 'created' THEN 'added' WHEN 'deleted' THEN 'deleted' ELSE 'modified' END AS change_type FROM r GROUP BY user_id, p, s", ctes=_FOLD)
def pending_fold(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select(F.col("user_id").cast("string").alias("workspace"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 50).cast("string").alias("path"), lookup("event_type", _KINDS).alias("kind"))
    return watch.folded(e, "6 hours").select("workspace", "path", "start", "change_type")


_PRICES = [("view", 1.0, 5.0, 1.25, 0.1), ("click", 3.0, 15.0, 3.75, 0.3), ("signup", 15.0, 75.0, 18.75, 1.5)]
_PRICED = "pr(event_type, a, b, c, r) AS (VALUES " + sql_values(_PRICES) + "), ev AS (SELECT event_type, sum(event_id % 1000)::BIGINT AS input, sum(event_id % 300)::BIGINT AS output, sum(event_id % 70)::BIGINT AS cache_write, sum(event_id % 900)::BIGINT AS cache_read FROM events GROUP BY 1)"


@query("SELECT ev.event_type, input, output, cache_write, cache_read, round((input * a + output * b + cache_write * c + cache_read * r) / 1e6, 6)::DOUBLE AS cost, round(cache_read * (a - r) / 1e6, 6)::DOUBLE AS cache_savings FROM ev LEFT JOIN pr ON pr.event_type = CASE WHEN ev.event_type IN (SELECT event_type FROM pr) THEN ev.event_type ELSE 'click' END", ctes=_PRICED)
def llm_cost(spark: SparkSession, d: str) -> DataFrame:
    """Events as calls with tokens of four classes; kinds without a price are charged as clicks."""
    p = spark.createDataFrame(_PRICES, "model string, input double, output double, cache_write double, cache_read double")
    i = F.col("event_id")
    e = load(spark, d, "events").select("event_type", (i % 1000).alias("input"), (i % 300).alias("output"), (i % 70).alias("cache_write"), (i % 900).alias("cache_read"))
    return call_costs(e, p, "event_type", "click")


@query("SELECT (SELECT count(*) FROM ex) AS n_entries, (SELECT count(*) FROM documents) AS n_documents", ctes=_TREE)
def scan_counts(spark: SparkSession, d: str) -> DataFrame:
    """Folders and files met by a scan, and knowledge documents."""
    entries = workspace.tree_nodes(_paths(spark, d)).agg(F.count(F.lit(1)).alias("n_entries"))
    return entries.crossJoin(load(spark, d, "documents").agg(F.count(F.lit(1)).alias("n_documents")))


@query(f"""{_HITN}, st AS (SELECT DISTINCT id FROM fl JOIN ch ON regexp_extract(path, '[^/]*$') = regexp_extract(file, '[^/]*$') WHERE ends_with(file, path) OR ends_with(path, file)), up(id, depth) AS (SELECT id, 0 FROM st UNION SELECT e.source_id, depth + 1 FROM up JOIN e ON e.target_id = up.id WHERE depth < 2),
fr AS (SELECT DISTINCT id FROM up WHERE id NOT IN (SELECT id FROM st)) SELECT (SELECT count(*) FROM st) AS n_affected, (SELECT count(*) FROM fr) AS n_blast, (SELECT list(id ORDER BY id) FROM (SELECT id FROM fr ORDER BY id LIMIT 50)) AS first_ids""", recursive=True)
def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    return incremental.change_report(Graph.load(spark, d), _changes(spark, d).select("path"))


@query("SELECT source_id, target_id, type, is_stale OR type = 'TESTS' AS is_stale FROM e")
def mark_edges_stale(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.load(spark, d)
    return g.mark_edges_stale(g.edges.where("type = 'TESTS'")).edges.select("source_id", "target_id", "type", "is_stale")


@query("SELECT id, CASE WHEN id = parent_id THEN name WHEN ord % 3 = 0 THEN 'corrected' ELSE name END AS name, CASE WHEN ord % 3 = 0 AND id <> coalesce(parent_id, '') AND ord % 2 = 0 THEN 'why' ELSE description END AS description FROM n")
def override_table(spark: SparkSession, d: str) -> DataFrame:
    n = Graph.load(spark, d).nodes
    t = n.where("ord % 3 = 0 and (parent_id is null or id <> parent_id)").select("id", F.lit("corrected").alias("name"), F.when(F.col("ord") % 2 == 0, "why").alias("description"))
    return store.overridden(n.select("id", "name", "description"), t, ["name", "description"])


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.sql
