"""Extraction and resolution queries over source files and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import behaviour, extract, resolve, syntax
from graphloom.graph import Graph
from graphloom.plans.registry import GRAPH, Registry
from graphloom.schema import sql_values
from graphloom.session import load

R = Registry()
query = R.query
_LANG = "CASE regexp_extract(lower(file_path), '\\.([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' END"
_LINES = f"""sp AS (SELECT file_id, project_id, file_path, {_LANG} AS language, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM source_files),
ln AS (SELECT file_id, project_id, file_path, language, unnest(generate_series(1, len(ls))) AS line_no, unnest(ls) AS line FROM sp)"""


def _hit(i: int) -> str:
    name, pattern, node_type, language, _ = extract.RULES[i]
    p = pattern.replace("'", "''")
    spoken = "true" if language is None else "language IN ('javascript', 'typescript')" if language == "javascript" else f"language = '{language}'"
    groups = pattern.replace("(?:", "").replace(r"\(", "").count("(")
    value = "NULL" if not groups else "coalesce(" + ", ".join(f"nullif(regexp_extract(line, '{p}', {g}), '')" for g in range(1, groups + 1)) + ", NULL)"
    return f"SELECT file_id, file_path, project_id, line_no, '{name}' AS rule, {i} AS rule_no, '{node_type}' AS node_type, {value} AS value, line FROM ln WHERE {spoken} AND regexp_matches(line, '{p}')"


_HITS = f"{_LINES}, ht AS ({' UNION ALL '.join(_hit(i) for i in range(len(extract.RULES)))})"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return extract.lines_of(load(spark, d, "source_files"))


@query(" SELECT file_id, line_no, rule, node_type, value FROM ht", ctes=_HITS)
def rule_hits(spark: SparkSession, d: str) -> DataFrame:
    return extract.rule_hits(_lines(spark, d)).select("file_id", "line_no", "rule", "node_type", "value")


_QUOTED = """nullif(regexp_extract(line, '[''"]([^''"]+)[''"]', 1), '')"""
_META = f"""{_HITS}, mt AS (SELECT *, CASE WHEN node_type = 'Endpoint' THEN CASE WHEN rule IN ('flask_route_decorator', 'django_path') THEN 'GET' ELSE upper(coalesce(value, 'GET')) END END AS http_method,
CASE WHEN node_type = 'Endpoint' THEN CASE WHEN rule IN ('flask_route_decorator', 'django_path') THEN value ELSE coalesce({_QUOTED}, '/') END END AS http_path, regexp_extract(file_path, '([^/]+?)(?:\\.[^./]*)?$', 1) AS stem FROM ht), nm AS (SELECT *, CASE WHEN node_type = 'Endpoint' THEN http_method || ' ' || http_path ELSE coalesce(value, stem) END AS name FROM mt)"""


@query(" SELECT file_id, line_no, rule, http_method, http_path, name FROM nm", ctes=_META)
def rule_metadata(spark: SparkSession, d: str) -> DataFrame:
    return extract.rule_metadata(extract.rule_hits(_lines(spark, d))).select("file_id", "line_no", "rule", "http_method", "http_path", "name")


_HEAD = "CASE node_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in extract.ID_HEADS.items()) + " END"


@query(f""", ids AS (SELECT concat_ws(':', {_HEAD}, project_id, CASE WHEN node_type = 'Endpoint' THEN http_method || ':' || http_path ELSE name END) AS id, * FROM nm),
fs AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file_path, line_no, rule_no) AS k FROM ids) SELECT id, node_type AS type, name, file_path, line_no, rule FROM fs WHERE k = 1""", ctes=_META)
def extracted_nodes(spark: SparkSession, d: str) -> DataFrame:
    return extract.extracted_nodes(extract.rule_hits(_lines(spark, d)))


def _sig(k: str, p: str, e: str, c: float) -> str:
    q = p.replace("'", "''")
    stripe = dict((a, b) for a, b, _, _ in extract.SIGNALS)["stripe"].replace("'", "''")
    more = f" AND NOT regexp_matches(line, '{stripe}')" if k == "http" else ""
    return f"SELECT file_id, line_no, '{k}' AS kind, regexp_extract(line, '{q}', 1) AS subject, '{e}' AS edge_type, {c}::DOUBLE AS confidence FROM cd WHERE regexp_matches(line, '{q}'){more}"


_NO = ", ".join(f"'{w}'" for w in extract.NO_CALL)
_SIGNALS = f"""{_LINES}, cd AS (SELECT * FROM ln WHERE NOT regexp_matches(line, '^\\s*(//|#|\\*|/\\*)')), sg AS ({' UNION ALL '.join(_sig(*s) for s in extract.SIGNALS)}
UNION ALL SELECT * FROM (SELECT file_id, line_no, 'call', unnest(list_filter(regexp_extract_all(line, '{extract.CALL}', 1), lambda f: f NOT IN ({_NO}))) AS subject, 'CALLS', 0.75 FROM cd))"""


@query(" SELECT file_id, line_no, kind, subject, edge_type, confidence FROM sg", ctes=_SIGNALS)
def signals(spark: SparkSession, d: str) -> DataFrame:
    return extract.signals(_lines(spark, d))


@query(r""", md AS (SELECT file_id, line_no, regexp_extract(line, '(?:const|let|var)\s+(\w+)\s*=\s*(?:await\s+)?new\s+[A-Z][a-zA-Z0-9]+\s*\(', 1) AS v, nullif(regexp_extract(line, '(?:const|let|var)\s+\w+\s*=\s*(?:await\s+)?new\s+([A-Z][a-zA-Z0-9]+)\s*\(', 1), '') AS m FROM ln), sv AS (SELECT file_id, line_no, regexp_extract(line, '(\w+)\.save\s*\(', 1) AS v FROM ln)
SELECT s.file_id, s.line_no, s.v AS variable, arg_max(m, md.line_no) AS model FROM sv s JOIN md ON md.file_id = s.file_id AND md.v = s.v AND md.line_no <= s.line_no AND m IS NOT NULL WHERE s.v <> '' GROUP BY ALL""", ctes=_LINES)
def last_assignment(spark: SparkSession, d: str) -> DataFrame:
    return extract.last_assignment(_lines(spark, d))


@query(r""" SELECT file_id, line_no, coalesce(nullif(regexp_replace(regexp_extract(line, '[''"`]([^''"`]+)[''"`]', 1), '\$\{[^}]+\}', '{id}', 'g'), ''), 'dynamic') AS key FROM ln""", ctes=_LINES)
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("file_id", "line_no", extract.cache_key(F.col("line")).alias("key"))


@query(r""", im AS (SELECT file_id, regexp_extract(line, '^\s*(?:import|from)\s(.*)$', 1) AS w FROM ln WHERE regexp_matches(line, '^\s*(?:import|from)\s')), us AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(w, '([A-Za-z_]\w+)', 1)) AS model FROM im) SELECT file_id, model FROM us WHERE model IN (SELECT name FROM graph_nodes WHERE type = 'Function')""", ctes=_LINES)
def file_models(spark: SparkSession, d: str) -> DataFrame:
    models = Graph.load(spark, d).nodes.where("type = 'Function'").select("name")
    f = load(spark, d, "source_files").withColumn("text", F.regexp_replace("text", "\r\n", "\n"))
    return extract.file_models(f, models)


_TAGS = sql_values([(i, k, t) for i, (k, t) in enumerate(extract.TAG_RULES.items())])
_CATS = "CASE type " + " ".join(f"WHEN '{t}' THEN '{c}'" for t, c in extract.CATEGORIES.items()) + " ELSE 'other' END"


@query(f""", tr(i, k, t) AS (VALUES {_TAGS}), hit AS (SELECT id, t, min(i) AS i FROM n JOIN tr ON contains(lower(concat_ws(' ', name, location.file_path)), k) GROUP BY id, t), ag AS (SELECT id, list(t ORDER BY i) AS c FROM hit GROUP BY id)
SELECT id, {_CATS} AS category, coalesce(c, []) AS concepts FROM n LEFT JOIN ag USING (id)""")
def enrich_tags(spark: SparkSession, d: str) -> DataFrame:
    return extract.concept_tags(Graph.load(spark, d).nodes)


_SK = ", ".join(f"'{p}'" for p in extract.SKIP_PARTS)


@query(f"SELECT file_id, len(list_filter([{_SK}], lambda p: contains(lower(file_path), p))) > 0 AS skip FROM source_files", ctes="")
def skip_rules(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "source_files").select("file_id", extract.skipped(F.col("file_path")).alias("skip"))


_CHUNKS = """fl AS (SELECT file_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM source_files),
mk AS (SELECT file_id, ls, greatest(1, floor(2000 / ((list_sum(list_transform(ls, lambda x: length(x))) + len(ls)) / len(ls)))::INT) AS k FROM fl), ex AS (SELECT file_id, k, unnest(ls) AS l, unnest(generate_series(0, len(ls) - 1)) AS i FROM mk)"""


@query("SELECT file_id, (i // k)::INT AS chunk, min(i) + 1 AS first_line, max(i) + 1 AS last_line, sum(length(l))::BIGINT AS n_chars FROM ex GROUP BY file_id, i // k", ctes=_CHUNKS)
def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    return extract.line_chunks(load(spark, d, "source_files"))


@query()
def ast_python(spark: SparkSession, d: str) -> DataFrame:
    return extract.python_entities(load(spark, d, "source_files"))


@query()
def ast_chunks(spark: SparkSession, d: str) -> DataFrame:
    return extract.ast_chunks(load(spark, d, "source_files"))


@query(r"""SELECT doc_id, nullif(trim(regexp_extract(substr(text, 1, 2000), '(?m)^#[ \t]+(.+)$', 1)), '') AS title, nullif(trim(regexp_extract(substr(text, 1, 500), '(\d{4}-\d{2}-\d{2})', 1)), '') AS date, len(regexp_extract_all(text, '\S+')) AS word_count, CASE WHEN contains(lower(coalesce(source, '')), 'learning') OR contains(lower(coalesce(source, '')), 'retro') THEN 'learning' WHEN contains(lower(coalesce(source, '')), 'decision') OR contains(lower(coalesce(source, '')), 'adr') THEN 'decision' WHEN contains(lower(coalesce(source, '')), 'runbook') THEN 'runbook' ELSE 'doc' END AS source_kind FROM documents""", ctes="")
def doc_meta(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    plain_kind = extract.doc_metadata(docs.withColumn("none", F.lit("")), "doc_id", "none", F.col("source")).select("doc_id", F.col("kind").alias("source_kind"))
    return extract.doc_metadata(docs, "doc_id", "text", F.col("source")).select("doc_id", "title", "date", "word_count").join(plain_kind, "doc_id")


_FIRST = lambda n, p: f"nullif(trim(regexp_extract(substr(coalesce(text, ''), 1, {n}), '{p}', 1)), '')"
_DOC = f"""dm AS (SELECT doc_id, lower(coalesce(source, '')) AS low, {_FIRST(2000, '(?m)^#[ \\t]+(.+)$')} AS title, regexp_replace({_FIRST(3000, '(?i)(?:category|type|kind|status)[ \\t]*[:=][ \\t]*(.+)')}, '^["'']+|["'']+$', '', 'g') AS category,
{_FIRST(3000, '(?i)(?:tags?|labels?|topics?)[ \\t]*[:=][ \\t]*\\[?([^]\\n]+)\\]?')} AS tg, {_FIRST(500, '(\\d{4}-\\d{2}-\\d{2})')} AS date, len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS word_count FROM documents)"""


@query(f""" SELECT doc_id, title, category, list_filter(list_transform(regexp_split_to_array(tg, '[,;]'), lambda x: regexp_replace(trim(x), '^["''#]+|["''#]+$', '', 'g')), lambda x: x <> '') AS tags, date, word_count,
CASE WHEN contains(low, 'principle') OR contains(lower(coalesce(category, '')), 'principle') THEN 'principle' WHEN contains(low, 'pattern') OR contains(lower(coalesce(category, '')), 'pattern') THEN 'pattern' WHEN contains(low, 'learning') OR contains(low, 'retro') OR contains(lower(coalesce(category, '')), 'learning') THEN 'learning' WHEN contains(low, 'decision') OR contains(low, 'adr') THEN 'decision' WHEN contains(low, 'runbook') OR contains(low, 'playbook') THEN 'runbook' ELSE 'doc' END AS kind FROM dm""", ctes=_DOC)
def doc_class(spark: SparkSession, d: str) -> DataFrame:
    return extract.doc_metadata(load(spark, d, "documents"), "doc_id", "text", F.col("source"))


_REPLAY = """ev AS (SELECT user_id AS stream, event_id AS ord, CASE event_type WHEN 'view' THEN 'file_classification' WHEN 'click' THEN 'edge_discovery' WHEN 'signup' THEN 'node_discovery' WHEN 'purchase' THEN 'conflict_resolution' ELSE 'invariant_detection' END AS task, CASE WHEN event_id % 3 = 0 THEN 'high' ELSE 'medium' END AS complexity, 1.0 AS cost FROM events),
bs AS (SELECT *, CASE WHEN task = 'file_classification' THEN CASE WHEN complexity = 'high' THEN 'sonnet' ELSE 'haiku' END WHEN task = 'conflict_resolution' THEN 'opus' ELSE 'sonnet' END AS b, coalesce(sum(cost) OVER (PARTITION BY stream ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 20.0 AS u FROM ev)"""


@query("SELECT ord, CASE WHEN u >= 1 THEN 'haiku' WHEN u >= 0.9 THEN CASE WHEN b = 'opus' THEN 'sonnet' ELSE 'haiku' END WHEN u >= 0.75 AND b = 'opus' THEN 'sonnet' ELSE b END AS tier FROM bs", ctes=_REPLAY)
def budget_replay(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"view": "file_classification", "click": "edge_discovery", "signup": "node_discovery", "purchase": "conflict_resolution", "error": "invariant_detection"}
    from graphloom.schema import lookup

    ev = load(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("ord"), lookup("event_type", kinds).alias("task"), F.when(F.col("event_id") % 3 == 0, "high").otherwise("medium").alias("complexity"), F.lit(1.0).alias("cost"))
    return extract.routed(ev, 20.0).select("ord", "tier")


_FN = """fn AS (SELECT id, name, ord, replace(location.file_path, '\\', '/') AS file, location.start_line AS first, location.end_line AS last FROM n WHERE type IN ('Function', 'Endpoint', 'AsyncHandler') AND location.file_path IS NOT NULL)"""


@query(f"""{', ' + _FN}, hit AS (SELECT l.file_id, l.line_no, arg_min(fn.id, [last - first, first]) AS scope FROM ln l JOIN fn ON fn.file = l.file_path AND l.line_no BETWEEN first AND last GROUP BY 1, 2) SELECT l.file_id, l.line_no, h.scope FROM ln l LEFT JOIN hit h USING (file_id, line_no)""", ctes=f"{GRAPH}, {_LINES}")
def innermost_scope(spark: SparkSession, d: str) -> DataFrame:
    n = Graph.load(spark, d).nodes.where("type in ('Function', 'Endpoint', 'AsyncHandler') and location.file_path is not null")
    scopes = n.select("id", F.translate("location.file_path", "\\", "/").alias("file"), F.col("location.start_line").alias("first"), F.col("location.end_line").alias("last"))
    at = _lines(spark, d).select("file_id", F.col("file_path").alias("file"), F.col("line_no").alias("line"))
    return resolve.innermost_scope(at, scopes).select("file_id", F.col("line").alias("line_no"), "scope")


@query(f"""{', ' + _FN}, cl AS (SELECT DISTINCT f.id AS caller, f.file, g.name FROM fn f JOIN e ON e.source_id = f.id AND e.type = 'CALLS' JOIN fn g ON g.id = e.target_id),
rk AS (SELECT c.caller, c.name, f.id AS callee, row_number() OVER (PARTITION BY c.caller, c.file, c.name ORDER BY (f.file = c.file)::INT, f.ord) AS k FROM cl c JOIN fn f ON f.name = c.name AND f.id <> c.caller) SELECT caller, name, callee FROM rk WHERE k = 1""")
def resolve_call(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.load(spark, d)
    fn = g.nodes.where("type in ('Function', 'Endpoint', 'AsyncHandler') and location.file_path is not null").select("id", "name", "ord", F.translate("location.file_path", "\\", "/").alias("file"))
    called = g.edges.where("type = 'CALLS'").select(F.col("source_id").alias("caller"), F.col("target_id").alias("t"))
    calls = called.join(fn.select(F.col("id").alias("caller"), "file"), "caller").join(fn.select(F.col("id").alias("t"), "name"), "t").select("caller", "file", "name")
    return resolve.resolve_calls(calls, fn)


@query(", q AS (SELECT DISTINCT upper(name) AS name FROM n WHERE type = 'Endpoint' UNION SELECT DISTINCT name FROM n WHERE type = 'Middleware'), j AS (SELECT q.name, n.id, n.name <> q.name AS inexact, row_number() OVER (PARTITION BY q.name ORDER BY n.name <> q.name, ord, n.id) AS k FROM q JOIN n ON lower(n.name) = lower(q.name)) SELECT name, id, NOT inexact AS exact FROM j WHERE k = 1")
def resolve_ci(spark: SparkSession, d: str) -> DataFrame:
    n = Graph.load(spark, d).nodes
    names = n.where("type = 'Endpoint'").select(F.upper("name").alias("name")).unionByName(n.where("type = 'Middleware'").select("name"))
    return resolve.resolve_names(names, n)


@query(""", q(name) AS (VALUES ('telemetry'), ('INVOICE'), ('record_event_now'), ('views'), ('no such thing at all')), x AS (SELECT q.name, n.id, CASE WHEN n.name = q.name THEN 0 WHEN lower(n.name) = lower(q.name) THEN 1 ELSE 2 END AS how, ord FROM q JOIN n ON lower(n.name) = lower(q.name) OR contains(lower(n.name), lower(q.name)) OR (n.name <> '' AND contains(lower(q.name), lower(n.name)))),
b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY how, ord) AS k FROM x) SELECT name, id, CASE how WHEN 0 THEN 'exact' WHEN 1 THEN 'case' ELSE 'part' END AS how FROM b WHERE k = 1""")
def fuzzy_resolve(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(x,) for x in ("telemetry", "INVOICE", "record_event_now", "views", "no such thing at all")], "name string")
    return resolve.fuzzy_resolve(names, Graph.load(spark, d).nodes.select("id", "name", "ord"))


_SUFFIXED = ", ".join(f"({i}, '{x}')" for i, x in enumerate(resolve.SUFFIXES))
_IMPORT_SQL = f"""{_LINES}, sp0 AS (SELECT DISTINCT file_path AS file, regexp_extract(line, 'from\\s+[''"]([^''"]+)[''"]', 1) AS spec FROM ln WHERE regexp_matches(line, 'from\\s+[''"]([^''"]+)[''"]')), rl AS (SELECT * FROM sp0 WHERE starts_with(spec, '.')),
bs AS (SELECT file, spec, regexp_replace(list_reduce(list_concat([''], string_split(CASE WHEN contains(file, '/') THEN regexp_replace(file, '/[^/]*$', '') ELSE '' END || '/' || spec, '/')), lambda a, p: CASE WHEN p IN ('', '.') THEN a WHEN p = '..' THEN regexp_replace(a, '/?[^/]*$', '') WHEN a = '' THEN p ELSE a || '/' || p END), '\\.js$', '') AS base FROM rl),
sx(i, x) AS (VALUES {_SUFFIXED}), ht AS (SELECT file, spec, arg_min(base || x, i) AS target FROM bs, sx WHERE base || x IN (SELECT file_path FROM source_files) GROUP BY ALL)"""


@query(" SELECT file, spec, target FROM rl LEFT JOIN ht USING (file, spec)", ctes=_IMPORT_SQL)
def import_resolve(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "source_files")
    specs = _lines(spark, d).select(F.col("file_path").alias("file"), F.regexp_extract("line", r"from\s+['\"]([^'\"]+)['\"]", 1).alias("spec")).where("spec <> ''")
    return resolve.resolve_imports(specs, f.select(F.col("file_path").alias("path")))


@query(""", pj AS (SELECT id, split_part(id, ':', 3) AS folder FROM n WHERE type = 'Project') SELECT file_path AS path, id AS project FROM source_files LEFT JOIN pj ON split_part(file_path, '/', 1) = folder""")
def project_of_file(spark: SparkSession, d: str) -> DataFrame:
    projects = Graph.load(spark, d).nodes.where("type = 'Project'").select("id", F.split_part("id", F.lit(":"), F.lit(3)).alias("folder"))
    return resolve.project_of(load(spark, d, "source_files").select(F.col("file_path").alias("path")), projects)


@query(""", t AS (SELECT DISTINCT id, lower(unnest(tags)) AS tag FROM n WHERE type IN ('Workspace', 'Project', 'Module')) SELECT x.id AS a, y.id AS b, list_sort(list(DISTINCT x.tag)) AS shared FROM t x JOIN t y ON x.tag = y.tag AND x.id < y.id GROUP BY ALL""")
def shared_tag_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = Graph.load(spark, d).nodes.where("type in ('Workspace', 'Project', 'Module')")
    return resolve.shared_tag_pairs(n, "id", "tags")


@query(", t AS (SELECT DISTINCT id, lower(unnest(tags)) AS tag FROM n), u AS (SELECT tag, count(*) AS n_items FROM t WHERE tag IS NOT NULL GROUP BY tag HAVING count(*) > 1) SELECT tag, id, n_items FROM t JOIN u USING (tag)")
def shared_tags(spark: SparkSession, d: str) -> DataFrame:
    """All tagged nodes."""
    return resolve.shared_tag_members(Graph.load(spark, d).nodes, "id", "tags")


@query(f""" SELECT 'file:' || project_id || ':' || file_path AS id, 'File' AS type, regexp_extract(file_path, '[^/]*$') AS name, file_path, 1 AS first_line, len(string_split(coalesce(text, ''), chr(10))) AS last_line, sha256(coalesce(text, '')) AS source_hash, {_LANG} AS language, 1.0::DOUBLE AS confidence FROM source_files WHERE {_LANG} IS NOT NULL""", ctes="")
def file_nodes(spark: SparkSession, d: str) -> DataFrame:
    return syntax.file_nodes(load(spark, d, "source_files"))


@query()
def syntax_entities(spark: SparkSession, d: str) -> DataFrame:
    """Of all files of the five languages."""
    return syntax.entity_nodes(syntax.parsed(load(spark, d, "source_files")))


@query()
def syntax_edges(spark: SparkSession, d: str) -> DataFrame:
    return syntax.syntax_edges(syntax.parsed(load(spark, d, "source_files")))


_QUOTED_PATH = r"""[''"]([^''"\n]+)[''"]"""
_IMPORTED = rf"""im AS (SELECT project_id, file_path, unnest(list_concat(regexp_extract_all(text, '(?m)^[ \t]*import[ \t]+(?:[\w$*{{}},\s]+?\bfrom\b[ \t]*)?{_QUOTED_PATH}', 1), regexp_extract_all(text, '(?m)^[ \t]*export[ \t]+[\w$*{{}},\s]+?\bfrom\b[ \t]*{_QUOTED_PATH}', 1), regexp_extract_all(text, '\brequire\s*\(\s*{_QUOTED_PATH}\s*\)', 1))) AS spec FROM source_files WHERE {_LANG} IN ('javascript', 'typescript'))"""


@query(" SELECT DISTINCT 'file:' || project_id || ':' || file_path AS source_id, 'file:' || project_id || ':' || spec AS target_id FROM im", ctes=_IMPORTED)
def import_edges(spark: SparkSession, d: str) -> DataFrame:
    """Of the files whose imports are quoted paths."""
    found = syntax.parsed(load(spark, d, "source_files")).where("language in ('javascript', 'typescript') and kind = 'import'")
    return syntax.syntax_edges(found).select("source_id", "target_id")


_KEY_OF = r"""coalesce(nullif(regexp_replace(regexp_extract(line, '[''"`]([^''"`]+)[''"`]', 1), '\$\{[^}]+\}', '{id}', 'g'), ''), 'dynamic')"""
_KIND_OF = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in behaviour.TARGETS.items()) + " END"
_HEAD_OF = "CASE tt " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in behaviour.HEADS.items()) + " END"
_SCOPE_TYPES = ", ".join(f"'{t}'" for t in behaviour.SCOPES)
_PATH_OF = "replace(location.file_path, '\\', '/')"
_OCCUR = f"""{_SIGNALS}, {GRAPH},
kn AS (SELECT file_id, unnest(regexp_extract_all(regexp_extract(line, '^\\s*(?:import|from)\\s(.*)$', 1), '([A-Za-z_]\\w+)', 1)) AS model FROM ln WHERE regexp_matches(line, '^\\s*(?:import|from)\\s')),
km AS (SELECT DISTINCT file_id, model FROM kn WHERE model IN (SELECT name FROM n WHERE type IN ('DataModel', 'Collection'))),
oc0 AS (SELECT s.file_id, l.file_path, l.project_id, s.line_no, s.kind, CASE WHEN s.kind IN ('cache_read', 'cache_write') THEN {_KEY_OF} WHEN s.kind IN ('stripe', 'http') THEN s.kind ELSE s.subject END AS subject, s.edge_type, s.confidence
  FROM sg s JOIN ln l USING (file_id, line_no) LEFT JOIN km ON km.file_id = s.file_id AND km.model = s.subject WHERE CASE WHEN starts_with(s.kind, 'db_') THEN km.model IS NOT NULL WHEN s.kind = 'call' THEN km.model IS NULL ELSE true END),
scp AS (SELECT id, {_PATH_OF} AS file, location.start_line AS first, location.end_line AS last FROM n WHERE type IN ({_SCOPE_TYPES}) AND location.file_path IS NOT NULL),
whl AS (SELECT {_PATH_OF} AS file, arg_min(id, ord) AS whole FROM n WHERE type = 'File' AND location.file_path IS NOT NULL GROUP BY 1),
pl AS (SELECT DISTINCT file_id, file_path, line_no FROM oc0), ins AS (SELECT file_id, line_no, id, row_number() OVER (PARTITION BY file_id, line_no ORDER BY last - first, first, last, id) AS k FROM pl JOIN scp ON scp.file = pl.file_path AND line_no BETWEEN first AND last),
oc AS (SELECT oc0.*, coalesce(ins.id, whole) AS source FROM oc0 LEFT JOIN ins ON ins.file_id = oc0.file_id AND ins.line_no = oc0.line_no AND ins.k = 1 LEFT JOIN whl ON whl.file = oc0.file_path WHERE coalesce(ins.id, whole) IS NOT NULL),
tn AS (SELECT *, {_KIND_OF} AS tt FROM oc WHERE {_KIND_OF} IS NOT NULL), ft AS (SELECT tt, subject, project_id, file_path, line_no FROM (SELECT *, row_number() OVER (PARTITION BY tt, subject ORDER BY file_id, line_no, file_path, project_id) AS k FROM tn) WHERE k = 1),
th AS (SELECT type AS tt, CASE WHEN type = 'ExternalAPI' THEN lower(name) ELSE name END AS subject, arg_min(id, ord) AS id FROM n WHERE type IN ('Event', 'Queue', 'CacheKey', 'ExternalAPI') GROUP BY ALL),
tg AS (SELECT ft.*, coalesce(th.id, {_HEAD_OF} || ':' || project_id || ':' || subject) AS id, th.id IS NULL AS made FROM (SELECT tt, subject, project_id, file_path, line_no FROM ft) ft LEFT JOIN th USING (tt, subject))"""


@query(" SELECT id, tt AS type, file_path, line_no FROM tg WHERE made", ctes=_OCCUR)
def signal_targets(spark: SparkSession, d: str) -> DataFrame:
    """Nodes made for what signals name."""
    g = Graph.load(spark, d)
    return behaviour.made_nodes(behaviour.occurrences(load(spark, d, "source_files"), g), g).select("id", "type", "file_path", "line_no")


_MADE_EDGES = f"""{_OCCUR}, fnx AS (SELECT id, name, ord, {_PATH_OF} AS file FROM n WHERE type = 'Function'),
cd1 AS (SELECT DISTINCT source, file_path, subject FROM oc WHERE kind = 'call'), cr AS (SELECT c.source, c.subject, f.id, row_number() OVER (PARTITION BY c.source, c.file_path, c.subject ORDER BY coalesce(f.file = c.file_path, false)::INT, f.ord) AS k FROM cd1 c JOIN fnx f ON f.name = c.subject AND f.id <> c.source),
ev AS (SELECT source AS source_id, tg.id AS target_id, edge_type AS type, confidence, tn.file_path, tn.line_no, file_id, kind FROM tn JOIN tg USING (tt, subject) UNION ALL SELECT oc.source, cr.id, edge_type, confidence, file_path, line_no, file_id, kind FROM oc JOIN cr ON cr.source = oc.source AND cr.subject = oc.subject AND cr.k = 1 WHERE kind = 'call'),
fe AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, type ORDER BY file_id, line_no, kind) AS k FROM ev)"""


@query(" SELECT source_id, target_id, type, confidence, file_path, line_no FROM fe WHERE k = 1", ctes=_MADE_EDGES)
def signal_edges(spark: SparkSession, d: str) -> DataFrame:
    """Its SQL leaves out edges to models, of which these tables have none; a fixture in the tests has."""
    g = Graph.load(spark, d)
    return behaviour.made_edges(behaviour.occurrences(load(spark, d, "source_files"), g), g)


@query()
def knowledge_upsert(spark: SparkSession, d: str) -> DataFrame:
    """All documents as knowledge nodes, merged into those there."""
    k = behaviour.knowledge_nodes(load(spark, d, "documents").withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("docs")), F.col("doc_id"))), "path", "text")
    return behaviour.enriched(Graph.load(spark, d).nodes, k)


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.sql
