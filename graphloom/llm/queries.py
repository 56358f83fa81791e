"""Queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import handwritten, leaks, mixing, parses, spans, splitting, survivors
from graphloom.session import load, materialize, plain

FIELDS = ["type", "description", "language", "source_hash"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """By precedence, which TESTDATA.md fixes and votes cannot give; p2_survivors chooses by truth discovery."""
    records = load(spark, d, "node_records")
    groups = survivors.group_sizes(records).where("n_records > 1").select("gid")
    values = survivors.surviving_values(survivors.claims(records, FIELDS), load(spark, d, "merge_conflicts"))
    return values.join(groups, "gid", "left_semi").select(F.col("gid").alias("node_id"), "field", "record_id")


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    records = load(spark, d, "node_records")
    claimed = materialize(survivors.claims(records, FIELDS))
    values = survivors.surviving_values(claimed, load(spark, d, "merge_conflicts"), survivors.reliabilities(claimed))
    return survivors.surviving_records(values, survivors.group_sizes(records), FIELDS)


def p2_reliability(spark: SparkSession, d: str) -> DataFrame:
    weight = survivors.reliabilities(survivors.claims(load(spark, d, "node_records"), FIELDS))
    return weight.select("source", F.round("reliability", 6).alias("reliability"), "n_claims")


def _located(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes, files = load(spark, d, "graph_nodes"), load(spark, d, "source_files")
    items = nodes.select(plain("id").alias("id"), splitting.clean_path(F.col("location.file_path")).alias("path"), F.col("location.start_line").alias("a"), F.col("location.end_line").alias("b"))
    return items, files.select(F.col("file_path").alias("path"), "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(*_located(spark, d), with_text=False).where("piece_no = 1").select("id")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(*_located(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_verdicts(spark, d).where("verdict <> 'handwritten'").select("file_id")


def p4_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.verdicts(load(spark, d, "source_files"), "file_id", "file_path", "text")


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return parses.parse_files(load(spark, d, "source_files"), "file_id", "file_path", "text", ["project_id"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("error_line is not null").select("file_id")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return parses.invalid_rates(_parsed(spark, d), ["project_id"])


def p5_errors(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("error_line is not null")


def _shared(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = load(spark, d, "documents")
    copies = spans.text_classes(docs, "doc_id", "text")
    return docs, copies, spans.shared_spans(docs, "doc_id", "text", 500, copies)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs, copies, found = _shared(spark, d)
    return spans.expand_copies(found, copies, docs, "doc_id")


def p10_spans(spark: SparkSession, d: str) -> DataFrame:
    """Between representatives of equal texts; p10_shared has the membership."""
    return _shared(spark, d)[2]


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    docs, copies, found = _shared(spark, d)
    return spans.shared_per_record(docs, "doc_id", "text", found, copies)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(load(spark, d, "documents"), "doc_id", "text", load(spark, d, "eval_items"), "item_id", "passage")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The exact check after the search: 12 or more consecutive words; p8_leaks also has edited copies without such a run."""
    return _leaks(spark, d).where("longest >= 12").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Every item with the number of documents it leaked into."""
    items = load(spark, d, "eval_items").select("item_id", "suite")
    found = _leaks(spark, d).groupBy(F.col("item").alias("item_id")).agg(F.count_distinct("doc").alias("n_docs"), F.max("similarity").alias("most_similar"))
    return items.join(found, "item_id", "left").select("item_id", "suite", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_similar", F.lit(0.0)).alias("most_similar"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counted = mixing.token_counts(load(spark, d, "documents"), "doc_id", "text", mixing.source_name("source"))
    return mixing.mix(counted, load(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_repeats(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0].groupBy("doc_id", "source", "n_tokens").agg(F.max("repeat_no").alias("repeats"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


_QUERIES = (p2_found, p2_survivors, p2_reliability, p3_found, p3_pieces, p4_found, p4_verdicts, p5_found, p5_rates, p5_errors, p8_found, p8_leaks, p8_items, p9_mix, p9_repeats, p9_shares, p10_found, p10_spans, p10_shared)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_OUTER = "' \t\n\r\x0b\x0c\xa0'"
_EMPTY = f"(value IS NULL OR lower(trim(value, {_OUTER})) IN ('', 'unknown', 'n/a', 'none', 'tbd', '-', '?'))"
_P2 = f"""records AS (SELECT DISTINCT lower(trim(node_id, {_OUTER})) AS gid, record_id, type, description, language, source_hash,
    coalesce(list_position(['human', 'runtime', 'scanner', 'llm', 'import'], lower(trim(provenance, {_OUTER}))), 9) AS trust, CASE WHEN isnan(confidence) THEN NULL ELSE confidence END AS confidence, last_updated
  FROM node_records WHERE node_id IS NOT NULL AND record_id IS NOT NULL),
claims AS (SELECT * FROM (UNPIVOT records ON type, description, language, source_hash INTO NAME field VALUE value) WHERE NOT {_EMPTY}),
latest AS (SELECT gid, field, CASE resolution WHEN 'keep_existing' THEN existing_value WHEN 'use_incoming' THEN incoming_value END AS decided FROM (
  SELECT *, row_number() OVER (PARTITION BY gid, field ORDER BY decided_at DESC) AS k FROM (SELECT DISTINCT lower(trim(node_id, {_OUTER})) AS gid, field, resolution, existing_value, incoming_value, decided_at FROM merge_conflicts)) WHERE k = 1),
ranked AS (SELECT c.*, row_number() OVER (PARTITION BY c.gid, c.field ORDER BY (c.value IS NOT DISTINCT FROM l.decided AND l.decided IS NOT NULL) DESC, trust, confidence DESC NULLS LAST, last_updated DESC NULLS LAST, record_id) AS k
  FROM claims c LEFT JOIN latest l ON l.gid = c.gid AND l.field = c.field),
best AS (SELECT * FROM ranked WHERE k = 1),
sizes AS (SELECT gid, count(DISTINCT record_id) AS n_records FROM records GROUP BY gid)"""


_GRAMS = """rp AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS rep, count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE length(text) >= 500),
g AS (SELECT doc_id, k, md5(substr(text, k, 500)) AS h FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 499)) AS k FROM rp WHERE rep = doc_id)),
m AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.k AS ka, b.k AS kb FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p10_spans": f"""WITH {_GRAMS}, i AS (SELECT *, ka - row_number() OVER (PARTITION BY a, b, kb - ka ORDER BY ka) AS island FROM m)
SELECT a, b, min(ka) - 1 AS start_a, min(kb) - 1 AS start_b, max(ka) - min(ka) + 500 AS length FROM i GROUP BY a, b, kb - ka, island""",
        "p10_shared": f"""WITH {_GRAMS}, s AS (SELECT a AS doc, ka AS k, b AS other FROM m UNION SELECT b, kb, a FROM m), o AS (SELECT doc, count(DISTINCT other) AS others FROM s GROUP BY doc),
c AS (SELECT doc, sum(least(500, k - before)) AS covered FROM (SELECT doc, k, coalesce(lag(k) OVER (PARTITION BY doc ORDER BY k), -500) AS before FROM (SELECT DISTINCT doc, k FROM s)) GROUP BY doc),
d AS (SELECT d.doc_id, coalesce(length(d.text), 0) AS n_chars, coalesce(rep, d.doc_id) AS rep, coalesce(copies, 1) AS copies FROM documents d LEFT JOIN rp ON rp.doc_id = d.doc_id),
e AS (SELECT d.*, coalesce(others, 0) + copies - 1 AS n_partners, CASE WHEN copies > 1 THEN n_chars ELSE coalesce(covered, 0) END AS shared_chars FROM d LEFT JOIN o ON o.doc = rep LEFT JOIN c ON c.doc = rep)
SELECT doc_id, n_chars, rep, n_partners, shared_chars::BIGINT AS shared_chars, CASE WHEN n_chars > 0 THEN round(shared_chars / n_chars, 6) ELSE 0.0 END::DOUBLE AS shared_ratio FROM e""",
        "p2_found": f"WITH {_P2} SELECT gid AS node_id, field, record_id FROM best WHERE gid IN (SELECT gid FROM sizes WHERE n_records > 1)",
        "p3_found": r"""WITH f AS (SELECT file_path, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS lens FROM source_files),
n AS (SELECT id, regexp_replace(regexp_replace(replace(location.file_path, '\', '/'), '/{2,}', '/', 'g'), '^(\./|/)', '') AS path, least(location.start_line, location.end_line) AS a, greatest(location.start_line, location.end_line) AS b
  FROM graph_nodes WHERE location.start_line IS NOT NULL AND location.end_line IS NOT NULL),
p AS (SELECT n.id, list_slice(f.lens, greatest(a, 1), least(b, len(f.lens))) AS part FROM n JOIN f ON f.file_path = n.path)
SELECT id FROM p WHERE len(part) > 0 AND list_sum(part) + len(part) - 1 > 6000""",
        "p8_found": """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), i AS (SELECT item_id, regexp_extract_all(lower(passage), '[a-z0-9]+') AS w FROM eval_items),
dw AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 11), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS k FROM d)),
iw AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + 11), ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)""",
        "p10_found": """WITH g AS (SELECT DISTINCT doc_id, md5(substr(text, k, 500)) AS h FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 499)) AS k FROM documents))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id""",
    }
