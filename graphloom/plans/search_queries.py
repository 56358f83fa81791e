"""Search queries over documents, nodes and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph, top_by
from graphloom.operators import search
from graphloom.plans.registry import GRAPH, Registry
from graphloom.session import load

R = Registry()
query = R.query
Q = "orphan edges resolver confidence"
_STOP = ", ".join(f"'{w}'" for w in search.STOPWORDS)


def _tok(c: str) -> str:
    return rf"list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace(coalesce({c}, ''), '([a-z])([A-Z])', '\1 \2', 'g'), '[_-]', ' ', 'g')), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))"


_INDEX = f"""tk AS (SELECT doc_id, {_tok('text')} AS t FROM documents), px AS (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM tk WHERE len(t) > 0), p AS (SELECT doc_id, term, length, count(*) AS tf FROM px GROUP BY ALL),
qt AS (SELECT term, count(*) AS n FROM (SELECT unnest({_tok(f"'{Q}'")}) AS term) GROUP BY 1), nn AS (SELECT count(DISTINCT doc_id) AS N FROM p), dfs AS (SELECT term, count(*) AS df FROM p GROUP BY 1)"""
_TFIDF = f"""{_INDEX}, idf AS (SELECT term, ln((N + 1) / (df + 1)) + 1 AS idf FROM dfs, nn), w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM p JOIN idf USING (term)), qw AS (SELECT term, (1 + ln(n)) * idf AS qw FROM qt JOIN idf USING (term)),
nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1), dt AS (SELECT doc_id, sum(w * qw) AS dot FROM w JOIN qw USING (term) GROUP BY 1), tfidf AS (SELECT doc_id, round(dot / (norm * (SELECT sqrt(sum(qw * qw)) FROM qw)), 6) AS score FROM dt JOIN nm USING (doc_id))"""
_BM25 = f"""{_INDEX}, dl AS (SELECT avg(length) AS mean FROM (SELECT DISTINCT doc_id, length FROM p)), raw AS (SELECT term, ln((N - df + 0.5) / (df + 0.5)) AS idf FROM dfs, nn), mi AS (SELECT avg(idf) AS m FROM raw),
bi AS (SELECT term, n, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM raw JOIN qt USING (term), mi), bm AS (SELECT doc_id, round(sum(n * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score FROM p JOIN bi USING (term), dl GROUP BY 1)"""


def _docs(spark: SparkSession, d: str) -> search.TextIndex:
    return search.TextIndex.build(load(spark, d, "documents"), "doc_id", F.col("text"))


@query(f"SELECT doc_id, {_tok('text')} AS tokens FROM documents", ctes="")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", search.tokens(F.col("text")).alias("tokens"))


@query("SELECT id, concat_ws(' ', coalesce(name, ''), description, array_to_string(tags, ' '), metadata->>'$.http_method', metadata->>'$.http_path', metadata->>'$.framework', metadata->>'$.orm', metadata->>'$.table_name', metadata->>'$.trigger', metadata->>'$.prefix') AS text FROM n")
def node_text(spark: SparkSession, d: str) -> DataFrame:
    return Graph.load(spark, d).nodes.select("id", search.node_text().alias("text"))


@query(f" SELECT doc_id, score FROM tfidf WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20", ctes=_TFIDF)
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    return search.tfidf(_docs(spark, d), Q, 20)


@query(" SELECT doc_id, score FROM bm WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20", ctes=_BM25)
def bm25(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(_docs(spark, d), Q, 20)


_COSINE = """qv AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1),
c AS (SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS score FROM embeddings, qv)"""


@query("SELECT vec_id, score FROM c WHERE score > 0.1 ORDER BY score DESC, vec_id LIMIT 50", ctes=_COSINE)
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    v = load(spark, d, "embeddings")
    first = v.orderBy("vec_id").select("embedding").first()[0]
    return search.cosine_top(v, "vec_id", "embedding", first, 50)


_COSINES = _COSINE.replace("SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1", "SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0").replace("(SELECT vec_id, round(", "(SELECT query_id, vec_id, round(")


@query("SELECT query_id, vec_id, score FROM c WHERE score > 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 50", ctes=_COSINES)
def cosine_topk_each(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth vector as a query against all vectors."""
    v = load(spark, d, "embeddings")
    return search.cosine_top_each(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", 50)


@query("SELECT id, CASE WHEN contains(lower(name), 'payment') THEN 0 ELSE 1 END AS cls, ord FROM n WHERE contains(lower(name), 'payment') OR contains(lower(coalesce(description, '')), 'payment')")
def exact_rank(spark: SparkSession, d: str) -> DataFrame:
    return search.exact_hits(Graph.load(spark, d).nodes, "payment")


_NODE_BM = _BM25.replace("documents", "nt").replace("doc_id", "id").replace(_tok(f"'{Q}'"), _tok("'payment ledger'"))
_NT = "nt AS (SELECT id, concat_ws(' ', coalesce(name, ''), description, array_to_string(tags, ' '), metadata->>'$.http_method', metadata->>'$.http_path', metadata->>'$.framework', metadata->>'$.orm', metadata->>'$.table_name', metadata->>'$.trigger', metadata->>'$.prefix') AS text FROM n)"


@query(""" , x0 AS (SELECT id, row_number() OVER (ORDER BY CASE WHEN contains(lower(name), 'payment') THEN 0 ELSE 1 END, ord) - 1 AS pos FROM n WHERE contains(lower(name), 'payment') OR contains(lower(coalesce(description, '')), 'payment')),
b0 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS pos FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 100),
f AS (SELECT id, 1.0 / (60 + pos + 1) AS part, 1.0 AS bonus, 1 AS i FROM b0 UNION ALL SELECT id, 1.0 / (60 + pos + 1), CASE WHEN pos < 3 THEN 2.0 ELSE 1.0 END, 2 FROM x0 WHERE pos < 100),
r AS (SELECT id, sum(part::DOUBLE) * max(bonus) AS raw, CASE min(i) WHEN 1 THEN 'keyword' ELSE 'exact' END AS match_type FROM f GROUP BY id) SELECT id, round(raw / (SELECT max(raw) FROM r), 6)::DOUBLE AS score, match_type FROM r ORDER BY score DESC, id LIMIT 20""".lstrip(), ctes=f"{GRAPH}, {_NT}, {_NODE_BM}")
def rrf(spark: SparkSession, d: str) -> DataFrame:
    n = Graph.load(spark, d).nodes
    keyword = search.bm25(search.TextIndex.build(n, "id", search.node_text()), "payment ledger", 100)
    exact = top_by(search.exact_hits(n, "payment"), 100, F.asc("cls"), F.asc("ord"))
    return search.fuse([("keyword", search.positions(keyword, F.desc("score"), F.asc("id"))), ("exact", search.positions(exact, F.asc("cls"), F.asc("ord")))], exact="exact")


@query(f"""SELECT id, CASE WHEN list_has_any({_tok('name')}, ['payment', 'user']) THEN 'name' WHEN list_has_any({_tok('description')}, ['payment', 'user']) THEN 'description' WHEN list_has_any({_tok("array_to_string(tags, ' ')")}, ['payment', 'user']) THEN 'tags' ELSE 'metadata' END AS field FROM n""")
def matched_field(spark: SparkSession, d: str) -> DataFrame:
    return Graph.load(spark, d).nodes.select("id", search.matched_field("payment user").alias("field"))


@query(""" , pe AS (SELECT id FROM n WHERE contains(lower(name), 'payment ledger') OR contains(lower(coalesce(description, '')), 'payment ledger') ORDER BY CASE WHEN contains(lower(name), 'payment ledger') THEN 0 ELSE 1 END, ord LIMIT 20), pk AS (SELECT id FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 20)
SELECT id, 1.0::DOUBLE AS score, 'exact' AS match_type FROM pe UNION ALL SELECT id, 0.85::DOUBLE, 'keyword' FROM pk""".lstrip(), ctes=f"{GRAPH}, {_NT}, {_NODE_BM}")
def plain_hits(spark: SparkSession, d: str) -> DataFrame:
    n = Graph.load(spark, d).nodes
    return search.plain_hits(n, "payment ledger", search.TextIndex.build(n, "id", search.node_text()))


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.sql
