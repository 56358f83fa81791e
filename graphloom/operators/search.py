"""Keyword, vector and hybrid search."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.graph import top_by
from graphloom.session import materialize

#: Words that carry no meaning, metadata keys that do, constants of fusion and of BM25.
STOPWORDS = "the a an is are was were in on at to for of with and or not this that it from by as".split()
TEXT_KEYS = ["http_method", "http_path", "framework", "orm", "table_name", "trigger", "prefix"]
RRF_K, K1, B, FLOOR = 60, 1.5, 0.75, 0.25


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, camelCase and snake_case taken apart, without stopwords and single characters. Null and
    empty texts have none."""
    t = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z])([A-Z])", "$1 $2"), "[_-]", " "))
    return F.filter(F.regexp_extract_all(t, F.lit("([a-z0-9]+)"), 1), lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def node_text() -> Column:
    """All that is searched of a node: name, description, tags and some metadata."""
    keys = [F.get_json_object("metadata", f"$.{k}") for k in TEXT_KEYS]
    return F.concat_ws(" ", F.coalesce("name", F.lit("")), "description", F.array_join("tags", " "), *keys)


@dataclass
class TextIndex:
    """A persisted inverted index: postings (key, term, tf, length), in files sorted by term so that a query's terms read few row groups,
    terms (term, df), and how many items there are and how many terms they have. Built once, asked often."""

    key: str
    postings: DataFrame
    terms: DataFrame
    n_items: int
    n_terms: int

    @staticmethod
    def build(items: DataFrame, key: str, text: Column) -> TextIndex:
        """Texts are taken apart once; sizes are observed while the postings are written. Items without terms are not in it."""
        seen = Observation()
        t = items.select(key, tokens(text).alias("_t")).withColumn("length", F.size("_t")).where("length > 0")
        t = t.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("length").alias("terms")).select(key, "length", F.explode("_t").alias("term"))
        written = materialize(t.groupBy(key, "term", "length").agg(F.count(F.lit(1)).alias("tf")).sortWithinPartitions("term"))
        terms = materialize(written.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
        got = seen.get if not items.isEmpty() else {}
        return TextIndex(key, written, terms, got.get("n") or 0, got.get("terms") or 0)

    def asked(self, query: str) -> dict[str, int]:
        """The words of a query, and how often it has each."""
        q = self.terms.sparkSession.createDataFrame([(query,)], "q string").select(tokens(F.col("q")).alias("t")).first()["t"]
        return {w: q.count(w) for w in q}


def tfidf(index: TextIndex, query: str, limit: int = 10) -> DataFrame:
    """(key, score): cosine of tf-idf vectors, tf = 1 + ln(count), idf = ln((N+1)/(df+1)) + 1; only scores above 0. Only the items that hold
    a word of the query are weighed."""
    asked, key = index.asked(query), index.key
    idf = index.terms.select("term", (F.log(F.lit(index.n_items + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    known = {r["term"]: r["idf"] for r in idf.where(F.col("term").isin(list(asked))).collect()}
    weight = {w: (1 + math.log(asked[w])) * i for w, i in known.items()}
    hits = index.postings.where(F.col("term").isin(list(known)))
    qw = schema.lookup("term", {w: weight[w] * known[w] for w in known}) if known else F.lit(None).cast("double")
    dot = hits.groupBy(key).agg(F.sum((1 + F.log("tf")) * qw).alias("dot"))
    w = index.postings.join(dot.select(key), key, "left_semi").join(idf, "term").select(key, ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    qn = math.sqrt(sum(x * x for x in weight.values()))
    s = dot.join(norm, key).select(key, F.round(F.col("dot") / (F.col("norm") * qn), 6).alias("score"))
    return top_by(s.where("score > 0"), limit, F.desc("score"), F.asc(key))


def bm25(index: TextIndex, query: str, limit: int = 10) -> DataFrame:
    """(key, score): Okapi BM25; a term in most items gets a quarter of the mean idf instead of a negative one. Only scores above 0."""
    asked, n = index.asked(query), index.n_items
    raw = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean_idf = index.terms.agg(F.avg(raw)).first()[0]
    known = {r["term"]: r["idf"] for r in index.terms.where(F.col("term").isin(list(asked))).select("term", raw.alias("idf")).collect()}
    idf = {w: asked[w] * (FLOOR * mean_idf if i < 0 else i) for w, i in known.items()}
    hits = index.postings.where(F.col("term").isin(list(idf)))
    part = (schema.lookup("term", idf) if idf else F.lit(None).cast("double")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / (index.n_terms / max(1, n))))
    s = hits.groupBy(index.key).agg(F.round(F.sum(part), 6).alias("score"))
    return top_by(s.where("score > 0"), limit, F.desc("score"), F.asc(index.key))


def cosine_top(vectors: DataFrame, key: str, vector: str, query: list[float], limit: int = 10, least: float = 0.1) -> DataFrame:
    """(key, score): cosine with a query vector given as a literal, in generated code without Python. Null vectors, vectors of another
    length and zero vectors match nothing."""
    q = F.array(*[F.lit(float(x)) for x in query])
    qn = sum(float(x) ** 2 for x in query) ** 0.5
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    s = vectors.where(F.size(vector) == len(query)).select(key, F.round(F.when(norm > 0, dot / (norm * qn)), 6).alias("score"))
    return top_by(s.where(F.col("score") > least), limit, F.desc("score"), F.asc(key))


def cosine_top_each(vectors: DataFrame, queries: DataFrame, key: str, vector: str, limit: int = 10, least: float = 0.1, block: int = 2048) -> DataFrame:
    """(query_id, key, score): cosine_top for each row of a table of query vectors, of the same columns. Blocks of queries meet blocks of
    vectors; a pair of blocks gives at most `limit` rows a query, of which the best stay. Null, zero and odd-length vectors match nothing."""

    def blocks(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where(F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull()))
        n = max(1, -(-df.count() // block))
        rows = rows.groupBy(F.pmod(F.xxhash64("k"), F.lit(n)).alias("b"), F.size("v").alias("d")).agg(F.collect_list(F.struct("k", "v")).alias("r"))
        return materialize(rows.select("d", F.transform("r", lambda x: x["k"]).alias(f"{name}k"), F.flatten(F.transform("r", lambda x: x["v"])).alias(f"{name}v")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, qk, qv, vk, vv in zip(batch["d"], batch["qk"], batch["qv"], batch["vk"], batch["vv"]):
                q, v, vk = np.reshape(qv, (-1, d)), np.reshape(vv, (-1, d)), np.asarray(vk)
                score = (q @ v.T / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(v, axis=1)).round(6)
                for i, k in enumerate(qk):
                    hit = np.flatnonzero(score[i] > least)
                    hit = hit[np.lexsort((vk[hit], -score[i][hit]))[:limit]]
                    yield pd.DataFrame({"query_id": k, key: vk[hit], "score": score[i][hit]})

    kind = vectors.select(F.col(key).alias("query_id"), key).schema.add("score", "double")
    pairs = blocks(queries, "q").join(blocks(vectors, "v"), "d").repartition("qk", "vk")
    best = pairs.select("d", "qk", "qv", "vk", "vv").mapInPandas(run, kind)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    return best.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def exact_hits(nodes: DataFrame, query: str) -> DataFrame:
    """(id, cls, ord): nodes whose name (0), else description (1), contains the query."""
    q = F.lit(query.lower())
    name, text = F.contains(F.lower("name"), q), F.contains(F.lower("description"), q)
    cls = F.when(name, 0).when(text, 1)
    return nodes.select("id", cls.alias("cls"), "ord").where("cls is not null")


def fuse(lists: list[tuple[str, DataFrame]], exact: str | None = None, limit: int = 20, where: Column | None = None) -> DataFrame:
    """(id, score, match_type): reciprocal rank fusion of ranked lists (id, pos from 0): the sum of 1/(60 + pos + 1), the first three exact
    hits doubled, over the maximum; match_type is the first list an id stands in. A filter is applied after fusion, so it never changes scores."""
    every = None
    for i, (name, ids) in enumerate(lists):
        part = 1.0 / (RRF_K + F.col("pos") + 1)
        bonus = F.when(F.col("pos") < 3, 2.0).otherwise(1.0) if name == exact else F.lit(1.0)
        rows = ids.select("id", part.alias("part"), bonus.alias("bonus"), F.struct(F.lit(i).alias("i"), F.lit(name).alias("name")).alias("src"))
        every = rows if every is None else every.unionByName(rows)
    s = every.groupBy("id").agg((F.sum("part") * F.max("bonus")).alias("raw"), F.min("src")["name"].alias("match_type"))
    s = s.crossJoin(F.broadcast(s.agg(F.max("raw").alias("most")))).select("id", F.round(F.col("raw") / F.col("most"), 6).alias("score"), "match_type")
    s = s.where(where) if where is not None else s
    return top_by(s, limit, F.desc("score"), F.asc("id"))


def positions(df: DataFrame, *order: Column) -> DataFrame:
    """A short ranked list (id, pos)."""
    return df.select("id", (F.row_number().over(Window.orderBy(*order)) - 1).alias("pos"))


def matched_field(query: str) -> Column:
    """The field of a node that shares a word with the query: name before description, tags and metadata."""
    t = tokens
    q = t(F.lit(query))
    return F.when(F.arrays_overlap(t(F.col("name")), q), "name").when(F.arrays_overlap(t(F.col("description")), q), "description").when(F.arrays_overlap(t(F.array_join("tags", " ")), q), "tags").otherwise("metadata")


def plain_hits(nodes: DataFrame, query: str, index: TextIndex, limit: int = 20) -> DataFrame:
    """(id, score, match_type): exact hits at 1.0 and keyword hits at 0.85, without fusion."""
    exact = top_by(exact_hits(nodes, query), limit, F.asc("cls"), F.asc("ord")).select("id", F.lit(1.0).alias("score"), F.lit("exact").alias("match_type"))
    return exact.unionByName(bm25(index, query, limit).select("id", F.lit(0.85).alias("score"), F.lit("keyword").alias("match_type")))
