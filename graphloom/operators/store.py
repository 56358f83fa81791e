"""Lookups, updates, comparison and statistics of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.graph import Graph, top_by


def search_nodes(g: Graph, query: str, type: str | None = None, tag: str | None = None, limit: int = 20) -> DataFrame:
    """Nodes whose name or description contains the query in any case, the most confident first, ties in order of insertion."""
    q = F.lit(query.lower())
    hit = F.coalesce(F.contains(F.lower("name"), q), F.lit(False)) | F.coalesce(F.contains(F.lower("description"), q), F.lit(False))
    n = g.nodes.where(hit)
    n = n.where(F.col("type") == type) if type else n
    n = n.where(F.array_contains("tags", tag)) if tag else n
    return top_by(n, limit, F.desc("confidence"), F.asc("ord"))


def find_by_name_or_id(g: Graph, query: str) -> DataFrame:
    q = F.lit(query.lower())
    return g.nodes.where(F.contains(F.lower("name"), q) | F.contains("id", q))


def search_entity(g: Graph, query: str, type: str | None = None, limit: int = 10) -> DataFrame:
    """Nodes by name alone, by falling confidence and name, each with total_matches (after the limit) and total_before_limit."""
    n = g.nodes.where(F.contains(F.lower("name"), F.lit(query.lower())))
    n = n.where(F.col("type") == type) if type else n
    total = n.agg(F.count(F.lit(1)).alias("total_before_limit"))
    top = top_by(n, limit, F.desc("confidence"), F.asc("name"), F.asc("ord"))
    return top.crossJoin(F.broadcast(total)).withColumn("total_matches", F.least("total_before_limit", F.lit(limit)))


def at(location: Column | str = "location") -> Column:
    """file:start-end."""
    c = F.col(location) if isinstance(location, str) else location
    return F.when(c["file_path"].isNotNull(), F.concat(c["file_path"], F.lit(":"), F.coalesce(c["start_line"].cast("string"), F.lit("?")), F.lit("-"), F.coalesce(c["end_line"].cast("string"), F.lit("?"))))


def project(g: Graph, level: int) -> DataFrame:
    """Nodes at detail 1 (identity), 2 (with place and state) or 3 (with all else)."""
    one = ["id", "type", "name", "tier"]
    two = [*one, F.coalesce("description", F.lit("")).alias("description"), at().alias("at"), "confidence", "is_stale"]
    three = [*two, "provenance", "version", "language", "source_hash", "tags", "metadata", "parent_id"]
    return g.nodes.select(*[one, two, three][level - 1])


def stats(g: Graph, spark: SparkSession) -> DataFrame:
    """(kind, name, n, n_stale): counts for every node type, tier and edge type of the ontology, 0 where there is none, then those of
    types the ontology lacks, and totals. One pass over the nodes and one over the edges."""
    stale = F.count(F.when(F.col("is_stale"), 1)).alias("n_stale")
    one = F.count(F.lit(1)).alias("n")
    n = g.nodes.groupBy("type").agg(one, stale)
    e = g.edges.groupBy("type").agg(one, stale)
    known = [("node_type", t) for t in schema.NODE_TYPES] + [("edge_type", t) for t in schema.EDGE_TYPES] + [("tier", t) for t in schema.TIERS]
    dims = spark.createDataFrame([(k, t, 0, 0) for k, t in known], "kind string, name string, n long, n_stale long")
    types = n.select(F.lit("node_type").alias("kind"), F.col("type").alias("name"), "n", "n_stale")
    tiers = n.select(F.lit("tier"), schema.tier_of("type"), "n", "n_stale")
    edges = e.select(F.lit("edge_type"), "type", "n", "n_stale")
    totals = n.select(F.lit("total"), F.lit("nodes"), "n", "n_stale").union(e.select(F.lit("total"), F.lit("edges"), "n", "n_stale"))
    return types.union(tiers).union(edges).union(totals).unionByName(dims).where("name is not null").groupBy("kind", "name").agg(F.sum("n").alias("n"), F.sum("n_stale").alias("n_stale"))


def health(g: Graph) -> DataFrame:
    """(n, n_fresh, fresh_pct, status): HEALTHY from 90 % fresh nodes, DEGRADED from 70, else STALE; EMPTY without nodes."""
    c = g.nodes.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.coalesce("is_stale", F.lit(False)), 1)).alias("n_fresh"))
    pct = F.when(F.col("n") > 0, F.round(F.col("n_fresh") * 100.0 / F.col("n"), 4)).otherwise(F.lit(0.0))
    return c.withColumn("fresh_pct", pct).withColumn("status", F.when(F.col("n") == 0, "EMPTY").when(F.col("fresh_pct") >= 90, "HEALTHY").when(F.col("fresh_pct") >= 70, "DEGRADED").otherwise("STALE"))


def density(g: Graph) -> DataFrame:
    n, e = g.nodes.agg(F.count(F.lit(1)).alias("n_nodes")), g.edges.agg(F.count(F.lit(1)).alias("n_edges"))
    d = F.when(F.col("n_nodes") > 1, F.round(F.col("n_edges") / (F.col("n_nodes").cast("double") * (F.col("n_nodes") - 1)), 10)).otherwise(F.lit(0.0))
    return n.crossJoin(F.broadcast(e)).withColumn("density", d)


def degrees(g: Graph) -> DataFrame:
    """(id, n_edges): every typed edge counts at both ends, whether or not the end is a node."""
    return g.incident().groupBy("id").agg(F.count(F.lit(1)).alias("n_edges"))


def simple_degrees(g: Graph) -> DataFrame:
    """(id, in_degree, out_degree, centrality) on the simple graph, ends that are no nodes being vertices too; centrality is the
    in-degree over n - 1. Counts are combined before the shuffle, so a hub costs one row a partition."""
    s = g.simple()
    ends = s.select(F.inline(F.array(F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    every = ends.unionByName(g.nodes.select("id", F.lit(0).alias("i"), F.lit(0).alias("o")))
    d = every.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    n = d.agg(F.count(F.lit(1)).alias("_n"))
    return d.crossJoin(F.broadcast(n)).select("id", "in_degree", "out_degree", F.when(F.col("_n") > 1, F.round(F.col("in_degree") / (F.col("_n") - 1), 10)).otherwise(F.lit(0.0)).alias("centrality"))


def diff(old: Graph, new: Graph) -> DataFrame:
    """(kind, key, change): nodes and edges added, removed or modified; compared are the columns that say what a node or edge is."""
    n_cols = ["type", "name", "description", "parent_id", "provenance", "confidence", "is_stale", "source_hash", "version", "language"]
    e_cols = ["description", "provenance", "confidence", "is_stale", "weight", "conditional"]
    key = F.concat("source_id", F.lit("->"), "target_id", F.lit(":"), "type")
    a = _diff(old.nodes.select(F.col("id").alias("key"), *n_cols), new.nodes.select(F.col("id").alias("key"), *n_cols), n_cols, "node")
    return a.unionByName(_diff(old.edges.select(key.alias("key"), *e_cols), new.edges.select(key.alias("key"), *e_cols), e_cols, "edge"))


def _diff(old: DataFrame, new: DataFrame, cols: list[str], kind: str) -> DataFrame:
    a, b = old.select("key", F.struct(*cols).alias("a")), new.select("key", F.struct(*cols).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified")
    return a.join(b, "key", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(F.lit(kind).alias("kind"), "key", change.alias("change"))


def overridden(nodes: DataFrame, table: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """nodes with what a table of corrections (key, some columns) says; nulls in it correct nothing, unknown keys are ignored, and of
    several rows for a key the greatest value of each column counts."""
    t = table.groupBy(key).agg(*[F.max(c).alias(f"_{c}") for c in columns])
    out = nodes.join(t, key, "left")
    return out.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in nodes.columns])
