"""A property graph: nodes and edges as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import load, plain

NODE_COLUMNS = ["id", "type", "name", "description", "location", "parent_id", "provenance", "confidence", "is_stale", "source_hash", "version", "language", "tags", "metadata", "last_updated", "tier", "ord"]
EDGE_COLUMNS = ["source_id", "target_id", "type", "description", "provenance", "confidence", "is_stale", "weight", "conditional", "location", "metadata", "ord"]


def upsert(old: DataFrame, key: list[str], ord: str = "ord") -> DataFrame:
    """One row per key: the last in order, at the place of the first. Rows equal in order are told apart by nothing but the plan, so
    `ord` has to be unique per key. Aggregation by struct keeps it to one shuffle with map-side combine, unlike a window."""
    rest = [c for c in old.columns if c not in key and c != ord]
    last = old.groupBy(*key).agg(F.max_by(F.struct(*rest), ord).alias("_v"), F.min(ord).alias(ord))
    return last.select(*[F.col(k) if k in key else F.col(ord) if k == ord else F.col("_v")[k].alias(k) for k in old.columns])


@dataclass
class Graph:
    """nodes, one row per id; edges, one row per (source_id, target_id, type); ord is the order of insertion of either."""

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def load(spark: SparkSession, d: str) -> Graph:
        """The graph of graph_nodes and graph_edges. Ids are compared in plain form, a re-sent relation replaces the older one, edges without
        an end are dropped."""
        nodes = load(spark, d, "graph_nodes").withColumns({"id": plain("id"), "parent_id": plain("parent_id")}).select(*NODE_COLUMNS)
        e = load(spark, d, "graph_edges").withColumns({"source_id": plain("source_id"), "target_id": plain("target_id")}).withColumnRenamed("edge_id", "ord")
        e = e.where("source_id is not null and target_id is not null").select(*EDGE_COLUMNS)
        return Graph(nodes, upsert(e, ["source_id", "target_id", "type"]))

    def simple(self) -> DataFrame:
        """(source_id, target_id, type, weight, ord): one row per ordered pair, with what the edge inserted last says."""
        last = self.edges.groupBy("source_id", "target_id").agg(F.max(F.struct("ord", "type", "weight")).alias("v"))
        return last.select("source_id", "target_id", "v.type", "v.weight", "v.ord")

    def typed_ends(self) -> DataFrame:
        """edges with the types of their ends, which are null where the end is no node."""
        n = self.nodes.select("id", "type")
        s, t = n.select(F.col("id").alias("source_id"), F.col("type").alias("source_type")), n.select(F.col("id").alias("target_id"), F.col("type").alias("target_type"))
        return self.edges.join(s, "source_id", "left").join(t, "target_id", "left")

    def incident(self) -> DataFrame:
        """(id, other, out, type, provenance, ord): each edge once for each of its ends."""
        e = self.edges
        ends = F.array(F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("other"), F.lit(True).alias("out")), F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("other"), F.lit(False).alias("out")))
        return e.select(F.inline(ends), "type", "provenance", "ord")

    def induced(self, ids: DataFrame) -> DataFrame:
        """The edges with both ends among ids (column id)."""
        i = ids.select("id")
        return self.edges.join(i.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(i.withColumnRenamed("id", "target_id"), "target_id", "left_semi")

    def dangling(self) -> DataFrame:
        """(source_id, target_id, type, ord, missing): edges of which an end is no node, one row for each such end."""
        ids, e = self.nodes.select("id"), self.edges.select("source_id", "target_id", "type", "ord")
        no_source = e.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti").withColumn("missing", F.lit("source"))
        return no_source.unionByName(e.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti").withColumn("missing", F.lit("target")))

    def without_nodes(self, ids: DataFrame) -> Graph:
        """The graph without these nodes and the edges at them."""
        i = ids.select("id")
        e = self.edges.join(i.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(i.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
        return Graph(self.nodes.join(i, "id", "left_anti"), e)

    def without_edges(self, keys: DataFrame) -> Graph:
        k = ["source_id", "target_id", "type"]
        return Graph(self.nodes, self.edges.join(keys.select(*k), k, "left_anti"))

    def with_rows(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Graph:
        """Rows added or replaced; their ord must follow the present ones'."""
        n = upsert(self.nodes.unionByName(nodes), ["id"]) if nodes is not None else self.nodes
        e = upsert(self.edges.unionByName(edges), ["source_id", "target_id", "type"]) if edges is not None else self.edges
        return Graph(n, e)

    def mark_stale(self, ids: DataFrame) -> Graph:
        hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
        return Graph(self.nodes.join(hit, "id", "left").withColumn("is_stale", F.coalesce("_hit", "is_stale")).drop("_hit"), self.edges)

    def mark_edges_stale(self, keys: DataFrame) -> Graph:
        """Edges by source_id, target_id and type; keys of no edge do nothing."""
        k = ["source_id", "target_id", "type"]
        hit = keys.select(*k).distinct().withColumn("_hit", F.lit(True))
        return Graph(self.nodes, self.edges.join(hit, k, "left").withColumn("is_stale", F.coalesce("_hit", "is_stale")).drop("_hit").select(*self.edges.columns))


def top_by(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """A top-k report: TakeOrdered, no global sort."""
    return df.orderBy(*order).limit(k)


def ranked(df: DataFrame, partition: list[str], *order: Column, name: str = "k") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
