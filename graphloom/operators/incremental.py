"""Keeping a graph up to date with changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, top_by, upsert
from graphloom.operators.impact import changed_nodes
from graphloom.operators.traverse import propagate_staleness, reach
from graphloom.session import materialize


def change_groups(changes: DataFrame) -> DataFrame:
    """(change_type, n, paths): changes grouped by kind, paths sorted."""
    return changes.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("path")).alias("paths"))


def remove_files(g: Graph, paths: DataFrame) -> Graph:
    """The graph without the nodes of these files and their edges."""
    return g.without_nodes(changed_nodes(g, paths).select("id").distinct())


def rename_files(g: Graph, renames: DataFrame) -> Graph:
    """Nodes and edges re-keyed after renames (old_path, path): the old path inside an id becomes the new one, in its lower-case form. A
    node belongs to a rename by its file, so ids and renames meet by equality."""
    file = F.translate("location.file_path", "\\", "/")
    r = renames.select(F.col("old_path").alias("_file"), F.lower("old_path").alias("_old"), F.lower("path").alias("_new"), F.col("path").alias("_path"))
    keyed = g.nodes.select("id", file.alias("_file")).join(r, "_file").select("id", F.replace("id", F.col("_old"), F.col("_new")).alias("_id"), "_path")
    nodes = g.nodes.join(keyed, "id", "left")
    loc = F.when(F.col("_path").isNull(), F.col("location")).otherwise(F.col("location").withField("file_path", F.col("_path")))
    new_parent = keyed.select(F.col("id").alias("parent_id"), F.col("_id").alias("_parent"))
    nodes = nodes.withColumn("location", loc).withColumn("id", F.coalesce("_id", "id")).drop("_id", "_path").join(new_parent, "parent_id", "left").withColumn("parent_id", F.coalesce("_parent", "parent_id")).select(*g.nodes.columns)
    edges = g.edges
    for end in ("source_id", "target_id"):
        edges = edges.join(keyed.select(F.col("id").alias(end), F.col("_id").alias("_new")), end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
    return Graph(nodes, upsert(edges.select(*g.edges.columns), ["source_id", "target_id", "type"]))


def selective_upsert(g: Graph, paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> Graph:
    """What is left after the changed files' nodes are gone, with the recomputed ones: (graph - affected) + recomputed."""
    return remove_files(g, paths).with_rows(nodes, edges)


def blast_radius(g: Graph, paths: DataFrame, hops: int = 2) -> DataFrame:
    """(id, depth): what depends, within hops, on the nodes of the changed files."""
    return reach(g.edges, changed_nodes(g, paths).select("id").distinct(), hops, forward=False)


def change_report(g: Graph, paths: DataFrame, hops: int = 2, most: int = 50) -> DataFrame:
    """(n_affected, n_blast, first_ids): nodes of the changed files, what depends on them within hops, and the first ids of that, at most
    `most`. No changes give zeros and no ids."""
    hit = materialize(changed_nodes(g, paths).select("id").distinct())
    far = materialize(reach(g.edges, hit, hops, forward=False).where("depth > 0").select("id"))
    first = top_by(far, most, F.asc("id")).agg(F.sort_array(F.collect_list("id")).alias("first_ids"))
    return hit.agg(F.count(F.lit(1)).alias("n_affected")).crossJoin(far.agg(F.count(F.lit(1)).alias("n_blast"))).crossJoin(first)


def update(g: Graph, changes: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 2) -> tuple[Graph, DataFrame]:
    """(graph, totals of staleness) of a set of changes: what changed spreads staleness, then the files are read anew."""
    totals, _ = propagate_staleness(g, changed_nodes(g, changes).select("id").distinct(), hops)
    return selective_upsert(g, changes, nodes, edges), totals
