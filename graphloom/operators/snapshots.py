"""What changed between consecutive full deliveries of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_in_snapshot(table: DataFrame, number: str, key: Column, order: list[Column], fields: list[Column]) -> DataFrame:
    """(_no, _id, _f): per snapshot and key the digest of the compared fields in the row with the greatest `order`, ties going to the
    greatest digest. Rows are spread by key alone, which serves every later step, so this is the only shuffle of whole rows."""
    marked = [F.coalesce(F.concat(F.lit("="), f.cast("string")), F.lit("")) for f in fields]
    rows = table.select(F.col(number).alias("_no"), key.alias("_id"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("_o"), F.unhex(F.sha2(F.concat_ws("\x1f", *marked), 256)).alias("_f"))
    rows = rows.where("_no is not null and _id is not null").repartition("_id")
    return rows.groupBy("_no", "_id").agg(F.max(F.struct("_o", "_f"))["_f"].alias("_f"))


def snapshot_changes(table: DataFrame, number: str, key: Column, order: list[Column], fields: list[Column]) -> DataFrame:
    """(snapshot_no, id, change): the difference of each delivered snapshot to the one delivered before it.

    Within a snapshot the row with the greatest `order` counts for each key; rows equal in `order` are told apart by a digest of their
    fields, so the outcome never depends on the order of arrival. `fields` are the compared expressions, null being equal to null only. A
    null key or number is no record and is left out. An empty table, or one snapshot, has no changes.
    All pairs of snapshots are compared at once: EXCEPT ALL both ways over (pair, key, fields) drops what is identical, and a full join
    of the residues by key labels the rest. Only the list of distinct snapshot numbers is ever sorted in one place."""
    last = latest_in_snapshot(table, number, key, order, fields)
    line = Window.orderBy("_no")
    numbers = table.select(F.col(number).alias("_no")).where("_no is not null").distinct()
    numbers = numbers.select("_no", F.lead("_no").over(line).alias("_next"), F.lag("_no").over(line).alias("_prev"))
    placed = last.join(numbers, "_no")
    later = placed.where("_prev is not null").select(F.col("_no").alias("pair"), "_id", "_f")
    earlier = placed.where("_next is not null").select(F.col("_next").alias("pair"), "_id", "_f")
    old = earlier.exceptAll(later).select("pair", "_id", F.lit(True).alias("_was"))
    new = later.exceptAll(earlier).select("pair", "_id", F.lit(True).alias("_is"))
    label = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").otherwise("changed")
    return old.join(new, ["pair", "_id"], "full_outer").select(F.col("pair").alias("snapshot_no"), F.col("_id").alias("id"), label.alias("change"))


def run_disagreements(changes: DataFrame, project: Column, runs: DataFrame) -> DataFrame:
    """(project, snapshot_no, found and reported counts of added, updated and removed nodes) where the two disagree.
    Runs of one project and snapshot add up; a null count counts as 0; a side without rows for a project and snapshot counts 0."""
    names = {"added": "nodes_added", "changed": "nodes_updated", "removed": "nodes_removed"}
    count = lambda k: F.count(F.when(F.col("change") == k, 1))
    found = changes.groupBy(project.alias("project"), "snapshot_no").agg(*[count(k).alias(f"found_{k}") for k in names])
    told = runs.where("snapshot_no is not null and project is not null").groupBy("project", "snapshot_no").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(f"reported_{k}") for k, c in names.items()])
    cols = [f"{a}_{k}" for k in names for a in ("found", "reported")]
    both = found.join(told, ["project", "snapshot_no"], "full_outer").select("project", "snapshot_no", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in cols])
    return both.where(" or ".join(f"found_{k} <> reported_{k}" for k in names))
