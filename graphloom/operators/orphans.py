"""References to parents that do not exist at the time of the reference.

Ids become dense integer codes, and a parent living from one time to another holds the integer keys (code, time) of that stretch. In
the order of the keys, parents that neighbour each other without a gap, in time or from one code to the next, form contiguous runs. A
reference is a key too: it is matched as of itself to the run that starts at or before it, and is an orphan if it lies beyond that
run's end. Codes count the ids of references and parents alike, so an id without parent is a gap that ends a run.

Keys are cut into blocks by a hash of the id, and codes, runs and matches are made in one sorted pass over each block: one shuffle
of references and parents, no join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

FOREVER = 9223372036854775806
#: References of one block, about; ids that hold more than HOT of all references (at most 1/HOT of them) are spread over SPREAD blocks.
BLOCK_ROWS, HOT, SPREAD = 100_000, 0.002, 32


@dataclass
class Profile:
    """What the references look like: their number, first and last time, and the hashes of hot ids, which only route rows."""

    n: int
    first: int | None
    last: int | None
    hot: list[int]


def profile(refs: DataFrame, ref: str, at: str) -> Profile:
    """One pass over the references, summed before the shuffle; at most 1/HOT hashes reach the driver, whatever the size."""
    if refs.isEmpty():  # nothing would be observed
        return Profile(0, None, None, [])
    seen = Observation()
    watched = refs.select(F.xxhash64(ref).alias("h"), at).observe(seen, F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    counts = watched.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where("n > 1000").orderBy(F.desc("n")).limit(round(1 / HOT)).collect()
    got = seen.get
    return Profile(got["n"], got["first"], got["last"], [r["h"] for r in top if r["n"] > got["n"] * HOT])


def keyed(refs: DataFrame, ref: str, at: str, parents: DataFrame, like: Profile) -> DataFrame:
    """(block, code, at, upto, id, kind, row): parents, with kind 0 and upto the end of the lifetime, and references, with kind 1 and row
    the other columns, under dense codes. Lifetimes are clipped to the times references have, so that parents alive all through adjoin."""
    blocks, hot = max(12, like.n // BLOCK_ROWS), like.hot
    home = F.pmod(F.xxhash64("id"), F.lit(blocks))
    spread = F.xxhash64("id").isin(hot) if hot else F.lit(False)
    p = parents.select("id", F.greatest("start", F.lit(like.first)).alias("at"), F.least(F.coalesce("end", F.lit(FOREVER)), F.lit(like.last)).alias("upto"))
    p = p.where("id is not null and at <= upto").withColumn("slot", F.explode(F.when(spread, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))))
    rest = [F.col(c) for c in refs.columns if c not in (ref, at)]
    r = refs.select(F.col(ref).alias("id"), F.col(at).alias("at"), F.struct(*rest, F.lit(1).alias("_kind")).alias("row"))
    r = r.withColumn("slot", F.when(spread, F.pmod(F.xxhash64("row"), F.lit(SPREAD)).cast("int")).otherwise(F.lit(0)))
    both = p.withColumn("row", F.lit(None).cast(r.schema["row"].dataType)).select("id", "at", "upto", "slot", "row", F.lit(0).alias("kind")).unionByName(r.withColumns({"upto": F.lit(None).cast("long"), "kind": F.lit(1)}))
    keys = both.select(F.pmod(home + F.col("slot") * 7919, F.lit(blocks)).alias("block"), "slot", "id", "at", "upto", "kind", "row")
    order = _in_block()
    fresh = F.coalesce((F.col("id") != F.lag("id").over(order)) | (F.col("slot") != F.lag("slot").over(order)), F.lit(True))
    return keys.withColumn("fresh", fresh.cast("int")).withColumn("code", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _in_block():
    """Parents come before references of the same time."""
    return Window.partitionBy("block").orderBy("slot", "id", "at", "kind")


def runs(keys: DataFrame, like: Profile) -> DataFrame:
    """keys with, of the run that starts at or before each row, run (its number in the block, 0 if there is none), and run_end (code, upto):
    how far it reaches by the parents up to this row, which decides on any row here, as later parents start later."""
    here = _in_block()
    end = F.when(F.col("kind") == 0, F.struct("code", "upto"))
    before = F.max(end).over(here.rowsBetween(Window.unboundedPreceding, -1))
    after = F.when(before["upto"] == like.last, F.struct((before["code"] + 1).alias("code"), F.lit(like.first).alias("at"))).otherwise(F.struct(before["code"].alias("code"), (before["upto"] + 1).alias("at")))
    starts = (F.col("kind") == 0) & F.coalesce(F.struct("code", "at") > after, F.lit(True))
    out = keys.withColumn("starts", starts.cast("int")).withColumn("run_end", F.max(end).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("run", F.sum("starts").over(here.rowsBetween(Window.unboundedPreceding, 0)))


def parent_runs(refs: DataFrame, ref: str, at: str, parents: DataFrame) -> DataFrame:
    """(block, run, n_parents, first_id, first_at, last_id, last_at): the contiguous runs that lifetimes are compressed into."""
    like = profile(refs.where(F.col(ref).isNotNull()), ref, at)
    if like.first is None:
        return refs.sparkSession.createDataFrame([], "block long, run long, n_parents long, first_id string, first_at long, last_id string, last_at long")
    found = runs(keyed(refs.where(F.col(ref).isNotNull() & F.col(at).isNotNull()), ref, at, parents, like), like).where("kind = 0")
    first, last = F.min(F.struct("code", "at", "id")), F.max(F.struct("code", "upto", "id"))
    return found.groupBy("block", "run").agg(F.count(F.lit(1)).alias("n_parents"), first.alias("f"), last.alias("l")).select("block", "run", "n_parents", F.col("f.id").alias("first_id"), F.col("f.at").alias("first_at"), F.col("l.id").alias("last_id"), F.col("l.upto").alias("last_at"))


def as_of_orphans(refs: DataFrame, ref: str, at: str, parents: DataFrame) -> DataFrame:
    """The rows of refs, with all their columns, whose integer time `at` no parent (id, start, end; long) of their id covers.

    Both bounds of a lifetime belong to it and a null end is open; a null start, a null id or an end before the start is no lifetime;
    several lifetimes of one id add up. A null `at` exists at no time, so such a row is an orphan; a null ref refers to nothing and is
    left out; repeated rows stay repeated; either side may be empty."""
    refs = refs.where(F.col(ref).isNotNull())
    timeless = refs.where(F.col(at).isNull())
    like = profile(refs, ref, at)
    if like.first is None:
        return timeless
    p = parents.where("start is not null")
    matched = runs(keyed(refs.where(F.col(at).isNotNull()), ref, at, p, like), like).where("kind = 1")
    beyond = (F.col("run") == 0) | (F.struct("code", F.col("at").alias("upto")) > F.col("run_end"))
    back = [F.col("id" if c == ref else "at" if c == at else f"row.{c}").alias(c) for c in refs.columns]
    return matched.where(beyond).select(*back).unionByName(timeless)


def endpoints(edges: DataFrame, key, edge_id: str = "edge_id", at: str = "indexed_at") -> DataFrame:
    """(edge_id, endpoint, ref, at): one row for each end of an edge that is not null; key(column) gives the form compared."""
    ends = F.array(*[F.struct(F.lit(c).alias("endpoint"), key(c).alias("ref")) for c in ("source_id", "target_id")])
    return edges.select(F.col(edge_id).alias("edge_id"), F.unix_micros(at).alias("at"), F.inline(ends)).where("ref is not null")


def lifetimes(nodes: DataFrame, key) -> DataFrame:
    """(id, start, end) in microseconds, both included, of [first_seen, removed_at)."""
    return nodes.select(key("id").alias("id"), F.unix_micros("first_seen").alias("start"), (F.unix_micros("removed_at") - 1).alias("end"))


def period(at: Column) -> Column:
    return F.date_format(F.timestamp_micros(at), "yyyy-MM")


def edge_orphans(nodes: DataFrame, edges: DataFrame, key) -> DataFrame:
    """(edge_id, endpoint, ref, at): ends of edges that name no node existing at indexed_at, see as_of_orphans."""
    return as_of_orphans(endpoints(edges, key), "ref", "at", lifetimes(nodes, key))


def orphan_report(nodes: DataFrame, edges: DataFrame, key) -> DataFrame:
    """(endpoint, period, n_refs, n_orphans, orphan_ids): counts per edge end and month; a null indexed_at has a null period."""
    by = ["endpoint", "period"]
    all_refs = endpoints(edges, key).groupBy("endpoint", period(F.col("at")).alias("period")).agg(F.count(F.lit(1)).alias("n_refs"))
    lost = edge_orphans(nodes, edges, key).groupBy("endpoint", period(F.col("at")).alias("period"), "ref").agg(F.count(F.lit(1)).alias("n"))
    lost = lost.groupBy(*by).agg(F.sum("n").alias("n_orphans"), F.count(F.lit(1)).alias("orphan_ids"))
    cond = [all_refs[c].eqNullSafe(lost[c]) for c in by]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return all_refs.join(lost, cond, "left").select(*[all_refs[c] for c in by], "n_refs", zero("n_orphans"), zero("orphan_ids"))
