"""Bounded and edge-type-aware traversal: one level loop with many policies.

Each level joins the frontier with the edges, drops what was seen and writes the new frontier, so lineage stays one level deep and a
level's work is its own edges. The frontier is broadcast only if Spark finds it small at run time.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.graph import Graph
from graphloom.session import materialize


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None, forward: bool = True, both: bool = False) -> DataFrame:
    """(id, depth): everything within max_depth edges of the seeds (column id), however far with None, seeds at depth 0. Seeds need not be nodes; cycles and
    parallel edges do no harm; no seeds give no rows."""
    a, b = ("source_id", "target_id") if forward else ("target_id", "source_id")
    step = edges.select(F.col(a).alias("id"), F.col(b).alias("next"))
    step = step.unionByName(step.select(F.col("next").alias("id"), F.col("id").alias("next"))) if both else step
    front = materialize(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    seen = front
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        new = front.select("id").join(step, "id").select(F.col("next").alias("id")).distinct()
        front = materialize(new.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        seen = seen if depth % 16 else materialize(seen)
    return seen


def upstream(g: Graph, ids: DataFrame, max_depth: int = 3, compat: bool = False) -> DataFrame:
    """What leads to ids within max_depth edges, without ids. compat stops after one edge, as the hop count has no effect there."""
    return reach(g.edges, ids, 1 if compat else max_depth, forward=False).where("depth > 0")


def downstream(g: Graph, ids: DataFrame, max_depth: int = 3, compat: bool = False) -> DataFrame:
    return reach(g.edges, ids, 1 if compat else max_depth).where("depth > 0")


def subgraph(g: Graph, ids: DataFrame, max_depth: int = 2) -> Graph:
    """The nodes within reach in either direction, ids too, and the edges among them."""
    near = reach(g.edges, ids, max_depth).unionByName(reach(g.edges, ids, max_depth, forward=False)).select("id").distinct()
    near = materialize(near)
    return Graph(g.nodes.join(near, "id", "left_semi"), g.induced(near))


def shortest_path(edges: DataFrame, source: str, target: str, max_depth: int | None = None) -> list[str]:
    """A shortest directed path, [] if there is none; of several the one whose ids sort first from the source on. The distances to the
    target are found level by level; only the path itself comes to the driver, an id a level."""
    spark = edges.sparkSession
    if source == target:
        return [source]
    step = edges.select("source_id", "target_id").distinct()
    front = seen = materialize(spark.createDataFrame([(target, 0)], "id string, depth int"))
    found = False
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        new = step.join(front.select(F.col("id").alias("target_id")), "target_id").select(F.col("source_id").alias("id")).distinct()
        front = materialize(new.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return []
        seen = seen.unionByName(front)
        seen = seen if depth % 16 else materialize(seen)
        if not front.where(F.col("id") == source).isEmpty():
            found = True
            break
    if not found:
        return []
    path, at = [source], source
    for left in range(depth - 1, -1, -1):
        at = step.where(F.col("source_id") == at).join(seen.where(F.col("depth") == left), F.col("target_id") == F.col("id")).agg(F.min("id")).first()[0]
        path.append(at)
    return path


def components(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, component): the smallest id each node is connected with, directions ignored, ends that are no nodes included. Labels jump to
    the label of their label each round, so rounds grow with the logarithm of a component's width, not with its width."""
    pairs = edges.select("source_id", "target_id").where("source_id <> target_id").distinct()
    every = ids.select("id").unionByName(pairs.select(F.col("source_id").alias("id"))).unionByName(pairs.select(F.col("target_id").alias("id"))).distinct()
    ranks = materialize(every.sort("id").withColumn("code", F.monotonically_increasing_id()))
    a, b = ranks.select(F.col("id").alias("source_id"), F.col("code").alias("u")), ranks.select(F.col("id").alias("target_id"), F.col("code").alias("v"))
    coded = pairs.join(a, "source_id").join(b, "target_id").select("u", "v")
    step = materialize(coded.unionByName(coded.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    label = materialize(ranks.select(F.col("code").alias("u"), F.col("code").alias("l")))
    while True:
        near = step.join(label.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        least = label.join(near, "u", "left").select("u", "l", F.least("l", F.coalesce("m", "l")).alias("n"))
        jump = least.select(F.col("u").alias("n"), F.col("n").alias("far"))
        new = materialize(least.join(jump, "n").select("u", F.col("far").alias("l"), (F.col("far") < F.col("l")).alias("news")))
        label = new.select("u", "l")
        if new.where("news").isEmpty():
            break
    names = ranks.select(F.col("code").alias("l"), F.col("id").alias("component"))
    return ranks.select(F.col("code").alias("u"), "id").join(label, "u").join(names, "l").select("id", "component")


def _cascade(g: Graph, triggers: DataFrame, hops: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(what smart_cascade() gives, the (trigger, id) of the last level from which it would go on, the (id, other) it goes on along)."""
    structural = F.col("type").isin(schema.STRUCTURAL)
    inc = g.incident().select("id", "other", "out", structural.alias("structural"), "ord")
    follow = inc.where("not structural").select("id", "other")
    start = triggers.select("id").distinct()
    seen = start.select(F.col("id").alias("trigger"), "id", F.lit(0).alias("depth"))
    if hops <= 0:
        return seen, seen.select("trigger", "id").limit(0), follow
    first = start.join(inc, "id").where("id <> other").groupBy("id", "other").agg(F.min(F.struct((~F.col("out")).alias("late"), "ord", "structural"))["structural"].alias("structural"))
    front = materialize(first.select(F.col("id").alias("trigger"), F.col("other").alias("id"), F.lit(1).alias("depth"), (~F.col("structural")).alias("goes_on")))
    seen = seen.unionByName(front.drop("goes_on"))
    front = front.where("goes_on")
    for depth in range(2, hops + 1):
        new = front.select("trigger", "id").join(follow, "id").select("trigger", F.col("other").alias("id")).distinct()
        front = materialize(new.join(seen.select("trigger", "id"), ["trigger", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen, front.select("trigger", "id"), follow


def smart_cascade(g: Graph, triggers: DataFrame, hops: int = 2) -> DataFrame:
    """(trigger, id, depth): what turns stale if a trigger changes, triggers at depth 0. Structural edges count only from a trigger itself
    and are not followed further; other edges are followed up to `hops`, in both directions. A neighbour of the trigger that both kinds of
    edges join is followed only if its first edge (outgoing before incoming, then by insertion) is not structural."""
    return _cascade(g, triggers, hops)[0]


#: Rows that the last hop of all cascades through one node would make, from which on that node is a hub.
HUB_ROWS = 100_000


def propagate_staleness(g: Graph, triggers: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """(totals per trigger, stale edges). A node counts as newly stale for the smallest trigger that reaches it, if it was not stale
    before; an edge becomes stale if some cascade saw both its ends.

    The last hop through a hub gives all its triggers the same nodes, so these are listed once for each group of triggers that come to the
    same hubs, under the group's first trigger, and not once a trigger: that one is the owner of whatever the group sees in common."""
    g = Graph(g.nodes, materialize(g.edges.select("source_id", "target_id", "type", "provenance", "ord")))
    start = triggers.select("id").distinct().select(F.col("id").alias("trigger"))
    seen, front, follow = _cascade(g, triggers, min(hops, max(1, hops - 1)))
    front = materialize(front) if hops > 1 else front.limit(0)
    follow = materialize(follow.join(front.select("id").distinct(), "id", "left_semi"))
    ways = follow.groupBy("id").agg(F.count(F.lit(1)).alias("ways"))
    hubs = materialize(front.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(ways, "id").where(F.col("n") * F.col("ways") > HUB_ROWS).select("id"))
    of = front.join(hubs, "id", "left_semi").groupBy("trigger").agg(F.sort_array(F.collect_set("id")).alias("hubs"))
    of = materialize(of.withColumn("first", F.min("trigger").over(Window.partitionBy("hubs"))))
    at = of.where(F.col("trigger") == F.col("first")).select("first", F.explode("hubs").alias("id"))
    held = materialize(at.unionByName(at.join(follow, "id").select("first", F.col("other").alias("id"))).distinct())
    of = of.select("trigger", "first")
    alone = front.join(hubs, "id", "left_anti").join(follow, "id").select("trigger", F.col("other").alias("id"))
    alone = seen.select("trigger", "id").unionByName(alone).distinct().join(of, "trigger", "left")
    alone = materialize(alone.join(held, ["first", "id"], "left_anti").select("trigger", "first", "id"))

    pairs = alone.select("trigger", "id", F.lit(False).alias("shared")).unionByName(held.select(F.col("first").alias("trigger"), "id", F.lit(True).alias("shared")))
    owner = pairs.groupBy("id").agg(F.min("trigger").alias("owner"), F.count(F.lit(1)).alias("n"))
    state = g.nodes.select("id", F.coalesce("is_stale", F.lit(False)).alias("was"))
    newly = (F.col("trigger") == F.col("owner")) & (F.col("was") == F.lit(False))
    counts = [F.count(F.when(what & on, 1)).alias(f"{c}_{k}") for k, what in (("own", ~F.col("shared")), ("all", F.col("shared"))) for c, on in (("seen", F.lit(True)), ("newly", newly), ("already", F.col("was")))]
    each = pairs.join(owner, "id").join(state, "id", "left").groupBy("trigger").agg(*counts)
    group = Window.partitionBy(F.coalesce("first", "trigger"))
    rows = start.join(each, "trigger", "left").join(of, "trigger", "left").na.fill(0)
    total = lambda c, of_all: (F.col(f"{c}_own") + of_all).alias(f"n_{c}")
    totals = rows.select("trigger", total("seen", F.sum("seen_all").over(group)), total("newly", F.col("newly_all")), total("already", F.sum("already_all").over(group)))

    ends = materialize(owner.select("id", "n"))
    e = g.edges.select("source_id", "target_id", "type").join(ends.select(F.col("id").alias("source_id"), F.col("n").alias("a")), "source_id")
    e = materialize(e.join(ends.select(F.col("id").alias("target_id"), F.col("n").alias("b")), "target_id"))
    lone = alone.where("first is not null").groupBy("first", "id").agg(F.min("trigger").alias("trigger"))
    found = []
    for near, far, fewer in (("source_id", "target_id", F.col("a") <= F.col("b")), ("target_id", "source_id", F.col("a") > F.col("b"))):
        s, t = pairs.select("trigger", F.col("id").alias(near)), pairs.select("trigger", F.col("id").alias(far))
        found.append(e.where(fewer).join(s, near).join(t, ["trigger", far]))  # from the end that fewer cascades see
        found.append(e.join(lone.withColumnRenamed("id", near), near).join(held.withColumnRenamed("id", far), ["first", far]))
    keys = ["source_id", "target_id", "type"]
    every = found[0].select("trigger", *keys)
    for x in found[1:]:
        every = every.unionByName(x.select("trigger", *keys))
    return totals, every.groupBy(*keys).agg(F.min("trigger").alias("owner"))


def trace_flow(g: Graph, entries: DataFrame, max_depth: int = 10) -> DataFrame:
    """(entry, pos, id): the executable nodes met breadth first along CALLS from each entry, the entry at pos 0; children follow in the
    order of their parents and edges. A node is met once per entry."""
    ok = g.nodes.where(F.col("type").isin(schema.EXECUTABLE)).select(F.col("id").alias("target_id"))
    calls = materialize(g.edges.where("type = 'CALLS'").join(ok, "target_id", "left_semi").select(F.col("source_id").alias("id"), F.col("target_id").alias("next"), "ord"))
    front = materialize(entries.select(F.col("id").alias("entry"), "id", F.lit(0).cast("long").alias("pos")))
    seen, depth = front, 0
    while depth < max_depth:
        depth += 1
        new = front.join(calls, "id").groupBy("entry", "next").agg(F.min(F.struct("pos", "ord")).alias("at")).select("entry", F.col("next").alias("id"), "at")
        new = new.join(seen.select("entry", "id"), ["entry", "id"], "left_anti")
        base = seen.groupBy("entry").agg(F.max("pos").alias("base"))
        order = F.row_number().over(Window.partitionBy("entry").orderBy("at", "id"))
        front = materialize(new.join(base, "entry").select("entry", "id", (F.col("base") + order).alias("pos")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def containment_depth(g: Graph) -> int:
    """The longest way down CONTAINS from a node nothing contains."""
    down = g.edges.where("type = 'CONTAINS'").select("source_id", "target_id")
    roots = down.select(F.col("source_id").alias("id")).distinct().join(down.select(F.col("target_id").alias("id")), "id", "left_anti")
    return reach(down, roots, None).agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]


def strong_parts(out: dict, among: set) -> list[set]:
    """The strongly connected parts of more than one node of the graph of `among`, by Tarjan without recursion."""
    index, low, stack, on, parts = {}, {}, [], set(), []
    for root in among:
        if root in index:
            continue
        work = [(root, iter(out.get(root, ())))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in among:
                    continue
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = set()
                    while v not in part:
                        part.add(stack.pop())
                    on -= part
                    if len(part) > 1:
                        parts.append(part)
    return parts


def count_cycles(out: dict, enough: int) -> int:
    """The number of simple cycles of at least two nodes, of any length, as far as `enough`, by Johnson's walk: a node from which the start
    was not reached is left alone until one after it is, so every cycle costs at most the size of its part."""
    found, parts = 0, strong_parts(out, set(out))
    while parts and found < enough:
        part = parts.pop()
        start = min(part)
        path, blocked, closed, waiting = [start], {start}, set(), defaultdict(set)
        near = {v: [w for w in out[v] if w in part] for v in part}
        work = [(start, list(near[start]))]
        while work and found < enough:
            v, rest = work[-1]
            if rest:
                w = rest.pop()
                if w == start:
                    found += 1
                    closed.update(path)
                elif w not in blocked:
                    path.append(w)
                    work.append((w, list(near[w])))
                    closed.discard(w)
                    blocked.add(w)
                continue
            if v in closed:
                free = [v]
                while free:
                    x = free.pop()
                    if x in blocked:
                        blocked.remove(x)
                        free += waiting.pop(x, ())
            else:
                for w in near[v]:
                    waiting[w].add(v)
            work.pop()
            path.pop()
        parts += strong_parts(near, part - {start})
    return min(found, enough)


def import_cycles(g: Graph, enough: int = 5) -> int:
    """The number of simple cycles of IMPORTS of any length, counted only as far as `enough`, where the penalty they bring is full. Nodes
    without an import in or out can lie on no cycle and are peeled off while that pays; what is left is walked component by component."""
    e = materialize(g.edges.where("type = 'IMPORTS'").select("source_id", "target_id").distinct())
    found = e.where("source_id = target_id").limit(enough).count()
    if found >= enough:
        return enough
    e = e.where("source_id <> target_id")
    n = e.count()
    while n:
        e = materialize(e.join(e.select(F.col("target_id").alias("source_id")).distinct(), "source_id", "left_semi").join(e.select(F.col("source_id").alias("target_id")).distinct(), "target_id", "left_semi"))
        before, n = n, e.count()
        if n > 0.95 * before:
            break
    if not n:
        return found
    of = components(e, e.select(F.col("source_id").alias("id")))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = defaultdict(list)
        for a, b in sorted(zip(part["source_id"], part["target_id"])):
            out[a].append(b)
        return pd.DataFrame({"n": [count_cycles(out, enough)]})

    each = e.join(of.select(F.col("id").alias("source_id"), "component"), "source_id").groupBy("component").applyInPandas(run, "n long")
    return min(enough, found + (each.agg(F.sum("n")).first()[0] or 0))
