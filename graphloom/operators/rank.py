"""Ranking: PageRank, betweenness, composite importance; communities; architecture scores."""

from __future__ import annotations

import random
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.store import simple_degrees
from graphloom.operators.traverse import containment_depth, import_cycles
from graphloom.session import discard, materialize, materialize_with

#: Shares of the parts of importance, types and edges of semantic clusters.
WEIGHTS = (0.5, 0.3, 0.2)
CLUSTER_NODES = ["Function", "AsyncHandler", "Middleware", "Class", "Method", "Endpoint", "DataModel", "Event", "ExternalAPI", "TypeDef"]
CLUSTER_EDGES = ["CALLS", "IMPORTS", "READS_DB", "WRITES_DB", "CALLS_API", "EMITS_EVENT", "CONSUMES_EVENT", "ENQUEUES", "DEQUEUES", "CALLS_SERVICE", "IMPLEMENTS", "INHERITS"]
HOLDERS, ROOTS = ["CONTAINS", "DEFINES"], ["Workspace", "Project"]


def pagerank(vertices: DataFrame, links: DataFrame, alpha: float = 0.85, rounds: int = 100, tol: float = 1e-6) -> DataFrame:
    """(id, rank) by power iteration over weighted links (source_id, target_id, weight); ranks sum to 1.

    The rank of vertices without links out, or whose links weigh nothing, is spread evenly. It ends when the ranks move by less than
    tol times the number of vertices, or after `rounds`; tol 0 runs all rounds. Contributions are summed before the shuffle, so a vertex
    with most of the links is no single task's work; ids are coded as integers once."""
    v = materialize(vertices.select("id").distinct().sort("id").withColumn("u", F.monotonically_increasing_id()))
    n = v.count()
    if not n:
        return v.select("id", F.lit(0.0).alias("rank"))
    out = links.groupBy("source_id").agg(F.sum("weight").alias("all")).where(F.col("all") > 0)
    a, b = v.select(F.col("id").alias("source_id"), "u"), v.select(F.col("id").alias("target_id"), F.col("u").alias("v"))
    coded = materialize(links.join(out, "source_id").join(a, "source_id").join(b, "target_id").select("u", "v", (F.col("weight") / F.col("all")).alias("w")))
    rank = materialize(v.select("u").join(coded.select("u").distinct().withColumn("has", F.lit(True)), "u", "left").select("u", F.lit(1.0 / n).alias("r"), F.coalesce("has", F.lit(False)).alias("has")))
    lost = rank.agg(F.sum(F.when(~F.col("has"), F.col("r")).otherwise(0.0))).first()[0]
    for _ in range(rounds):
        got = coded.join(rank, "u").groupBy(F.col("v").alias("u")).agg(F.sum(F.col("r") * F.col("w")).alias("g"))
        value = F.lit(alpha) * (F.coalesce("g", F.lit(0.0)) + F.lit(lost / n)) + F.lit((1 - alpha) / n)
        step = rank.join(got, "u", "left").select("u", value.alias("r"), "has", F.abs(value - F.col("r")).alias("moved"))
        new, seen = materialize_with(step, moved=F.sum("moved"), lost=F.sum(F.when(~F.col("has"), F.col("r")).otherwise(0.0)))
        lost = seen["lost"]
        discard(rank)
        rank = new
        if seen["moved"] < tol * n:
            break
    return v.join(rank, "u").select("id", F.col("r").alias("rank"))


def graph_pagerank(g: Graph, rounds: int = 100, tol: float = 1e-6) -> DataFrame:
    """PageRank on the simple graph; ends that are no nodes count as vertices but are left out of the result. A null weight counts 0.5."""
    s = g.simple().select("source_id", "target_id", F.coalesce("weight", F.lit(0.5)).alias("weight"))
    every = g.nodes.select("id").unionByName(s.select(F.col("source_id").alias("id"))).unionByName(s.select(F.col("target_id").alias("id")))
    return pagerank(every, s, rounds=rounds, tol=tol).join(g.nodes.select("id"), "id", "left_semi")


#: Sources are walked from in written batches, so that a lost executor costs no more than a batch.
BATCH = 16_384


def dense_codes(vertices: DataFrame) -> tuple[DataFrame, int]:
    """((id, u), n): the ids numbered from 0 to n-1 in their order."""
    v = materialize(vertices.select("id").distinct().sort("id").withColumn("m", F.monotonically_increasing_id()))
    part = F.shiftright("m", 33)
    sizes = sorted((r.p, r.n) for r in v.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    bases, n = {}, 0
    for p, size in sizes:
        bases[p], n = n - (p << 33), n + size
    if not n:
        return v.select("id", F.col("m").alias("u")), 0
    base = F.create_map(*[F.lit(x) for kv in bases.items() for x in kv])
    return v.select("id", (F.col("m") + F.element_at(base, part)).cast("long").alias("u")), n


def betweenness(vertices: DataFrame, links: DataFrame, pivots: int | None = None) -> DataFrame:
    """(id, betweenness), directed, unweighted, over (n-1)(n-2); exact, or, only if asked for, estimated from so many pivots as sources (a
    fixed sample). Sources are spread over the tasks, each of which walks the whole graph from its sources: the work is vertices times
    links, and the links travel to every task, four bytes a link."""
    ids, n = dense_codes(vertices)
    s, t = ids.select(F.col("id").alias("source_id"), F.col("u").alias("a")), ids.select(F.col("id").alias("target_id"), F.col("u").alias("b"))
    pairs = links.select("source_id", "target_id").where("source_id <> target_id").distinct().join(s, "source_id").join(t, "target_id").select("a", "b").toArrow()
    a, b = (pairs.column(c).to_numpy() for c in ("a", "b"))
    order = np.argsort(a, kind="stable")
    offsets = np.searchsorted(a[order], np.arange(n + 1)).astype(np.int32 if len(a) < 2**31 else np.int64)
    spark = vertices.sparkSession
    shared = spark.sparkContext.broadcast((offsets, b[order].astype(np.int32), n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        off, nxt, size = shared.value
        total, scratch = np.zeros(size), _scratch(size)
        for b in batches:
            for s in b["id"]:
                at, delta = _dependencies(off, nxt, int(s), scratch)
                total[at] += delta
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"u": hit, "b": total[hit]})

    some = random.Random(7).sample(range(n), pivots) if pivots and pivots < n else range(n)
    sums = None
    for first in range(0, len(some), BATCH):
        batch = some[first : first + BATCH]
        slices = min(len(batch), 4 * spark.sparkContext.defaultParallelism)
        sources = spark.range(batch[0], batch[-1] + 1, 1, slices) if isinstance(batch, range) else spark.createDataFrame([(x,) for x in batch], "id long").repartition(slices)
        one = sources.mapInPandas(run, "u long, b double").groupBy("u").agg(F.sum("b").alias("b"))
        one = materialize(one)
        sums = one if sums is None else sums.unionByName(one)
    if sums is None:
        return ids.select("id", F.lit(0.0).alias("betweenness"))
    scale = (n / max(1, len(some))) / ((n - 1) * (n - 2)) if n > 2 else 1.0
    total = sums.groupBy("u").agg(F.sum("b").alias("b"))
    return ids.join(total, "u", "left").select("id", F.round(F.coalesce("b", F.lit(0.0)) * scale, 10).alias("betweenness"))


def _scratch(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What _dependencies() writes on and leaves clean: whether a vertex was met (-1: not), its ways from the source, its place in its level."""
    return np.full(n, -1, np.int8), np.zeros(n), np.zeros(n, np.int32)


def _dependencies(off: np.ndarray, nxt: np.ndarray, s: int, scratch: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, what the shortest paths from s add to each of them), level by level; only what s reaches is touched."""
    met, ways, place = scratch
    front, steps = np.array([s], np.int32), []
    met[s], ways[s] = 0, 1
    while True:
        begin = off[front]
        count = off[front + 1] - begin
        ends = np.cumsum(count)
        if not len(ends) or not ends[-1]:
            break
        at = np.repeat(begin - (ends - count), count)
        at += np.arange(ends[-1], dtype=at.dtype)
        b = nxt[at]
        on = np.flatnonzero(met[b] < 0)
        if not len(on):
            break
        b, a = b[on], np.repeat(np.arange(len(front), dtype=np.int32), count)[on]
        k = np.arange(len(b), dtype=np.int32)
        place[b] = k
        new = b[place[b] == k]  # each once
        place[new] = k[: len(new)]
        to, before = place[b], ways[front]
        own = np.bincount(to, before[a], len(new))
        met[new], ways[new] = 0, own
        steps.append((new, a, to, before, own))
        front = new
    met[s] = -1
    delta = np.zeros(len(steps[-1][0])) if steps else np.zeros(0)
    found = [delta]
    for k in range(len(steps) - 1, 0, -1):
        _, a, to, before, own = steps[k]
        delta = np.bincount(a, ((1 + delta) / own)[to], len(before)) * before
        found.append(delta)
    levels = [new for new, *_ in reversed(steps)]
    for new in levels:
        met[new] = -1
    return np.concatenate([np.zeros(0, np.int32), *levels]), np.concatenate(found)


def importance(g: Graph, rounds: int = 100, tol: float = 1e-6) -> DataFrame:
    """(id, pagerank, betweenness, centrality, score, ord): half the normalised PageRank, three tenths betweenness, two tenths in-degree
    centrality. Graphs of fewer than three nodes get equal scores; betweenness is exact at every size, so its cost grows with the square."""
    n = g.nodes.count()
    if n < 3:
        return g.nodes.select("id", *[F.lit(1.0 / max(1, n)).alias(c) for c in ("pagerank", "betweenness", "centrality", "score")], "ord")
    pr = graph_pagerank(g, rounds, tol)
    dc = simple_degrees(g).select("id", "centrality")
    links = materialize(g.simple())
    bw = betweenness(g.nodes, links)
    x = materialize(g.nodes.select("id", "ord").join(pr, "id").join(dc, "id", "left").join(bw, "id", "left"))
    most = x.agg(*[F.max(c).alias(f"m_{c}") for c in ("rank", "betweenness", "centrality")])
    part = lambda c: F.when(F.col(f"m_{c}") > 0, F.coalesce(F.col(c), F.lit(0.0)) / F.col(f"m_{c}")).otherwise(F.lit(0.0))
    score = sum(w * part(c) for w, c in zip(WEIGHTS, ("rank", "betweenness", "centrality")))
    return x.crossJoin(F.broadcast(most)).select("id", F.col("rank").alias("pagerank"), "betweenness", "centrality", F.round(score, 6).alias("score"), "ord")


def in_order_of_score(ids: DataFrame, scores: DataFrame) -> DataFrame:
    """Ids (id, pos) by score; those without one last, in the order given."""
    return ids.join(scores.select("id", "score"), "id", "left").orderBy(F.desc_nulls_last("score"), F.asc("pos"))


def semantic_orphans(g: Graph) -> DataFrame:
    """Nodes joined by nothing but containment; workspaces and projects excepted."""
    s = g.simple().where(~F.col("type").isin(HOLDERS))
    ends = s.select(F.col("source_id").alias("id")).unionByName(s.select(F.col("target_id").alias("id")))
    return g.nodes.where(~F.col("type").isin(ROOTS)).join(ends, "id", "left_anti")


def degree_orphans(g: Graph) -> DataFrame:
    ends = g.edges.select(F.col("source_id").alias("id")).unionByName(g.edges.select(F.col("target_id").alias("id")))
    return g.nodes.where(~F.col("type").isin(ROOTS)).join(ends, "id", "left_anti")


def cluster_links(g: Graph, node_types: list[str], edge_types: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """(members, undirected links with weights) of the induced graph of these types; a link weighs its edges' weight plus confidence."""
    members = g.nodes.where(F.col("type").isin(node_types)).select("id", "ord")
    e = g.induced(members)
    e = e.where(F.col("type").isin(edge_types)) if edge_types else e
    w = F.coalesce("weight", F.lit(0.5)) + F.coalesce("confidence", F.lit(0.5)) if edge_types else F.lit(1.0)
    pair = e.where("source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), w.alias("w"))
    return members, pair.groupBy("a", "b").agg(F.sum("w").alias("w"))


#: Rows of a graph of communities, two a link, from which on the rest of the passes is done in one task, 24 bytes a row and as much again a
#: few times over.
FEW_LINKS = 6_000_000

_P1, _P2, _P3, _P4, _P5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turns(labels: np.ndarray, r: int) -> np.ndarray:
    """Whether pmod(xxhash64(label, r), 2) is 0, as Spark has it of a bigint and an int."""
    u = np.uint64
    turn = lambda v, k: (v << u(k)) | (v >> u(64 - k))

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> u(33))) * _P2
        h = (h ^ (h >> u(29))) * _P3
        return h ^ (h >> u(32))

    with np.errstate(over="ignore"):
        h = u(42) + _P5 + u(8)
        h = mixed(turn(h ^ (turn(labels.astype(u) * _P2, 31) * _P1), 27) * _P1 + _P4)
        h = mixed(turn((h + _P5 + u(4)) ^ (u(r) * _P1), 23) * _P2 + _P3)
    return (h & u(1)) == 0


def settle(x: np.ndarray, y: np.ndarray, w: np.ndarray, total: float, passes: int, rounds: int) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """(vertices, their communities, whether rounds ran out, whether passes did): the passes of communities() over links that one task can
    hold, move by move the same."""
    first = np.lexsort((y, x))
    x, y, w = x[first], y[first], w[first]
    ids = labels = np.unique(x)
    x, y, at, moving = np.searchsorted(ids, x), np.searchsorted(ids, y), np.arange(len(ids)), False
    for _ in range(passes):
        n = len(labels)
        k, c, changed, still = np.bincount(x, w, n), np.arange(n), False, 0
        apart = x != y
        ex, ey, ew = x[apart], y[apart], w[apart]
        for r in range(rounds):
            on = _turns(labels, r)[ex]
            key, v = ex[on] * n + c[ey[on]], ew[on]
            order = np.argsort(key, kind="stable")
            key = key[order]
            begin = np.flatnonzero(np.diff(key, prepend=-1))
            into, near, to = np.add.reduceat(v[order], begin) if len(begin) else v[:0], key[begin] // n, key[begin] % n
            size, stays = np.bincount(c, k, n), to == c[near]
            gain = np.round(into - k[near] * (size[to] - np.where(stays, k[near], 0.0)) / total, 9)
            now = np.round(-k * (size[c] - k) / total, 9)
            now[near[stays]] = gain[stays]
            begin = np.flatnonzero(np.diff(near, prepend=-1))
            own = near[begin]
            best = np.maximum.reduceat(gain, begin) if len(begin) else gain[:0]
            which = np.where(gain == np.repeat(best, np.diff(begin, append=len(near))), to, n)
            which = np.minimum.reduceat(which, begin) if len(begin) else which[:0]
            go = best > now[own] + 1e-9
            c = c.copy()
            c[own[go]] = which[go]
            changed |= bool(go.any())
            still = 0 if go.any() else still + 1
            if still == 2:
                break
        else:
            moving = True
        kept, c = np.unique(c, return_inverse=True)
        labels, at = labels[kept], c[at]
        if not changed:
            return ids, labels[at], moving, False
        key, links = np.unique(c[x] * len(kept) + c[y], return_inverse=True)
        x, y, w = key // len(kept), key % len(kept), np.bincount(links, w)
    return ids, labels[at], moving, True


def communities(members: DataFrame, links: DataFrame, passes: int = 20, rounds: int = 60) -> DataFrame:
    """(id, community) by distributed Louvain: in each round every vertex weighs the communities of its neighbours and moves where
    modularity gains most; halves of the vertices (by a hash that changes with the round) take turns, which keeps neighbours from swapping.
    Then communities become vertices, pass after pass, until none moves; a warning tells if rounds or passes run out before. Ties go to the smallest label, so the result is the same every
    time. Members without links are communities of their own. As long as there are more than FEW_LINKS rows all is joins and sums on edges;
    the passes left then are done in one task, by the same rounds, so where it begins changes no result."""
    v = materialize(members.select("id").distinct().sort("id").withColumn("u", F.monotonically_increasing_id()))
    a, b = v.select(F.col("id").alias("a"), F.col("u").alias("x")), v.select(F.col("id").alias("b"), F.col("u").alias("y"))
    one = links.join(a, "a").join(b, "b").select("x", "y", "w")
    both = F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    edges, seen = materialize_with(one.select(F.inline(both), "w"), total=F.sum("w"), n=F.count(F.lit(1)))
    total, n = seen["total"] or 0.0, seen["n"]
    place = v.select("u", F.col("u").alias("c"))
    if not total:
        return v.select("id", F.col("u").alias("community"))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        ids, found, moving, changing = settle(*(t.column(c).to_numpy() for c in ("x", "y", "w")), total, left, rounds)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found), pa.array([moving] * len(ids)), pa.array([changing] * len(ids))], ["x", "c", "moving", "changing"])

    for done in range(passes):
        if n <= FEW_LINKS:
            left = passes - done
            com, seen = materialize_with(edges.coalesce(1).mapInArrow(last, "x long, c long, moving boolean, changing boolean"), moving=F.max("moving"), changing=F.max("changing"))
            if seen["moving"]:
                warnings.warn(f"vertices still move after {rounds} rounds", stacklevel=2)
            if seen["changing"]:
                warnings.warn(f"communities still change after {passes} passes", stacklevel=2)
            place = place.join(com.select(F.col("x").alias("c"), F.col("c").alias("d")), "c", "left").select("u", F.coalesce("d", "c").alias("c"))
            break
        com = materialize(edges.groupBy("x").agg(F.sum("w").alias("k")).select("x", F.col("x").alias("c"), "k"))
        changed, still = False, 0
        for r in range(rounds):
            turn = F.pmod(F.xxhash64("x", F.lit(r)), F.lit(2)) == 0
            near = edges.where("x <> y").where(turn).join(com.select(F.col("x").alias("y"), F.col("c").alias("cy")), "y").groupBy("x", "cy").agg(F.sum("w").alias("into"))
            size = com.groupBy("c").agg(F.sum("k").alias("s"))
            own = com.join(size, "c").select("x", "c", "k", F.col("s").alias("own_s"))
            option = near.join(own.where(turn), "x").join(size.select(F.col("c").alias("cy"), F.col("s").alias("cs")), "cy")
            stays = F.col("cy") == F.col("c")
            gain = F.col("into") - F.col("k") * (F.col("cs") - F.when(stays, F.col("k")).otherwise(0.0)) / total
            best = option.groupBy("x").agg(F.max(F.struct(F.round(gain, 9).alias("g"), (-F.col("cy")).alias("o"))).alias("b"), F.max(F.when(stays, F.round(gain, 9))).alias("now"))
            stay = F.coalesce("now", F.round(-F.col("k") * (F.col("own_s") - F.col("k")) / total, 9))
            moves = own.join(best, "x", "left").select("x", "c", "k", F.when(F.col("b.g") > stay + 1e-9, -F.col("b.o")).alias("to"))
            new, seen = materialize_with(moves.select("x", F.coalesce("to", "c").alias("c"), "k", F.col("to").isNotNull().alias("moved")), moved=F.count(F.when(F.col("moved"), 1)))
            moved = seen["moved"]
            discard(com)
            com = new
            changed |= moved > 0
            still = 0 if moved else still + 1
            if still == 2:  # each half of the vertices has had its turn
                break
        else:
            warnings.warn(f"vertices still move after {rounds} rounds", stacklevel=2)
        place = materialize(place.join(com.select(F.col("x").alias("c"), F.col("c").alias("d")), "c", "left").select("u", F.coalesce("d", "c").alias("c")))
        if not changed:
            break
        x, y = com.select("x", F.col("c").alias("cx")), com.select(F.col("x").alias("y"), F.col("c").alias("cy"))
        edges, seen = materialize_with(edges.join(x, "x").join(y, "y").groupBy("cx", "cy").agg(F.sum("w").alias("w")).select(F.col("cx").alias("x"), F.col("cy").alias("y"), "w"), n=F.count(F.lit(1)))
        n = seen["n"]
    else:
        warnings.warn(f"communities still change after {passes} passes", stacklevel=2)
    return v.join(place, "u").select("id", F.col("c").alias("community"))


def modularity(found: DataFrame, links: DataFrame) -> float:
    """Of communities (id, community) over undirected links (a, b, w)."""
    x, y = found.select(F.col("id").alias("a"), F.col("community").alias("ca")), found.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    e = materialize(links.join(x, "a").join(y, "b"))
    m = e.agg(F.sum("w")).first()[0]
    if not m:
        return 0.0
    inner = e.where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    deg = e.select(F.col("ca").alias("c"), "w").unionByName(e.select(F.col("cb").alias("c"), "w")).groupBy("c").agg(F.sum("w").alias("k"))
    return inner / m - (deg.agg(F.sum(F.col("k") * F.col("k"))).first()[0] / (4 * m * m))


def cohesion(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, size, n_inner, cohesion): directed edges inside over n(n-1), 1 for single members."""
    x, y = found.select(F.col("id").alias("source_id"), F.col("community").alias("cs")), found.select(F.col("id").alias("target_id"), F.col("community").alias("ct"))
    inner = edges.select("source_id", "target_id").distinct().where("source_id <> target_id").join(x, "source_id").join(y, "target_id").where("cs = ct").groupBy(F.col("cs").alias("community")).agg(F.count(F.lit(1)).alias("n_inner"))
    size = found.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    out = size.join(inner, "community", "left").withColumn("n_inner", F.coalesce("n_inner", F.lit(0)))
    return out.withColumn("cohesion", F.when(F.col("size") == 1, 1.0).otherwise(F.round(F.col("n_inner") / (F.col("size") * (F.col("size") - 1)), 6)))


def cluster_labels(found: DataFrame, names: DataFrame) -> DataFrame:
    """(community, label): the most frequent word of more than two letters in the members' names, ties to the first by letter."""
    words = F.explode(F.filter(F.split(F.lower(F.regexp_replace("name", "([a-z])([A-Z])", "$1 $2")), r"[^a-z0-9]+"), lambda w: F.length(w) > 2))
    c = found.join(names.select("id", "name"), "id").select("community", words.alias("word")).groupBy("community", "word").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("n"), "word"))["word"].alias("label"))


def depth_score(depth: int | None) -> float:
    if depth is None:
        return 50.0
    if depth < 3:
        return 70 + depth / 3 * 30
    return 100.0 if depth <= 5 else 100 - 15 * (depth - 5) if depth <= 7 else max(20.0, 100 - 15 * (depth - 5))


def module_of(g: Graph) -> DataFrame:
    """(id, module): the module or file a node lies in, its own parent."""
    return g.nodes.where("parent_id is not null").select("id", F.col("parent_id").alias("module"))


def coupling(g: Graph) -> DataFrame:
    """(n_semantic, n_cross, ratio, score): edges between modules among those that join two nodes with a module."""
    m = module_of(g)
    e = g.edges.where(~F.col("type").isin(HOLDERS)).select("source_id", "target_id")
    both = e.join(m.select(F.col("id").alias("source_id"), F.col("module").alias("ms")), "source_id", "left").join(m.select(F.col("id").alias("target_id"), F.col("module").alias("mt")), "target_id", "left")
    known = both.where("ms is not null and mt is not null")
    t = known.agg(F.count(F.lit(1)).alias("n_semantic"), F.count(F.when(F.col("ms") != F.col("mt"), 1)).alias("n_cross"))
    ratio = F.when(F.col("n_semantic") > 0, F.col("n_cross") / F.col("n_semantic"))
    score = F.when(ratio.isNull(), 80.0).when(ratio <= 0.3, 100.0).when(ratio >= 0.6, F.greatest(F.lit(0.0), F.lit(100.0) - ratio * 100)).otherwise(F.lit(100.0) - (ratio - 0.3) * 200)
    return t.select("n_semantic", "n_cross", F.round(ratio, 6).alias("ratio"), F.round(score, 6).alias("score"))


def module_cohesion(g: Graph) -> DataFrame:
    """(n_modules, average, score) over modules of at least two members: edges inside over n(n-1)."""
    m = module_of(g)
    size = m.groupBy("module").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    e = g.edges.where(~F.col("type").isin(HOLDERS) & (F.col("source_id") != F.col("target_id"))).select("source_id", "target_id").distinct()
    inner = e.join(m.select(F.col("id").alias("source_id"), "module"), "source_id").join(m.select(F.col("id").alias("target_id"), F.col("module").alias("mt")), "target_id").where("module = mt").groupBy("module").agg(F.count(F.lit(1)).alias("inner_edges"))
    per = size.join(inner, "module", "left").select((F.coalesce("inner_edges", F.lit(0)) / (F.col("n") * (F.col("n") - 1))).alias("c"))
    t = per.agg(F.count(F.lit(1)).alias("n_modules"), F.avg("c").alias("average"))
    score = F.when(F.col("n_modules") == 0, 50.0).otherwise(F.least(F.lit(100.0), F.lit(30.0) + F.lit(116.7) * F.col("average")))
    return t.select("n_modules", F.round("average", 6).alias("average"), F.round(score, 4).alias("score"))


def architecture(g: Graph) -> dict:
    """The scores of depth, coupling and cohesion, the penalties of orphans and cycles, and the total from 0 to 100."""
    n = g.nodes.count()
    if not n:
        return dict.fromkeys(("depth", "coupling", "cohesion", "orphan_penalty", "cycle_penalty", "score"), 0.0)
    has = not g.edges.where("type = 'CONTAINS'").isEmpty()
    d = depth_score(containment_depth(g) if has else None)
    c, h = coupling(g).first().score, module_cohesion(g).first().score
    orphans = semantic_orphans(g).count() / n * 20
    cycles = min(25, 5 * import_cycles(g))
    return {"depth": d, "coupling": c, "cohesion": h, "orphan_penalty": round(orphans, 4), "cycle_penalty": float(cycles), "score": float(min(100, max(0, round((d + c + h) / 3 - orphans - cycles))))}
