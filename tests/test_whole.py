"""Operators do the whole job: results that no bound cuts off."""

import random
import time
from collections import defaultdict

import numpy as np
from graphloom.functions import resolve
from graphloom.graph import Graph
from graphloom.operators import rank, search, traverse
from graphloom.plans import graph_checks, rank_queries, traversal_queries
from graphloom.plans.store_queries import HUB
from pyspark.sql import functions as F


def graph(spark, edges, kind="IMPORTS", more=()):
    """A graph of edges (source, target) between functions, in the order given."""
    ids = sorted({x for e in edges for x in e} | set(more))
    nodes = spark.createDataFrame([(x, "Function", None, i) for i, x in enumerate(ids)], "id string, type string, parent_id string, ord long")
    rows = [(a, b, kind, 1.0, i) for i, (a, b) in enumerate(edges)]
    return Graph(nodes, spark.createDataFrame(rows, "source_id string, target_id string, type string, weight double, ord long"))


def brute_betweenness(edges):
    out, total = defaultdict(set), defaultdict(float)
    for a, b in edges:
        out[a].add(b)
    ids = {x for e in edges for x in e}
    for s in ids:
        dist, ways, order, front = {s: 0}, defaultdict(int, {s: 1}), [], [s]
        while front:
            order += front
            new = []
            for v in front:
                for w in out[v]:
                    if w not in dist:
                        dist[w] = dist[v] + 1
                        new.append(w)
                    if dist[w] == dist[v] + 1:
                        ways[w] += ways[v]
            front = new
        part = defaultdict(float)
        for w in reversed(order):
            for v in order:
                if w in out[v] and dist[w] == dist[v] + 1:
                    part[v] += ways[v] / ways[w] * (1 + part[w])
            if w != s:
                total[w] += part[w]
    n = len(ids)
    return {x: total[x] / ((n - 1) * (n - 2)) for x in ids}


def test_betweenness_is_exact_at_any_size(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(f"n{10 * k + i}", f"n{10 * k + rng.randrange(10)}") for k in range(220) for i in range(10) for _ in range(2)]
    edges = sorted({e for e in edges if e[0] != e[1]})
    want = brute_betweenness(edges)
    assert len(want) > 2000
    monkeypatch.setattr(rank, "BATCH", 800)
    got = {r.id: r.betweenness for r in rank.importance(graph(spark, edges), rounds=2).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_shared_tags_have_no_bound(spark):
    items = spark.createDataFrame([(i, ["Hot", "hot"] if i else ["hot", "x", None]) for i in range(1100)] + [(2000, None), (2001, ["y"])], "id long, tags array<string>")
    assert resolve.shared_tag_pairs(items, "id", "tags").count() == 1100 * 1099 // 2
    got = resolve.shared_tag_members(items, "id", "tags").collect()
    assert {(r.tag, r.id, r.n_items) for r in got} == {("hot", i, 1100) for i in range(1100)} and len(got) == 1100


def test_long_ways(spark, tables, monkeypatch):
    chain = [f"f{i:02}" for i in range(8)] + [HUB]
    g = graph(spark, [("w", "f00"), *zip(chain, chain[1:])], "CALLS")
    g.nodes = g.nodes.withColumn("type", F.expr("case id when 'w' then 'Workspace' when 'f00' then 'Endpoint' else type end"))
    monkeypatch.setattr(Graph, "load", staticmethod(lambda spark, d: g))
    assert traversal_queries.shortest_path_len(spark, "").first()[0] == 9
    assert [tuple(r) for r in traversal_queries.trace_flow_full(spark, "").collect()] == [("f00", 9)]
    assert traverse.shortest_path(g.edges, HUB, "w") == []


def brute_cycles(edges):
    out, found = defaultdict(set), 0
    for a, b in edges:
        out[a].add(b)
    ids = {x for e in edges for x in e}

    def walk(first, at, line):
        return sum(1 if w == first else walk(first, w, line | {w}) if w > first and w not in line else 0 for w in out[at])

    return sum(walk(x, x, {x}) for x in ids)


def test_cycles_of_any_length(spark):
    ring = [(f"m{i}", f"m{(i + 1) % 9}") for i in range(9)]
    tail = [("m0", "t0"), ("t0", "t1"), ("s0", "m3")]
    assert traverse.import_cycles(graph(spark, ring + tail)) == 1
    two = [(f"k{i}", f"k{(i + 1) % 7}") for i in range(7)]
    assert traverse.import_cycles(graph(spark, ring + tail + two + [("z", "z")])) == 3
    assert traverse.import_cycles(graph(spark, tail)) == 0 and traverse.import_cycles(graph(spark, tail, "CALLS")) == 0
    assert rank.architecture(graph(spark, ring))["cycle_penalty"] == 5
    rng = random.Random(8)
    for _ in range(300):
        edges = {(a, b) for a in range(6) for b in range(6) if a != b and rng.random() < 0.3}
        out = defaultdict(list)
        for a, b in sorted(edges):
            out[a].append(b)
        assert traverse.count_cycles(out, 10**9) == brute_cycles(edges)


def test_descendants_of_all_nodes(spark, tables):
    rng = random.Random(2)
    parent = {f"n{k:04}": f"n{rng.randrange(k):04}" if k else None for k in range(5000)}
    parent["c"], parent["d"] = "c", "c"
    kinds = "id string, parent_id string, name string, type string"
    d = tables(graph_nodes=([(k, p, k, "Module") for k, p in parent.items()], kinds))
    want = set()
    for i in parent:
        up, n = parent[i], 1
        while up and i not in "cd":
            want.add((up, i, n))
            up, n = parent[up], n + 1
    got = [tuple(r) for r in graph_checks.p6_descendants_all(spark, d).collect()]
    assert len(got) == len(want) and set(got) == want


def test_cosine_of_a_table_of_queries(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(300, [0.0] * 8), (301, None), (302, [1.0, 2.0]), (303, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search.cosine_top_each(df, df.where("vec_id % 50 = 0"), "vec_id", "embedding", 7, block=40)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = set()
    for i in range(0, 300, 50):
        score = (unit @ unit[i]).round(6)
        want |= {(i, int(j), float(score[j])) for j in np.lexsort((np.arange(300), -score))[:7] if score[j] > 0.1}
    assert {tuple(r) for r in got.collect()} == want and len(want) == 42


def test_betweenness_of_all_nodes(spark, monkeypatch):
    edges = [("module:a:1", "function:b:2"), ("function:b:2", "module:c:3"), ("module:c:3", "file:d:4"), ("module:a:1", "file:d:4"), ("file:d:4", "module:a:1")]
    monkeypatch.setattr(Graph, "load", staticmethod(lambda spark, d: graph(spark, edges)))
    want = brute_betweenness(edges)
    got = {r.id: r.betweenness for r in rank_queries.betweenness_all(spark, "").collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want) and got["function:b:2"] > 0


def jobs(spark, run):
    """What run() gives, and the number of Spark's jobs it took."""
    sc = spark.sparkContext
    sc.setJobGroup(name := f"jobs-{random.random()}", "")
    try:
        return run(), len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_turns_are_those_of_spark(spark):
    labels = [0, 1, 7, 12345, (5 << 33) + 3, 2**40 + 1, *range(100, 160)]
    df = spark.createDataFrame([(x,) for x in labels], "x long")
    for r in (0, 1, 59):
        want = [x.e for x in df.coalesce(1).select((F.pmod(F.xxhash64("x", F.lit(r)), F.lit(2)) == 0).alias("e")).collect()]
        assert rank._turns(np.array(labels), r).tolist() == want


def test_communities_take_few_jobs_and_the_same_moves(spark, monkeypatch):
    rng = random.Random(4)
    pairs = sorted({tuple(sorted(rng.sample(range(12), 2))) for _ in range(30)} | {tuple(sorted(rng.sample(range(12, 24), 2))) for _ in range(30)} | {(3, 15), (8, 20)})
    links = spark.createDataFrame([(f"n{a:02}", f"n{b:02}", float(1 + (a + b) % 3)) for a, b in pairs], "a string, b string, w double").coalesce(1)
    members = spark.createDataFrame([(f"n{i:02}",) for i in range(26)], "id string").coalesce(1)
    run = lambda: {r.id: r.community for r in rank.communities(members, links).collect()}
    found, n = jobs(spark, run)
    assert n <= 20 and len(found) == 26 and 4 <= len(set(found.values())) < 26
    for few in (0, 40):  # all passes by joins, the first ones by joins
        monkeypatch.setattr(rank, "FEW_LINKS", few)
        assert run() == found


def test_stale_by_way_of_hubs(spark, monkeypatch):
    rng = random.Random(5)
    ids = [f"n{i:02}" for i in range(60)]
    edges = [(rng.choice(ids), rng.choice(["hub1", "hub2"])) for _ in range(70)] + [("hub1", "n03"), ("hub2", "hub1"), ("n05", "n05"), ("n07", "gone")]
    edges = list(dict.fromkeys(edges + [tuple(rng.sample(ids, 2)) for _ in range(60)]))
    kinds = ["CALLS", "CALLS", "CALLS", "CONTAINS"]
    nodes = spark.createDataFrame([(x, i % 5 == 0 if i % 7 else None) for i, x in enumerate([*ids, "hub1", "hub2"])], "id string, is_stale boolean").coalesce(1)
    rows = [(a, b, kinds[i % 4], None, i) for i, (a, b) in enumerate(edges)]
    g = Graph(nodes, spark.createDataFrame(rows, "source_id string, target_id string, type string, provenance string, ord long").coalesce(1))
    triggers = nodes.where("id < 'n20' or id = 'hub2'")
    was = {r.id: bool(r.is_stale) for r in nodes.collect()}
    for hops in (0, 1, 2, 3):
        sees = defaultdict(set)
        for r in traverse.smart_cascade(g, triggers, hops).collect():
            sees[r.trigger].add(r.id)
        owner = {x: min(t for t in sees if x in sees[t]) for t in sees for x in sees[t]}
        totals = {(t, len(v), sum(owner[x] == t and was.get(x) is False for x in v), sum(was.get(x, False) for x in v)) for t, v in sees.items()}
        stale = {(a, b, k, min(t for t in sees if a in sees[t] and b in sees[t])) for a, b, k, *_ in rows if any(a in v and b in v for v in sees.values())}
        for least in (10, 10**9) if hops > 1 else (10,):
            monkeypatch.setattr(traverse, "HUB_ROWS", least)
            got, lost = traverse.propagate_staleness(g, triggers, hops)
            assert {tuple(r) for r in got.collect()} == totals and {(r.source_id, r.target_id, r.type, r.owner) for r in lost.collect()} == stale


def test_cascades_through_a_hub_are_kept_once(spark, monkeypatch):
    written, keep = [], traverse.materialize

    def counted(df, *args, **kw):
        out = keep(df, *args, **kw)
        written.append(out.count())
        return out

    monkeypatch.setattr(traverse, "materialize", counted)
    edges = [(f"n{i:04}", "hub") for i in range(3000)]
    nodes = spark.range(3000).select(F.format_string("n%04d", "id").alias("id"), F.lit(False).alias("is_stale")).coalesce(1)
    e = spark.createDataFrame([(a, b, "CALLS", None, i) for i, (a, b) in enumerate(edges)], "source_id string, target_id string, type string, provenance string, ord long").coalesce(1)
    totals, stale = traverse.propagate_staleness(Graph(nodes, e), nodes.where("id < 'n0300'"))
    assert {(r.trigger, r.n_seen, r.n_newly) for r in totals.collect()} == {(f"n{i:04}", 3001, 0 if i else 3000) for i in range(300)}
    assert {r.owner for r in stale.collect()} == {"n0000"} and sum(written) < 30_000


def test_walks_touch_only_what_they_reach():
    n = 4_000_000
    off, nxt = np.full(n + 1, 3, np.int32), np.array([1, 2, 3], np.int32)
    off[:3] = [0, 1, 2]
    scratch, total = rank._scratch(n), np.zeros(n)
    began = time.process_time()
    for s in [0, 1, 2, 3, n - 1] * 100:
        at, delta = rank._dependencies(off, nxt, s, scratch)
        total[at] += delta
    assert time.process_time() - began < 0.5  # 0.02 s, and 1.6 s with arrays of all vertices for each source
    assert total[:5].tolist() == [0, 200, 200, 0, 0] and (scratch[0] == -1).all()
