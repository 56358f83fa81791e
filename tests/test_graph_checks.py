from datetime import datetime, timedelta

from oracle import rows
from graphloom.operators import hierarchy, orphans, snapshots
from graphloom.plans import graph_checks as q
from pyspark.sql import functions as F

T = datetime(2025, 1, 1)
NODES = "id string, parent_id string, name string, type string, first_seen timestamp, removed_at timestamp, ref string, at long, run_start long"
EDGES = "edge_id long, source_id string, target_id string, indexed_at timestamp, ref string, at long, _runs string"
SNAPS = "snapshot_no int, id string, type string, name string, parent_id string, language string, source_hash string, last_updated timestamp, pair int, change string"


def node(i, parent=None, first=T, gone=None):
    return (i, parent, i, "Module", first, gone, "x", 1, 2)


def test_orphans_in_time(spark, tables):
    d = tables(
        graph_nodes=([node("a"), node("b", first=T + timedelta(days=5)), node("c", gone=T + timedelta(days=1)), node(None), node("n", first=None)], NODES),
        graph_edges=([
            (1, " A\t", "a", T, None, None, None), (2, "a", "b", T, None, None, None), (3, "b", None, T + timedelta(days=5), None, None, None), (4, "c", "c", T + timedelta(days=1), None, None, None),
            (5, "nobody", "", None, None, None, None), (6, "a", "n", T, None, None, None), (7, "a", "a", None, None, None, None), (1, " A\t", "zz", T, None, None, None),
        ], EDGES),
    )
    got = rows(q.p1_found(spark, d))
    want = [(2, "target_id"), (4, "source_id"), (4, "target_id"), (5, "source_id"), (5, "target_id"), (6, "target_id"), (7, "source_id"), (7, "target_id"), (1, "target_id")]
    assert got == sorted(want, key=repr)
    assert sum(r.n_orphans for r in q.p1_report(spark, d).collect()) == len(want)


def test_orphans_of_empty_tables(spark, tables):
    d = tables(graph_nodes=([], NODES), graph_edges=([(1, "a", "b", T, None, None, None)], EDGES))
    assert len(rows(q.p1_found(spark, d))) == 2
    d = tables(graph_nodes=([node("a")], NODES), graph_edges=([], EDGES))
    assert rows(q.p1_found(spark, d)) == []


def test_runs_merge_and_hot_keys(spark):
    p = spark.createDataFrame([("k", 1, 3), ("k", 4, 6), ("k", 5, 9), ("k", 12, 12), ("k", 20, None), ("z", 5, 4), ("z", None, 3)], "id string, start long, end long")
    refs = spark.range(0, 6000).select(F.lit("k").alias("g"), (F.col("id") % 15).alias("at"), F.lit(1).alias("id"), F.lit(2).alias("row"), F.lit(3).alias("block"))
    assert orphans.profile(refs, "g", "at").hot
    lost = orphans.as_of_orphans(refs, "g", "at", p)
    assert lost.columns == refs.columns
    assert {r["at"] for r in lost.select("at").distinct().collect()} == {0, 10, 11, 13, 14}
    assert lost.count() == 5 * 400


def test_lifetimes_compress_to_runs(spark):
    """Parents alive all through adjoin from code to code; an id without parent, a late start or an early end breaks the run."""
    p = spark.createDataFrame([(f"n{k:04}", 0, None) for k in range(3000)] + [("short", 5, 7)], "id string, start long, end long")
    refs = spark.createDataFrame([(f"n{k:04}", k % 10 + 1) for k in range(3100)] + [("short", 4), ("short", 5), ("short", 8), ("short", None)], "ref string, at long")
    found = orphans.parent_runs(refs, "ref", "at", p)
    assert found.agg(F.sum("n_parents")).first()[0] == 3001 and found.count() <= 12 + 100 + 1
    want = sorted([("n%04d" % k, k % 10 + 1) for k in range(3000, 3100)] + [("short", 4), ("short", 8), ("short", None)], key=repr)
    assert rows(orphans.as_of_orphans(refs, "ref", "at", p)) == want


def test_orphans_against_brute_force(spark):
    import random

    rng = random.Random(3)
    p = [(f"i{rng.randrange(40)}", s := rng.choice([None, *range(20)]), rng.choice([None, (s or 0) + rng.randrange(-2, 6)])) for _ in range(60)]
    r = [(k, rng.choice([None, f"i{rng.randrange(60)}"]), rng.choice([None, *range(25)])) for k in range(800)]
    want = [x for x in r if x[1] is not None and not any(i == x[1] and s is not None and x[2] is not None and s <= x[2] and (e is None or x[2] <= e) for i, s, e in p)]
    got = orphans.as_of_orphans(spark.createDataFrame(r, "k long, ref string, at long"), "ref", "at", spark.createDataFrame(p, "id string, start long, end long"))
    assert rows(got) == sorted(want, key=repr)


def brute_cycles(pairs):
    out = set()
    for i in pairs:
        seen, c = [], i
        while c in pairs and c not in seen:
            seen.append(c)
            c = pairs[c]
        if c in seen:
            out.add((i, min(seen[seen.index(c) :])))
    return out


def test_hierarchy_against_brute_force(spark, tables):
    import random

    rng = random.Random(5)
    for n in (2, 150):
        pairs = {f"n{k:03}": rng.choice([None, "", "gone", *(f"n{x:03}" for x in range(n))]) if rng.random() < 0.9 else f"n{k:03}" for k in range(n)}
        d = tables(graph_nodes=([node(k, p) for k, p in pairs.items()], NODES))
        assert {tuple(r) for r in q.p6_found(spark, d).collect()} == brute_cycles(pairs)
        table = {r.id: r for r in q.p6_hierarchy(spark, d).collect()}
        assert set(table) == set(pairs) - {i for i, _ in brute_cycles(pairs)}
        for i, r in table.items():
            line, c = [i], pairs[i]
            while c in pairs:
                line.append(c)
                c = pairs[c]
            assert (r.depth, r.root_id, r.path) == (len(line) - 1, line[-1], "/".join(reversed(line)))
            assert r.n_descendants == sum(t.lo > r.lo and t.lo <= r.hi for t in table.values()) == r.hi - r.lo


def test_hierarchy_edge_cases(spark, tables):
    d = tables(graph_nodes=([node(None, "a"), node("a", "A "), node("a", "A "), node("b", " a\t")], NODES))
    assert rows(q.p6_found(spark, d)) == [("a", "a"), ("b", "a")]
    d = tables(graph_nodes=([], NODES))
    assert rows(q.p6_found(spark, d)) == [] and rows(q.p6_hierarchy(spark, d)) == []


def test_deep_chain_and_many_siblings(spark):
    n = spark.createDataFrame([(f"c{k:03}", f"c{k - 1:03}" if k else None) for k in range(25)] + [(f"s{k:05}", "c000") for k in range(3000)], "id string, p string")
    for few in (hierarchy.FEW, 10):
        f = hierarchy.build_forest(n, F.col("id"), F.col("p"), paths=True, few=few)
        t = {r.id: r for r in hierarchy.hierarchy_table(f).collect()}
        assert t["c024"].depth == 24 and t["c000"].n_descendants == 3024 and t["s00000"].lo == 25 and t["c002"].path == "c000/c001/c002"
        assert hierarchy.descendants(f, spark.createDataFrame([("c015",)], "id string")).count() == 9


def test_long_chain(spark):
    n = spark.range(10_000).select(F.format_string("c%05d", "id").alias("id"), F.when(F.col("id") > 0, F.format_string("c%05d", F.col("id") - 1)).alias("p"))
    f = hierarchy.build_forest(n, F.col("id"), F.col("p"))
    assert hierarchy.hierarchy_table(f).agg(F.max("depth"), F.sum("n_descendants")).first() == (9999, 9999 * 5000)


def test_layers_and_one_task_agree(spark, tables):
    import random

    rng = random.Random(11)
    pairs = {f"n{k:03}": rng.choice([None, *(f"n{x:03}" for x in range(200))]) for k in range(200)}
    n = spark.createDataFrame([(k, p) for k, p in pairs.items()], "id string, p string")
    whole = [hierarchy.build_forest(n, F.col("id"), F.col("p"), paths=True, few=few) for few in (1000, 40, 0)]
    assert len({tuple(map(str, rows(hierarchy.hierarchy_table(f)))) for f in whole}) == 1
    assert all({tuple(r) for r in hierarchy.cyclic_nodes(f).collect()} == brute_cycles(pairs) for f in whole)


def snap(no, i, type="File", name="n", parent=None, lang=None, h=None, at=0):
    return (no, i, type, name, parent, lang, h, T + timedelta(seconds=at), 7, "x")


def test_snapshots(spark, tables):
    d = tables(node_snapshots=([
        snap(1, "a", h="sha256:AB"), snap(1, " A", h="zz", at=-5), snap(1, "b"), snap(1, "c", lang=None), snap(1, "e"), snap(None, "q"), snap(1, None),
        snap(4, "a", h=" ab "), snap(4, "a", h=" ab "), snap(4, "c", lang="go"), snap(4, "d"), snap(4, "e", name="N "),
        snap(6, "a", h="cd"), snap(6, "c", lang="go"), snap(6, "d"), snap(6, "e"),
    ], SNAPS))
    assert rows(q.p7_found(spark, d)) == sorted([(4, "b", "removed"), (4, "c", "changed"), (4, "d", "added"), (6, "a", "changed")], key=repr)
    d = tables(node_snapshots=([], SNAPS))
    assert rows(q.p7_found(spark, d)) == []
    d = tables(node_snapshots=([snap(3, "a")], SNAPS))
    assert rows(q.p7_found(spark, d)) == []


def test_run_counts(spark):
    changes = spark.createDataFrame([(2, "f:p:x", "added"), (2, "f:p:y", "changed"), (2, "f:r:y", "removed")], "snapshot_no int, id string, change string")
    runs = spark.createDataFrame([("p", 2, 1, None, 0), ("p", 2, 0, 1, 0), ("z", 2, 1, 0, 0), (None, 2, 1, 1, 1)], "project string, snapshot_no int, nodes_added int, nodes_updated int, nodes_removed int")
    got = snapshots.run_disagreements(changes, F.split_part("id", F.lit(":"), F.lit(2)), runs)
    assert {(r.project, r.found_removed, r.reported_added) for r in got.collect()} == {("r", 1, 0), ("z", 0, 1)}
