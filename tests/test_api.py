import json

import pytest

from oracle import rows
from graphloom import api
from graphloom.cache import ResultCache, version
from graphloom.functions.extract import call_costs
from graphloom.graph import Graph
from graphloom.operators import incremental, rank, store
from pyspark.sql import functions as F

LOC = "struct<file_path: string, start_line: int, end_line: int, start_col: int, end_col: int>"
NODES = f"id string, type string, name string, description string, location {LOC}, parent_id string, provenance string, confidence double, is_stale boolean, source_hash string, version int, language string, tags array<string>, metadata string, last_updated timestamp, tier string, ord long"
EDGES = f"source_id string, target_id string, type string, description string, provenance string, confidence double, is_stale boolean, weight double, conditional boolean, location {LOC}, metadata string, ord long"


def make(spark, n=9):
    nodes = [(f"f{k}", "Function" if k else "Endpoint", f"step {k}", None, (f"src/f{k}.py", 1, 9, 0, 0), None, "scanner", 1 - k / 100, k == 2, None, 1, "python", [], None, None, "micro", k) for k in range(n)]
    edges = [(f"f{k}", f"f{k + 1}", "CALLS", None, "scanner", 1.0, False, 1.0, False, None, None, k) for k in range(n - 1)]
    edges += [(f"f{k}", "f1", "CALLS", None, "scanner", 1.0, False, 1.0, False, None, None, 100 + k) for k in range(2, n)]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


@pytest.fixture(scope="module")
def service(spark):
    return api.Service(spark, make(spark), "demo", ttl=1000)


def ask(service, method, **params):
    return service.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}))


def call(service, tool, **arguments):
    got = ask(service, "tools/call", name=tool, arguments=arguments)
    return json.loads(got["result"]["content"][0]["text"]) if "result" in got else got["error"]


def test_tools(service):
    assert len(ask(service, "tools/list")["result"]["tools"]) == 8
    assert call(service, "search_entity", query="STEP", limit=2)["total_matches"] == 2
    assert "error" in call(service, "search_entity", query="x", type_filter="Nothing")
    near = call(service, "traverse_graph", node_id="f0", direction="downstream", depth=1)
    assert [n["id"] for n in near["nodes"]] == ["f0", "f1"] and near["edges"] == [{"source_id": "f0", "target_id": "f1", "type": "CALLS"}]
    assert call(service, "impact_analysis", node_id="f1", depth=1)["risk"]["n_up"] == 8
    assert {"kind": "node_type", "name": "Function", "n": 8, "n_stale": 1} in call(service, "get_stats")
    assert call(service, "list_flows")[0]["entry"] == "f0"
    assert call(service, "list_clusters", min_size=1)
    assert call(service, "detect_changes", paths=["src/f8.py"]) == {"n_affected": 1, "n_blast": 2, "first_ids": ["f6", "f7"]}
    assert call(service, "detect_changes", paths=[]) == {"n_affected": 0, "n_blast": 0, "first_ids": []}


def test_context_levels(service):
    one, two, three = (call(service, "get_context", scope="f1", detail_level=x, depth=2) for x in ("L1", "L2", "L3"))
    assert set(one["relevant_nodes"][0]) == {"id", "type", "name", "tier"} and one["relevant_nodes"][0]["id"] == "f1" and "risk_assessment" not in one
    assert len(one["upstream"]) <= len(two["upstream"]) == 8 and two["risk_assessment"] == "High" and "step 2 is stale" in two["stale_warnings"]
    assert three["related_files"][0] == "src/f0.py" and three["edges"] == two["edges"]
    assert call(service, "get_context", scope="no such thing")["relevant_nodes"] == []
    assert call(service, "get_context", scope="f1", detail_level="L9")["level"] == "L2"


def test_resources_prompts_and_errors(service):
    assert len(ask(service, "resources/list")["result"]["resourceTemplates"]) == 5
    read = lambda uri: json.loads(ask(service, "resources/read", uri=uri)["result"]["contents"][0]["text"])
    assert read("wi://repos")["count"] == 1 and len(read("wi://repo/demo/schema")["edge_types"]) == 28 and read("wi://repo/demo/stats")["counts"] and read("wi://repo/demo/flows")["flows"]
    assert all("error" in read(u) for u in ("wi://repo/other/stats", "wi://repo/demo/nothing", "wi://repo/demo", "x"))
    assert {p["name"] for p in ask(service, "prompts/list")["result"]["prompts"]} == set(api.PROMPTS)
    assert "f.py" in ask(service, "prompts/get", name="detect_impact", arguments={"file_or_function": "f.py"})["result"]["messages"][0]["content"]["text"]
    assert service.handle("{nonsense")["error"]["code"] == api.PARSE
    assert ask(service, "no/such")["error"]["code"] == api.INTERNAL == ask(service, "tools/call", name="none")["error"]["code"]
    assert service.handle('{"method": "ping"}') is None and ask(service, "ping")["result"] == {}


def test_cache_follows_the_graph(spark):
    now, made = [0.0], []
    c = ResultCache(30, lambda: now[0])
    make_it = lambda g: (made.append(1), g.nodes.select("id"))[1]
    g = make(spark, 3)
    assert c.get(g, "x", make_it).count() == c.get(g, "x", make_it).count() == 3 and len(made) == 1
    h = g.without_nodes(spark.createDataFrame([("f0",)], "id string"))
    assert version(g) != version(h) and c.get(h, "x", make_it).count() == 2 and len(made) == 2
    now[0] = 31
    c.get(h, "x", make_it)
    assert len(made) == 3


def test_all_metrics(spark):
    m = api.all_metrics(make(spark, 5))
    assert m["pagerank"].count() == 5 and m["stats"]["n_nodes"] == 5 and 0 <= m["architecture_score"]["score"] <= 100


def test_betweenness_of_all_nodes_against_brute_force(spark):
    from collections import deque

    g = make(spark, 9)
    nxt = {}
    for r in g.edges.select("source_id", "target_id").distinct().collect():
        nxt.setdefault(r.source_id, set()).add(r.target_id)
    ids = [f"f{k}" for k in range(9)]
    want = dict.fromkeys(ids, 0.0)
    for s in ids:
        dist, ways, order, before, todo = {s: 0}, {s: 1}, [], {}, deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in nxt.get(v, ()):
                if w not in dist:
                    dist[w], ways[w] = dist[v] + 1, 0
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    ways[w] += ways[v]
                    before.setdefault(w, []).append(v)
        gain = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before.get(w, ()):
                gain[v] += ways[v] / ways[w] * (1 + gain[w])
            if w != s:
                want[w] += gain[w]
    got = {r.id: r.betweenness for r in rank.betweenness(g.nodes, g.simple()).collect()}
    assert got == {i: pytest.approx(v / (8 * 7), abs=1e-9) for i, v in want.items()}


def test_corrections_and_costs(spark):
    n = spark.createDataFrame([("a", "x", None), ("b", "y", "d")], "id string, name string, description string")
    t = spark.createDataFrame([("a", None, "new"), ("b", "z", None), ("b", "q", None), ("gone", "w", "w")], "id string, name string, description string")
    assert rows(store.overridden(n, t, ["name", "description"])) == [("a", "x", "new"), ("b", "z", "d")] and rows(store.overridden(n, t.limit(0), ["name"])) == rows(n)
    p = spark.createDataFrame([("m", 3.0, 15.0, 3.75, 0.3)], "model string, input double, output double, cache_write double, cache_read double")
    c = spark.createDataFrame([("m", 1_000_000, 0, None, 1_000_000), ("?", 0, 1_000_000, 0, 0)], "model string, input long, output long, cache_write long, cache_read long")
    assert {(r.model, r.cost, r.cache_savings) for r in call_costs(c, p, default="m").collect()} == {("m", 3.3, 2.7), ("?", 15.0, 0.0)}
    assert rows(call_costs(c.limit(0), p)) == []


def test_stale_edges(spark):
    g = make(spark, 3)
    keys = spark.createDataFrame([("f0", "f1", "CALLS"), ("x", "y", "CALLS")], "source_id string, target_id string, type string")
    assert {(r.source_id, r.is_stale) for r in g.mark_edges_stale(keys).edges.where("target_id = 'f1'").collect()} == {("f0", True), ("f2", False)}
    assert incremental.change_report(g, spark.createDataFrame([("src/f1.py",)], "path string")).first().first_ids == ["f0", "f2"]
    assert g.mark_edges_stale(keys).edges.where(F.col("is_stale")).count() == 1
