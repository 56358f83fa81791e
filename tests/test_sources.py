import json

from graphloom.graph import Graph
from graphloom.sources import graphs, workspace
from oracle import rows

NODES = "id string, type string, name string, tier string, confidence double, is_stale boolean, tags array<string>, ord long"


def small(spark):
    n = spark.createDataFrame([("a", "File", "A\"x", "meso", 1.0, True, ["t", "u"], 0), ("b", "Event", "B", "micro", 0.5, False, [], 1), ("c", "File", "B", "meso", 0.5, None, None, 2)], NODES)
    e = spark.createDataFrame([("a", "b", "CALLS", 0.5, 1.0, True, 0)], "source_id string, target_id string, type string, weight double, confidence double, is_stale boolean, ord long")
    return Graph(n, e)


def test_round_trips(spark, tmp_path):
    g = small(spark)
    graphs.save(g, f"{tmp_path}/native")
    assert rows(graphs.open_graph(spark, f"{tmp_path}/native").nodes) == rows(g.nodes)
    graphs.save_json(g, f"{tmp_path}/json")
    assert rows(graphs.read_json(spark, f"{tmp_path}/json", g).edges) == rows(g.edges)
    graphs.write_dot(g, f"{tmp_path}/dot")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/dot").collect())
    assert '"a" -> "b" [label="CALLS", style=dashed];' in text and 'A\\"x [STALE]' in text


def test_csv_is_told_apart(spark, tmp_path):
    (tmp_path / "e.csv").write_text("source,target,weight\na,b,0.9\nb,c,\n,c,1\n")
    (tmp_path / "n.csv").write_text("id,name,parent,categories\na,A,,x;y\nb,B,a,\n")
    e, n = graphs.csv_graph(spark, f"{tmp_path}/e.csv"), graphs.csv_graph(spark, f"{tmp_path}/n.csv")
    assert {r.id for r in e.nodes.collect()} == {"a", "b", "c"} and sorted(r.weight for r in e.edges.collect()) == [0.5, 0.9]
    assert [(r.source_id, r.target_id) for r in n.edges.collect()] == [("a", "b")] and {r.id: r.tags for r in n.nodes.collect()} == {"a": ["x", "y"], "b": []}


def test_pages_exports_and_answers(spark):
    g = small(spark)
    pages = spark.createDataFrame([("2025-01-02-x", "a", 90.0), ("y", "zz", 0.4), ("z", None, None)], "id string, node_id string, confidence double")
    assert {(r.doc_id, r.date, r.confidence, r.node_name) for r in graphs.knowledge_pages(pages, g).collect()} == {("2025-01-02-x", "2025-01-02", 0.9, "A\"x"), ("y", None, 0.4, None), ("z", None, None, None)}
    x = graphs.exported_graph({"File": spark.createDataFrame([("a", None)], "id string, name string"), "Event": spark.createDataFrame([("b", "B")], "id string, name string")}, spark.createDataFrame([("a", "b", "CALLS")], "source_id string, target_id string, type string"))
    assert {(r.id, r.type, r.name) for r in x.nodes.collect()} == {("a", "File", "a"), ("b", "Event", "B")} and x.edges.count() == 1
    answers = [("1", "classify_file", json.dumps({"category": "api"})), ("1", "discover_edges", json.dumps({"edges": [{"source": "a", "target": "B", "type": "CALLS"}, {"source": "a", "target": "nobody", "type": "CALLS"}]})), ("2", "discover_edges", "no json"), ("3", "classify_file", None)]
    tags, edges = graphs.model_answers(spark.createDataFrame(answers, "file_id string, tool string, input string"), g)
    assert rows(tags) == [("1", "api")] and rows(edges) == [("a", "b", "CALLS", 0.7)]
    lines = spark.createDataFrame([(json.dumps({"custom_id": "k", "result": {"type": "succeeded", "message": "m"}}),), ("broken",)], "value string")
    assert {(r.custom_id, r.ok) for r in graphs.batch_results(lines).collect()} == {("k", True), (None, False)}


def test_registry_hides_broken_sources():
    r = graphs.SourceRegistry()
    r.add("good", lambda: ["x"], lambda name: name)
    r.add("bad", lambda: 1 / 0, lambda name: name)
    assert r.sources() == ["good:x"] and r.load("good:x") == "x"


def test_folder_listing(spark, tmp_path):
    (tmp_path / "p/src").mkdir(parents=True)
    (tmp_path / "p/package.json").write_text("{}")
    (tmp_path / "p/src/a.ts").write_text("x")
    found = workspace.list_folder(spark, str(tmp_path))
    assert {r.path for r in found.collect()} == {"p/package.json", "p/src/a.ts"}
    assert [(r.folder, r.project_type) for r in workspace.projects(found.select("path")).collect()] == [("p", "nodejs")]
