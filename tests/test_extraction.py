import ast

from oracle import rows
from graphloom.functions import behaviour, syntax
from graphloom.graph import Graph
from pyspark.sql import functions as F

LOC = "struct<file_path: string, start_line: int, end_line: int>"
NODES = f"id string, type string, name string, description string, location {LOC}, parent_id string, provenance string, confidence double, is_stale boolean, metadata string, tags array<string>, ord long"
FILES = "file_id long, project_id string, file_path string, text string, n_lines int"


def node(i, type, name, path=None, a=None, b=None, **kw):
    return (i, type, name, kw.get("description"), (path, a, b) if path else None, None, "scanner", 1.0, False, kw.get("metadata"), kw.get("tags"), kw.get("ord", 0))


JS = """import User from "./models/User.js";
function load(id) {
  const u = User.findOne({ id });
  // User.create() in a comment is none
  bus.emit("USER_LOADED");
  cache.get(`user:${id}`);
  return helper(id);
}
const x = new User();
x.save();
x.save();
stripe.charges.create(1); fetch("y");
new Worker("mails");
queue.add("mails");
"""


def test_signals_become_edges(spark):
    g = Graph(
        spark.createDataFrame([node("f:load", "Function", "load", "a.js", 2, 8, ord=1), node("f:helper", "Function", "helper", "b.js", 1, 2, ord=2), node("f:helper2", "Function", "helper", "a.js", 90, 91, ord=0), node("file:a", "File", "a.js", "a.js", 1, 99, ord=3), node("m:user", "DataModel", "user", ord=4), node("m:User", "DataModel", "User", ord=5), node("q:mails", "Queue", "mails", ord=6)], NODES),
        spark.createDataFrame([], "source_id string, target_id string, type string, ord long"),
    )
    files = spark.createDataFrame([(1, "p", "a.js", JS, 0), (2, "p", "nowhere.js", 'bus.emit("LOST");', 0), (3, "p", "a.js", None, 0)], FILES)
    found = behaviour.occurrences(files, g)
    got = {(r.source_id, r.target_id, r.type, r.line_no) for r in behaviour.made_edges(found, g).collect()}
    assert got == {
        ("f:load", "m:User", "READS_DB", 3), ("f:load", "event:p:USER_LOADED", "EMITS_EVENT", 5), ("f:load", "cache_key:p:user:{id}", "CACHE_READ", 6), ("f:load", "f:helper", "CALLS", 7),
        ("file:a", "m:User", "WRITES_DB", 9), ("file:a", "externalapi:p:stripe", "CALLS_API", 12), ("file:a", "q:mails", "DEQUEUES", 13), ("file:a", "q:mails", "ENQUEUES", 14),
    } | {e for e in got if e[:3] == ("file:a", "f:load", "CALLS")}
    assert {(r.id, r.type, r.name) for r in behaviour.made_nodes(found, g).collect()} == {("event:p:USER_LOADED", "Event", "USER_LOADED"), ("cache_key:p:user:{id}", "CacheKey", "user:{id}"), ("externalapi:p:stripe", "ExternalAPI", "Stripe")}
    empty = behaviour.occurrences(files.limit(0), g)
    assert rows(behaviour.made_edges(empty, g)) == [] and rows(behaviour.made_nodes(empty, g)) == []


def test_entities_of_scripts():
    text = 'import a from "./x.js";\nimport {b,\n  c} from \'./y.js\';\nconst z = require("./z");\n// class Hidden {}\nexport class Foo extends Model {\n  async bar(x) { return "}"; }\n}\nexport async function run(a, b = {}) {\n  return a;\n}\nconst arrow = async (x) => {\n  return x;\n};\nconst s = "function nope() {}";\n'
    assert syntax.entities(text, "javascript") == [("DataModel", "Foo", 6, 8, False, True, 1.0), ("Function", "run", 9, 11, True, False, 1.0), ("Function", "arrow", 12, 14, True, False, 1.0)]
    assert syntax.imports(text, "javascript") == ["./x.js", "./y.js", "./z"]
    ts = "interface Shape { a: number }\nabstract class X<T> {\n  private async go(a: string): Promise<void> {\n    if (a) { }\n  }\n}\nfunction f(x: any): number { return 1 }\n"
    assert [e[:4] for e in syntax.entities(ts, "typescript")] == [("TypeDef", "Shape", 1, 1), ("TypeDef", "X", 2, 6), ("Function", "go", 3, 5), ("Function", "f", 7, 7)]
    java = "package a;\nimport java.util.*;\nimport static a.b.C;\npublic class A {\n    private Node f(int x) {\n        if (x) { }\n    }\n}\ninterface B { }\n"
    assert [e[:4] for e in syntax.entities(java, "java")] == [("DataModel", "A", 4, 8), ("Function", "f", 5, 7), ("TypeDef", "B", 9, 9)] and syntax.imports(java, "java") == ["java.util.*", "a.b.C"]
    go = 'package a\nimport (\n "x"\n "y/z"\n)\ntype T struct {\n a int\n}\nfunc (s *T) Go(a int) error {\n return nil\n}\n'
    assert [e[:4] for e in syntax.entities(go, "go")] == [("DataModel", "T", 6, 8), ("Function", "Go", 9, 11)] and syntax.imports(go, "go") == ["x", "y/z"]
    assert syntax.entities("", "go") == [] and syntax.entities("def f(:", "python") == []


def test_python_sample_of_two_classes():
    text = "import os\nfrom x import y\n\nclass User(Model):\n    def save(self):\n        pass\n\nclass UserInterface(ABC):\n    async def go(self):\n        pass\n\ndef run():\n    pass\n"
    got = syntax.entities(text, "python")
    assert [(e[0], e[1], e[6]) for e in got] == [("DataModel", "User", 1.0), ("Function", "save", 1.0), ("TypeDef", "UserInterface", 1.0), ("Function", "go", 1.0), ("Function", "run", 1.0)]
    assert {e[1] for e in got if e[4]} == {"go"} and syntax.imports(text, "python") == []
    assert sum(isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) for x in ast.walk(ast.parse(text))) == len(got)


def test_file_nodes_define_what_they_hold(spark):
    files = spark.createDataFrame([(1, "p", "a/b.ts", 'import x from "./c";\nclass A {}\nclass A {\n}\n', 0), (2, "p", "n.py", None, 0), (3, "p", "r.md", "# x", 0), (4, None, None, "x", 0)], FILES)
    assert {(r.id, r.last_line) for r in syntax.file_nodes(files).collect()} == {("file:p:a/b.ts", 5), ("file:p:n.py", 1)}
    found = syntax.parsed(files)
    assert [(r.id, r.first_line) for r in syntax.entity_nodes(found).collect()] == [("datamodel:p:a/b.ts:A", 3)]
    assert {tuple(r) for r in syntax.syntax_edges(found).collect()} == {("file:p:a/b.ts", "datamodel:p:a/b.ts:A", "DEFINES"), ("file:p:a/b.ts", "file:p:./c", "IMPORTS")}


def test_knowledge_is_merged_into_nodes(spark):
    docs = spark.createDataFrame([("docs/My-learning_a.md", "tags: [x, y]\ndate 2024-01-02"), ("new.md", "# Title\nbody"), ("e.md", None)], "path string, text string")
    k = behaviour.knowledge_nodes(docs, "path", "text")
    nodes = spark.createDataFrame([node("file:docs/my-learning_a.md", "File", "kept", tags=["old", "x"], metadata='{"a":"1","date":"?"}')], NODES)
    got = {r.id: r for r in behaviour.enriched(nodes, k).collect()}
    old = got["file:docs/my-learning_a.md"]
    assert (old.name, old.tags, old.made) == ("kept", ["knowledge", "learning", "old", "x", "y"], False) and '"a":"1"' in old.metadata and '"date":"2024-01-02"' in old.metadata and old.description == "Knowledge learning: My Learning A"
    assert got["file:new.md"].name == "Title" and got["file:e.md"].made and rows(behaviour.enriched(nodes, k.limit(0)).where(F.lit(True))) == []
