"""Reading and writing graphs in other shapes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import EDGE_COLUMNS, NODE_COLUMNS, Graph

#: Shapes of node types in DOT.
SHAPES = {"Workspace": "house", "Project": "box3d", "Service": "component", "Module": "folder", "File": "note", "Endpoint": "cds", "Function": "ellipse", "DataModel": "cylinder", "Event": "diamond", "Queue": "parallelogram"}
NODE_SCHEMA = "id string, type string, name string, description string, tier string, parent_id string, tags array<string>, confidence double, is_stale boolean, language string, metadata string"
LOOSE = "id string, name string, label string, title string, type string, kind string, category string, description string, parent_id string, parent string, tags array<string>, timestamp string"
LOOSE_EDGE = "source string, target string, `from` string, `to` string, source_id string, target_id string, type string, label string, kind string, weight double"


def save(g: Graph, folder: str) -> None:
    """Native form: Parquet, nodes beside edges."""
    g.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    g.edges.write.mode("overwrite").parquet(f"{folder}/edges")


def open_graph(spark: SparkSession, folder: str) -> Graph:
    return Graph(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"))


def save_json(g: Graph, folder: str) -> None:
    """One JSON object a line, nodes and edges in folders of their own, so that no task has to hold the whole graph."""
    g.nodes.write.mode("overwrite").json(f"{folder}/nodes")
    g.edges.write.mode("overwrite").json(f"{folder}/edges")


def read_json(spark: SparkSession, folder: str, like: Graph) -> Graph:
    return Graph(spark.read.schema(like.nodes.schema).json(f"{folder}/nodes"), spark.read.schema(like.edges.schema).json(f"{folder}/edges"))


def json_document(spark: SparkSession, path: str) -> Graph:
    """A document {nodes: [...], edges or links: [...]} with the usual synonyms: name, label or title; type, kind or category; source and
    target, from and to, or source_id and target_id. Missing tiers are meso, missing weights .5."""
    doc = spark.read.schema(f"nodes array<struct<{_as_fields(LOOSE)}>>, edges array<struct<{_as_fields(LOOSE_EDGE)}>>, links array<struct<{_as_fields(LOOSE_EDGE)}>>").json(path, multiLine=True)
    n = doc.select(F.posexplode("nodes").alias("ord", "n")).select("n.*", "ord")
    nodes = n.select("id", F.coalesce("type", "kind", "category", F.lit("Module")).alias("type"), F.coalesce("name", "label", "title", "id").alias("name"), "description", F.coalesce("parent_id", "parent").alias("parent_id"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.lit("meso").alias("tier"), F.col("ord").cast("long").alias("ord")).where("id is not null")
    e = doc.select(F.posexplode(F.coalesce("edges", "links")).alias("ord", "e")).select("e.*", "ord")
    edges = e.select(F.coalesce("source", "from", "source_id").alias("source_id"), F.coalesce("target", "to", "target_id").alias("target_id"), F.coalesce("type", "label", "kind", F.lit("DEPENDS_ON")).alias("type"), F.coalesce("weight", F.lit(0.5)).alias("weight"), F.col("ord").cast("long").alias("ord")).where("source_id is not null and target_id is not null")
    return Graph(nodes, edges)


def _as_fields(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (x.split(" ", 1) for x in ddl.split(", ")))


def csv_edges(table: DataFrame) -> Graph:
    """An edge list (source, target[, source_type, target_type, type or label, weight]): every end becomes a node once, types from its
    first mention."""
    has = set(table.columns)
    col = lambda *names, other=None: F.coalesce(*[F.col(c) for c in names if c in has], F.lit(other))
    t = table.withColumn("ord", F.monotonically_increasing_id())
    edges = t.where("source is not null and target is not null").select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), col("type", "label", other="DEPENDS_ON").alias("type"), (F.coalesce(F.col("weight").cast("double"), F.lit(0.5)) if "weight" in has else F.lit(0.5)).alias("weight"), "ord")
    ends = t.select(F.inline(F.array(F.struct(F.col("source").alias("id"), col("source_type", other="Module").alias("type"), (F.col("ord") * 2).alias("ord")), F.struct(F.col("target").alias("id"), col("target_type", other="Module").alias("type"), (F.col("ord") * 2 + 1).alias("ord"))))).where("id is not null")
    nodes = ends.groupBy("id").agg(F.min(F.struct("ord", "type")).alias("v")).select("id", "v.type", F.col("id").alias("name"), "v.ord")
    return Graph(nodes, edges)


def csv_nodes(table: DataFrame) -> Graph:
    """A node list (id, name, type, parent_id or parent, categories by `;`): parents become CONTAINS edges."""
    has = set(table.columns)
    col = lambda *names, other=None: F.coalesce(*[F.col(c) for c in names if c in has], F.lit(other))
    t = table.withColumn("ord", F.monotonically_increasing_id()).where("id is not null")
    nodes = t.select("id", col("type", other="Module").alias("type"), col("name", "id").alias("name"), col("parent_id", "parent").alias("parent_id"), F.filter(F.split(col("categories", other=""), ";"), lambda x: F.trim(x) != "").alias("tags"), "ord")
    edges = nodes.where("parent_id is not null and parent_id <> ''").select(F.col("parent_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("CONTAINS").alias("type"), F.lit(0.5).alias("weight"), "ord")
    return Graph(nodes, edges)


def csv_graph(spark: SparkSession, path: str) -> Graph:
    """A CSV file with a header, told apart by its columns."""
    t = spark.read.csv(path, header=True)
    return csv_edges(t) if {"source", "target"} <= set(t.columns) else csv_nodes(t)


def exported_graph(tables: dict[str, DataFrame], relations: DataFrame) -> Graph:
    """A graph database's exports: one table per node type (id, name, ...) and one of relations (source_id, target_id, type)."""
    nodes = None
    for kind, t in sorted(tables.items()):
        rows = t.select("id", F.lit(kind).alias("type"), F.coalesce("name", "id").alias("name"))
        nodes = rows if nodes is None else nodes.unionByName(rows)
    return Graph(nodes.withColumn("ord", F.monotonically_increasing_id()), relations.select("source_id", "target_id", "type", F.lit(0.5).alias("weight")).withColumn("ord", F.monotonically_increasing_id()))


def knowledge_pages(pages: DataFrame, g: Graph) -> DataFrame:
    """(doc_id, node_id, date, confidence): documents (id, node_id, confidence) of a paginated knowledge source, already fetched as JSON,
    joined with the nodes they name; the date is taken from the id, confidences above 1 are percentages."""
    c = F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence"))
    d = pages.select(F.col("id").alias("doc_id"), "node_id", F.nullif(F.regexp_extract("id", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")).alias("date"), c.alias("confidence"))
    return d.join(g.nodes.select(F.col("id").alias("node_id"), F.col("name").alias("node_name")), "node_id", "left")


def model_answers(answers: DataFrame, g: Graph) -> tuple[DataFrame, DataFrame]:
    """(tags by file, edges) from recorded tool answers (file_id, tool, input as JSON): classifications become tags; discovered edges are
    resolved by exact id or name, first in order, with confidence .7 where none is given. Nothing is called over a network."""
    cls = answers.where("tool = 'classify_file'").select("file_id", F.get_json_object("input", "$.category").alias("tag")).where("tag is not null")
    e = answers.where("tool = 'discover_edges'").select(F.explode(F.from_json(F.get_json_object("input", "$.edges"), "array<struct<source:string,target:string,type:string,confidence:double>>")).alias("e")).select("e.*")
    keys = g.nodes.select(F.explode(F.array_distinct(F.array("id", "name"))).alias("key"), "id", "ord").groupBy("key").agg(F.min(F.struct("ord", "id"))["id"].alias("id"))
    s, t = keys.select(F.col("key").alias("source"), F.col("id").alias("source_id")), keys.select(F.col("key").alias("target"), F.col("id").alias("target_id"))
    edges = e.join(s, "source").join(t, "target").groupBy("source_id", "target_id", "type").agg(F.max(F.coalesce("confidence", F.lit(0.7))).alias("confidence"))
    return cls, edges


def batch_results(lines: DataFrame) -> DataFrame:
    """(custom_id, ok, text, error) from lines (value) of a batch job's results; lines that are no JSON are errors without an id."""
    j = F.from_json("value", "custom_id string, result struct<type: string, message: string, error: string>")
    return lines.select(j.alias("j")).select("j.custom_id", F.coalesce(F.col("j.result.type") == "succeeded", F.lit(False)).alias("ok"), F.col("j.result.message").alias("text"), F.col("j.result.error").alias("error"))


def dot_lines(g: Graph) -> DataFrame:
    """(value): the lines of a DOT file between its braces; stale nodes are marked, stale edges dashed."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    from graphloom.schema import lookup

    label = F.concat("name", F.when(F.col("is_stale"), " [STALE]").otherwise(F.lit("")))
    n = g.nodes.select(F.concat(F.lit("  "), q(F.col("id")), F.lit(" [label="), q(label), F.lit(", shape="), F.coalesce(lookup("type", SHAPES), F.lit("box")), F.lit("];")).alias("value"))
    e = g.edges.select(F.concat(F.lit("  "), q(F.col("source_id")), F.lit(" -> "), q(F.col("target_id")), F.lit(" [label="), q(F.col("type")), F.when(F.col("is_stale"), ", style=dashed").otherwise(F.lit("")), F.lit("];")).alias("value"))
    return n.unionByName(e)


def write_dot(g: Graph, path: str) -> None:
    s = g.nodes.sparkSession
    head, tail = s.createDataFrame([("digraph G {",)], "value string"), s.createDataFrame([("}",)], "value string")
    head.union(dot_lines(g)).union(tail).write.mode("overwrite").text(path)


def csv_export(g: Graph) -> tuple[DataFrame, DataFrame]:
    n = g.nodes.select("id", "type", "name", "tier", "confidence", "is_stale", F.array_join("tags", ";").alias("tags"))
    return n, g.edges.select("source_id", "target_id", "type", "weight", "confidence", "is_stale")


class SourceRegistry:
    """Sources by prefix; a source that fails is left out of the listing, not raised."""

    def __init__(self) -> None:
        self.adapters: dict[str, tuple[Callable[[], list[str]], Callable[[str], Graph]]] = {}

    def add(self, prefix: str, listing: Callable[[], list[str]], load: Callable[[str], Graph]) -> None:
        self.adapters[prefix] = (listing, load)

    def sources(self) -> list[str]:
        out = []
        for prefix, (listing, _) in self.adapters.items():
            try:
                out += [f"{prefix}:{x}" for x in listing()]
            except Exception:  # noqa: BLE001 - one broken source must not hide the others
                continue
        return out

    def load(self, source: str) -> Graph:
        prefix, _, name = source.partition(":")
        return self.adapters[prefix][1](name)


__all__ = ["EDGE_COLUMNS", "NODE_COLUMNS", "SourceRegistry", "csv_graph", "json_document"]
