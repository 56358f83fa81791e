"""Signals of behaviour turned into a graph: who does it, to what, and the targets that have to be made for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions import extract, resolve
from graphloom.graph import Graph

#: What a signal's target is; ids, tiers of confidence of targets that are made.
TARGETS = {"event_emit": "Event", "event_listen": "Event", "enqueue": "Queue", "dequeue": "Queue", "cache_read": "CacheKey", "cache_write": "CacheKey", "stripe": "ExternalAPI", "http": "ExternalAPI"}
HEADS = {"Event": "event", "Queue": "queue", "CacheKey": "cache_key", "ExternalAPI": "externalapi"}
MADE_WITH = {"Event": 0.85, "Queue": 0.85, "CacheKey": 0.8, "ExternalAPI": 0.8}
SCOPES, MODELS = ["Function", "Endpoint", "AsyncHandler"], ["DataModel", "Collection"]


def _path(c: str = "location.file_path") -> Column:
    return F.translate(c, "\\", "/")


def occurrences(files: DataFrame, g: Graph) -> DataFrame:
    """(file_id, file_path, project_id, line_no, kind, subject, edge_type, confidence, source): signals with the innermost scope they stand
    in, else the file's node; signals in files without either are left out. Signals of models count where the file knows the model,
    calls where it does not; a saved variable stands for the model it was last given."""
    lines = extract.lines_of(files)
    s = extract.signals(lines, keep=("file_path", "project_id", "line"))
    subject = F.when(F.col("kind").isin("cache_read", "cache_write"), extract.cache_key(F.col("line"))).when(F.col("kind").isin("stripe", "http"), F.col("kind")).otherwise(F.col("subject"))
    s = s.withColumn("subject", subject).drop("line")
    saved = extract.last_assignment(lines).join(files.select("file_id", "file_path", "project_id"), "file_id")
    saved = saved.select("file_id", "line_no", "file_path", "project_id", F.lit("db_save").alias("kind"), F.col("model").alias("subject"), F.lit("WRITES_DB").alias("edge_type"), F.lit(0.85).alias("confidence"))
    s = s.unionByName(saved)
    models = g.nodes.where(F.col("type").isin(MODELS)).select("name")
    known = extract.file_models(files, models).select("file_id", F.col("model").alias("subject"), F.lit(True).alias("known"))
    of_model = F.startswith("kind", F.lit("db_"))
    s = s.join(known, ["file_id", "subject"], "left").where(F.when(of_model, F.col("known").isNotNull()).when(F.col("kind") == "call", F.col("known").isNull()).otherwise(True)).drop("known")
    scopes = g.nodes.where(F.col("type").isin(SCOPES) & F.col("location.file_path").isNotNull()).select("id", _path().alias("file"), F.col("location.start_line").alias("first"), F.col("location.end_line").alias("last"))
    whole = g.nodes.where("type = 'File' and location.file_path is not null").groupBy(_path().alias("file")).agg(F.min(F.struct("ord", "id"))["id"].alias("whole"))
    placed = resolve.innermost_scope(s.withColumnsRenamed({"file_path": "file", "line_no": "line"}), scopes).join(whole, "file", "left")
    return placed.withColumn("source", F.coalesce("scope", "whole")).where("source is not null").withColumnsRenamed({"file": "file_path", "line": "line_no"}).drop("scope", "whole")


def targets(found: DataFrame, g: Graph) -> DataFrame:
    """(type, name, id, made, file_path, line_no): events, queues, cache keys and APIs that are signalled: the first node of that type and
    name, or one made in the project of the first signal (by file and line)."""
    t = found.withColumn("type", schema.lookup("kind", TARGETS)).where("type is not null")
    first = t.groupBy("type", F.col("subject").alias("name")).agg(F.min(F.struct("file_id", "line_no", "file_path", "project_id")).alias("f"))
    there = g.nodes.where(F.col("type").isin(list(HEADS))).groupBy("type", F.when(F.col("type") == "ExternalAPI", F.lower("name")).otherwise(F.col("name")).alias("name")).agg(F.min(F.struct("ord", "id"))["id"].alias("id"))
    own = F.concat_ws(":", schema.lookup("type", HEADS), F.col("f.project_id"), F.col("name"))
    return first.join(there, ["type", "name"], "left").select("type", "name", F.coalesce("id", own).alias("id"), F.col("id").isNull().alias("made"), "f.file_path", "f.line_no")


def made_nodes(found: DataFrame, g: Graph) -> DataFrame:
    """(id, type, name, confidence, provenance, file_path, line_no): the targets that no node was there for."""
    t = targets(found, g).where("made")
    name = F.when(F.col("type") == "ExternalAPI", F.initcap("name")).otherwise(F.col("name"))
    return t.select("id", "type", name.alias("name"), schema.lookup("type", MADE_WITH).alias("confidence"), F.lit("scanner").alias("provenance"), "file_path", "line_no")


def made_edges(found: DataFrame, g: Graph) -> DataFrame:
    """(source_id, target_id, type, confidence, file_path, line_no): one edge per key, as the first signal (by file, line, kind) has it."""
    t = targets(found, g).select(F.col("type").alias("target_type"), F.col("name").alias("subject"), F.col("id").alias("target_id"))
    to_thing = found.withColumn("target_type", schema.lookup("kind", TARGETS)).join(t, ["target_type", "subject"]).drop("target_type")
    models = g.nodes.where(F.col("type").isin(MODELS)).select("id", "name", "ord")
    db = found.where(F.startswith("kind", F.lit("db_")))
    to_model = db.join(resolve.resolve_names(db.select(F.col("subject").alias("name")), models).select(F.col("name").alias("subject"), F.col("id").alias("target_id")), "subject")
    functions = g.nodes.where("type = 'Function'").select("id", "name", "ord", _path().alias("file"))
    calls = found.where("kind = 'call'")
    callee = resolve.resolve_calls(calls.select(F.col("source").alias("caller"), F.col("file_path").alias("file"), F.col("subject").alias("name")), functions)
    to_function = calls.join(callee.select(F.col("caller").alias("source"), F.col("name").alias("subject"), F.col("callee").alias("target_id")).dropDuplicates(["source", "subject"]), ["source", "subject"])
    every = to_thing.unionByName(to_model).unionByName(to_function).withColumnsRenamed({"source": "source_id", "edge_type": "type"})
    w = Window.partitionBy("source_id", "target_id", "type").orderBy("file_id", "line_no", "kind")
    return every.withColumn("k", F.row_number().over(w)).where("k = 1").select("source_id", "target_id", "type", "confidence", "file_path", "line_no")


def knowledge_nodes(docs: DataFrame, path: str, text: str) -> DataFrame:
    """(id, type, name, description, tags, metadata): documents as knowledge nodes, titled by their heading or their file name."""
    meta = extract.doc_metadata(docs.select(F.col(path).alias("_p"), F.col(text).alias("_t")), "_p", "_t", F.col("_p"))
    stem = F.initcap(F.translate(F.regexp_extract("_p", r"([^/]+?)(?:\.[^./]*)?$", 1), "-_", "  "))
    name = F.coalesce("title", stem)
    tags = F.concat(F.array(F.lit("knowledge"), F.col("kind")), F.coalesce("tags", F.array()))
    about = F.to_json(F.struct(F.col("kind").alias("knowledge_type"), "word_count", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("date", F.lit("")).alias("date"), F.col("_p").alias("source_file")))
    return meta.select(F.concat(F.lit("file:"), F.lower("_p")).alias("id"), F.lit("File").alias("type"), name.alias("name"), F.concat(F.lit("Knowledge "), "kind", F.lit(": "), name).alias("description"), tags.alias("tags"), about.alias("metadata"))


def enriched(nodes: DataFrame, knowledge: DataFrame) -> DataFrame:
    """(id, name, description, tags, metadata, made): nodes there keep their name, take over tags and metadata and a description where they
    have none; the others come as they are. Of knowledge rows with one id the greatest counts."""
    k = knowledge.groupBy("id").agg(F.max(F.struct("name", "description", "tags", "metadata")).alias("k")).select("id", "k.*").alias("k")
    j = nodes.alias("n").join(k, F.col("n.id") == F.col("k.id"), "right")
    there = F.col("n.id").isNotNull()
    tags = F.array_sort(F.array_union(F.coalesce("n.tags", F.array()), F.col("k.tags")))
    more = F.map_concat(F.map_filter(F.coalesce(F.from_json("n.metadata", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda a, _: ~F.map_contains_key(F.from_json("k.metadata", "map<string,string>"), a)), F.from_json("k.metadata", "map<string,string>"))
    blank = F.coalesce(F.col("n.description"), F.lit("")) == ""
    return j.select(F.col("k.id").alias("id"), F.coalesce("n.name", "k.name").alias("name"), F.when(there & ~blank, F.col("n.description")).otherwise(F.col("k.description")).alias("description"), F.when(there, tags).otherwise(F.col("k.tags")).alias("tags"), F.when(there, F.to_json(more)).otherwise(F.col("k.metadata")).alias("metadata"), (~there).alias("made"))
