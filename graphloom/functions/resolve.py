"""Resolving names, scopes and paths to nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import materialize


def innermost_scope(at: DataFrame, scopes: DataFrame) -> DataFrame:
    """at (file, line, ...) with the id of the smallest scope (file, first, last, id) around each line, ties to the earlier start, end and
    id; null where none is. Files are the equality of the join, the range is its residual."""
    keyed = at.withColumn("_row", F.monotonically_increasing_id())
    hit = keyed.select("_row", "file", "line").join(scopes.select("file", "first", "last", F.col("id").alias("scope")), "file").where("line between first and last")
    best = hit.groupBy("_row").agg(F.min(F.struct((F.col("last") - F.col("first")).alias("span"), "first", "last", "scope"))["scope"].alias("scope"))
    return keyed.join(best, "_row", "left").drop("_row")


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """calls (caller, file, name) to functions (id, file, name, ord): by name, one of another file (or none) first, then by order,
    never itself."""
    c = calls.distinct().join(functions.select(F.col("id").alias("callee"), F.col("file").alias("cfile"), "name", "ord"), "name").where("callee <> caller")
    w = Window.partitionBy("caller", "file", "name").orderBy(F.coalesce(F.col("cfile") == F.col("file"), F.lit(False)).cast("int"), "ord")
    return c.withColumn("k", F.row_number().over(w)).where("k = 1").select("caller", "name", "callee")


def resolve_names(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """names (name) to nodes (id, name, ord): the first exact match, else the first in any case. Both are one equality on the lower case."""
    low = F.lower("name")
    j = names.distinct().withColumn("low", low).join(nodes.select(low.alias("low"), F.col("name").alias("node_name"), "id", "ord"), "low")
    best = j.groupBy("name").agg(F.min(F.struct((F.col("node_name") != F.col("name")).alias("inexact"), "ord", "id")).alias("b"))
    return best.select("name", F.col("b.id").alias("id"), (~F.col("b.inexact")).alias("exact"))


MAX_ASKED = 10_000


def fuzzy_resolve(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """Like resolve_names, with a last stage for names that have no equal: the first node whose name contains it or is contained in it.
    That stage compares each asked name with all nodes; names go to the nodes MAX_ASKED or so at a time, however many there are."""
    sure = resolve_names(names, nodes).select("name", "id", F.when(F.col("exact"), "exact").otherwise("case").alias("how"))
    left = names.distinct().join(sure.select("name"), "name", "left_anti").where("name <> ''")
    left = materialize(left)
    parts = max(1, -(-left.count() // MAX_ASKED))
    a, b = F.lower("name"), F.lower("node_name")
    known, loose = nodes.select(F.col("name").alias("node_name"), "id", "ord").where("node_name <> ''"), None
    for k in range(parts):
        part = known.join(F.broadcast(left.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == k)), F.contains(b, a) | F.contains(a, b))
        loose = part if loose is None else loose.unionByName(part)
    loose = loose.groupBy("name").agg(F.min(F.struct("ord", "id"))["id"].alias("id")).select("name", "id", F.lit("part").alias("how"))
    return sure.unionByName(loose)


SUFFIXES = ["", ".js", ".ts", ".jsx", ".tsx", ".py", "/index.js", "/index.ts"]


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (file, spec) of relative specs to files (path): the importing folder joined with the spec, tried with the suffixes in
    order; null where none exists. Other specs are dropped."""
    rel = imports.where(F.col("spec").startswith(".")).distinct()
    folder = F.when(F.contains("file", F.lit("/")), F.regexp_replace("file", "/[^/]*$", "")).otherwise(F.lit(""))
    parts = F.split(F.concat_ws("/", folder, "spec"), "/")
    clean = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    base = F.regexp_replace(F.array_join(clean, "/"), r"\.js$", "")
    tried = rel.withColumn("base", base).select("file", "spec", F.posexplode(F.transform(F.array(*map(F.lit, SUFFIXES)), lambda s: F.concat(F.col("base"), s))).alias("rank", "path"))
    hit = tried.join(files.select("path"), "path").groupBy("file", "spec").agg(F.min(F.struct("rank", "path"))["path"].alias("target"))
    return rel.join(hit, ["file", "spec"], "left")


def project_of(files: DataFrame, projects: DataFrame) -> DataFrame:
    """files (path) with the longest project folder (folder, id) that is a prefix; folders of a path are exploded, so it is an equality."""
    n = F.size(F.split("path", "/"))
    heads = files.select("path", F.explode(F.sequence(F.lit(1), n)).alias("k")).select("path", "k", F.array_join(F.slice(F.split("path", "/"), 1, F.col("k")), "/").alias("folder"))
    best = heads.join(projects.select("folder", "id"), "folder").groupBy("path").agg(F.max(F.struct("k", "id"))["id"].alias("project"))
    return files.select("path").join(best, "path", "left")


def shared_tag_members(items: DataFrame, key: str, tags: str) -> DataFrame:
    """(tag, key, n_items): the items of every tag that at least two hold, in any case. Two items share a tag if both stand under it, so
    this says all that pairs say in a row for each item and tag, whatever the number of items of a tag."""
    t = items.select(key, F.explode(F.array_distinct(F.transform(tags, lambda x: F.lower(x)))).alias("tag")).where("tag is not null").distinct()
    return t.join(t.groupBy("tag").agg(F.count(F.lit(1)).alias("n_items")).where("n_items > 1"), "tag").select("tag", key, "n_items")


def shared_tag_pairs(items: DataFrame, key: str, tags: str) -> DataFrame:
    """(a, b, shared): all pairs of items with a tag in common in any case. Their number grows with the square of a tag's items;
    shared_tag_members() has the same in linear size."""
    t = items.select(key, F.explode(F.array_distinct(F.transform(tags, lambda x: F.lower(x)))).alias("tag"))
    x, y = t.select(F.col(key).alias("a"), "tag"), t.select(F.col(key).alias("b"), "tag")
    return x.join(y, "tag").where("a < b").groupBy("a", "b").agg(F.sort_array(F.collect_set("tag")).alias("shared"))
