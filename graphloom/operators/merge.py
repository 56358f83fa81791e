"""Merging graphs field by field, aware of confidence, specificity and provenance."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom import schema
from graphloom.graph import Graph

PREFER_FILLED = ["description", "language", "parent_id", "location", "source_hash"]
CLOSE = 0.1


def _chain() -> Column:
    """Clearly higher confidence, else the more specific type where types differ, else the more trusted provenance, else a person decides."""
    d = F.round(F.col("i.confidence") - F.col("e.confidence"), 9)
    si, se = schema.specificity(F.col("i.type")), schema.specificity(F.col("e.type"))
    ti, te = schema.lookup(F.col("i.provenance"), schema.TRUST), schema.lookup(F.col("e.provenance"), schema.TRUST)
    differ = F.coalesce(F.col("i.type") != F.col("e.type"), F.lit(False))
    use, keep = F.lit("use_incoming"), F.lit("keep_existing")
    return F.when(d > CLOSE, use).when(d < -CLOSE, keep).when(differ & (si > se), use).when(differ & (si < se), keep).when(ti > te, use).when(ti < te, keep).otherwise(F.lit("flag_review"))


def _resolution(field: str) -> Column:
    e, i = F.col(f"e.{field}"), F.col(f"i.{field}")
    if field == "confidence":
        return F.when(F.coalesce(i > e, e.isNull()), "use_incoming").otherwise("keep_existing")
    if field == "provenance":
        ti, te = schema.lookup(i, schema.TRUST), schema.lookup(e, schema.TRUST)
        return F.when(F.coalesce(ti, F.lit(0)) > F.coalesce(te, F.lit(0)), "use_incoming").when(F.coalesce(ti, F.lit(0)) < F.coalesce(te, F.lit(0)), "keep_existing").otherwise("flag_review")
    if field in ("tags", "metadata"):
        return F.lit("merge")
    if field in PREFER_FILLED:
        return F.when(e.isNull(), "use_incoming").when(i.isNull(), "keep_existing").otherwise(_chain())
    return _chain()


def _text(c: Column, field: str) -> Column:
    return F.to_json(c) if field in ("tags", "location") else c.cast("string")


def field_conflicts(existing: DataFrame, incoming: DataFrame, fields: list[str]) -> DataFrame:
    """(node_id, field, existing_value, incoming_value, resolution): one row for each field in which two nodes of one id differ.
    Tags and metadata conflict only if the incoming ones add something."""
    j = existing.alias("e").join(incoming.alias("i"), F.col("e.id") == F.col("i.id"))
    parts = []
    for f in fields:
        e, i = F.col(f"e.{f}"), F.col(f"i.{f}")
        differ = F.size(F.array_except(F.coalesce(i, F.array()), F.coalesce(e, F.array()))) > 0 if f == "tags" else ~e.eqNullSafe(i)
        parts.append(F.when(differ, F.struct(F.lit(f).alias("field"), _text(e, f).alias("existing_value"), _text(i, f).alias("incoming_value"), _resolution(f).alias("resolution"))))
    return j.select(F.col("e.id").alias("node_id"), F.inline(F.filter(F.array(*parts), lambda x: x.isNotNull())))


@F.pandas_udf(T.StringType())
def merge_json(a: pd.Series, b: pd.Series) -> pd.Series:
    """Objects merged key by key into the depth, the second winning; keys sorted. What is no object counts as an empty one."""

    def load(x):
        try:
            v = json.loads(x) if isinstance(x, str) else {}
        except ValueError:
            v = {}
        return v if isinstance(v, dict) else {}

    def deep(x, y):
        return {k: deep(x[k], y[k]) if isinstance(x.get(k), dict) and isinstance(y.get(k), dict) else y.get(k, x.get(k)) for k in {**x, **y}}

    return pd.Series([json.dumps(deep(load(x), load(y)), sort_keys=True) for x, y in zip(a, b)])


def merged_nodes(existing: DataFrame, incoming: DataFrame, fields: list[str]) -> DataFrame:
    """(id, version, modified, fields...): existing nodes with their conflicts applied; a flagged conflict changes nothing, a changed node
    gets the next version. Incoming nodes that are new come as they are."""
    j = existing.alias("e").join(incoming.alias("i"), F.col("e.id") == F.col("i.id"), "full_outer")
    out, changes = [], []
    for f in fields:
        e, i = F.col(f"e.{f}"), F.col(f"i.{f}")
        value = F.array_union(F.coalesce(e, F.array()), F.coalesce(i, F.array())) if f == "tags" else merge_json(e, i) if f == "metadata" else F.when(~e.eqNullSafe(i) & (_resolution(f) == "use_incoming"), i).otherwise(e)
        out.append(F.when(F.col("e.id").isNull(), i).when(F.col("i.id").isNull(), e).otherwise(value).alias(f))
        changes.append(~value.eqNullSafe(e))
    both = F.col("e.id").isNotNull() & F.col("i.id").isNotNull()
    changed = F.coalesce(both, F.lit(False)) & F.coalesce(any_of(changes), F.lit(False))
    version = F.coalesce("e.version", "i.version") + changed.cast("int")
    return j.select(F.coalesce("e.id", "i.id").alias("id"), version.alias("version"), changed.alias("modified"), *out)


def any_of(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out | c
    return out


def new_edges(g: Graph, nodes: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming edges with a key of their own whose both ends exist among the merged nodes."""
    k = ["source_id", "target_id", "type"]
    ids = nodes.select("id")
    e = incoming.dropDuplicates(k).join(g.edges.select(*k), k, "left_anti")
    return e.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def merge_counts(conflicts: DataFrame, merged: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """(n_conflicts, n_auto, n_flagged, n_updated), and edges_added with the edges from new_edges()."""
    c = conflicts.agg(F.count(F.lit(1)).alias("n_conflicts"), F.count(F.when(F.col("resolution") != "flag_review", 1)).alias("n_auto"), F.count(F.when(F.col("resolution") == "flag_review", 1)).alias("n_flagged"))
    out = c.crossJoin(merged.agg(F.count(F.when(F.col("modified"), 1)).alias("n_updated")))
    return out if added is None else out.crossJoin(added.agg(F.count(F.lit(1)).alias("edges_added")))
