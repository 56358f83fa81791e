"""Context packs and impact analysis on top of traversal."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.graph import Graph
from graphloom.operators import store
from graphloom.operators.traverse import downstream, reach, upstream
from graphloom.session import materialize

#: The token budgets of the detail levels.
LEVEL_TOKENS = {"L1": 200, "L2": 1000, "L3": 4000}


def context_risk(up: Column, down: Column) -> Column:
    return F.when(up > 5, "High").when(down > 10, "Medium")


def cli_risk(up: Column, down: Column) -> Column:
    return F.when((up == 0) & (down == 0), "ISOLATED").when(up > 10, "HIGH").when(up > 5, "MEDIUM").otherwise("LOW")


def tool_risk(up: Column) -> Column:
    return F.when(up > 10, "CRITICAL").when(up > 5, "HIGH").when(up > 2, "MEDIUM").otherwise("LOW")


def focus(g: Graph, scope: str) -> DataFrame:
    """(id): the node with this id, else the first in order whose name contains it."""
    hit = g.nodes.where((F.col("id") == scope) | F.contains(F.lower("name"), F.lit(scope.lower())))
    return hit.select("id", F.struct((F.col("id") != scope).alias("a"), "ord").alias("k")).orderBy("k").limit(1).select("id")


def tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def pack(g: Graph, scope: str, max_depth: int = 2) -> DataFrame:
    """(section, id, type, name, confidence, ord, line, cost): the rows of a context pack: target, upstream, downstream."""
    target = materialize(focus(g, scope))
    parts = [("target", target), ("upstream", upstream(g, target, max_depth)), ("downstream", downstream(g, target, max_depth))]
    out = None
    for name, ids in parts:
        n = g.nodes.join(ids.select("id"), "id", "left_semi")
        line = F.concat(F.col("type"), F.lit(" "), F.col("name"), F.coalesce(F.concat(F.lit(" @ "), store.at()), F.lit("")))
        rows = n.select(F.lit(name).alias("section"), "id", "type", "name", "confidence", "ord", line.alias("line"), "is_stale")
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("cost", tokens(F.to_json(F.struct("id", "type", "name", "confidence"))))


def within_budget(rows: DataFrame, budget: int, compat: bool = False) -> DataFrame:
    """The rows that fit: the target first, then the sections in order, each by falling confidence until the first that does not fit.
    compat leaves a section whole where the budget is used up before it, as the reference results do; else such a section is empty."""
    rank = F.when(F.col("section") == "target", 0).when(F.col("section") == "upstream", 1).otherwise(2)
    w = Window.partitionBy("section").orderBy(F.desc("confidence"), F.asc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("rank", rank).withColumn("run", F.sum("cost").over(w))
    left, kept = budget, None
    for k in range(3):
        part = r.where(F.col("rank") == k)
        fit = part if k == 0 or (compat and left <= 0) else part.where(F.col("run") <= left) if left > 0 else part.limit(0)
        used = fit.agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0]
        left -= used if not (compat and left <= 0) else 0
        kept = fit if kept is None else kept.unionByName(fit)
    return kept.drop("run", "rank")


def render(rows: list, level: str) -> str:
    """The text of a pack at a level from its (bounded) rows."""
    out = []
    for section in ("target", "upstream", "downstream"):
        part = [r for r in rows if r["section"] == section]
        if part:
            out.append(f"## {section} ({len(part)})")
            out += [f"- {r['name']}" if level == "L1" else f"- {r['line']}" if level == "L2" else f"- {r['line']} [{r['id']}] confidence {r['confidence']}" for r in part]
    return "\n".join(out)


def fitting_level(rows: list, budget: int) -> str:
    """The richest level whose text fits the budget, the plainest if none does."""
    return next((level for level in ("L3", "L2", "L1") if len(render(rows, level)) // 4 <= budget), "L1")


def truncate(text: str, budget: int, order: tuple[str, ...] = ("downstream", "upstream")) -> str:
    """Whole sections dropped in order until the text fits, then a hard cut."""
    for name in order:
        if len(text) // 4 <= budget:
            return text
        text = re.sub(rf"(?ms)^## {name} .*?(?=^## |\Z)", "", text).rstrip("\n")
    return text[: 4 * budget]


def impact(g: Graph, ids: DataFrame, max_depth: int = 3) -> DataFrame:
    """(direction, type, tier, n, n_stale): what lies up- and downstream, by type."""
    ids = materialize(ids.select("id"))
    out = None
    for name, fwd in (("upstream", False), ("downstream", True)):
        near = reach(g.edges, ids, max_depth, forward=fwd).where("depth > 0").select("id")
        rows = g.nodes.join(near, "id", "left_semi").groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_stale"), 1)).alias("n_stale"))
        rows = rows.select(F.lit(name).alias("direction"), "type", schema.tier_of("type").alias("tier"), "n", "n_stale")
        out = rows if out is None else out.unionByName(rows)
    return out


def risk_of(by_type: DataFrame) -> DataFrame:
    """(n_up, n_down, cli, tool, context): the three risk ladders over impact()."""
    side = lambda s: F.coalesce(F.sum(F.when(F.col("direction") == s, F.col("n"))), F.lit(0)).cast("long")
    t = by_type.agg(side("upstream").alias("n_up"), side("downstream").alias("n_down"))
    return t.select("n_up", "n_down", cli_risk(F.col("n_up"), F.col("n_down")).alias("cli"), tool_risk(F.col("n_up")).alias("tool"), context_risk(F.col("n_up"), F.col("n_down")).alias("context"))


def changed_nodes(g: Graph, paths: DataFrame) -> DataFrame:
    """(path, id): nodes whose file is a changed path or ends with it, or the other way round. Both sides meet by file name, so the
    suffix test is a residual of an equality join."""
    base = lambda c: F.substring_index(c, "/", -1)
    n = g.nodes.where("location.file_path is not null").select("id", F.translate("location.file_path", "\\", "/").alias("file"))
    n = n.withColumn("base", base(F.col("file")))
    p = paths.select("path").distinct().withColumn("base", base(F.col("path")))
    return n.join(p, "base").where(F.endswith("file", F.col("path")) | F.endswith("path", F.col("file"))).select("path", "id")
