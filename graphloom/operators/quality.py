"""Graph validation, confidence adjustment, entry points and flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.graph import Graph
from graphloom.operators.rank import degree_orphans
from graphloom.operators.traverse import trace_flow
from graphloom.session import materialize

#: What confirms or weakens a node, and name patterns of entry points in their order.
CONFIRMED_BY_OTHER, LLM_ALONE, STALE, CONFIRMED_EDGE, HIGH = 0.1, -0.1, -0.2, 0.05, 0.8
ENTRY_PATTERNS = {
    "handler": 0.9, "controller": 0.9, "start": 0.9, "main": 0.9, "init": 0.85, "bootstrap": 0.85, "setup": 0.8, "listener": 0.8, "subscriber": 0.8, "consumer": 0.8, "onmessage": 0.8, "onevent": 0.8,
    "worker": 0.8, "processor": 0.8, "middleware": 0.7, "interceptor": 0.7,
}


def orphan_issues(g: Graph) -> DataFrame:
    return degree_orphans(g).select(F.lit("warning").alias("severity"), F.lit("orphan").alias("category"), F.col("id").alias("subject"), F.lit("no edges").alias("detail"))


def dangling_issues(g: Graph) -> DataFrame:
    key = F.concat("source_id", F.lit("->"), "target_id", F.lit(":"), "type")
    return g.dangling().select(F.lit("error").alias("severity"), F.lit("dangling").alias("category"), key.alias("subject"), F.concat(F.lit("no "), "missing").alias("detail"))


def constraint_issues(g: Graph) -> DataFrame:
    """Up to two warnings an edge: an end whose type the edge type does not allow. Edge types the ontology lacks and missing ends are none."""
    allowed = lambda k: F.create_map(*[x for t, c in schema.CONSTRAINTS.items() for x in (F.lit(t), F.array(*map(F.lit, c[k])))])[F.col("type")]
    off = lambda c, k: F.coalesce(~F.array_contains(allowed(k), F.col(c)), F.lit(False))
    key = F.concat("source_id", F.lit("->"), "target_id", F.lit(":"), "type")
    bad = F.array(F.when(off("source_type", 0), F.concat(F.lit("source "), "source_type")), F.when(off("target_type", 1), F.concat(F.lit("target "), "target_type")))
    return g.typed_ends().select(key.alias("subject"), F.explode(F.filter(bad, lambda x: x.isNotNull())).alias("detail")).select(F.lit("warning").alias("severity"), F.lit("constraint").alias("category"), "subject", "detail")


def pair_issues(g: Graph) -> DataFrame:
    """Targets that one edge type of a pair reaches and the other does not."""
    side = F.create_map(*[F.lit(x) for i, (a, b) in enumerate(schema.PAIRS) for x in (a, f"{i}a", b, f"{i}b")])
    t = g.edges.select("target_id", side[F.col("type")].alias("s"), "type").where("s is not null").groupBy("target_id", F.substring("s", 1, 1).alias("pair")).agg(F.collect_set("type").alias("types"))
    return t.where(F.size("types") == 1).select(F.lit("info").alias("severity"), F.lit("bidirectional").alias("category"), F.col("target_id").alias("subject"), F.concat(F.lit("only "), F.col("types")[0]).alias("detail"))


def issues(g: Graph) -> DataFrame:
    return orphan_issues(g).unionByName(dangling_issues(g)).unionByName(constraint_issues(g)).unionByName(pair_issues(g))


def adjusted_confidence(g: Graph) -> DataFrame:
    """(id, confidence, adjusted): per node: confirmed by edges of the other of scanner and llm, llm without scanner edges, stale."""
    sets = g.incident().groupBy("id").agg(F.max((F.col("provenance") == "scanner").cast("int")).alias("sc"), F.max((F.col("provenance") == "llm").cast("int")).alias("ll"))
    n = g.nodes.select("id", "provenance", "confidence", "is_stale").join(sets, "id", "left")
    sc, ll, p = F.coalesce("sc", F.lit(0)) == 1, F.coalesce("ll", F.lit(0)) == 1, F.col("provenance")
    first = F.when(((p == "scanner") & ll) | ((p == "llm") & sc), CONFIRMED_BY_OTHER).otherwise(0.0)
    change = first + F.when((p == "llm") & ~sc, LLM_ALONE).otherwise(0.0) + F.when(F.col("is_stale"), STALE).otherwise(0.0)
    value = F.when(change == 0, F.col("confidence")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") + change)))
    return n.select("id", "confidence", value.alias("adjusted"))


def boosted_confidence(g: Graph, base: DataFrame) -> DataFrame:
    """(id, boosted, steps): every edge between two nodes of at least .8 adds .05 to both ends, up to 1. Boosts only raise nodes that
    already qualify, so the edges that count are fixed beforehand and their number per node suffices; the additions are folded one by one,
    up to the few that change anything, to give the same floating-point sums as a loop. base: id, adjusted."""
    c = base.select("id", "adjusted")
    high = c.where(F.col("adjusted") >= HIGH).select("id")
    e = g.edges.select("source_id", "target_id").join(high.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(high.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    slots = e.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    fold = F.aggregate(F.sequence(F.lit(1), F.least("k", F.lit(6)).cast("int")), F.col("adjusted"), lambda acc, _: F.least(F.lit(1.0), acc + CONFIRMED_EDGE))
    return c.join(slots, "id", "left").select("id", F.when(F.col("k") > 0, fold).otherwise(F.col("adjusted")).alias("boosted"), F.coalesce("k", F.lit(0)).alias("slots"))


def report(g: Graph, fix: bool = False) -> DataFrame:
    """(category, severity, n) with a last row for the number of checks, and of confidence adjustments if fix."""
    t = materialize(issues(g)).groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))
    checks = g.nodes.agg(F.count(F.lit(1)).alias("a")).crossJoin(g.edges.agg(F.count(F.lit(1)).alias("b"))).select(F.lit("checks").alias("category"), F.lit("total").alias("severity"), (2 * F.col("a") + 2 * F.col("b") + 10).alias("n"))
    t = t.unionByName(checks)
    if fix:
        base = materialize(adjusted_confidence(g))
        moved = base.where("adjusted <> confidence").agg(F.count(F.lit(1)).alias("a")).crossJoin(boosted_confidence(g, base).join(base, "id").where("boosted <> adjusted").agg(F.count(F.lit(1)).alias("b")))
        t = t.unionByName(moved.select(F.lit("adjusted").alias("category"), F.lit("total").alias("severity"), (F.col("a") + F.col("b")).alias("n")))
    return t


def entry_scores(g: Graph) -> DataFrame:
    """(id, score, reason, ord): endpoints 1, async handlers .85, middleware .7; functions by the best name pattern (the first of equals),
    exported ones a tenth more or .6, uncalled ones that call others .5."""
    calls = g.edges.where("type = 'CALLS'")
    out, into = calls.select(F.col("source_id").alias("id")).distinct().withColumn("calls", F.lit(True)), calls.select(F.col("target_id").alias("id")).distinct().withColumn("called", F.lit(True))
    name = F.lower(F.coalesce("name", F.lit("")))
    found = F.filter(F.array(*[F.when(F.contains(name, F.lit(p)), F.struct(F.lit(s).alias("s"), F.lit(-i).alias("i"), F.lit(f"name matches '{p}'").alias("r"))) for i, (p, s) in enumerate(ENTRY_PATTERNS.items())]), lambda x: x.isNotNull())
    best = F.array_max(found)
    exported = F.coalesce(F.get_json_object("metadata", "$.is_exported") == "true", F.lit(False))
    f = g.nodes.where("type = 'Function'").join(out, "id", "left").join(into, "id", "left").withColumn("b", best)
    lonely = F.col("called").isNull() & F.col("calls").isNotNull()
    score = F.when(exported & F.col("b").isNotNull(), F.least(F.col("b.s") + 0.1, F.lit(1.0))).when(exported, 0.6).when(F.col("b").isNotNull(), F.col("b.s")).when(lonely, 0.5)
    reason = F.when(F.col("b").isNotNull(), F.col("b.r")).when(exported, "exported function").when(lonely, "uncalled function with outgoing calls")
    rows = f.select("id", F.round(score, 6).alias("score"), reason.alias("reason"), "ord").where("score is not null")
    rest = schema.lookup("type", {"Endpoint": 1.0, "AsyncHandler": 0.85, "Middleware": 0.7})
    why = schema.lookup("type", {"Endpoint": "HTTP endpoint", "AsyncHandler": "async handler", "Middleware": "middleware"})
    return rows.unionByName(g.nodes.select("id", rest.alias("score"), why.alias("reason"), "ord").where("score is not null"))


def flow_kind(type: Column, name: Column) -> Column:
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(name), w))
    return F.when(type == "Endpoint", "route").when(has(["listener", "consumer", "onevent", "onmessage"]), "event").when(has(["start", "main", "init", "bootstrap", "setup"]), "startup").otherwise("general")


def flows(g: Graph, max_flows: int = 50, min_steps: int = 2, max_depth: int = 10, least: float = 0.5) -> DataFrame:
    """(entry, kind, name, n_steps, steps, place): the flows of the best entry points (twice max_flows of them are traced), each set of
    steps once, in order of the entries. The order among entries of equal score is by type, then insertion."""
    kinds = schema.lookup("type", {"Endpoint": 0, "Function": 1, "AsyncHandler": 2, "Middleware": 3})
    e = entry_scores(g).where(F.col("score") >= least).join(g.nodes.select("id", "type", "name"), "id").withColumn("kind_order", kinds)
    top = materialize(e.orderBy(F.desc("score"), "kind_order", "ord").limit(2 * max_flows).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "kind_order", "ord"))))
    steps = trace_flow(g, top.select("id"), max_depth).groupBy(F.col("entry").alias("id")).agg(F.sort_array(F.collect_list(F.struct("pos", F.col("id").alias("step")))).alias("s"))
    f = top.join(steps, "id").withColumn("steps", F.col("s.step")).where(F.size("steps") >= min_steps)
    f = f.withColumn("twin", F.row_number().over(Window.partitionBy(F.array_sort("steps")).orderBy("place"))).where("twin = 1")
    last = f.join(g.nodes.select(F.col("id").alias("last"), F.col("name").alias("last_name")), F.element_at("steps", -1) == F.col("last"))
    title = F.when(F.col("name") == F.col("last_name"), F.col("name")).otherwise(F.concat("name", F.lit(" -> "), "last_name"))
    out = last.select(F.col("id").alias("entry"), flow_kind(F.col("type"), F.col("name")).alias("kind"), title.alias("name"), F.size("steps").alias("n_steps"), "steps", "place")
    return out.orderBy("place").limit(max_flows)


def flow_graph(found: DataFrame, first_ord: int) -> tuple[DataFrame, DataFrame]:
    """Event nodes tagged `flow` and their weighted edges from the steps: weight 1 - i/n."""
    event = F.concat(F.lit("event:flow:"), "entry")
    nodes = found.select(event.alias("id"), F.lit("Event").alias("type"), "name", F.array(F.lit("flow")).alias("tags"), F.to_json(F.struct(F.col("kind").alias("flow_type"), F.col("n_steps").alias("step_count"))).alias("metadata"), (F.col("place") + first_ord).alias("ord"))
    e = found.select(event.alias("target_id"), "n_steps", F.posexplode("steps").alias("i", "source_id"))
    return nodes, e.select("source_id", "target_id", F.lit("EMITS_EVENT").alias("type"), F.round(1 - F.col("i") / F.col("n_steps"), 6).alias("weight"))
