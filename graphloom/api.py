"""Questions to a graph by name, as JSON-ready answers: tools, resources, prompts, and a dispatcher of JSON-RPC requests.

Every answer is a bounded report: rows come to the driver only after a limit, a budget or an aggregation.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.cache import ResultCache
from graphloom.graph import Graph, top_by
from graphloom.operators import impact, incremental, quality, rank, store, traverse

INTERNAL, PARSE = -32603, -32700
RESOURCES = ["repos", "stats", "clusters", "flows", "schema"]
#: What the prompts ask for, step by step.
PROMPTS = {
    "detect_impact": ("file_or_function", "Before changing {0}: find it with search_entity, measure it with impact_analysis, see its group with list_clusters and pending edits with detect_changes. Report what may break, which tests to run and how risky it is."),
    "explore_area": ("starting_point", "Starting at {0}: find it with search_entity, look around with traverse_graph two steps both ways, see its flows with list_flows and read get_context. Report what it does, who calls it and what it needs."),
    "generate_map": (None, "Draw the architecture: sizes from get_stats, groups from list_clusters, paths from list_flows, endpoints and services from search_entity. Report services, endpoints, groups and data models."),
}
MOST = 50


def rows(df: DataFrame, limit: int = MOST) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(limit).collect()]


def context(g: Graph, scope: str, level: str = "L2", max_depth: int = 3) -> dict:
    """A context pack at a detail level, within the level's budget (200, 1000, 4000 tokens): L1 names, L2 descriptions and risk, L3 files too.
    An unknown level counts as L2; a scope that names nothing gives empty lists."""
    level = level if level in impact.LEVEL_TOKENS else "L2"
    pack = impact.within_budget(impact.pack(g, scope, max_depth), impact.LEVEL_TOKENS[level])
    kept = pack.select("section", "id").collect()  # bounded by the budget
    ids = g.nodes.sparkSession.createDataFrame([(r.section, r.id) for r in kept], "section string, id string")
    nodes = store.project(g, int(level[1])).join(F.broadcast(ids), "id")
    by = {s: [] for s in ("target", "upstream", "downstream")}
    for r in nodes.collect():
        d = r.asDict(recursive=True)
        by[d.pop("section")].append(d)
    out = {"scope": scope, "depth": max_depth, "level": level, "total_nodes_in_scope": len({r.id for r in kept}), "relevant_nodes": by["target"], "upstream": by["upstream"], "downstream": by["downstream"]}
    edge = ["source_id", "target_id", "type"] + ([] if level == "L1" else ["confidence", "is_stale"])
    out["edges"] = rows(g.induced(ids.select("id").distinct()).select(*edge).orderBy(*edge[:3]))
    if level != "L1":
        risk = "High" if len(by["upstream"]) > 5 else "Medium" if len(by["downstream"]) > 10 else None
        out |= {"risk_assessment": risk, "stale_warnings": [f"{n['name']} is stale" for s in by.values() for n in s if n.get("is_stale")]}
    if level == "L3":
        out["related_files"] = sorted({n["at"].rsplit(":", 1)[0] for s in by.values() for n in s if n.get("at")})
    return out


def clusters(g: Graph, min_size: int = 3) -> DataFrame:
    """(community, size, n_inner, cohesion, label): the semantic communities of at least min_size members."""
    members, links = rank.cluster_links(g, rank.CLUSTER_NODES, rank.CLUSTER_EDGES)
    found = rank.communities(members, links)
    return rank.cohesion(found, g.edges).where(F.col("size") >= min_size).join(rank.cluster_labels(found, g.nodes), "community", "left").withColumn("cohesion", F.round("cohesion", 3))


def all_metrics(g: Graph) -> dict:
    """Ranks, communities, orphans and architecture scores as tables and numbers in one place; nothing is computed before it is asked for
    but the scores."""
    members, links = rank.cluster_links(g, ["Module", "File"], None)
    return {"pagerank": rank.graph_pagerank(g), "communities": rank.communities(members, links), "clusters": clusters(g, 1), "orphans": rank.semantic_orphans(g).select("id"), "architecture_score": rank.architecture(g), "stats": rows(store.density(g))[0]}


class Service:
    """A graph and what may be asked of it. Rankings and clusters are kept while the graph stays the same."""

    def __init__(self, spark: SparkSession, graph: Graph, name: str = "graph", ttl: float = 30.0):
        self.spark, self.g, self.name, self.cache = spark, graph, name, ResultCache(ttl)
        self.tools: dict[str, Callable[[dict], object]] = {
            "search_entity": self._search, "traverse_graph": self._traverse, "get_context": lambda a: context(self.g, a.get("scope", ""), a.get("detail_level", "L2"), a.get("depth", 3)), "impact_analysis": self._impact,
            "get_stats": lambda a: rows(store.stats(self.g, self.spark).where("n > 0"), 200), "list_flows": self._flows, "list_clusters": self._clusters, "detect_changes": self._changes,
        }

    def _search(self, a: dict) -> dict:
        kind = a.get("type_filter")
        if kind and kind not in schema.NODE_TYPES:
            return {"error": f"unknown type: {kind}"}
        found = rows(store.search_entity(self.g, a.get("query", ""), kind, a.get("limit", 10)).select("id", "type", "name", "confidence", "total_before_limit"), a.get("limit", 10))
        return {"matches": found, "total_matches": len(found)}

    def _traverse(self, a: dict) -> dict:
        ids = self.spark.createDataFrame([(a["node_id"],)], "id string")
        near = None
        for name, forward in (("upstream", False), ("downstream", True)):
            if a.get("direction", "both") in (name, "both"):
                one = traverse.reach(self.g.edges, ids, a.get("depth", 2), forward=forward)
                near = one if near is None else near.unionByName(one)
        near = near.groupBy("id").agg(F.min("depth").alias("depth"))
        edges = self.g.induced(near)
        edges = edges.where(F.col("type").isin(a["edge_types"])) if a.get("edge_types") else edges
        return {"nodes": rows(near.join(self.g.nodes.select("id", "type", "name"), "id").orderBy("depth", "id")), "edges": rows(edges.select("source_id", "target_id", "type").orderBy("source_id", "target_id", "type"))}

    def _impact(self, a: dict) -> dict:
        by = impact.impact(self.g, self.spark.createDataFrame([(a["node_id"],)], "id string"), a.get("depth", 3))
        e = self.g.edges.select("source_id", "target_id", "type")
        direct = e.where((F.col("source_id") == a["node_id"]) | (F.col("target_id") == a["node_id"]))
        return {"by_type": rows(by, 200), "risk": rows(impact.risk_of(by))[0], "direct_edges": rows(direct.orderBy("source_id", "target_id", "type"))}

    def _flows(self, a: dict) -> list[dict]:
        f = self.cache.get(self.g, "flows", lambda g: quality.flows(g).select("entry", "kind", "name", "n_steps"))
        f = f.where(F.col("kind") == a["flow_type"]) if a.get("flow_type") else f
        return rows(top_by(f, a.get("limit", 20), F.desc("n_steps"), F.asc("entry")))

    def _clusters(self, a: dict) -> list[dict]:
        c = self.cache.get(self.g, "clusters", lambda g: clusters(g, 1)).where(F.col("size") >= a.get("min_size", 3))
        return rows(top_by(c, a.get("limit", 20), F.desc("size"), F.asc("community")))

    def _changes(self, a: dict) -> dict:
        paths = self.spark.createDataFrame([(p,) for p in a.get("paths", [])], "path string")
        return rows(incremental.change_report(self.g, paths))[0]

    def read(self, uri: str) -> dict:
        """repos, or repo/<name>/stats, clusters, flows or schema; anything else is an error row."""
        parts = uri.split("://")[-1].split("/")
        if parts == ["repos"]:
            return {"repos": [{"name": self.name}], "count": 1}
        if parts[0] != "repo" or len(parts) < 3:
            return {"error": f"unknown resource: {uri}"}
        if parts[1] != self.name:
            return {"error": f"no graph named {parts[1]}; there is {self.name}"}
        kinds = {
            "stats": lambda: {"counts": self.tools["get_stats"]({})}, "clusters": lambda: {"clusters": self._clusters({"min_size": 2, "limit": MOST})}, "flows": lambda: {"flows": self._flows({"limit": MOST})},
            "schema": lambda: {"node_types": [{"name": t, "tier": tier} for tier, ts in schema.TIERS.items() for t in ts], "edge_types": [{"name": t} for t in schema.EDGE_TYPES], "tiers": [{"name": t} for t in schema.TIERS]},
        }
        return kinds[parts[2]]() if parts[2] in kinds else {"error": f"unknown resource: {uri}"}

    def dispatch(self, method: str, params: dict) -> object:
        text = lambda x: json.dumps(x, default=str)
        if method == "initialize":
            return {"capabilities": {"tools": {}, "resources": {}, "prompts": {}}, "serverInfo": {"name": "graphloom"}}
        if method in ("ping", "notifications/initialized"):
            return {}
        if method == "tools/list":
            return {"tools": [{"name": t} for t in self.tools]}
        if method == "tools/call":
            return {"content": [{"type": "text", "text": text(self.tools[params["name"]](params.get("arguments", {})))}]}
        if method == "resources/list":
            return {"resourceTemplates": [{"uriTemplate": r if r == "repos" else f"repo/{{name}}/{r}"} for r in RESOURCES]}
        if method == "resources/read":
            return {"contents": [{"uri": params["uri"], "mimeType": "application/json", "text": text(self.read(params["uri"]))}]}
        if method == "prompts/list":
            return {"prompts": [{"name": k, "arguments": [{"name": a, "required": True}] if a else []} for k, (a, _) in PROMPTS.items()]}
        if method == "prompts/get":
            asked, words = PROMPTS[params["name"]]
            return {"messages": [{"role": "user", "content": {"type": "text", "text": words.format(params.get("arguments", {}).get(asked, "unknown"))}}]}
        raise ValueError(f"unknown method: {method}")

    def handle(self, line: str) -> dict | None:
        """One request of a line of JSON; None answers a notification. What is no JSON and what fails are errors, never exceptions."""
        try:
            request = json.loads(line)
        except ValueError as e:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE, "message": str(e)}}
        key = request.get("id")
        try:
            result = self.dispatch(request.get("method"), request.get("params") or {})
        except Exception as e:  # noqa: BLE001 - the caller gets it as an answer
            return None if key is None else {"jsonrpc": "2.0", "id": key, "error": {"code": INTERNAL, "message": f"{type(e).__name__}: {e}"}}
        return None if key is None else {"jsonrpc": "2.0", "id": key, "result": result}
