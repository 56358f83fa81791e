"""The ontology: node types and tiers, edge types, groups and constraints, and the tables' schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Node types by tier, in the ontology's order.
TIERS = {
    "macro": ["Workspace", "Project", "Service", "Resource", "ExternalAPI"],
    "meso": ["Module", "File", "Router", "Collection", "InfraConfig", "Queue"],
    "micro": ["Endpoint", "Function", "AsyncHandler", "DataModel", "Event", "Middleware", "TypeDef", "CacheKey", "EnvVar"],
}
NODE_TYPES = [t for ts in TIERS.values() for t in ts]
#: Edge types by group.
EDGE_GROUPS = {
    "structural": ["CONTAINS", "DEFINES", "IMPORTS", "IMPLEMENTS", "INHERITS"],
    "data_flow": ["READS_DB", "WRITES_DB", "MIGRATES"],
    "communication": ["CALLS_API", "CALLS_SERVICE", "CALLS", "WEBHOOK_SEND", "WEBHOOK_RECEIVE"],
    "event_async": ["EMITS_EVENT", "CONSUMES_EVENT", "ENQUEUES", "DEQUEUES", "SCHEDULES"],
    "caching": ["CACHE_READ", "CACHE_WRITE"],
    "routing": ["ROUTES_TO", "INTERCEPTS", "VALIDATES", "AUTHENTICATES"],
    "config_deploy": ["DEPENDS_ON", "DEPLOYED_BY", "CONFIGURES"],
    "quality": ["TESTS"],
}
EDGE_TYPES = [t for ts in EDGE_GROUPS.values() for t in ts]
STRUCTURAL = EDGE_GROUPS["structural"]
#: The types an edge may start from and end at.
CONSTRAINTS = {
    "CONTAINS": (["Workspace", "Project", "Service", "Module", "Router"], ["Project", "Service", "Module", "File", "Endpoint", "Function", "AsyncHandler", "DataModel", "Event", "Middleware", "TypeDef", "CacheKey", "EnvVar", "Router", "Collection", "Queue", "InfraConfig", "Resource"]),
    "DEFINES": (["File"], ["Endpoint", "Function", "DataModel", "TypeDef", "Middleware", "AsyncHandler", "Event", "CacheKey", "EnvVar", "Router", "Collection"]),
    "IMPORTS": (["File", "Module"], ["File", "Module"]),
    "IMPLEMENTS": (["DataModel", "Function", "TypeDef"], ["TypeDef"]),
    "INHERITS": (["DataModel", "TypeDef"], ["DataModel", "TypeDef"]),
    "READS_DB": (["Function", "Endpoint", "AsyncHandler"], ["Collection"]),
    "WRITES_DB": (["Function", "Endpoint", "AsyncHandler"], ["Collection"]),
    "MIGRATES": (["Function"], ["Collection"]),
    "CALLS_API": (["Function", "Service", "Endpoint"], ["ExternalAPI"]),
    "CALLS_SERVICE": (["Service", "Function", "Endpoint"], ["Service"]),
    "CALLS": (["Function", "Endpoint", "AsyncHandler", "Middleware"], ["Function"]),
    "WEBHOOK_SEND": (["Service", "Function"], ["ExternalAPI"]),
    "WEBHOOK_RECEIVE": (["Endpoint"], ["ExternalAPI"]),
    "EMITS_EVENT": (["Function", "Service", "Endpoint"], ["Event"]),
    "CONSUMES_EVENT": (["AsyncHandler"], ["Event"]),
    "ENQUEUES": (["Function", "Endpoint", "AsyncHandler"], ["Queue"]),
    "DEQUEUES": (["AsyncHandler"], ["Queue"]),
    "SCHEDULES": (["InfraConfig", "Function"], ["AsyncHandler"]),
    "CACHE_READ": (["Function", "Endpoint", "Middleware"], ["CacheKey"]),
    "CACHE_WRITE": (["Function", "Endpoint", "Middleware"], ["CacheKey"]),
    "ROUTES_TO": (["Router"], ["Endpoint", "Router"]),
    "INTERCEPTS": (["Middleware"], ["Endpoint", "Router", "Service"]),
    "VALIDATES": (["Middleware", "Function"], ["DataModel", "TypeDef"]),
    "AUTHENTICATES": (["Middleware"], ["Endpoint", "Router", "Service"]),
    "DEPENDS_ON": (["Service", "Project"], ["Resource", "Queue", "ExternalAPI"]),
    "DEPLOYED_BY": (["Service"], ["InfraConfig"]),
    "CONFIGURES": (["EnvVar", "InfraConfig"], ["Service", "Resource", "Function", "ExternalAPI", "Queue"]),
    "TESTS": (["Function"], ["Function", "Endpoint", "DataModel", "Middleware", "AsyncHandler"]),
}
#: Edge pairs of which one side without the other is worth a note.
PAIRS = [("EMITS_EVENT", "CONSUMES_EVENT"), ("ENQUEUES", "DEQUEUES"), ("READS_DB", "WRITES_DB"), ("CACHE_READ", "CACHE_WRITE"), ("WEBHOOK_SEND", "WEBHOOK_RECEIVE")]
#: Trust of provenances, specificity of tiers and what some types add to it.
TRUST = {"human": 50, "runtime": 40, "scanner": 30, "llm": 20, "import": 10}
TIER_SPECIFICITY = {"micro": 30, "meso": 20, "macro": 10}
TYPE_BONUS = {"Endpoint": 5, "AsyncHandler": 4, "DataModel": 3, "Middleware": 2, "Router": 2}
EXECUTABLE = ["Function", "Endpoint", "AsyncHandler", "Middleware"]


def lookup(c: Column | str, table: dict) -> Column:
    """table[c] as one literal map; null where there is none."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(c) if isinstance(c, str) else c]


def tier_of(c: Column | str) -> Column:
    return lookup(c, {t: tier for tier, ts in TIERS.items() for t in ts})


def specificity(c: Column | str) -> Column:
    return lookup(c, {t: TIER_SPECIFICITY[tier] + TYPE_BONUS.get(t, 0) for tier, ts in TIERS.items() for t in ts})


def dimension(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} string, pos int")


def sql_values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
