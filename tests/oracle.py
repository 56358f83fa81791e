"""Each query of a module beside its SQL."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


def database(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(folder).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else str(p) + '/*.parquet'}'")
    return con


def same(spark, con, folder, query, sql):
    df = query(spark, folder)
    cols = sorted(df.columns)
    got = Counter(canon(tuple(r[c] for c in cols)) for r in df.collect())
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(canon(tuple(x[i] for i in at)) for x in r.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
