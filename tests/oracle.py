"""Compare a query with its SQL in DuckDB: columns, row count and values, in any order."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def compare(spark, query, sql: str, sf_dir: str) -> int:
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = Counter(tuple(_norm(r[c]) for c in names) for r in df.collect())
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == names, (sorted(cols), names)
    order = [cols.index(c) for c in names]
    want = Counter(tuple(_norm(r[i]) for i in order) for r in rel.fetchall())
    extra, missing = got - want, want - got
    assert not extra and not missing, f"{sum(got.values())} rows against {sum(want.values())}; only here {list(extra)[:3]}; only in SQL {list(missing)[:3]}"
    return sum(got.values())
