"""Run registered queries next to their SQL and compare the rows."""
from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(float(f"{v:.12g}"))
    return v if isinstance(v, bool) else str(v)


def _number(v):
    # engines differ in integer widths and int/double results of one value
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(_number(r[i])) for i in order) for r in rows)


def compare(name, fn, sql, spark, sf_dir, con) -> tuple[bool, str]:
    started = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - started
    note = f"{sum(got.values())} rows, {spent:.1f}s"
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("NestedLoop", "CartesianProduct", "Exchange SinglePartition"):
        if bad in plan:
            return False, f"{note}: {bad} in the plan"
    if sql is None:
        return True, note + ", rows only"
    started = time.time()
    rel = con.sql(sql)
    columns = rel.columns
    want = rows_of(columns, rel.fetchall())
    note += f", sql {time.time() - started:.1f}s"
    if sorted(columns) != sorted(df.columns):
        return False, f"{note}: columns {sorted(df.columns)} vs {sorted(columns)}"
    if got != want:
        only = list((got - want).items())[:2], list((want - got).items())[:2]
        return False, f"{note}: {sum((got - want).values())} differ of {sum(want.values())}: {str(only)[:900]}"
    return True, note


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from storyline.session import local_session
    sf_dir = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark, con = local_session(), connection(sf_dir)
    sqls, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, note = compare(name, fn, sqls.get(name), spark, sf_dir, con)
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += [] if ok else [name]
        print(("ok  " if ok else "BAD ") + name, note, flush=True)
    print("failed:", bad)
