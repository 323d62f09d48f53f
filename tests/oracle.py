"""Run registered queries against their SQL: python tests/oracle.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from relaygrid import catalog  # noqa: E402
from relaygrid.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else ("float", round(value, 9))
    return value if value is None else (type(value).__name__, value)


UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "CollectLimit")


def unwanted_nodes(df) -> list[str]:
    """Plan nodes that would not survive large tables."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [node for node in UNWANTED if node in plan]


def differences(spark, sf_dir: str, name: str, con=None) -> tuple[list, list, int]:
    """(rows only Spark has, rows only SQL has, row count)."""
    con = con or connect(sf_dir)
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    if unwanted_nodes(df):
        raise AssertionError(f"{name}: {unwanted_nodes(df)}")
    mine = Counter(tuple(_plain(v) for v in row) for row in df.select(*columns).collect())
    result = con.execute(catalog.checks()[name])
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        raise AssertionError(f"{name}: columns {columns} vs {sorted(names)}")
    order = [names.index(c) for c in columns]
    theirs = Counter(tuple(_plain(row[i]) for i in order) for row in result.fetchall())
    return list((mine - theirs).items())[:3], list((theirs - mine).items())[:3], sum(mine.values())


if __name__ == "__main__":
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{scale}"
    session = local_session("8")
    db = connect(folder)
    bad = 0
    for query_name in sys.argv[2:] or catalog.queries():
        began = time.time()
        try:
            if query_name not in catalog.checks():
                print(f"ROWS {query_name} {catalog.queries()[query_name](session, folder).count()} {time.time() - began:.2f}s", flush=True)
                continue
            left, right, n = differences(session, folder, query_name, db)
            state = "ok  " if not left and not right else "DIFF"
            print(f"{state} {query_name} rows={n} {time.time() - began:.2f}s", flush=True)
            if state == "DIFF":
                bad += 1
                print("   spark:", left, "\n   sql:  ", right)
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {query_name}: {str(error)[:900]}", flush=True)
    print("bad:", bad)
