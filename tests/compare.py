"""Run registered queries against their SQL twins in DuckDB.

    python tests/compare.py [folder] [name-part ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"long": "BIGINT", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def rows(names: list[str], records: list[tuple]) -> list[tuple]:
    """Comparable rows: columns by name, floats to six digits."""
    order = sorted(range(len(names)), key=names.__getitem__)

    def cell(v):
        if v is None or (isinstance(v, float) and v != v):
            return "~"
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in records)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    result = con.execute(sql)
    theirs = {d[0]: str(d[1]) for d in result.description}
    expected = rows(list(theirs), result.fetchall())
    ours = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    if ours != theirs:
        diff = {k: (ours.get(k), theirs.get(k)) for k in ours.keys() | theirs.keys() if ours.get(k) != theirs.get(k)}
        return f"schema differs (ours, sql): {diff}"
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), expected
    if a == b:
        return None
    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return f"{len(a)} rows against {len(b)}; columns {sorted(ours)}; only ours {str(only_a)[:700]}; only sql {str(only_b)[:700]}"


def main(folder: str, parts: list[str]) -> int:
    import __spark_entry__ as entry
    from siftbook.session import build_session

    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    con, sql, bad = connect(folder), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in sql:
                problem = compare(df, con, sql[name])
                n = ""
            else:
                n, problem = df.count(), None
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        state = "DIFF" if problem else ("ok" if name in sql else f"rows {n}")
        print(f"{state:9s} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    sys.exit(bool(main(folder, sys.argv[2:])))
