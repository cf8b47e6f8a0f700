"""Compare registered queries with their SQL twins in DuckDB.

    python -m tests.compare <sf_dir> [key prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (0, "") if math.isnan(value) else (1, value + 0.0)
    if isinstance(value, bool):
        return (2, value)
    if isinstance(value, int):
        return (1, float(value)) if abs(value) < 2 ** 53 else (1, value)
    return (3, str(value))


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """None when both results hold the same rows, else a short description."""
    names, mine = _table(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    columns, theirs = _table([d[0] for d in cursor.description], cursor.fetchall())
    if names != columns:
        return f"columns {names} vs {columns}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        cell = next((n, x[1], y[1]) for n, x, y in zip(names, *bad[0]) if x != y)
        return f"{len(bad)} of {len(mine)} rows differ, first in {cell}"
    return None


def kinds(df, con, sql: str) -> list[str]:
    """Columns whose type family differs."""
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
            "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    theirs = dict((d[0], str(d[1])) for d in con.execute(sql).description)
    return [f"{n}: {t} vs {theirs.get(n)}" for n, t in df.dtypes if same.get(t) != theirs.get(n)]


def main() -> None:
    sys.path.insert(0, os.getcwd())
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf_dir, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark, con = make_session(), connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    spark.range(1).count()
    for key, build in queries.items():
        if prefixes and not key.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if key in oracle:
                found = difference(df, con, oracle[key])
                types = kinds(df, con, oracle[key])
                text = "ok" if found is None else f"DIFF {found}"
                if types:
                    text += f"  types {types}"
            else:
                found, text = None, f"rows only: {len(df.collect())}"
        except Exception as error:  # noqa: BLE001
            found, text = "error", f"FAIL {type(error).__name__} {str(error)[:300]}".replace("\n", " ")
        failed += found is not None
        print(f"{key:32s} {time.time() - start:6.2f}s {text}", flush=True)
    print(f"failed {failed}")


if __name__ == "__main__":
    main()
