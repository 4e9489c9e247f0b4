"""Run registered queries next to their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.6f}"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(row[i]) for i in order) for row in rows)


KINDS = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
         "TIMESTAMP": "timestamp"}


def type_differences(df, con, sql):
    """Columns whose types differ between the two results."""
    kinds = {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    mine = dict(df.dtypes)
    return [f"{n}: {mine[n]} / {kinds[n]}" for n in mine if n in kinds and KINDS.get(kinds[n], kinds[n]) != mine[n]]


def compare(spark, con, sf, fn, sql):
    df = fn(spark, sf)
    columns, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    wanted_columns, wanted = _rows(names, cursor.fetchall())
    if columns != wanted_columns:
        return f"columns {columns} != {wanted_columns}", len(got)
    if got != wanted:
        extra = [r for r in got if r not in set(wanted)][:3]
        lacking = [r for r in wanted if r not in set(got)][:3]
        return f"{len(got)} rows vs {len(wanted)}; only here {extra}; only there {lacking}", len(got)
    return None, len(got)


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from postmill.session import build_session

    types_only = argv[0] == "--types"
    argv = argv[types_only:]
    sf = argv[0]
    spark = build_session("compare", 8, spark__sql__shuffle__partitions="8",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = argv[1:] or list(queries)
    bad = 0
    for name in [q for q in queries if any(q == w or (w.endswith("*") and q.startswith(w[:-1])) for w in wanted)]:
        began = time.time()
        if types_only:
            if name in oracles:
                found = type_differences(queries[name](spark, sf), con, oracles[name])
                if found:
                    print("TYPES", name, found, flush=True)
            continue
        try:
            if name in oracles:
                problem, n = compare(spark, con, sf, queries[name], oracles[name])
            else:
                problem, n = None, len(queries[name](spark, sf).collect())
        except Exception as exc:  # noqa: BLE001
            problem, n = f"{type(exc).__name__}: {str(exc)[:1500]}", -1
        bad += problem is not None
        kind = "" if name in oracles else " (rows only)"
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={n} {time.time() - began:.1f}s{kind} {problem or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
