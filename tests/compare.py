"""Run registered queries and compare them with their DuckDB oracles: python tests/compare.py [folder] [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(folder: str):
    import duckdb
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + "/*.parquet" if os.path.isdir(path) else path}')")
    return connection


def _cell(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return "nan" if math.isnan(number) else repr(number) if number else "0"
    return str(value)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows), sorted(columns)


def difference(frame, connection, sql) -> str | None:
    """None when equal, else a short description."""
    left, left_columns = table([tuple(r) for r in frame.collect()], frame.columns)
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    right, right_columns = table(result.fetchall(), names)
    if left_columns != right_columns:
        return f"columns {left_columns} / {right_columns}"
    if left == right:
        return None
    only_left, only_right = [x for x in left if x not in set(right)], [x for x in right if x not in set(left)]
    return (f"rows {len(left)} / {len(right)}, differ {len(only_left)} / {len(only_right)}\n   {left_columns}\n"
            f"   spark {only_left[:3]}\n   duck  {only_right[:3]}")


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from churnlake.session import build_session
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(folder)
    oracles, bad = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        begin = time.perf_counter()
        try:
            frame = run(spark, folder)
            if name in oracles:
                problem = difference(frame, connection, oracles[name])
                state = "ok" if problem is None else f"DIFFERENT {problem}"
            else:
                problem, state = None, f"rows {len(frame.collect())}"
        except Exception as error:      # report and go on
            problem = state = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{name:34s} {time.perf_counter() - begin:6.1f}s  {state}", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    arguments = sys.argv[1:]
    chosen = arguments[0] if arguments else "/root/testdata/sf0.01"
    sys.exit(1 if main(chosen, arguments[1:]) else 0)
