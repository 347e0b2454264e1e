"""Run registered queries beside their SQL and report differences.

    python tests/compare.py FOLDER [NAME_PREFIX ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(plain(v) for v in value)
    if type(value).__name__ == "Row" or isinstance(value, dict):
        items = value.asDict() if hasattr(value, "asDict") else value
        return tuple((k, plain(v)) for k, v in sorted(items.items()))
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, name, fn, sql):
    """Empty text if equal, else what differs."""
    df = fn(spark, folder)
    left_columns = df.columns
    left = rows_of(left_columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows only: {len(left)}"
    result = con.execute(sql)
    right_columns = [d[0] for d in result.description]
    right = rows_of(right_columns, result.fetchall())
    if sorted(left_columns) != sorted(right_columns):
        return f"DIFF columns {sorted(left_columns)} / {sorted(right_columns)}"
    if len(left) != len(right):
        return f"DIFF rows {len(left)} / {len(right)}"
    bad = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    if bad:
        return f"DIFF values in {len(bad)} of {len(left)} {sorted(left_columns)}\n   {bad[0][0]}\n   {bad[0][1]}"
    for a, b in zip(left[0] if left else (), right[0] if right else (), strict=True):
        if a is not None and b is not None and type(a) is not type(b):
            return f"DIFF types {left[0]} / {right[0]}"
    return "" if left else "EMPTY (equal)"


def main() -> int:
    from tickloom.catalog import load
    from tickloom.session import build_session

    folder, prefixes = sys.argv[1], tuple(sys.argv[2:])
    queries, oracles = load()
    spark = build_session(
        "compare", "local[8]", **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
        }
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    failed = 0
    for name, fn in queries.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            message = compare(spark, con, folder, name, fn, oracles.get(name))
        except Exception as error:
            message = "DIFF " + "".join(traceback.format_exception_only(error))[:1500]
        failed += message.startswith("DIFF")
        print(f"{name:45s} {time.time() - start:6.2f}s {message or 'ok'}", flush=True)
    print(f"{failed} differ")
    return failed


if __name__ == "__main__":
    sys.exit(main())
