"""Run registered queries in Spark and their SQL in DuckDB, and compare the results.

    python tools/check.py [--sf DIR] [--module NAME] [query ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from fieldgrain.plans import load_queries  # noqa: E402
from fieldgrain.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        out = []
        for v in row:
            if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
                out.append("~")
            elif isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
                out.append(str(bool(v)))
            elif isinstance(v, (int, float)) or hasattr(v, "dtype"):
                out.append(repr(float(v) + 0.0))
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return sorted(rows)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns differ: {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = canonical(got), canonical(want)
    if a == b:
        return ""
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    names = sorted(got.columns)
    x, y = bad[0]
    fields = [(n, p, q) for n, p, q in zip(names, x, y) if p != q]
    return f"{len(bad)} rows differ, e.g. {fields[:4]} in {x[:6]}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--module", default=None)
    parser.add_argument("--no-oracle", action="store_true")
    args = parser.parse_args()
    spark = build_session(
        "check",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    failed = []
    for name, q in load_queries().items():
        if args.names and name not in args.names:
            continue
        if args.module and not q.build.__module__.endswith("." + args.module):
            continue
        start = time.time()
        try:
            got = q.build(spark, args.sf).toPandas()
            took = time.time() - start
            note = "no-sql"
            if q.sql and not args.no_oracle:
                start = time.time()
                want = con.execute(q.sql).fetchdf()
                note = compare(got, want)
                note = f"FAIL {note}" if note else f"ok (sql {time.time() - start:.1f}s)"
        except Exception as error:  # report and go on
            took = time.time() - start
            text = str(error)
            note = "FAIL " + type(error).__name__ + ": " + text[:1500]
            if os.environ.get("TRACE"):
                traceback.print_exc()
            got = []
        if note.startswith("FAIL"):
            failed.append(name)
        print(f"{name:32s} rows={len(got):7d} {took:6.2f}s {note}", flush=True)
    print("failed:", failed)
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
