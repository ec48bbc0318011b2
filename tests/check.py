"""Compare registered queries with their DuckDB texts: python tests/check.py [-s SF_DIR] [name or prefix* ...]"""

from __future__ import annotations

import fnmatch
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 1e15 else float(f"{v:.12g}")
    if hasattr(v, "isoformat"):
        return str(v)
    if type(v).__name__ == "Decimal":
        return cell(float(v))
    return v


def compare(df, con, sql):
    """Empty string if equal, else what differs."""
    cols = sorted(df.columns)
    got = sorted(([cell(r[c]) for c in cols] for r in df.collect()), key=repr)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    at = [names.index(c) for c in cols]
    exp = sorted(([cell(r[i]) for i in at] for r in cur.fetchall()), key=repr)
    if len(got) != len(exp):
        return f"rows {len(got)} != {len(exp)}"
    for g, e in zip(got, exp):
        if g != e:
            return f"\n   spark {dict(zip(cols, g))}\n   duck  {dict(zip(cols, e))}"
    kinds = {d[0]: str(d[1]) for d in cur.description}
    for c in cols:
        s, d = dict(df.dtypes)[c], kinds[c]
        if (s in ("int", "bigint", "smallint")) != (d in ("BIGINT", "INTEGER", "SMALLINT", "NUMBER") or "INT" in d) or "DECIMAL" in d or d == "HUGEINT":
            return f"types differ in {c}: {s} / {d}"
    return "" if got else "EMPTY"


def main(argv):
    folder = "/root/testdata/sf0.01"
    if argv[:1] == ["-s"]:
        folder, argv = argv[1], argv[2:]
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(fnmatch.fnmatch(n, a) for a in argv)]
    spark, con = session(), connect(folder)
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = queries[n](spark, folder)
            if n in oracles:
                diff = compare(df, con, oracles[n])
            else:
                diff = "" if df.count() else "EMPTY"
        except Exception as e:  # report and go on
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {time.time() - t:6.2f}s {n}{'' if n in oracles else ' (rows)'} {diff}", flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
