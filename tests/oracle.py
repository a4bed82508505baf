"""Compare registered queries with their check SQL: python -m tests.oracle [sf] [names...]"""

import math
import os
import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus=8, **conf):
    from pyspark.sql import SparkSession

    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return "null" if v is None else str(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def run_sql(path, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    cur = con.execute(sql)
    return canon(cur.fetchall(), [d[0] for d in cur.description])


def compare(spark, path, fn, sql):
    """None when equal, else a short account of the difference."""
    df = fn(spark, path)
    got, names = canon([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return None if got else "no rows"
    want, want_names = run_sql(path, sql)
    if names != want_names:
        return f"columns: only spark {set(names) - set(want_names)}, only sql {set(want_names) - set(names)}"
    if len(got) != len(want):
        return f"rows: {len(got)} vs {len(want)}"
    if got == want:
        return None
    bad = {}
    for g, w in zip(got, want):
        for n, a, b in zip(names, g, w):
            if a != b:
                bad.setdefault(n, []).append((a, b))
    return "; ".join(f"{n}: {len(v)} e.g. {v[0]}" for n, v in list(bad.items())[:6]) + f" ({len(bad)} columns)"


def main(argv):
    from bookflow.plans import registry

    sf = argv[0] if argv else "0.001"
    spark = session()
    if os.environ.get("ROWS_PER_SLICE"):
        spark.conf.set("bookflow.rowsPerSlice", os.environ["ROWS_PER_SLICE"])
    failed = []
    todo = registry.entries()
    for name in argv[1:] or todo:
        fn, sql = todo[name]
        t0 = time.time()
        try:
            diff = compare(spark, f"/root/testdata/sf{sf}", fn, sql)
        except Exception as e:
            diff = "".join(traceback.format_exception_only(e)).strip()[:1500]
        print(f"{name:36s} {time.time() - t0:6.1f}s {'ok' if diff is None else 'FAIL ' + diff}", flush=True)
        if diff:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
