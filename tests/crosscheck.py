"""Run registered queries on Spark and their SQL on DuckDB, and compare all rows.

python tests/crosscheck.py [sf] [name ...]
"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
ROOT = os.environ.get("MEMSPARK_TESTDATA", "/root/testdata")


def sql_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], [str(d[1]) for d in cur.description], cur.fetchall()


def canonical(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def cell(x):
        if isinstance(x, float) and math.isnan(x):
            return "nan"
        return repr(x) if not isinstance(x, bool) else str(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, name, sf_dir):
    from memspark import catalog

    t0 = time.time()
    df = catalog.QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if name not in catalog.SQL:
        return len(rows), t1 - t0, 0.0, []
    cols, types, expected = sql_rows(catalog.SQL[name], sf_dir)
    t2 = time.time()
    problems = []
    if sorted(cols) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(cols)}")
    else:
        got, want = canonical(df.columns, rows), canonical(cols, expected)
        if len(got) != len(want):
            problems.append(f"rows {len(got)} != {len(want)}")
        if got != want:
            a, b = sorted(set(got) - set(want)), sorted(set(want) - set(got))
            problems.append(f"{len(a)} only in Spark {a[:2]}; {len(b)} only in SQL {b[:2]}")
        problems += [f"{c}: {k}" for c, k in zip(cols, types) if "HUGEINT" in k or "DECIMAL" in k]
    return len(rows), t1 - t0, t2 - t1, problems


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master(f"local[{cpus}]").appName("memspark-check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


if __name__ == "__main__":
    from memspark import catalog

    sf, names = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), sys.argv[2:]
    names = [n for n in catalog.QUERIES if not names or any(n.startswith(p) for p in names)]
    spark, bad = session(), 0
    for n in names:
        try:
            rows, a, b, problems = compare(spark, n, f"{ROOT}/sf{sf}")
        except Exception as err:  # report and go on
            rows, a, b, problems = -1, 0, 0, [f"{type(err).__name__}: {str(err)[:1500]}"]
        bad += bool(problems)
        state = "BAD " if problems else ("rows" if n not in catalog.SQL else "ok  ")
        print(f"{state} {n:34s} rows={rows:<8d} spark={a:6.2f}s sql={b:6.2f}s", *problems, sep="\n       " if problems else " ", flush=True)
    print("bad:", bad)
    sys.exit(bool(bad))
