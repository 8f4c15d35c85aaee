"""Run registered queries against their DuckDB SQL: python tests/oracle.py [names..]."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def make_spark():
    from pyspark.sql import SparkSession

    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return repr(v)

    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir) -> tuple[bool, str]:
    t = time.time()
    df = query(spark, sf_dir)
    rows = df.collect()
    took = time.time() - t
    left = canonical(df.columns, [tuple(r) for r in rows])
    if sql is None:
        return True, f"{len(rows)} rows, no SQL, {took:.1f}s"
    t = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    right = canonical(names, result.fetchall())
    sql_took = time.time() - t
    if left == right:
        return True, f"{len(rows)} rows, {took:.1f}s, SQL {sql_took:.1f}s"
    if left[0] != right[0]:
        return False, f"columns {left[0]} != {right[0]}"
    a, b = set(left[1]), set(right[1])
    return False, (
        f"{len(left[1])} rows against {len(right[1])}; only Spark {len(a - b)}: {str(sorted(a - b)[:3])[:600]}; "
        f"only SQL {len(b - a)}: {str(sorted(b - a)[:3])[:600]}"
    )


def main() -> None:
    from __spark_entry__ import oracle_sql, queries

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark, con = make_spark(), connect(sf_dir)
    sqls, bad = oracle_sql(), []
    for name, query in queries().items():
        if wanted and name not in wanted and not any(name.startswith(w[:-1]) for w in wanted if w.endswith("*")):
            continue
        try:
            ok, note = compare(spark, con, name, query, sqls.get(name), sf_dir)
        except Exception as error:
            ok, note = False, "".join(traceback.format_exception(error))[-1500:]
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
