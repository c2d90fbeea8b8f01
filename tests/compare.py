"""Compare registered queries with their SQL on the shared tables."""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wattline-check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
        return int(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, folder, fn, sql):
    """None when equal, else a short text that says what differs."""
    df = fn(spark, folder)
    got = df.collect()
    cols, mine = rows_of(df.columns, got)
    if sql is None:
        return None if mine else "no rows"
    cur = con.execute(sql)
    ocols, theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != ocols:
        return f"columns {cols} against {ocols}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    for a, z in zip(mine, theirs, strict=True):
        if a != z:
            return f"row {a} against {z}"
    if not mine:
        return "both empty"
    return None


def main(folder: str, wanted: list[str]) -> int:
    from wattline.catalog import load

    queries, sqls = load()
    spark, con, bad = session(), connect(folder), 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, folder, fn, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - start:6.2f}s {'sql' if name in sqls else '   '} {name} {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    main(sys.argv[1], [a for a in sys.argv[2:] if not a.startswith("-")])
