"""Run queries beside their SQL twins: ``python -m checks.compare [name-prefix ...]``."""

import math
import os
import sys
import time
import traceback
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks.registry import BASE, ORACLES, QUERIES
from plumbline.functions.ship import ship


def session(cores: str = "8") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("plumbline")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v) if not hasattr(v, "isoformat") else v.isoformat()


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, folder: str) -> str:
    """``""`` when equal, else what differs."""
    df = QUERIES[name](spark, folder)
    got = _table(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return "" if got[1] else "no rows"
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    want = _table(columns, cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] == want[1]:
        return ""
    has, wants = Counter(got[1]), Counter(want[1])
    only_got, only_want = list((has - wants).elements())[:4], list((wants - has).elements())[:4]
    return f"{len(got[1])} rows vs {len(want[1])}; columns {got[0]}\n  spark {only_got}\n  duck  {only_want}"


def main(prefixes):
    import checks.all  # noqa: F401
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con, bad = session(), duck(folder), 0
    for name in QUERIES:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, folder)
        except Exception:
            problem = traceback.format_exc(limit=4)[-1500:]
        bad += bool(problem)
        state = "FAIL" if problem else ("ok" if name in ORACLES else "rows")
        print(f"{state:5}{name:40}{time.time() - start:7.2f}s {problem}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
