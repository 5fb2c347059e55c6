"""Fixture tables, the query registry and helpers for writing the SQL twins."""

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.tables import read_parquet

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations").split()

# Small files whose rows cost much work each.
LONG_TEXTS = {"documents", "pages"}

# Derived tables; each text is valid in Spark SQL and in DuckDB.
FIXTURES = {
    "li_gappy": """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_orderkey % 7 = 0 AND l_linenumber % 2 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
  CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_discount END AS l_discount,
  l_tax,
  CASE WHEN l_suppkey % 20 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
  l_linestatus
FROM lineitem""",
    "li_redundant": """
SELECT l_orderkey, l_linenumber, l_quantity,
  l_quantity * 2.0 + l_tax AS l_qty_x2,
  l_discount, l_tax,
  CAST(1.0 AS DOUBLE) AS c_const,
  CASE WHEN l_orderkey % 100 = 0 THEN l_quantity ELSE CAST(0.0 AS DOUBLE) END AS c_mostly_zero
FROM lineitem""",
    "orders_labeled": """
SELECT o.o_orderkey, o.o_custkey, c.c_mktsegment, c.c_nationkey, c.c_acctbal,
  o.o_orderpriority, o.o_totalprice, o.o_orderstatus,
  CASE WHEN o.o_totalprice > 250000 THEN 1 ELSE 0 END AS big_order,
  CASE WHEN o.o_totalprice > 250000 THEN CAST(10.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END
    + CAST(o.o_orderkey % 10 AS DOUBLE) * CAST(0.01 AS DOUBLE) AS leak,
  CASE WHEN o.o_totalprice > 250000 THEN 'HI' ELSE 'LO' END AS price_band
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "drift_train": """
SELECT l_quantity, l_discount, l_tax, l_linenumber, l_returnflag, l_linestatus, l_orderkey
FROM lineitem WHERE l_shipdate < timestamp '1998-07-01 00:00:00'""",
    "drift_test": """
SELECT l_quantity * 1.2 AS l_quantity,
  CASE WHEN l_orderkey % 10 < 3 THEN NULL ELSE l_discount END AS l_discount,
  l_tax, l_linenumber,
  CASE WHEN l_returnflag = 'R' AND l_orderkey % 5 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag,
  l_linestatus, l_orderkey
FROM lineitem WHERE l_shipdate >= timestamp '1998-07-01 00:00:00'""",
    "orders_daily": """
SELECT CAST(o_orderdate AS DATE) AS ds, SUM(o_totalprice) AS y
FROM orders GROUP BY CAST(o_orderdate AS DATE)""",
    "orders_monthly": """
SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
  SUM(o_totalprice) AS y
FROM orders GROUP BY o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE)""",
    "events_hourly": """
SELECT event_type AS series_id, date_trunc('hour', ts) AS ds, COUNT(*) AS n, AVG(value) AS y
FROM events GROUP BY event_type, date_trunc('hour', ts)""",
    "docs_labeled": """
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "pages_text": """
SELECT page_id, page_id % 200 AS grp, html AS text, CASE WHEN page_id % 3 = 0 THEN url ELSE NULL END AS maybe_url
FROM pages""",
    "customer_shapes": """
SELECT c_custkey, c_mktsegment, c_acctbal,
  CONCAT(CAST(c_custkey % 500 AS STRING), ' Main Street') AS c_address,
  CONCAT('(', CAST((c_custkey % 500) % 90 AS STRING), '.123456, -', CAST((c_custkey % 500) % 170 AS STRING), '.654321)') AS c_coord,
  1000 + c_custkey % 60 AS c_grp60,
  c_nationkey AS `zipcode`,
  c_custkey % 4 AS `region code`
FROM customer""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Reads base tables and fixtures of one scale-factor folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        # time columns carry no zone; one fixed zone makes date arithmetic exact
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __call__(self, name: str) -> DataFrame:
        if name in FIXTURES:
            sql = re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", FIXTURES[name])
            used = set(re.findall(r"\{(\w+)\}", sql))
            return self.spark.sql(sql, **{n: self(n) for n in used})
        return read_parquet(self.spark, f"{self.folder}/{name}.parquet", spread=name in LONG_TEXTS)


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its DuckDB twin (none for what SQL cannot say)."""
    def add(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(spark, folder))
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build
    return add


def on(*fixtures: str, more: str = "", body: str) -> str:
    """SQL text with the fixtures it reads (and further CTEs) as ``WITH`` clauses."""
    parts = [f"{f} AS ({FIXTURES[f].strip()})" for f in fixtures if f in FIXTURES]
    if more:
        parts.append(more.strip())
    return (f"WITH {', '.join(parts)}\n" if parts else "") + body.strip()


def union(template: str, columns: list[str], sep: str = "\nUNION ALL\n") -> str:
    """The template once per column; ``@c`` is the quoted column, ``@n`` its name."""
    return sep.join(template.strip().replace("@c", f'"{c}"').replace("@n", c) for c in columns)
