"""Helpers shared by the operators of this subpackage."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# the ASCII white space at which bytes.split() cuts
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared scratch folder and read back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The intermediate tables of one call, under one folder of the shared scratch space.

    ``keep`` writes a table and reads it back, ``drop`` deletes tables that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, scratch_path(spark, name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """As ``keep``, in buckets of ``key``: tables of one bucket count join on it without a shuffle."""
        table = f"scratch_{uuid.uuid4().hex}"
        (df.write.bucketBy(buckets, key).sortBy(key).option("path", f"{self.path}/{name}")
         .saveAsTable(table, format="parquet"))
        kept = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")  # the files stay; the frame knows their place and buckets
        return kept

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def prefix_for(df: DataFrame) -> str:
    """A prefix that no column of ``df`` begins with, in either case."""
    prefix = "_q"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_array(text: Column) -> Column:
    """The words of a text; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)``: the smallest node reachable, for every node of an edge.

    ``edges`` has two columns of one type.  Large-star and small-star steps
    alternate; both are a grouped minimum joined back, so a node with very many
    neighbours is pre-aggregated on the map side and its join is split by
    adaptive execution.  Edges never reach the driver; it sees a count and a
    checksum per round.
    """
    a, b = edges.columns
    pairs = stored(edges.where(F.col(a) != F.col(b))
                   .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    mark = None
    while True:
        both = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionAll(
            pairs.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
        low = both.groupBy("node").agg(F.min("other").alias("low")).select(
            F.col("node"), F.least("node", "low").alias("low"))
        large = both.join(low, "node").where("other > node").select(
            F.col("other").alias("hi"), F.col("low").alias("lo"))
        low = large.groupBy("hi").agg(F.min("lo").alias("low"))
        small = large.join(low, "hi").where("lo != low").select(
            F.col("lo").alias("hi"), F.col("low").alias("lo")).unionAll(
                low.select("hi", F.col("low").alias("lo"))).distinct()
        pairs = stored(small, "stars")
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == mark:
            break
        mark = now
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(
        pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct()
