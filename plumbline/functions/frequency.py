"""Value frequencies and distinct counts of many columns in one shuffle."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import aggregate_long, as_double, as_text, kinds, quoted, unfold


def digest(*cols: Column) -> Column:
    """A 128-bit key of the given values; the null positions are part of the key."""
    nulls = F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    return F.struct(F.xxhash64(F.lit(1), nulls, *cols).alias("h1"),
                    F.xxhash64(F.lit(2), nulls, *cols).alias("h2"))


def _is_wide(kind: T.DataType) -> bool:
    """Whether a value can take more than 8 bytes."""
    return isinstance(kind, T.DecimalType) and kind.precision > 18 or isinstance(kind, (T.BinaryType, T.StringType))


def _keys(df: DataFrame, names: list[str]) -> DataFrame:
    """``i, h1, h2``: the column's index and the value's key, one row per cell.

    The 64-bit hash of one 8-byte value is a bijection, so numbers and times
    keep an exact key; text and wider values shrink to 128 bits before the shuffle.
    """
    kind = kinds(df)
    rows = []
    for i, name in enumerate(names):
        c = quoted(name)
        if kind[name] == "string" or _is_wide(df.schema[name].dataType):
            h1, h2 = F.xxhash64(F.lit(1), c), F.xxhash64(F.lit(2), c)
        else:
            h1, h2 = F.xxhash64(c), F.lit(0).cast("bigint")
        rows.append([F.lit(i), F.when(c.isNotNull(), h1), h2])
    return unfold(df, rows, ["i", "h1", "h2"]).filter("h1 is not null")


def distinct_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """``(column, n_distinct, top_n, n_present)``, exact: distinct non-null values, the count of
    the commonest one, and all non-null values.

    One pass and one shuffle for all columns; repeated values are combined
    before the shuffle, so a value on a third of all rows costs one row per task.
    """
    if not names:
        return df.sparkSession.createDataFrame([], "column string, n_distinct bigint, top_n bigint, n_present bigint")
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1)
    return (_keys(df, names)
            .groupBy("i", "h1", "h2").agg(F.count("*").alias("n"))
            .groupBy("i").agg(F.count("*").alias("n_distinct"), F.max("n").alias("top_n"),
                              F.sum("n").alias("n_present"))
            .select(label.alias("column"), "n_distinct", "top_n", "n_present"))


def approx_distinct_counts(df: DataFrame, names: list[str], rsd: float = 0.01) -> DataFrame:
    """Sketch version of ``distinct_counts`` without a shuffle of values (no ``top_n``)."""
    per = {n: {"n_distinct": F.approx_count_distinct(quoted(n), rsd), "n_present": F.count(quoted(n))}
           for n in names}
    return aggregate_long(df, per).withColumn("top_n", F.lit(None).cast("bigint"))


def text_counts(df: DataFrame, names: list[str], null_as: str | None = None) -> DataFrame:
    """``(column, value, n)`` of the named columns as text; nulls dropped or replaced."""
    rows = []
    for name in names:
        c = as_text(df, name)
        rows.append([F.lit(name), F.coalesce(c, F.lit(null_as)) if null_as else c])
    return (unfold(df, rows, ["column", "value"]).filter("value is not null")
            .groupBy("column", "value").agg(F.count("*").alias("n")))


def number_counts(df: DataFrame, names: list[str], by: list[str] = ()) -> DataFrame:
    """``(by..., column, value, n)`` of the named columns as doubles, nulls dropped."""
    rows = [[F.lit(n), as_double(n)] for n in names]
    return (unfold(df, rows, ["column", "value"], [quoted(c) for c in by]).filter("value is not null")
            .groupBy(*by, "column", "value").agg(F.count("*").alias("n")))
