"""Reading tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import quoted


# What common writers of CSV put for an absent value.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
               "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# the first type that every value of a column can be read as
CSV_TYPES = ["int", "bigint", "double", "boolean", "date", "timestamp_ntz"]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             encoding: str = "auto", limit: int | None = None, null_tokens: list[str] = NULL_TOKENS,
             multiline: bool | None = None, **options) -> DataFrame:
    """A CSV file or folder with a header, all rows.

    Values equal to one of ``null_tokens`` are null; quotes inside quoted values
    are doubled.  ``auto`` reads UTF-8 and falls back to Latin-1 when the bytes
    are not valid UTF-8; ``multiline`` None looks for line breaks inside quotes.
    Either costs the same one pass over the lines; a file with such breaks is
    read by one task, others are split.  Without a schema one more pass finds,
    for all columns at once, the narrowest type that holds every value.
    """
    if encoding == "auto" or multiline is None:
        odd = (F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1
        seen = spark.read.text(path).agg(F.bool_or(~F.is_valid_utf8("value")).alias("broken"), F.bool_or(odd).alias("open")).first()
        encoding = ("ISO-8859-1" if seen["broken"] else "UTF-8") if encoding == "auto" else encoding
        multiline = bool(seen["open"]) if multiline is None else multiline
    reader = spark.read.options(**{"header": True, "encoding": encoding, "escape": '"', "multiLine": multiline, **options})
    text = reader.csv(path)
    cells = {c: F.when(~quoted(c).isin(null_tokens), quoted(c)) for c in text.columns}
    if schema is not None:
        fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        df = text.select(*[cells[c].cast(f.dataType).alias(f.name) for c, f in zip(text.columns, fields.fields, strict=True)])
    else:
        df = text.select(*[cells[c].alias(c) for c in text.columns])
        fits = [F.struct(*[F.every(quoted(c).isNull() | _reads_as(quoted(c), kind)).alias(kind) for kind in CSV_TYPES],
                         F.count(quoted(c)).alias("n")).alias(c) for c in df.columns]
        found = df.agg(*fits).first()
        chosen = {c: next((k for k in CSV_TYPES if found[c]["n"] and found[c][k]), "string") for c in df.columns}
        df = df.select(*[quoted(c).cast(k).alias(c) for c, k in chosen.items()])
    return df if limit is None else df.limit(limit)


def _reads_as(c: Column, kind: str) -> Column:
    if kind == "boolean":
        return F.lower(c).isin("true", "false")
    if kind == "date":
        return c.rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast("date").isNotNull()
    if kind == "timestamp_ntz":
        return c.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$") & c.try_cast("timestamp_ntz").isNotNull()
    if kind == "double":
        return c.rlike(r"^\s*[+-]?(\d|\.\d|[iI]nf)") & c.try_cast("double").isNotNull()
    return c.rlike(r"^\s*[+-]?\d+\s*$") & c.try_cast(kind).isNotNull()


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None,
                 spread: bool = False) -> DataFrame:
    """A Parquet file or folder; only the named columns are read.

    ``spread`` deals the rows of a table with fewer splits than there are cores
    (one small file, one row group) out to all of them.  A table with enough
    splits is left alone.
    """
    df = spark.read.parquet(path)
    df = df if columns is None else df.select(*columns)
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


def validate_input(df: DataFrame, mode: str = "unlabeled", target: str | None = None) -> None:
    """Reject an unknown mode, a missing target and an empty table."""
    if mode not in ("unlabeled", "labeled"):
        raise ValueError("mode must be 'unlabeled' or 'labeled'")
    if mode == "labeled" and not target:
        raise ValueError("a labeled table needs a target column")
    if target is not None and target not in df.columns:
        raise ValueError(f"no column {target!r} in the table")
    if df.isEmpty():
        raise ValueError("the table has no rows")
