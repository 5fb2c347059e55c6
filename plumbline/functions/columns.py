"""Column kinds, null normalisation and small expression builders."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.words import SPACE

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType, T.BooleanType)
DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)
FRACTIONAL = (T.FloatType, T.DoubleType)

# Spark drops generated code for a stage with more than 100 fields; one wide
# aggregate keeps its buffers below that and further columns go to further ones.
BUFFERS_PER_AGGREGATE = 90
ROWS_PER_STACK = 60


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(data_type: T.DataType) -> str:
    """``numeric``, ``datetime``, ``string`` or ``unsupported``."""
    if isinstance(data_type, NUMERIC):
        return "numeric"
    if isinstance(data_type, DATETIME):
        return "datetime"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    return "unsupported"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def numeric_names(df: DataFrame) -> list[str]:
    return [c for c, k in kinds(df).items() if k == "numeric"]


def normalise(df: DataFrame) -> DataFrame:
    """Booleans become integers and NaN becomes NULL; other columns pass untouched."""
    out = []
    for field in df.schema.fields:
        c = quoted(field.name)
        if isinstance(field.dataType, T.BooleanType):
            c = c.cast("int").alias(field.name)
        elif isinstance(field.dataType, FRACTIONAL):
            c = F.nanvl(c, F.lit(None).cast(field.dataType)).alias(field.name)
        out.append(c)
    return df.select(*out)


def as_double(name: str) -> Column:
    return quoted(name).cast("double")


def as_text(df: DataFrame, name: str) -> Column:
    """The value as text; a time stamp at midnight is written as a bare date."""
    c = quoted(name).cast("string")
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType)):
        c = F.regexp_replace(c, " 00:00:00$", "")
    return c


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(rf"[^{SPACE}]+"))


def in_groups(names: Iterable[str], size: int) -> list[list[str]]:
    names = list(names)
    return [names[i:i + size] for i in range(0, len(names), size)]


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def unfold(df: DataFrame, rows: list[list[Column]], names: list[str],
           keep: list[Column] = ()) -> DataFrame:
    """Several rows for each row of ``df``: one per entry of ``rows``, with the given names.

    ``stack`` runs in generated code without building arrays of structs; very
    wide tables are unfolded in slices so that the code stays small.
    """
    def part(some):
        cells = [c for row in some for c in row]
        return df.select(*keep, F.stack(F.lit(len(some)), *cells).alias(*names))

    return union_all([part(rows[i:i + ROWS_PER_STACK]) for i in range(0, len(rows), ROWS_PER_STACK)])


def aggregate_long(df: DataFrame, per_column: dict[str, dict[str, Column]],
                   key: str = "column", buffers: int | None = None) -> DataFrame:
    """Wide aggregates over the table, turned into one row per key.

    ``per_column`` maps a key to its named aggregates; all keys give the same
    names.  ``buffers`` is the number of buffer fields they need per key (two
    each unless told).  The one-row wide result is unfolded with ``inline``, so
    no row multiplication happens before the aggregation.
    """
    frames = []
    width = buffers or 2 * max(len(v) for v in per_column.values())
    for group in in_groups(per_column, max(1, BUFFERS_PER_AGGREGATE // width)):
        aggs, structs = [], []
        for i, name in enumerate(group):
            fields = [F.lit(name).alias(key)]
            for j, (label, expr) in enumerate(per_column[name].items()):
                slot = f"_{i}_{j}"
                aggs.append(expr.alias(slot))
                fields.append(F.col(slot).alias(label))
            structs.append(F.struct(*fields))
        frames.append(df.agg(*aggs).select(F.inline(F.array(*structs))))
    return union_all(frames)


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    """Round the named columns; a negative zero becomes a plain one."""
    return df.withColumns({n: F.round(quoted(n), digits) + F.lit(0.0) for n in names})
