"""Writing results."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import FRACTIONAL, quoted


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers become NULL."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, FRACTIONAL):
            c = quoted(f.name)
            bad = F.isnan(c) | (F.abs(c) == float("inf"))
            out[f.name] = F.when(~bad, c)
    return df.withColumns(out) if out else df


def write_report(report: dict[str, DataFrame], folder: str, fmt: str = "json") -> None:
    """One folder per named result, as JSON lines (nulls kept) or Parquet."""
    for name, df in report.items():
        writer = finite(df).write.mode("errorifexists")
        if fmt == "json":
            writer.option("ignoreNullFields", False).json(f"{folder}/{name}")
        else:
            writer.format(fmt).save(f"{folder}/{name}")
