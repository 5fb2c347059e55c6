"""Column facts, column roles and the table profile shared by the other operators."""

import math
import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import STANDARD, Thresholds
from plumbline.functions.columns import (aggregate_long, as_double, as_text, kinds, normalise,
                                         word_count)
from plumbline.functions.frequency import approx_distinct_counts, distinct_counts
from plumbline.functions.quantiles import exact_quantiles

# Patterns and name parts that decide column roles.
ADDRESS = r"^\d+\s+\w+"
COORDINATE = r"^\s*\(?\s*-?\d+\.\d+\s*,\s*-?\d+\.\d+"
ID_SEGMENTS = {"id", "key", "code", "num", "no", "number", "postal", "permit", "fips", "idx",
               "seq", "ref", "oid"}
ID_NAMES = {"uuid", "guid", "zipcode", "postcode", "fips", "oid", "uid", "nid", "pid", "rid",
            "sid", "cid"}
ID_SUFFIXES = ("_id", "_Id", "_ID", "_idx", "_Idx", "_cd", "_Cd")

# Whole numbers whose 5 % quantile of non-zero values is above this are codes.
CODES_ABOVE, CODES_AT = 100, 0.05

IDENTIFIER, ENTITY_KEY, NUMERIC, CATEGORICAL, FREE_TEXT, TARGET, UNSUPPORTED = (
    "identifier", "entity_key", "numeric", "categorical", "free_text", "target", "unsupported")


def named_like_identifier(name: str) -> bool:
    low = name.lower().strip()
    return bool(set(re.split(r"[-_ ]", low)) & ID_SEGMENTS or low in ID_NAMES
                or name.endswith(ID_SUFFIXES) or re.search(r"(^|[-_ ])id$", low))


def moments(df: DataFrame, names: list[str]) -> DataFrame:
    """One pass: ``column, n_rows, n, mean, std, min, max, skew_pop, kurt_pop, n_zero, integral, n_low``."""
    per = {}
    for c in names:
        x = as_double(c)
        per[c] = {
            "n_rows": F.count("*"), "n": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x),
            "min": F.min(x), "max": F.max(x), "skew_pop": F.skewness(x),
            "kurt_pop": F.kurtosis(x), "n_zero": F.count_if(x == 0),
            "integral": F.count_if(x != F.rint(x)) == 0,
            "n_low": F.count_if((x != 0) & (x <= CODES_ABOVE)),
        }
    return aggregate_long(df, per, buffers=21)


def corrected_skewness(skew: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population value."""
    n = n.cast("double")
    return F.when(n > 2, F.try_divide(skew * F.sqrt(n * (n - 1)), n - 2))


def corrected_kurtosis(kurt: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from the population excess value."""
    n = n.cast("double")
    return F.when(n > 3, F.try_divide((n - 1) * ((n + 1) * kurt + 6), (n - 2) * (n - 3)))


def text_shape(df: DataFrame, names: list[str]) -> DataFrame:
    """One pass: ``column, n_rows, n, words, length, words_std, address, coordinate``."""
    per = {}
    for c in names:
        s = as_text(df, c)
        words = word_count(s)
        per[c] = {
            "n_rows": F.count("*"), "n": F.count(s), "words": F.avg(words),
            "length": F.avg(F.length(s)), "words_std": F.stddev_samp(words),
            "address": F.avg(s.rlike(ADDRESS).cast("int")),
            "coordinate": F.avg(s.rlike(COORDINATE).cast("int")),
        }
    return aggregate_long(df, per, buffers=14)


@dataclass
class ColumnFacts:
    """What the passes over the table found out about one column."""

    name: str
    kind: str
    n_rows: int = 0
    n: int = 0
    n_distinct: int = 0
    top_n: int = 0
    mean: float | None = None
    std: float | None = None
    min: float | None = None
    max: float | None = None
    skewness: float | None = None
    kurtosis: float | None = None
    n_zero: int = 0
    integral: bool = False
    n_low: int | None = None        # non-zero values up to CODES_ABOVE
    p5_nonzero: float | None = None     # where the counts do not settle whether it is above CODES_ABOVE
    words: float | None = None
    length: float | None = None
    words_std: float | None = None
    address: float | None = None
    coordinate: float | None = None

    @property
    def ratio(self) -> float:
        return self.n_distinct / self.n_rows if self.n_rows else 0.0

    @property
    def may_be_codes(self) -> bool:
        return self.kind == "numeric" and self.integral and self.n_distinct > 50 and self.ratio <= 0.5

    @property
    def high(self) -> bool | None:
        """Whether the 5 % quantile of the non-zero values is above ``CODES_ABOVE``; None when counts do not tell.

        It lies between the values of the two ranks around it, so it is above when
        the lower one is and not above when the upper one is not.
        """
        if self.p5_nonzero is not None:
            return self.p5_nonzero > CODES_ABOVE
        if self.n_low is None:
            return None
        n = self.n - self.n_zero
        if not n:
            return False
        rank = (n - 1) * CODES_AT
        return True if self.n_low <= math.floor(rank) else False if self.n_low > math.ceil(rank) else None

    @property
    def null_share(self) -> float:
        return 1 - self.n / self.n_rows if self.n_rows else 0.0


@dataclass
class Profile:
    """Facts and roles of every column of one table; each pass runs once, on first use.

    Only O(columns) numbers come to the driver.  ``df`` is the null-normalised
    table all other operators read.
    """

    source: DataFrame
    target: str | None = None
    config: Thresholds = STANDARD
    numeric_measures: bool = False
    approximate_distinct: bool = False
    df: DataFrame = field(init=False)

    def __post_init__(self):
        if self.target is not None and self.target not in self.source.columns:
            raise ValueError(f"no column {self.target!r} in the table")
        self.df = normalise(self.source)

    @property
    def spark(self):
        return self.source.sparkSession

    @cached_property
    def kinds(self) -> dict[str, str]:
        return kinds(self.df)

    @cached_property
    def facts(self) -> dict[str, ColumnFacts]:
        out = {c: ColumnFacts(c, k) for c, k in self.kinds.items()}
        usable = [c for c, k in self.kinds.items() if k != "unsupported"]
        numbers = [c for c in usable if self.kinds[c] == "numeric"]
        texts = [c for c in usable if self.kinds[c] != "numeric"]
        for r in moments(self.df, numbers).collect() if numbers else []:
            f = out[r["column"]]
            f.n_rows, f.n, f.n_zero = r["n_rows"], r["n"], r["n_zero"]
            f.mean, f.std, f.min, f.max = r["mean"], r["std"], r["min"], r["max"]
            f.integral, f.n_low = r["integral"], r["n_low"]
            if f.n > 2 and r["skew_pop"] is not None:
                f.skewness = r["skew_pop"] * (f.n * (f.n - 1)) ** 0.5 / (f.n - 2)
            if f.n > 3 and r["kurt_pop"] is not None:
                f.kurtosis = ((f.n - 1) * ((f.n + 1) * r["kurt_pop"] + 6)
                              / ((f.n - 2) * (f.n - 3)))
        counter = approx_distinct_counts if self.approximate_distinct else distinct_counts
        for r in counter(self.df, usable).collect():
            f = out[r["column"]]
            f.n_distinct, f.top_n = r["n_distinct"], r["top_n"]
            if f.kind != "numeric":
                f.n = r["n_present"]
        n_rows = out[numbers[0]].n_rows if numbers else self.df.count() if texts else 0
        for c in texts:
            out[c].n_rows = n_rows
        # only these can be anything but categories or identifiers
        shaped = [c for c in texts if 0.02 < out[c].ratio < 0.95]
        for r in text_shape(self.df, shaped).collect() if shaped else []:
            for k in ("words", "length", "words_std", "address", "coordinate"):
                setattr(out[r["column"]], k, r[k])
        self._add_quantiles([f for f in out.values() if f.may_be_codes and f.high is None])
        return out

    def _add_quantiles(self, facts: list[ColumnFacts]) -> None:
        p5 = exact_quantiles(
            self.df, {f.name: F.when(as_double(f.name) != 0, as_double(f.name)) for f in facts},
            [CODES_AT], n_rows=max((f.n_rows for f in facts), default=0))
        for f in facts:
            f.p5_nonzero = p5[f.name][0]

    @property
    def n_rows(self) -> int:
        return max((f.n_rows for f in self.facts.values()), default=0)

    @cached_property
    def roles(self) -> dict[str, tuple[str, str]]:
        """Column -> (view, id of the deciding rule)."""
        return {c: (TARGET, "target") if c == self.target else self._role(f)
                for c, f in self.facts.items()}

    def _role(self, f: ColumnFacts) -> tuple[str, str]:
        if f.kind == "unsupported":
            return UNSUPPORTED, "type"
        view, rule = self._role_by_values(f)
        if view == FREE_TEXT and (f.coordinate or 0) > 0.7:
            return IDENTIFIER, "B10"
        if view in (NUMERIC, CATEGORICAL) and named_like_identifier(f.name):
            return IDENTIFIER, "B11"
        return view, rule

    def _role_by_values(self, f: ColumnFacts) -> tuple[str, str]:
        number = f.kind == "numeric"
        measure = self.numeric_measures and number and not f.integral
        if f.ratio >= 0.96 and not measure:
            return IDENTIFIER, "B4"
        if number:
            if f.integral and f.ratio > 0.5:
                return ENTITY_KEY, "B5"
            if f.integral and f.n_distinct > 50 and f.high:
                return CATEGORICAL, "B6"
            if f.integral and f.n_distinct <= 30:
                small = f.n == 0 or (f.min >= 0 and f.max <= 10)
                return (NUMERIC if small else CATEGORICAL), "B9"
            return NUMERIC, "default"
        if not 0.02 < f.ratio < 0.95:
            return CATEGORICAL, "default"
        if f.address > 0.7:
            return ENTITY_KEY, "B7"
        long_text = f.words > 3 or f.length > 20 or (f.length > 15 and f.ratio > 0.7)
        steady = (f.ratio > 0.8 and f.words < 8 and f.length < 50
                  and f.words_std is not None and f.words_std < 3)
        return (FREE_TEXT if long_text and not steady else ENTITY_KEY), "B8"

    def view(self, *names: str) -> list[str]:
        """Columns of the given views; within one view in table order."""
        return [c for v in names for c, (role, _) in self.roles.items() if role == v]

    @property
    def numeric(self) -> list[str]:
        return self.view(NUMERIC)

    @property
    def categorical(self) -> list[str]:
        return self.view(CATEGORICAL)

    @property
    def features(self) -> list[str]:
        return self.view(NUMERIC, CATEGORICAL)

    @property
    def means(self) -> dict[str, float | None]:
        return {c: f.mean for c, f in self.facts.items()}

    def table(self, rows: list[tuple], schema: str) -> DataFrame:
        """A result of O(columns) rows."""
        return self.spark.createDataFrame(rows, schema)


def basic_info(df: DataFrame) -> DataFrame:
    """``column, n_rows, n_distinct`` for every supported column."""
    df = normalise(df)
    names = [c for c, k in kinds(df).items() if k != "unsupported"]
    rows = aggregate_long(df, {c: {"n_rows": F.count("*")} for c in names})
    return (rows.join(F.broadcast(distinct_counts(df, names)), "column", "left")
            .select("column", "n_rows",
                    F.coalesce("n_distinct", F.lit(0).cast("bigint")).alias("n_distinct")))


def uniqueness_ratio(df: DataFrame) -> DataFrame:
    """``column, ratio``: distinct non-null values over all rows."""
    return basic_info(df).select("column", F.try_divide("n_distinct", "n_rows").alias("ratio"))


def integer_valued(df: DataFrame) -> DataFrame:
    """``column, integer_valued`` for numeric columns."""
    df = normalise(df)
    names = [c for c, k in kinds(df).items() if k == "numeric"]
    per = {c: {"integer_valued": F.count_if(as_double(c) != F.rint(as_double(c))) == 0} for c in names}
    return aggregate_long(df, per)


def string_shape(df: DataFrame) -> DataFrame:
    """Shape facts of non-numeric columns (share of address- and coordinate-like values, words)."""
    df = normalise(df)
    names = [c for c, k in kinds(df).items() if k in ("string", "datetime")]
    return text_shape(df, names).drop("n_rows")


def column_views(profile: Profile) -> DataFrame:
    """``column, view, rule`` for every column."""
    return profile.table([(c, v, r) for c, (v, r) in profile.roles.items()],
                         "column string, view string, rule string")


def columns_by_rule(profile: Profile, rule: str) -> DataFrame:
    """The columns one role rule decided, with the facts the rule looked at."""
    shown = [profile.facts[c] for c, (_, r) in profile.roles.items() if r == rule]
    profile._add_quantiles([f for f in shown if f.may_be_codes and f.p5_nonzero is None])
    rows = [(c, v, profile.facts[c].ratio, profile.facts[c].n_distinct,
             profile.facts[c].p5_nonzero)
            for c, (v, r) in profile.roles.items() if r == rule]
    return profile.table(rows, "column string, view string, ratio double, n_distinct bigint, "
                               "p5_nonzero double")

