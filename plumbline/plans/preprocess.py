"""The preprocessing a table's findings ask for, as a fitted plan."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import aggregate_long, as_double, as_text, quoted
from plumbline.functions.frequency import text_counts
from plumbline.functions.quantiles import exact_quantiles
from plumbline.ml import features as ft
from plumbline.operators import association, categorical, numeric
from plumbline.operators.profile import Profile

MISSING = "MISSING"


def columns_to_drop(profile: Profile, order_col: str | None = None) -> DataFrame:
    """``column, reason``: identifiers, flagged columns, the first of each redundant pair,
    one-valued categories."""
    df, numbers = profile.df, profile.numeric
    found = [profile.table([(c, "identifier") for c in profile.view("identifier")],
                           "column string, reason string")]
    if numbers:
        found.append(numeric.drop_candidates(df, numbers, order_col).select("column", "reason"))
    if len(numbers) >= 2:
        pairs = association.feature_redundancy(df, numbers, profile.means, profile.config)
        found.append(pairs.select(F.col("col_a").alias("column"), F.lit("redundant").alias("reason")))
    if profile.categorical:
        one = categorical.categorical_summary(df, profile.categorical, profile.config)
        found.append(one.filter("most_frequent_pct > 0.99")
                     .select("column", F.lit("near_zero_variance").alias("reason")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("column").agg(F.min("reason").alias("reason"))


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, mode``: the most frequent non-null value; the smallest of equals."""
    return (text_counts(df, columns).groupBy("column")
            .agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("m"))
            .select("column", F.col("m.value").alias("mode")))


def impute_median(df: DataFrame, columns: list[str], n_rows: int | None = None) -> DataFrame:
    medians = exact_quantiles(df, {c: as_double(c) for c in columns}, [0.5], n_rows)
    return df.withColumns({c: F.coalesce(as_double(c), F.lit(m)) for c, (m,) in medians.items()
                           if m is not None})


def impute_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    found = {r["column"]: r["mode"] for r in modes(df, columns).collect()}
    types = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(quoted(c), F.lit(m).cast(types[c]))
                           for c, m in found.items()})


def log_transform(df: DataFrame, columns: list[str]) -> DataFrame:
    """Natural logarithm; a column with any value <= 0 stays as it is."""
    lows = aggregate_long(df, {c: {"low": F.min(as_double(c))} for c in columns}).collect()
    fine = [r["column"] for r in lows if r["low"] is not None and r["low"] > 0]
    return df.withColumns({c: F.ln(as_double(c)) for c in fine})


def log1p_transform(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.log1p(as_double(c)) for c in columns})


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null becomes ``MISSING``; values become their number in sorted order."""
    codes = ft.category_codes(df, columns, MISSING)
    sizes = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count("*").alias("n")).collect()}
    return ft.apply_codes(df, codes, columns, MISSING, sizes)


def target_mean_encode(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Each category becomes the mean target of its rows (null stays null)."""
    order = df.columns
    for c in columns:
        means = (df.groupBy(as_text(df, c).alias("_v")).agg(F.avg(as_double(target)).alias("_m"))
                 .filter("_v is not null"))
        if means.count() <= ft.BROADCAST_CODES:
            means = F.broadcast(means)
        df = (df.withColumn("_v", as_text(df, c)).join(means, "_v", "left")
              .withColumn(c, F.col("_m")).drop("_v", "_m"))
    return df.select(*[quoted(c) for c in order])


@dataclass
class PreprocessPlan:
    """Steps decided on one table, applied to any table with its columns.

    ``fit`` learns what to drop, fill, transform and code; ``transform`` applies
    it, so a test table gets the training table's medians, modes and codes.
    """

    drop: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    log: list[str] = field(default_factory=list)
    log1p: list[str] = field(default_factory=list)
    encode: list[str] = field(default_factory=list)
    high_cardinality: list[str] = field(default_factory=list)
    codes: DataFrame | None = None
    sizes: dict[str, int] = field(default_factory=dict)

    @classmethod
    def fit(cls, profile: Profile, order_col: str | None = None) -> "PreprocessPlan":
        df, facts = profile.df, profile.facts
        drop = sorted(r["column"] for r in columns_to_drop(profile, order_col).collect())
        plan = cls(drop=drop)
        gappy = [c for c in profile.features if facts[c].n < facts[c].n_rows and c not in drop]
        numbers = [c for c in profile.numeric if c not in drop]
        flagged = {r["column"] for r in numeric.drop_candidates(df, profile.numeric, order_col).collect()} \
            if profile.numeric else set()
        found = exact_quantiles(df, {c: as_double(c) for c in gappy if c in numbers}, [0.5], profile.n_rows)
        plan.medians = {c: m for c, (m,) in found.items() if m is not None}
        texts = [c for c in gappy if c in profile.categorical]
        if texts:
            plan.modes = {r["column"]: r["mode"] for r in modes(df, texts).collect()}
        if numbers:
            for r in numeric.log_candidates(df, profile.numeric, profile.config, sorted(flagged)).collect():
                if r["column"] in numbers:
                    getattr(plan, r["action"]).append(r["column"])
            plan.log = [c for c in plan.log if (facts[c].min or 0) > 0]
        limit = profile.config.high_cardinality
        coded = [c for c in profile.categorical if c not in drop]
        many = lambda c: facts[c].n_distinct + (facts[c].n < facts[c].n_rows) > limit
        plan.high_cardinality = [c for c in coded if many(c)]
        plan.encode = [c for c in coded if not many(c)]
        if plan.encode:
            plan.codes = ft.category_codes(plan._filled(df), plan.encode, MISSING)
            plan.sizes = {r["column"]: r["n"] for r in
                          plan.codes.groupBy("column").agg(F.count("*").alias("n")).collect()}
        return plan

    def _filled(self, df: DataFrame) -> DataFrame:
        types = dict(df.dtypes)
        return df.withColumns({
            **{c: F.coalesce(as_double(c), F.lit(m)) for c, m in self.medians.items() if c in types},
            **{c: F.coalesce(quoted(c), F.lit(m).cast(types[c])) for c, m in self.modes.items()
               if c in types}})

    def transform(self, df: DataFrame) -> DataFrame:
        """Drop, fill, transform, code; categories not seen in fitting get -1."""
        df = self._filled(df.drop(*self.drop))
        df = df.withColumns({**{c: F.ln(as_double(c)) for c in self.log if c in df.columns},
                             **{c: F.log1p(as_double(c)) for c in self.log1p if c in df.columns}})
        present = [c for c in self.encode if c in df.columns]
        if present:
            df = ft.apply_codes(df, self.codes, present, MISSING, self.sizes, unseen=-1)
        return df
