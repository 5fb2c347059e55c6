"""Time columns, regular series, gaps.

All operators work on many keyed series at once.  A series may be long: nothing
here puts one into a single task (see ``functions.ordered``).
"""

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import aggregate_long, as_double, kinds, quoted
from plumbline.functions.ordered import chunk_window, overlapped, with_position
from plumbline.functions.session import cut_lineage
from plumbline.functions.skew import split_join

KEY = "series_id"
MICROS = 1_000_000
DAY = 86_400 * MICROS
# Rows one array of a generated range holds.
RANGE_ROWS = 4096

# Accepted formats of time columns held as text.
FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS",
           "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss",
           "MM/dd/yyyy", "MM/dd/yyyy HH:mm", "MM/dd/yyyy HH:mm:ss", "dd.MM.yyyy", "dd-MMM-yyyy",
           "MMM d yyyy", "d MMM yyyy"]
# What every text of one of these formats has (a year of 4 to 19 digits, a separator, no part beyond 44 characters in all).
YEAR, SEPARATOR, LONGEST = "[0-9]{4}", "[-/. ]", 64

# Seasonal period by frequency.
PERIODS = {"D": 7, "W": 52, "MS": 12, "ME": 12, "QS": 4, "QE": 4, "YS": 1, "YE": 1, "H": 24, "T": 60}
OTHER_PERIOD = 7


def parsed_time(df: DataFrame, column: str) -> Column:
    """The column as a time stamp; text is tried against the known formats.

    A failed try costs far more than a look at the text, so only texts that a format could fit are tried.
    """
    if kinds(df)[column] == "datetime":
        return quoted(column).cast("timestamp")
    text = quoted(column).cast("string")
    possible = (F.length(text) <= LONGEST) & text.rlike(YEAR) & text.rlike(SEPARATOR)
    return F.when(possible, F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in FORMATS]))


def detect_datetime(df: DataFrame) -> DataFrame:
    """``column, parsed_share, is_datetime`` for time-typed and text columns."""
    kind = kinds(df)
    per = {}
    for c, k in kind.items():
        if k == "datetime":
            per[c] = {"parsed_share": F.lit(1.0) + F.min(F.lit(0.0))}
        elif k == "string":
            ok = F.when(quoted(c).isNotNull(), parsed_time(df, c).isNotNull().cast("int"))
            per[c] = {"parsed_share": F.avg(ok)}
    if not per:
        return df.sparkSession.createDataFrame([], "column string, parsed_share double, is_datetime boolean")
    return (aggregate_long(df, per)
            .withColumn("is_datetime", F.coalesce(F.col("parsed_share") > 0.8, F.lit(False))))


def detect_series_target(df: DataFrame) -> DataFrame:
    """``column, variance`` of the numeric columns, largest variance first."""
    names = [c for c, k in kinds(df).items() if k == "numeric"]
    return (aggregate_long(df, {c: {"variance": F.var_samp(as_double(c))} for c in names})
            .orderBy(F.desc_nulls_last("variance"), "column"))


def series_candidates(df: DataFrame) -> DataFrame:
    """``role, column, chosen``: possible time and value columns and the automatic choice."""
    times = [r["column"] for r in detect_datetime(df).filter("is_datetime").collect()]
    times = [c for c in df.columns if c in times]
    values = [r["column"] for r in detect_series_target(df).collect()] if times else []
    numeric = [c for c, k in kinds(df).items() if k == "numeric"]
    rows = [("datetime", c, i == 0) for i, c in enumerate(times)]
    rows += [("target", c, bool(values) and c == values[0]) for c in numeric]
    return df.sparkSession.createDataFrame(rows, "role string, column string, chosen boolean")


@dataclass
class SeriesSet:
    """Observed points ``series_id, t, y, pos, n`` of many series.

    ``t`` is in microseconds, ``pos`` the 0-based position and ``n`` the length
    of the series.  Points at the same instant are averaged; null times and
    values are dropped.
    """

    points: DataFrame

    @cached_property
    def steps(self) -> DataFrame:
        """``series_id, dt, dm, n``: time and month steps between neighbours, counted."""
        w = chunk_window([KEY])
        at = F.timestamp_micros("t")
        month = F.year(at) * 12 + F.month(at)
        return (overlapped(self.points, [KEY], before=1).withColumn("_m", month)
                .withColumns({"dt": F.col("t") - F.lag("t").over(w),
                              "dm": F.col("_m") - F.lag("_m").over(w)})
                .filter("_own and pos > 0").groupBy(KEY, "dt", "dm").agg(F.count("*").alias("n"))
                .transform(cut_lineage))

    @cached_property
    def spec(self) -> DataFrame:
        """One row per series: ``freq, step_us, step_months, t0, t1, n, n_expected, period``.

        The step is the most frequent one (the smaller of equals).  A series is
        regular when every step is a multiple of it; others have ``freq``
        ``unknown`` and are kept as they are.
        """
        at = F.timestamp_micros("t")
        midnight = F.col("t") % DAY == 0
        last = F.dayofmonth(F.last_day(at)) == F.dayofmonth(at)
        ends = self.points.groupBy(KEY).agg(
            F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"),
            F.bool_and(midnight & (F.dayofmonth(at) == 1)).alias("starts"),
            F.bool_and(midnight & last).alias("month_ends"))

        def modal(step):
            counts = self.steps.groupBy(KEY, step).agg(F.sum("n").alias("n"))
            # one struct per series: the commonest step, the smaller of equals
            return counts.groupBy(KEY).agg(F.max(F.struct("n", -F.col(step)))["col2"].alias("_s")) \
                .select(KEY, (-F.col("_s")).alias(f"modal_{step}"))

        regular = (self.steps.join(modal("dt"), KEY).join(modal("dm"), KEY).groupBy(KEY)
                   .agg(F.first("modal_dt").alias("modal_dt"), F.first("modal_dm").alias("modal_dm"),
                        F.bool_and(F.col("dt") % F.col("modal_dt") == 0).alias("fixed"),
                        F.bool_and((F.col("modal_dm") > 0) & (F.col("dm") % F.greatest(
                            F.col("modal_dm"), F.lit(1)) == 0)).alias("monthly")))
        spec = ends.join(regular, KEY, "left")
        enough = F.col("n") >= 3
        by_month = enough & F.col("monthly") & (F.col("starts") | F.col("month_ends"))
        fixed = enough & F.col("fixed") & ~F.coalesce(by_month, F.lit(False))
        k = F.col("modal_dm")
        end = F.when(F.col("starts"), "S").otherwise("E")
        month_freq = (F.when(k == 12, F.concat(F.lit("Y"), end)).when(k == 3, F.concat(F.lit("Q"), end))
                      .when(k == 1, F.concat(F.lit("M"), end)).otherwise(F.concat(k, F.lit("M"), end)))
        step = F.col("modal_dt")
        units = [("W", 7 * DAY), ("D", DAY), ("H", 3600 * MICROS), ("T", 60 * MICROS), ("S", MICROS),
                 ("U", 1)]
        time_freq = F.lit(None).cast("string")
        for name, size in reversed(units):
            label = F.when(step == size, name).otherwise(
                F.concat((step / size).cast("bigint"), F.lit(name)))
            time_freq = F.when(step % size == 0, label).otherwise(time_freq)
        spec = (spec.withColumn("freq", F.when(by_month, month_freq).when(fixed, time_freq)
                                .otherwise("unknown"))
                .withColumn("step_months", F.when(by_month, k))
                .withColumn("step_us", F.when(fixed, step)))
        a, b = F.timestamp_micros("t0"), F.timestamp_micros("t1")
        months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
        expected = (F.when(F.col("step_months").isNotNull(), (months / F.col("step_months")).cast("bigint") + 1)
                    .when(F.col("step_us").isNotNull(),
                          ((F.col("t1") - F.col("t0")) / F.col("step_us")).cast("bigint") + 1)
                    .otherwise(F.col("n")))
        table = F.create_map(*[F.lit(x) for kv in PERIODS.items() for x in kv])
        period = F.least(F.coalesce(table[F.col("freq")], F.lit(OTHER_PERIOD)),
                         F.floor(F.col("n") / 2).cast("int"))
        return (spec.withColumn("n_expected", expected).withColumn("period", period)
                .select(KEY, "freq", "step_us", "step_months", "month_ends", "t0", "t1", "n",
                        "n_expected", "period").transform(cut_lineage))

    @cached_property
    def gap_ranges(self) -> DataFrame:
        """Neighbouring points more than one step apart.

        ``series_id, first, last`` are the grid indexes missing between them;
        with them the two points and the series' step.
        """
        w = chunk_window([KEY])
        grid = (self.points.drop("n").join(self.spec.filter("freq <> 'unknown'"), KEY)
                .withColumn("i", grid_index(F.col("t"))))
        linked = (overlapped(grid, [KEY], before=1)
                  .withColumns({f"{c}_before": F.lag(c).over(w) for c in ("t", "y", "i")}))
        return (linked.filter("_own and i - i_before > 1")
                .withColumns({"first": F.col("i_before") + 1, "last": F.col("i") - 1})
                .drop("_own", "_chunk"))


def grid_index(t: Column) -> Column:
    """Grid index of a time in its series (needs the columns of ``spec``)."""
    at, start = F.timestamp_micros(t), F.timestamp_micros("t0")
    months = (F.year(at) - F.year(start)) * 12 + F.month(at) - F.month(start)
    return (F.when(F.col("step_months").isNotNull(), months / F.col("step_months"))
            .otherwise((t - F.col("t0")) / F.col("step_us"))).cast("bigint")


def grid_time(i: Column) -> Column:
    """Time of a grid index in microseconds (needs the columns of ``spec``)."""
    start = F.to_date(F.timestamp_micros("t0"))
    day = F.add_months(start, (i * F.col("step_months")).cast("int"))
    day = F.when(F.col("month_ends"), F.last_day(day)).otherwise(day)
    return (F.when(F.col("step_months").isNotNull(), F.unix_date(day).cast("bigint") * DAY)
            .otherwise(F.col("t0") + i * F.col("step_us")))


def explode_range(df: DataFrame, first: str, last: str, name: str) -> DataFrame:
    """One row per integer in [first, last]; long ranges are cut into short arrays first."""
    starts = F.sequence(F.col(first), F.col(last), F.lit(RANGE_ROWS).cast("bigint"))
    return (df.withColumn("_start", F.explode(starts))
            .withColumn(name, F.explode(F.sequence(
                F.col("_start"), F.least(F.col("_start") + RANGE_ROWS - 1, F.col(last)))))
            .drop("_start"))


def prepare_series(df: DataFrame, time: str, value: str, series: str | None = None) -> SeriesSet:
    """Parse times, drop nulls, average points at one instant, number the points in time order."""
    key = quoted(series).cast("string") if series else F.lit("all")
    raw = df.select(key.alias(KEY), F.unix_micros(parsed_time(df, time)).alias("t"),
                    F.nanvl(as_double(value), F.lit(None)).alias("y"))
    points = (raw.filter(f"{KEY} is not null and t is not null and y is not null")
              .groupBy(KEY, "t").agg(F.avg("y").alias("y")))
    sizes = points.groupBy(KEY).agg(F.count("*").alias("n"))
    # written once, read by every operator on the set
    placed = split_join(with_position(points, [KEY], ["t"]), sizes, [KEY], F.col("t"),
                        counts=sizes.withColumnRenamed("n", "_n"))
    return SeriesSet(cut_lineage(placed))


def infer_frequency(s: SeriesSet) -> DataFrame:
    """``series_id, freq, n, n_expected``."""
    return s.spec.select(KEY, "freq", "n", "n_expected")


def regular_series(s: SeriesSet) -> DataFrame:
    """``series_id, ds, y`` on the full calendar of each series; missing points are null."""
    seen = s.points.select(KEY, "t", "y")
    holes = explode_range(s.gap_ranges, "first", "last", "at").select(
        KEY, grid_time(F.col("at")).alias("t"), F.lit(None).cast("double").alias("y"))
    return seen.unionByName(holes).select(KEY, F.timestamp_micros("t").alias("ds"), "y")


def fill_gaps(s: SeriesSet) -> DataFrame:
    """``series_id, ds, y, filled``: missing points interpolated linearly in time."""
    t = grid_time(F.col("at"))
    line = F.col("y_before") + (F.col("y") - F.col("y_before")) * (
        (F.col("t_new") - F.col("t_before")) / (F.col("t") - F.col("t_before")))
    holes = (explode_range(s.gap_ranges, "first", "last", "at").withColumn("t_new", t)
             .select(KEY, F.col("t_new").alias("t"), line.alias("y"), F.lit(True).alias("filled")))
    seen = s.points.select(KEY, "t", "y", F.lit(False).alias("filled"))
    return seen.unionByName(holes).select(KEY, F.timestamp_micros("t").alias("ds"), "y", "filled")


def missing_timestamps(s: SeriesSet) -> DataFrame:
    """``series_id, freq, n, n_expected, gap_count, coverage_pct``."""
    missing = F.col("n_expected") - F.col("n")
    return s.spec.select(KEY, "freq", "n", "n_expected", missing.alias("gap_count"),
                         ((1 - missing / F.col("n_expected")) * 100).alias("coverage_pct"))


def first_gaps(s: SeriesSet, k: int = 20) -> DataFrame:
    """``series_id, rank, ds`` of the first k missing times.

    The first k missing times lie in the first k gaps, and k steps of each are
    enough, so long gaps are not unfolded.
    """
    order = Window.partitionBy(KEY).orderBy("first")
    few = (s.gap_ranges.withColumn("_g", F.row_number().over(order)).filter(F.col("_g") <= k)
           .withColumn("last", F.least("last", F.col("first") + k - 1)))
    times = explode_range(few, "first", "last", "at").withColumn(
        "rank", F.row_number().over(Window.partitionBy(KEY).orderBy("at"))).filter(F.col("rank") <= k)
    return times.select(KEY, "rank", F.timestamp_micros(grid_time(F.col("at"))).alias("ds"))
