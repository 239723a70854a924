"""Working intervals of a series: gaps and islands, learned thresholds, and the points of each interval.

A series is a table of series_id, t (seconds), power and event_id, which orders rows of equal t.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loadspan.functions.windows import finite, moving_average, ordered, with_position


def active(df: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """Rows with a power of at least threshold (above it if strict). Null and NaN are inactive."""
    power = finite("power")
    return df.where(power > threshold if strict else power >= threshold)


def islands(df: DataFrame, threshold: float, t_drop: float, strict: bool = False) -> DataFrame:
    """Active rows with island: a new one begins where active rows lie more than t_drop seconds apart."""
    w = ordered()
    rows = active(df, threshold, strict)
    fresh = F.when(F.col("t") - F.lag("t").over(w) <= t_drop, 0).otherwise(1)
    return rows.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(w) - 1).drop("_fresh")


def _least(t_min: float | Column) -> Column:
    return F.max(t_min if isinstance(t_min, Column) else F.lit(t_min)).alias("_least")


def intervals(df: DataFrame, threshold: float | Column, t_drop: float | Column, t_min: float | Column) -> DataFrame:
    """series_id, activity_id (from 0 in order of time), start_t, end_t, duration_sec, n_active: islands of at least t_min.

    Parameters are numbers, or columns of df that are constant within a series."""
    spans = islands(df, threshold, t_drop).groupBy("series_id", "island").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count(F.lit(1)).alias("n_active"), _least(t_min))
    spans = spans.withColumn("duration_sec", F.col("end_t") - F.col("start_t")).where(F.col("duration_sec") >= F.col("_least"))
    number = F.row_number().over(Window.partitionBy("series_id").orderBy("start_t")) - 1
    return spans.select("series_id", number.alias("activity_id"), "start_t", "end_t", "duration_sec", "n_active")


def interval_points(df: DataFrame, threshold: float, t_drop: float, t_min: float, context: int) -> DataFrame:
    """Rows of each interval and of context rows on either side: series_id, activity_id, pos (from 0), t, power, event_id.

    Positions are numbered once; each interval names the positions it takes, so rows meet them by an equality join.
    """
    rows = with_position(df, name="_at")
    last = rows.groupBy("series_id").agg(F.max("_at").alias("_last"))
    spans = islands(rows, threshold, t_drop).groupBy("series_id", "island").agg(F.min("_at").alias("a"), F.max("_at").alias("b"), F.min("t").alias("start_t"), F.max("t").alias("end_t"), _least(t_min))
    spans = spans.where(F.col("end_t") - F.col("start_t") >= F.col("_least")).join(last, "series_id")
    number = F.row_number().over(Window.partitionBy("series_id").orderBy("start_t")) - 1
    first, stop = F.greatest(F.col("a") - context, F.lit(0)), F.least(F.col("b") + context, F.col("_last"))
    wanted = spans.withColumn("activity_id", number).select("series_id", "activity_id", F.posexplode(F.sequence(first, stop)).alias("pos", "_at"))
    return wanted.join(rows, ["series_id", "_at"]).select("series_id", "activity_id", "pos", "t", "power", "event_id")


def session_intervals(df: DataFrame, threshold: float, gap: str, ts: str = "ts") -> DataFrame:
    """Islands by session_window, which also runs on streams: series_id, start_ts, last_ts, n_active."""
    rows = active(df, threshold)
    found = rows.groupBy("series_id", F.session_window(ts, gap)).agg(F.min(ts).alias("start_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_active"))
    return found.select("series_id", "start_ts", "last_ts", "n_active")


def histogram(df: DataFrame, value: str = "smooth", bins: int = 500) -> DataFrame:
    """series_id, bin, n, total, lo, hi: equal bins from least to greatest value, the last one closed."""
    ends = df.groupBy("series_id").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    placed = df.join(ends, "series_id").withColumn("bin", bin_of(F.col(value), F.col("lo"), F.col("hi"), bins))
    return placed.groupBy("series_id", "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))


def bin_of(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    return F.when(hi > lo, F.least(F.floor((value - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")


def otsu_threshold(df: DataFrame, bins: int = 500) -> DataFrame:
    """series_id, bin, threshold: of the moving average's histogram, the first bin that sets the two classes furthest
    apart; the threshold is its centre, but not over the sleeping class's mean and six deviations."""
    found = histogram(moving_average(df), bins=bins)
    centre = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    found = found.withColumn("c", centre)
    up = Window.partitionBy("series_id").orderBy("bin")
    total = Window.partitionBy("series_id")
    found = found.withColumns({"s": F.col("n") * F.col("c"), "q": F.col("n") * F.col("c") * F.col("c")})
    # classes are the bins below and from each bin on; empty bins never separate better than the next full one
    below = up.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumns({"n0": F.sum("n").over(below), "s0": F.sum("s").over(below), "q0": F.sum("q").over(below), "n_all": F.sum("n").over(total), "s_all": F.sum("s").over(total)})
    found = found.where((F.col("bin") >= 1) & (F.col("bin") <= bins - 2) & (F.col("n0") > 0))
    gap = F.col("s0") / F.col("n0") - (F.col("s_all") - F.col("s0")) / (F.col("n_all") - F.col("n0"))
    found = found.withColumn("between", F.col("n0") / F.col("n_all") * (1 - F.col("n0") / F.col("n_all")) * gap * gap)
    mean0 = F.col("s0") / F.col("n0")
    found = found.withColumn("cap", mean0 + 6 * F.sqrt(F.greatest(F.col("q0") / F.col("n0") - mean0 * mean0, F.lit(0.0))))
    best = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc(F.round("between", 9)), "bin"))
    found = found.withColumn("_best", best).where("_best = 1")
    return found.select("series_id", "bin", F.least("c", "cap").alias("threshold"))


def two_means(df: DataFrame, value: str) -> DataFrame:
    """series_id, n, low_max, low_mean, high_mean: the exact split of sorted values into two classes of least squares."""
    up = Window.partitionBy("series_id").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("series_id")
    rows = df.withColumns({"_k": F.count(F.lit(1)).over(up), "_s": F.sum(value).over(up), "_n": F.count(F.lit(1)).over(all_), "_all": F.sum(value).over(all_)})
    rest = F.col("_n") - F.col("_k")
    gain = F.col("_s") * F.col("_s") / F.col("_k") + F.when(rest > 0, (F.col("_all") - F.col("_s")) * (F.col("_all") - F.col("_s")) / rest).otherwise(0.0)
    rows = rows.withColumn("gain", gain).where(rest > 0)
    best = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc(F.round("gain", 9)), "_k"))
    rows = rows.withColumn("_best", best).where("_best = 1")
    return rows.select("series_id", F.col("_n").alias("n"), F.col(value).alias("low_max"), (F.col("_s") / F.col("_k")).alias("low_mean"), ((F.col("_all") - F.col("_s")) / rest).alias("high_mean"))


def active_gaps(df: DataFrame, threshold: float) -> DataFrame:
    """series_id, gap: seconds between consecutive active rows (power above threshold)."""
    rows = active(df, threshold, strict=True).withColumn("gap", F.col("t") - F.lag("t").over(ordered()))
    return rows.where("gap is not null").select("series_id", "gap")


def time_parameters(df: DataFrame, threshold: float) -> DataFrame:
    """series_id, t_drop, t_min_work: 1.2 times the longest short gap, and one more than the longest noise island.

    Short gaps, and noise among the islands that lie more than t_drop apart, are the lower of two classes of log1p
    values. A series of under five active rows gets 15 and 30; a class of under two values gives the same defaults.
    """
    counts = active(df, threshold, strict=True).groupBy("series_id").agg(F.count(F.lit(1)).alias("n_active"))
    gaps = two_means(active_gaps(df, threshold).withColumn("g", F.log1p("gap")), "g").select("series_id", (1.2 * F.expm1("low_max")).alias("drop"))
    drops = counts.join(gaps, "series_id", "left").select("series_id", "n_active", F.when(F.col("n_active") < 5, 15.0).otherwise(F.coalesce("drop", F.lit(15.0))).alias("t_drop"))
    rows = active(df, threshold, strict=True).join(drops, "series_id")
    w = ordered()
    fresh = F.when(F.col("t") - F.lag("t").over(w) <= F.col("t_drop"), 0).otherwise(1)
    spans = rows.withColumn("_f", fresh).withColumn("island", F.sum("_f").over(w)).groupBy("series_id", "island").agg((F.max("t") - F.min("t")).alias("d"))
    noise = two_means(spans.withColumn("d", F.log1p("d")), "d").select("series_id", (F.expm1("low_max") + 1).alias("least"))
    found = drops.join(noise, "series_id", "left")
    return found.select("series_id", "t_drop", F.when(F.col("n_active") < 5, 30.0).otherwise(F.coalesce("least", F.lit(30.0))).alias("t_min_work"))


class SimpleThreshold:
    """Detector with given parameters."""

    def __init__(self, threshold: float = 5.0, t_drop: float = 150.0, t_min_work: float = 180.0, context_seconds: float = 90.0, fs: float = 0.1666667):
        self.threshold, self.t_drop, self.t_min_work = threshold, t_drop, t_min_work
        self.context = int(context_seconds * fs)

    def train(self, df: DataFrame) -> SimpleThreshold:
        return self

    def detect(self, df: DataFrame) -> DataFrame:
        return intervals(df, self.threshold, self.t_drop, self.t_min_work)

    def points(self, df: DataFrame) -> DataFrame:
        return interval_points(df, self.threshold, self.t_drop, self.t_min_work, self.context)


class AdaptiveThreshold(SimpleThreshold):
    """Detector that learns what it is not given (None, or a threshold of 0) for each series by itself.

    threshold, t_drop and t_min_work hold the least threshold and the longest times, for series that were not learned from.
    """

    learned: DataFrame | None = None

    def __init__(self, threshold: float | None = None, t_drop: float | None = None, t_min_work: float | None = None, **rest):
        super().__init__(threshold or 0.0, t_drop or 0.0, t_min_work or 0.0, **rest)

    def train(self, df: DataFrame) -> AdaptiveThreshold:
        given = (self.threshold, self.t_drop, self.t_min_work)
        of = df.select("series_id").distinct()
        cuts = of.join(otsu_threshold(df), "series_id", "left") if not given[0] else of.withColumn("threshold", F.lit(given[0]))
        rows = df.join(cuts.select("series_id", F.coalesce("threshold", F.lit(0.0)).alias("_threshold")), "series_id")
        times = time_parameters(rows, F.col("_threshold"))
        pick = lambda x, learned, least: F.lit(x) if x else F.coalesce(learned, F.lit(least))
        found = cuts.join(times, "series_id", "left").select("series_id", F.coalesce("threshold", F.lit(0.0)).alias("_threshold"), pick(given[1], "t_drop", 15.0).alias("_t_drop"), pick(given[2], "t_min_work", 30.0).alias("_t_min"))
        self.learned = found  # one row a series
        least = found.agg(F.min("_threshold"), F.max("_t_drop"), F.max("_t_min")).first()
        self.threshold, self.t_drop, self.t_min_work = least[0] or 0.0, least[1] or 15.0, least[2] or 30.0
        return self

    def _parameters(self, df: DataFrame) -> tuple[DataFrame, Column, Column, Column]:
        rows = df.join(self.learned, "series_id", "left")
        filled = [F.coalesce(F.col(c), F.lit(x)) for c, x in (("_threshold", self.threshold), ("_t_drop", self.t_drop), ("_t_min", self.t_min_work))]
        return rows, *filled

    def detect(self, df: DataFrame) -> DataFrame:
        return intervals(*self._parameters(df)) if self.learned is not None else super().detect(df)

    def points(self, df: DataFrame) -> DataFrame:
        return interval_points(*self._parameters(df), self.context) if self.learned is not None else super().points(df)


DETECTORS = {"simple": SimpleThreshold, "adaptive": AdaptiveThreshold}
