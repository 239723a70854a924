"""Row-frame expressions over a series. Each function adds columns; series and order columns are named by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SERIES, ORDER = ("series_id",), ("t", "event_id")


def ordered(series=SERIES, order=ORDER):
    return Window.partitionBy(*series).orderBy(*order)


def finite(column: str) -> Column:
    """The value, with NaN as null: NaN sorts above every number, so it would pass any threshold."""
    return F.when(~F.isnan(column), F.col(column))


def with_position(df: DataFrame, series=SERIES, order=ORDER, name: str = "pos") -> DataFrame:
    return df.withColumn(name, F.row_number().over(ordered(series, order)) - 1)


def first_difference(df: DataFrame, value: str = "power", **by) -> DataFrame:
    """diff: the value less the one before it; 0 at the start."""
    return df.withColumn("diff", F.col(value) - F.coalesce(F.lag(value).over(ordered(**by)), F.col(value)))


def moving_average(df: DataFrame, value: str = "power", width: int = 5, **by) -> DataFrame:
    """smooth: a centred sum over width rows divided by width, rows beyond the ends counting as 0."""
    half = width // 2
    return df.withColumn("smooth", F.sum(value).over(ordered(**by).rowsBetween(-half, half)) / width)


def rolling_median_std(df: DataFrame, value: str = "power", width: int = 50, **by) -> DataFrame:
    """roll_median and roll_std (sample deviation, 0 where there is one row) over a centred frame of width rows."""
    after = (width - 1) // 2
    frame = ordered(**by).rowsBetween(after - width + 1, after)
    held = df.withColumns({"_f": F.sort_array(F.collect_list(value).over(frame)), "roll_std": F.coalesce(F.stddev_samp(value).over(frame), F.lit(0.0))})
    middle = lambda up: F.get("_f", F.floor((F.size("_f") - 1 + up) / 2).cast("int"))
    return held.withColumn("roll_median", (middle(0) + middle(1)) / 2).drop("_f")


def median_filter5(df: DataFrame, value: str = "power", **by) -> DataFrame:
    """cleaned: the median of five rows, rows beyond the ends counting as 0."""
    w = ordered(**by)
    beside = [F.lag(value, 2).over(w), F.lag(value).over(w), F.col(value), F.lead(value).over(w), F.lead(value, 2).over(w)]
    near = [F.coalesce(x, F.lit(0.0)) for x in beside]
    return df.withColumn("cleaned", F.sort_array(F.array(*near))[2])


def glr_score(df: DataFrame, channels=("power",), width: int = 10, series=SERIES, order=ORDER) -> DataFrame:
    """glr: for each row the squared difference of the means of the width rows before and from it on, over the sum of
    their population variances by width, summed over channels; 0 where a side is not full."""
    w = ordered(series, order)
    left, right = w.rowsBetween(-width, -1), w.rowsBetween(0, width - 1)
    score = F.lit(0.0)
    for c in channels:
        gap = F.avg(c).over(left) - F.avg(c).over(right)
        score = score + gap * gap / (F.var_pop(c).over(left) / width + F.var_pop(c).over(right) / width + 1e-12)
    full = (F.count(F.lit(1)).over(left) == width) & (F.count(F.lit(1)).over(w.rowsBetween(0, width)) == width + 1)
    return df.withColumn("glr", F.when(full, score).otherwise(0.0))


def sliding_statistics(df: DataFrame, value: str = "power", width: int = 10, **by) -> DataFrame:
    """Of each full forward window: slide_mean, slide_std (population, below 1e-3 as 1), slide_sq (sum of squares) and
    slide_dsq (sum of squared steps and 1e-5). Rows without a full window go."""
    w = ordered(**by)
    frame = w.rowsBetween(0, width - 1)
    df = df.withColumn("_step", F.lead(value).over(w) - F.col(value))
    std = F.stddev_pop(value).over(frame)
    df = df.withColumns({
        "slide_mean": F.avg(value).over(frame),
        "slide_std": F.when(std < 1e-3, 1.0).otherwise(std),
        "slide_sq": F.sum(F.col(value) * F.col(value)).over(frame),
        "slide_dsq": F.coalesce(F.sum(F.col("_step") * F.col("_step")).over(w.rowsBetween(0, width - 2)), F.lit(0.0)) + 1e-5,
        "_n": F.count(F.lit(1)).over(frame),
    })
    return df.where(F.col("_n") == width).drop("_n", "_step")


def forward_durations(df: DataFrame, **by) -> DataFrame:
    """dt: seconds to the next row; the last row repeats the one before it, and a single row has 0."""
    w = ordered(**by)
    step = F.lead("t").over(w) - F.col("t")
    return df.withColumn("dt", F.coalesce(step, F.col("t") - F.lag("t").over(w), F.lit(0.0)))


def neighbour_labels(df: DataFrame, label: str = "label", series=("activity_id",), order=("pos",)) -> DataFrame:
    w = ordered(series, order)
    return df.withColumns({"prev_label": F.lag(label).over(w), "next_label": F.lead(label).over(w)})


def rolled(value: str, fill: float = 0.0) -> Column:
    """The next row's value; fill for a series' last row (a buffer shifted left by one)."""
    return F.coalesce(F.lead(value).over(ordered()), F.when(F.lead(F.lit(1)).over(ordered()).isNull(), F.lit(fill)))
