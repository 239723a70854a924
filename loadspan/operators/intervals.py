"""Interval operators: merging, closed-interval membership, knock-out, durations and composition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loadspan.functions.windows import forward_durations


def ordered_ends(df: DataFrame) -> DataFrame:
    """Intervals whose ends are known, the lesser one first."""
    rows = df.where("start_t is not null and end_t is not null")
    return rows.withColumns({"start_t": F.least("start_t", "end_t"), "end_t": F.greatest("start_t", "end_t")})


def merged(df: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """series_id, start_t, end_t: the union of closed intervals, each widened by tolerance on either side."""
    w = Window.partitionBy("series_id").orderBy("start_t", "end_t")
    rows = ordered_ends(df).select("series_id", (F.col("start_t") - tolerance).alias("start_t"), (F.col("end_t") + tolerance).alias("end_t"))
    reach = F.max("end_t").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_f", F.when(F.col("start_t") <= reach, 0).otherwise(1)).withColumn("_g", F.sum("_f").over(w))
    return rows.groupBy("series_id", "_g").agg(F.min("start_t").alias("start_t"), F.max("end_t").alias("end_t")).drop("_g")


def dropped(points: DataFrame, spans: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """points with drop (boolean): t lies in one of the series's closed intervals.

    One sort instead of a range join: merged intervals' bounds and points share an order (starts before points before
    ends at equal t), and the running sum of +1 and -1 says whether a point is inside.
    """
    bounds = merged(spans, tolerance)
    names = points.columns
    marks = bounds.select("series_id", F.col("start_t").alias("t"), F.lit(1).alias("_d"), F.lit(0).alias("_o"))
    marks = marks.unionByName(bounds.select("series_id", F.col("end_t").alias("t"), F.lit(-1).alias("_d"), F.lit(2).alias("_o")))
    both = points.withColumns({"_d": F.lit(0), "_o": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("series_id").orderBy("t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("drop", F.sum("_d").over(w) > 0).where("_o = 1").select(*names, "drop")


def aligned(branch: DataFrame, mains: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """series_id, t, branch, mains by position; an error where lengths differ or a time differs by more than tolerance."""
    number = lambda df, c: df.select("series_id", F.col("t").alias(f"t_{c}"), F.col("power").alias(c), F.row_number().over(Window.partitionBy("series_id").orderBy("t")).alias("_n"))
    both = number(branch, "branch").join(number(mains, "mains"), ["series_id", "_n"], "full_outer")
    wrong = F.col("t_branch").isNull() | F.col("t_mains").isNull() | (F.abs(F.col("t_branch") - F.col("t_mains")) > tolerance)
    checked = F.when(wrong, F.raise_error(F.lit("branch and mains differ in length or time"))).otherwise(F.col("t_branch"))
    return both.select("series_id", checked.cast("double").alias("t"), "branch", "mains")


def knocked_out(both: DataFrame, clip: bool = True) -> DataFrame:
    """Dropped rows (column drop) have no branch, and their mains less it; clip keeps mains from going below 0."""
    rest = F.col("mains") - F.when(F.col("drop"), F.col("branch")).otherwise(0.0)
    return both.withColumns({"new_branch": F.when(F.col("drop"), 0.0).otherwise(F.col("branch")), "new_mains": F.greatest(rest, F.lit(0.0)) if clip else rest})


def knockout_quality(both: DataFrame) -> DataFrame:
    """series_id, n_points, drop_points, drop_ratio, negative_before_clip."""
    rest = F.col("mains") - F.when(F.col("drop"), F.col("branch")).otherwise(0.0)
    found = both.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_points"), F.count_if("drop").alias("drop_points"), F.count_if(rest < 0).alias("negative_before_clip"))
    return found.withColumn("drop_ratio", F.col("drop_points") / F.col("n_points"))


def mask_duration(points: DataFrame) -> DataFrame:
    """series_id, mask_seconds: the durations of dropped rows."""
    rows = forward_durations(points)
    return rows.groupBy("series_id").agg(F.sum(F.when(F.col("drop"), F.col("dt")).otherwise(0.0)).alias("mask_seconds"))


def composition(events: DataFrame, group: str = "part") -> DataFrame:
    """group, n_events, seconds and their shares of all; shares of nothing are 0."""
    sums = events.groupBy(group).agg(F.count(F.lit(1)).alias("n_events"), F.sum("duration_sec").alias("seconds"))
    total = Window.partitionBy(F.lit(1))
    share = lambda c: F.when(F.sum(c).over(total) > 0, F.col(c) / F.sum(c).over(total)).otherwise(0.0)
    return sums.withColumns({"event_share": share("n_events"), "seconds_share": share("seconds")})
