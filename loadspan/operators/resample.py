"""Time buckets, densification and gap filling of a series (series_id, t, power)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loadspan.functions.windows import finite


def bucket_mean(df: DataFrame, width: int) -> DataFrame:
    """series_id, b (bucket start, seconds, a multiple of width), power: the mean of what is not null or NaN."""
    b = (F.floor(F.col("t") / width) * width).cast("long")
    return df.groupBy("series_id", b.alias("b")).agg(F.avg(finite("power")).alias("power"))


def densified(df: DataFrame, width: int) -> DataFrame:
    """bucket_mean with every bucket between a series's first and last; empty ones have a null power."""
    means = bucket_mean(df, width)
    ends = means.groupBy("series_id").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    grid = ends.select("series_id", F.explode(F.sequence("lo", "hi", F.lit(width).cast("long"))).alias("b"))
    return grid.join(means, ["series_id", "b"], "left")


def interpolated(df: DataFrame, longest: float | None = None) -> DataFrame:
    """Null powers between known ones become linear in b; nulls at the ends stay, as do those between known buckets
    more than longest apart."""
    w = Window.partitionBy("series_id").orderBy("b")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("power").isNotNull(), F.struct("b", "power"))
    df = df.withColumns({"_p": F.last(known, ignorenulls=True).over(before), "_n": F.first(known, ignorenulls=True).over(after)})
    p0, p1, b0, b1 = (F.col(c) for c in ("_p.power", "_n.power", "_p.b", "_n.b"))
    value = p0 + (p1 - p0) * (F.col("b") - b0) / (b1 - b0)
    if longest and longest > 0:
        value = F.when(b1 - b0 <= longest, value)
    return df.withColumn("power", F.coalesce("power", value)).drop("_p", "_n")


def resampled(df: DataFrame, fs: float, longest: float | None = None) -> DataFrame:
    """The whole chain at fs samples a second: buckets of round(1 / fs) seconds, dense, interpolated, long gaps null."""
    return interpolated(densified(df, max(1, round(1 / fs))), longest)


def filled(df: DataFrame, series=("series_id",), order=("b",)) -> DataFrame:
    """Null powers take the last known one, else the next, else 0."""
    w = Window.partitionBy(*series).orderBy(*order)
    last = F.last("power", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    following = F.first("power", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("power", F.coalesce(last, following, F.lit(0.0)))
