"""Sinks for activities, exported segments and prepared series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadspan.functions.windows import median_filter5
from loadspan.operators.mapping import segment_points


def write_activities(points: DataFrame, path: str, form: str = "parquet") -> None:
    """One folder per activity, rows in order of time, with an ISO datetime column."""
    rows = points.withColumn("datetime", F.date_format(F.timestamp_micros((F.col("t") * 1e6).cast("long")), "yyyy-MM-dd HH:mm:ss"))
    rows.repartition("series_id", "activity_id").sortWithinPartitions("series_id", "activity_id", "pos").write.mode("overwrite").partitionBy("series_id", "activity_id").format(form).save(path)


def activity_names(points: DataFrame, zone: str = "UTC") -> DataFrame:
    """series_id, activity_id, name: activity_<id>_<start>_<end>_<whole seconds>, times as they are read in the zone."""
    ends = points.groupBy("series_id", "activity_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    said = lambda t: F.date_format(F.from_utc_timestamp(F.timestamp_micros((F.col(t) * 1e6).cast("long")), zone), "yyyyMMdd-HHmmss")
    return ends.select("series_id", "activity_id", F.concat_ws("_", F.lit("activity"), "activity_id", said("a"), said("b"), (F.col("b") - F.col("a")).cast("long")).alias("name"))


def write_segments(primitives: DataFrame, points: DataFrame, labels: DataFrame, path: str, form: str = "parquet", channel: str = "raw") -> DataFrame:
    """Points of labelled primitives, one folder per cluster; returns the manifest (id, label, activity_id, start, length).

    channel: raw, or cleaned for powers through the median filter of five over the whole activity."""
    if channel not in ("raw", "cleaned"):
        raise ValueError(f"{channel} is neither raw nor cleaned")
    if channel == "cleaned":
        points = median_filter5(points, series=("activity_id",), order=("pos",)).withColumn("power", F.col("cleaned")).drop("cleaned")
    chosen = primitives.join(labels.select("id", "label"), "id")
    rows = segment_points(chosen.select("id", "activity_id", "start", "length"), points).join(labels.select("id", "label"), "id")
    rows.repartition("label").sortWithinPartitions("label", "id", "pos").write.mode("overwrite").partitionBy("label").format(form).save(path)
    return chosen.select("id", "label", "activity_id", "start", "length")


def write_series(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """timestamp,power CSV files in order of time, none over rows_per_file rows."""
    out = df.select(F.col("t").alias("timestamp"), "power").repartitionByRange("timestamp").sortWithinPartitions("timestamp")
    out.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", rows_per_file).csv(path)
