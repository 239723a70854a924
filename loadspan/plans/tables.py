"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as one series per user: series_id, t (seconds), power, event_id."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), t.alias("t"), F.col("value").alias("power"), "event_id")


def primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as primitives: id, features, label, 20 to an activity, each of 10 points."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").cast("int").alias("label"),
        F.floor(F.col("vec_id") / 20).cast("long").alias("activity_id"), (F.col("vec_id") % 20).alias("pos"), ((F.col("vec_id") % 20) * 10).alias("start"), F.lit(10).cast("long").alias("length"),
    )


def daily(spark: SparkSession, sf_dir: str, flag: str | None = None) -> DataFrame:
    """lineitem's quantities by day of shipment as a series (of one return flag if given): series_id, t, power."""
    rows = read(spark, sf_dir, "lineitem")
    rows = rows.where(F.col("l_returnflag") == flag) if flag else rows
    t = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / F.lit(86400e6)) * 86400.0
    return rows.groupBy(F.lit(0).alias("series_id"), t.alias("t")).agg(F.sum("l_quantity").alias("power"))
