"""Series from CSV, text, NumPy and annotated benchmark files: series_id, t, power, event_id."""

from __future__ import annotations

import io
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

_FILE = "_metadata.file_path"


def _numbered(df: DataFrame) -> DataFrame:
    """NaN powers become null; event_id numbers rows in order of time within a series."""
    power = F.when(~F.isnan("power"), F.col("power"))
    order = Window.partitionBy("series_id").orderBy("t", "power")
    return df.withColumn("power", power).withColumn("event_id", F.row_number().over(order).cast("long") - 1)


def series_columns(columns: list[str]) -> tuple[str, str]:
    """Which columns are time and power: datetime and power, else timestamp and power, else the first two."""
    for time in ("datetime", "timestamp"):
        if time in columns and "power" in columns:
            return time, "power"
    if len(columns) < 2:
        raise ValueError("a series needs two columns")
    return columns[0], columns[1]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header; each file is a series. Times are unix seconds or timestamps."""
    raw = spark.read.option("header", True).csv(path)
    time, power = series_columns(raw.columns)
    t = F.coalesce(F.expr(f"try_cast(`{time}` AS double)"), F.unix_micros(F.expr(f"try_cast(`{time}` AS timestamp)")) / 1e6)
    rows = raw.select(F.col(_FILE).alias("series_id"), t.alias("t"), F.expr(f"try_cast(`{power}` AS double)").alias("power"))
    return _numbered(rows.where("t is not null"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of numbers between white space, time and power first; each file is a series."""
    parts = F.split(F.btrim("value", F.lit(" \t\r")), r"\s+")
    rows = spark.read.text(path).select(F.col(_FILE).alias("series_id"), parts.alias("p")).where("size(p) >= 2")
    return _numbered(rows.select("series_id", F.expr("try_cast(p[0] AS double)").alias("t"), F.expr("try_cast(p[1] AS double)").alias("power")).where("t is not null"))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """NumPy files of at least two columns, time and power first; each file is a series and one task."""

    def run(parts):
        for part in parts:
            for file, content in zip(part["path"], part["content"]):
                x = np.load(io.BytesIO(content))
                if x.ndim != 2 or x.shape[1] < 2:
                    raise ValueError(f"{file} does not have two columns")
                yield pd.DataFrame({"series_id": file, "t": x[:, 0].astype(float), "power": x[:, 1].astype(float)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return _numbered(files.mapInPandas(run, "series_id string, t double, power double"))


def read_pair(spark: SparkSession, branch: str, mains: str) -> tuple[DataFrame, DataFrame]:
    """Two series of .npy or .dat files under one series_id; other kinds are an error."""

    def one(path: str) -> DataFrame:
        kind = path.rsplit(".", 1)[-1]
        if kind not in ("npy", "dat"):
            raise ValueError(f"{path} is neither .npy nor .dat")
        return (read_npy if kind == "npy" else read_text)(spark, path).withColumn("series_id", F.lit(0))

    return one(branch), one(mains)


def read_activities(spark: SparkSession, path: str) -> DataFrame:
    """activity_id, pos, t, power of a folder of activity files: numbered from 0 in order of their names.

    Columns are found by name in each file's own header; files without power have no rows and no number.
    """
    lines = spark.read.text(path).select(F.col(_FILE).alias("series_id"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"), F.split("value", ",").alias("_v"))
    heads = lines.where("_block = 0").groupBy("series_id").agg(F.min_by("_v", "_line").alias("_h"), F.min("_line").alias("_first"))  # one row a file
    clean = F.transform("_h", lambda c: F.lower(F.btrim(c, F.lit(" \t\r\"\ufeff"))))
    heads = heads.withColumn("_h", clean).where(F.array_contains("_h", "power"))
    place = lambda name: F.array_position("_h", name).cast("int")
    time = F.when(place("datetime") > 0, place("datetime")).when(place("timestamp") > 0, place("timestamp")).otherwise(F.lit(1))
    rows = lines.join(heads, "series_id").where("_line <> _first").withColumns({"_t": F.get("_v", time - 1), "_p": F.get("_v", place("power") - 1)})
    t = F.coalesce(F.expr("try_cast(_t AS double)"), F.unix_micros(F.expr("try_cast(_t AS timestamp)")) / 1e6)
    rows = _numbered(rows.select("series_id", t.alias("t"), F.expr("try_cast(_p AS double)").alias("power")).where("t is not null"))
    names = rows.select("series_id").distinct().withColumn("activity_id", F.row_number().over(Window.orderBy("series_id")).cast("long") - 1)  # one row a file
    return rows.join(names, "series_id").select("activity_id", F.col("event_id").alias("pos"), "t", "power")


def read_benchmark(spark: SparkSession, description: str, folder: str) -> DataFrame:
    """dataset, window_size, cps, series: lines `name,window,cp,...` and a file of numbers per name."""
    d = spark.read.text(description).select(F.split("value", ",").alias("p")).where("size(p) >= 2")
    d = d.select(F.col("p")[0].alias("dataset"), F.col("p")[1].cast("long").alias("window_size"), F.slice("p", 3, F.size("p")).cast("array<bigint>").alias("cps"))
    files = spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.regexp_extract(F.col(_FILE), r"([^/]+)\.txt$", 1).alias("dataset"), F.split(F.btrim("value", F.lit(" \t\r\n")), r"\s+").cast("array<double>").alias("series"))
    return d.join(files, "dataset")


def parse_annotated(df: DataFrame, column: str, dimensions: int) -> DataFrame:
    """Series written as list literals, as arrays: column becomes array<array<double>> of so many dimensions."""
    return df.withColumn(column, F.from_json(column, "array<array<double>>")).where(F.forall(column, lambda x: F.size(x) == dimensions))


def anchored_slice(df: DataFrame, threshold: float, n: int, before: int = 10) -> DataFrame:
    """n rows of each series from `before` rows ahead of the first power above threshold; pos is the row's number."""
    rows = df.withColumn("pos", F.row_number().over(Window.partitionBy("series_id").orderBy("t", "event_id")) - 1)
    start = rows.where(F.col("power") > threshold).groupBy("series_id").agg(F.greatest(F.min("pos") - before, F.lit(0)).alias("_s"))
    return rows.join(start, "series_id").where(F.col("pos").between(F.col("_s"), F.col("_s") + n - 1)).drop("_s")


def first_power(columns: list[str]) -> str:
    """The first column named power, on its own or as the first part of a two-part name; an error if there is none."""
    for c in columns:
        if c.split(".")[0].strip("()' ").split(",")[0].strip("' ") == "power":
            return c
    raise ValueError("no power column")


def read_annotated(spark: SparkSession, path: str, place: str = "indoor") -> DataFrame:
    """dataset, window_size, cps, labels, series array<array<double>>: a CSV of list literals, a row a series.

    place: indoor series have 9 channels and outdoor ones 6; rows of another width are an error when they are read.
    """
    width = {"indoor": 9, "outdoor": 6}[place]
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    rows = raw.select("dataset", F.col("window_size").cast("long"), F.from_json("change_points", "array<bigint>").alias("cps"), F.split(F.regexp_replace("labels", r"[\[\]'\s]", ""), ",").alias("labels"), F.from_json("time_series", "array<array<double>>").alias("series"))
    sound = F.forall("series", lambda x: F.size(x) == width)
    return rows.withColumn("series", F.when(sound, F.col("series")).otherwise(F.raise_error(F.lit(f"a series of other than {width} channels")).cast("array<array<double>>")))


def meter_score(rules: list[tuple[Column, int]]) -> Column:
    """The points of the first rule that holds, else 0."""
    if not rules:
        return F.lit(0)
    return reduce(lambda col, r: col.when(r[0], r[1]), rules[1:], F.when(*rules[0])).otherwise(0)


def best_meter(meters: DataFrame, rules: list[tuple[Column, int]], order: str) -> DataFrame:
    """The meter of most points over 0, the first in order of those."""
    scored = meters.withColumn("score", meter_score(rules)).where("score > 0")
    return scored.orderBy(F.desc("score"), order).limit(1)
