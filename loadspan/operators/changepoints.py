"""Change points of many series against one another, as DataFrames: truth and found tables of series_id and s (n in truth)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loadspan.kernels import evaluation


def pieces(cps: DataFrame) -> DataFrame:
    """series_id, s, e, n: from each change point (0 among them) to the next, the last to the end."""
    following = F.lead("s").over(Window.partitionBy("series_id").orderBy("s"))
    return cps.withColumn("e", F.coalesce(following, F.col("n"))).where("e > s")


def covering(truth: DataFrame, found: DataFrame) -> DataFrame:
    """series_id, covering: the true pieces, by length, each with its greatest Jaccard overlap with a found piece.

    Only pieces that overlap can count, so each is met by those that share one of its stretches between the cuts of both.
    """
    a = pieces(truth).select("series_id", F.col("s").alias("s1"), F.col("e").alias("e1"), "n")
    b = pieces(found).select("series_id", F.col("s").alias("s2"), F.col("e").alias("e2"))
    both = F.greatest(F.lit(0), F.least("e1", "e2") - F.greatest("s1", "s2"))
    pairs = a.join(b, (a.series_id == b.series_id) & (F.col("s1") < F.col("e2")) & (F.col("s2") < F.col("e1"))).select(a.series_id, "s1", "e1", "n", (both / (F.col("e1") - F.col("s1") + F.col("e2") - F.col("s2") - both)).alias("j"))
    best = pairs.groupBy("series_id", "s1", "e1", "n").agg(F.max("j").alias("j"))
    return best.groupBy("series_id").agg((F.sum((F.col("e1") - F.col("s1")) * F.col("j")) / F.max("n")).alias("covering"))


def _nearest(points: DataFrame, base: DataFrame) -> DataFrame:
    """series_id, s, base: the nearest base point of each point, the lower one if two are; by one sort of both."""
    both = points.select("series_id", "s", F.lit(0).alias("_b")).unionByName(base.select("series_id", "s", F.lit(1).alias("_b")))
    w = Window.partitionBy("series_id").orderBy("s", F.desc("_b"))
    is_base = F.when(F.col("_b") == 1, F.col("s"))
    both = both.withColumns({"_lo": F.last(is_base, ignorenulls=True).over(w), "_hi": F.first(is_base, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))}).where("_b = 0")
    lower = F.col("_hi").isNull() | (F.col("s") - F.col("_lo") <= F.col("_hi") - F.col("s"))
    return both.select("series_id", "s", F.when(lower & F.col("_lo").isNotNull(), F.col("_lo")).otherwise(F.col("_hi")).alias("base"))


def nearest_distance(points: DataFrame, base: DataFrame) -> DataFrame:
    return _nearest(points, base).select("series_id", "s", F.abs(F.col("s") - F.col("base")).alias("distance"))


def synthesised(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """series_id, base, change_point: each point of the shorter list joins the nearest of the longer; groups' means."""
    both = longer.select("series_id", F.col("s").alias("base"), "s").unionByName(_nearest(shorter, longer).select("series_id", "base", "s"))
    return both.groupBy("series_id", "base").agg(F.avg("s").alias("change_point"))


def segmentation_rates(counts: DataFrame) -> DataFrame:
    """series_id, osr, usr from numbers of found (m) and true (r) points."""
    rate = lambda a, b: F.greatest(F.lit(0), F.col(a) - F.col(b)) / F.greatest(F.lit(1), F.col("r"))
    return counts.select("series_id", rate("m", "r").alias("osr"), rate("r", "m").alias("usr"))


def compared(rows: DataFrame) -> DataFrame:
    """series_id and the comparison of found with truth (arrays, and the length n), matched greedily."""
    names = ["f1@0.005", "f1@0.01", "f1@0.02", "f1@0.05", "osr", "usr", "d_nn"]
    out = ["f1_0_5", "f1_1", "f1_2", "f1_5", "osr", "usr", "d_nn"]

    def run(parts):
        for part in parts:
            got = [evaluation.comparison(t, f, n) for t, f, n in zip(part["truth"], part["found"], part["n"])]
            yield pd.DataFrame({"series_id": part["series_id"], **{o: [g[k] for g in got] for k, o in zip(names, out)}})

    return rows.mapInPandas(run, "series_id long, " + ", ".join(f"{o} double" for o in out))
