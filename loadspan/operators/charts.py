"""Tables that charts are drawn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def cluster_centres(df: DataFrame) -> DataFrame:
    """label, pos, value: mean sample at each position that all of a cluster's sequences reach."""
    shortest = df.groupBy("label").agg(F.min(F.size("samples")).alias("_n"))
    rows = df.join(shortest, "label").select("label", "_n", F.posexplode("samples").alias("pos", "value"))
    return rows.where("pos < _n").groupBy("label", "pos").agg(F.avg("value").alias("value"))


def stacked(df: DataFrame, n: int = 50) -> DataFrame:
    """The first n rows of each cluster by id."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def sampled(df: DataFrame, n: int = 200, seed: int = 42, key: str = "id") -> DataFrame:
    """n rows without replacement, the same for the same seed whatever the partitioning (a row's place is a hash of its key)."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def showcase(primitives: DataFrame, runs: DataFrame, n: int = 10) -> DataFrame:
    """activity_id, n_changed, n_rle, n_seg of the n activities that merging changes most."""
    segments = primitives.groupBy("activity_id").agg(F.count(F.lit(1)).alias("n_seg"))
    merged = runs.groupBy("activity_id").agg(F.count(F.lit(1)).alias("n_rle"))
    both = segments.join(merged, "activity_id").select("activity_id", (F.col("n_seg") - F.col("n_rle")).alias("n_changed"), "n_rle", "n_seg")
    return both.orderBy(F.desc("n_changed"), F.desc("n_rle"), F.desc("n_seg"), "activity_id").limit(n)


def boundaries(segments: DataFrame, points: DataFrame) -> DataFrame:
    """points with boundary: a segment of the activity other than the first begins there."""
    starts = segments.where("start > 0").select("series_id", "activity_id", F.col("start").alias("pos"), F.lit(True).alias("boundary"))
    return points.join(starts, ["series_id", "activity_id", "pos"], "left").fillna(False, ["boundary"])


def reconstructed(primitives: DataFrame) -> DataFrame:
    """activity_id, pos and the channels of primitives (activity_id, start, samples) laid end to end."""
    rows = primitives.select("activity_id", "start", F.posexplode("samples").alias("_i", "_s"))
    return rows.select("activity_id", (F.col("start") + F.col("_i")).alias("pos"), "_s.*")


def label_spans(primitives: DataFrame) -> DataFrame:
    return primitives.select("activity_id", "label", "start", (F.col("start") + F.col("length")).alias("stop"))


def projected(features: DataFrame) -> DataFrame:
    """id, x, y: the two first principal components (in place of a neighbour embedding)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = features.select("id", array_to_vector("features").alias("v"))
    out = PCA(k=2, inputCol="v", outputCol="p").fit(rows).transform(rows).select("id", vector_to_array("p").alias("p"))
    return out.select("id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
