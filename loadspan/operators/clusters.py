"""Analytics on clustered feature rows: id, features array<double>, label int (-1: noise), activity_id, pos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loadspan.functions.windows import neighbour_labels
from loadspan.operators.pairwise import distance_sums

NOISE = -1


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def finite_rows(df: DataFrame) -> DataFrame:
    """Rows whose features are all finite."""
    return df.where(F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def nan_to_zero(df: DataFrame) -> DataFrame:
    return df.withColumn("features", F.transform("features", lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)))


def long_form(df: DataFrame) -> DataFrame:
    return df.select("*", F.posexplode("features").alias("dim", "value"))


def label_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def fewshot(df: DataFrame, method: str = "avg_percent", amount: float = 50.0) -> DataFrame:
    """label, n of the small clusters: under amount percent of the mean size, or under amount rows. Noise never counts."""
    if amount < 0:
        raise ValueError("amount must not be negative")
    sizes = label_histogram(df).where(F.col("label") != NOISE)
    if method in ("avg_percent", "percent_avg", "avg_ratio", "ratio"):
        mean = F.avg("n").over(Window.partitionBy(F.lit(1)))
        return sizes.withColumn("_m", mean).where(F.col("n") < F.col("_m") * amount / 100).drop("_m").orderBy("n", "label")
    if method == "threshold":
        return sizes.where(F.col("n") < amount).orderBy("n", "label")
    raise ValueError(f"unknown method {method!r}")


def min_cluster_share(df: DataFrame) -> DataFrame:
    sizes = label_histogram(df).where(F.col("label") != NOISE)
    return sizes.agg(F.round(F.min("n") / F.sum("n"), 5).alias("share"))


def centroids(df: DataFrame) -> DataFrame:
    """label, dim, value: mean vectors of the clusters in long form."""
    return long_form(df.where(F.col("label") != NOISE)).groupBy("label", "dim").agg(F.avg("value").alias("value"))


def centroid_vectors(df: DataFrame) -> DataFrame:
    """label, centroid array<double>."""
    pairs = F.sort_array(F.collect_list(F.struct("dim", "value")))
    return centroids(df).groupBy("label").agg(F.transform(pairs, lambda p: p["value"]).alias("centroid"))


def zscored(df: DataFrame) -> DataFrame:
    """df with features scaled by population mean and deviation of each dimension (a deviation of 0 divides by 1)."""
    stats = long_form(df).groupBy("dim").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return _scaled(df, stats.select("dim", "m", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("s")))


def minmax_scaled(df: DataFrame) -> DataFrame:
    """df with features scaled to [0, 1] in each dimension (a constant dimension is 0)."""
    stats = long_form(df).groupBy("dim").agg(F.min("value").alias("m"), (F.max("value") - F.min("value")).alias("s"))
    return _scaled(df, stats.select("dim", "m", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("s")))


def clipped_minmax(df: DataFrame, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """df with each dimension clipped to its exact percentiles and scaled to [0, 1]."""
    stats = long_form(df).groupBy("dim").agg(F.percentile("value", F.array(F.lit(lo), F.lit(hi))).alias("p"))
    stats = stats.select("dim", F.col("p")[0].alias("m"), F.when(F.col("p")[1] > F.col("p")[0], F.col("p")[1] - F.col("p")[0]).otherwise(1.0).alias("s"), F.col("p")[1].alias("h"))
    return _scaled(df, stats, lambda x, r: F.greatest(F.least(x, r["h"]), r["m"]))


def _scaled(df: DataFrame, stats: DataFrame, first=lambda x, r: x) -> DataFrame:
    fields = stats.columns
    table = stats.agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_t"))  # one row, as long as a feature vector
    both = df.crossJoin(F.broadcast(table))
    scaled = F.transform("features", lambda x, i: (first(x, F.get("_t", i)) - F.get("_t", i)["m"]) / F.get("_t", i)["s"])
    return both.withColumn("features", scaled).drop("_t")


def sequence_znorm(df: DataFrame) -> DataFrame:
    """df with each row's features as deviations from their own mean, over their own deviation + 1e-8."""
    n = F.size("features")
    total = lambda f: F.aggregate("features", F.lit(0.0), lambda s, x: s + f(x))
    # arrays of one bind the mean and then the deviation, so that neither is computed for every element
    bound = F.transform(
        F.array(total(lambda x: x) / n),
        lambda m: F.transform(F.array(F.sqrt(total(lambda x: (x - m) * (x - m)) / n)), lambda s: F.transform("features", lambda x: (x - m) / (s + 1e-8)))[0],
    )
    return df.withColumn("features", bound[0])


def nearest_centroid(df: DataFrame, centres: DataFrame) -> DataFrame:
    """id, label, nearest, d2: the nearest of few centroids, ties to the smallest label.

    One row per cluster is collected into an array, so the rows of df do not multiply."""
    table = centres.agg(F.sort_array(F.collect_list(F.struct("label", "centroid"))).alias("_c"))
    found = F.array_min(F.transform("_c", lambda c: F.struct(squared(F.col("features"), c["centroid"]).alias("d2"), c["label"].alias("label"))))
    return df.crossJoin(F.broadcast(table)).withColumn("_f", found).select("id", "label", F.col("_f.label").alias("nearest"), F.col("_f.d2").alias("d2"))


def silhouette(df: DataFrame, metric: str = "euclidean") -> DataFrame:
    """id, label, score for rows that are not noise; 0 in clusters of one row."""
    sums = distance_sums(df.where(F.col("label") != NOISE), metric)
    own = F.col("other") == F.col("label")
    rows = sums.groupBy("id", "label").agg(
        F.max(F.when(own, F.col("n"))).alias("n"), F.max(F.when(own & (F.col("n") > 0), F.col("total") / F.col("n"))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b")
    )
    score = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return rows.select("id", "label", score.alias("score"))


def davies_bouldin(df: DataFrame) -> DataFrame:
    """One row: dbi, the mean over clusters of the greatest (scatter + scatter) / distance of centroids."""
    spread = _spread(df)
    other = spread.select(F.col("label").alias("l2"), F.col("centroid").alias("c2"), F.col("scatter").alias("s2"))
    pairs = spread.crossJoin(other).where("label <> l2")  # one row per cluster on either side
    worst = pairs.groupBy("label").agg(F.max((F.col("scatter") + F.col("s2")) / F.sqrt(squared(F.col("centroid"), F.col("c2")))).alias("r"))
    return worst.agg(F.avg("r").alias("dbi"))


def _spread(df: DataFrame) -> DataFrame:
    """label, centroid, n, scatter (mean distance to the centroid), within (sum of squares)."""
    centres = centroid_vectors(df)
    rows = df.where(F.col("label") != NOISE).join(centres, "label").withColumn("d2", squared(F.col("features"), F.col("centroid")))
    sums = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(F.sqrt("d2")).alias("scatter"), F.sum("d2").alias("within"))
    return centres.join(sums, "label")


def calinski_harabasz(df: DataFrame) -> DataFrame:
    """One row: chi, between-cluster over within-cluster variance."""
    rows = df.where(F.col("label") != NOISE)
    mean = long_form(rows).groupBy("dim").agg(F.avg("value").alias("value"))
    mean = mean.agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda p: p["value"]).alias("mean"))
    spread = _spread(df).crossJoin(mean)
    sums = spread.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("within").alias("w"), F.sum(F.col("n") * squared(F.col("centroid"), F.col("mean"))).alias("b"))
    return sums.select((F.col("b") * (F.col("n") - F.col("k")) / (F.col("w") * (F.col("k") - 1))).alias("chi"))


def rank_sum(metrics: DataFrame, key: str = "k") -> DataFrame:
    """key and rank_sum of (key, sci, dbi, dbcv): positions by ascending dbi, descending sci and dbcv, ties by key."""
    everything = Window.partitionBy(F.lit(1))  # one row per candidate
    rank = lambda c: F.row_number().over(everything.orderBy(c, key)) - 1
    return metrics.select(key, (rank(F.asc("dbi")) + rank(F.desc("sci")) + rank(F.desc("dbcv"))).alias("rank_sum"))


def adjacency(df: DataFrame, small: DataFrame, big: DataFrame) -> DataFrame:
    """label, dominant, hits, n_adjacent, adj_ratio for each small cluster: its most frequent big neighbour in time.

    A row hits once for each of its two neighbours in the dominant cluster, and counts once if either is big, so the
    ratio may reach 2. Ties go to the smallest label.
    """
    rows = neighbour_labels(df).join(small.select("label"), "label", "left_semi")
    sides = rows.select("id", "label", F.explode(F.array("prev_label", "next_label")).alias("side")).where("side is not null")
    sides = sides.join(big.select(F.col("label").alias("side")), "side", "left_semi")
    hits = sides.groupBy("label", "side").agg(F.count(F.lit(1)).alias("hits"))
    best = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("hits"), "side"))
    hits = hits.withColumn("_b", best).where("_b = 1").select("label", F.col("side").alias("dominant"), "hits")
    near = sides.groupBy("label").agg(F.count_distinct("id").alias("n_adjacent"))
    return hits.join(near, "label").withColumn("adj_ratio", F.col("hits") / F.col("n_adjacent"))


def centre_support(df: DataFrame, dominant: DataFrame, big: DataFrame, margin: float = 0.1) -> DataFrame:
    """label, centre_support: the share of a cluster's rows whose nearest big centroid is the dominant one and clearly
    (by margin) nearer than their own."""
    centres = centroid_vectors(df)
    rows = df.join(dominant.select("label", "dominant"), "label").join(centres, "label")
    best = nearest_centroid(rows, centres.join(big.select("label"), "label", "left_semi")).select("id", "nearest", "d2")
    rows = rows.join(best, "id").withColumn("own", F.sqrt(squared(F.col("features"), F.col("centroid"))))
    yes = (F.col("nearest") == F.col("dominant")) & (F.sqrt("d2") < F.col("own") * (1 - margin))
    return rows.groupBy("label").agg(F.avg(yes.cast("double")).alias("centre_support"))


def artifact_report(df: DataFrame, small: DataFrame, adj_least: float = 0.6, margin: float = 0.1, support_least: float = 0.6) -> DataFrame:
    """label, dominant, adj_ratio, centre_support, artifact for each small cluster (both ratios at least as given)."""
    big = label_histogram(df).where(F.col("label") != NOISE).join(small.select("label"), "label", "left_anti")
    near = adjacency(df, small, big)
    support = centre_support(df, near, big, margin)
    rows = small.select("label").join(near, "label", "left").join(support, "label", "left")
    yes = (F.col("adj_ratio") >= adj_least) & (F.col("centre_support") >= support_least)
    return rows.select("label", "dominant", "adj_ratio", "centre_support", F.coalesce(yes, F.lit(False)).alias("artifact"))


def label_runs(df: DataFrame) -> DataFrame:
    """activity_id, block_id (from 0), label, first_pos, last_pos, n_segments, members: runs of equal labels in time."""
    w = Window.partitionBy("activity_id").orderBy("pos")
    rows = df.withColumn("_f", F.when(F.lag("label").over(w) == F.col("label"), 0).otherwise(1)).withColumn("block_id", F.sum("_f").over(w) - 1)
    return rows.groupBy("activity_id", "block_id", "label").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("n_segments"), F.sort_array(F.collect_list("id")).alias("members")
    )


def run_features(df: DataFrame, runs: DataFrame, weight: str = "length") -> DataFrame:
    """activity_id, block_id, dim, value: features of a run's members averaged by weight (a total below 1 counts as 1)."""
    members = runs.select("activity_id", "block_id", F.explode("members").alias("id"))
    rows = long_form(df.select("id", "features", weight)).join(members, "id")
    total = F.sum(F.col("value") * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1))
    return rows.groupBy("activity_id", "block_id", "dim").agg(total.alias("value"))


def state_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("label").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("n_segments").alias("n_segments"))


def merged_summary(blocks: DataFrame, seconds_per_sample: float = 6.0) -> DataFrame:
    """label, n_blocks, n_segments, n_samples, seconds, absorbed_labels (distinct, sorted) of merged blocks."""
    absorbed = F.array_sort(F.array_distinct(F.flatten(F.collect_list("absorbed_labels"))))
    rows = blocks.groupBy("label").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("n_segments").alias("n_segments"), F.sum("length").alias("n_samples"), absorbed.alias("absorbed_labels"))
    return rows.withColumn("seconds", F.col("n_samples") * seconds_per_sample)


def merge_metrics(runs: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: segments, blocks before and after merging, their ratio (4 digits), segments absorbed, blocks of similar neighbours."""
    before = runs.agg(F.sum("n_segments").alias("n_segments"), F.count(F.lit(1)).alias("n_blocks_before"))
    after = blocks.agg(F.count(F.lit(1)).alias("n_blocks_after"), F.sum("n_absorbed").alias("n_absorbed"), F.count_if("similar_merged").alias("n_similar_merges"))
    ratio = F.round(F.col("n_blocks_after") / F.greatest(F.col("n_blocks_before"), F.lit(1)), 4)
    return before.join(after, F.lit(True)).withColumn("merge_ratio", ratio)  # one row each


def by_size(df: DataFrame) -> DataFrame:
    """label, n: clusters from small to large, equal ones by label."""
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "label")


def common_cycles(a: DataFrame, b: DataFrame, key: str = "activity_id") -> DataFrame:
    """Keys that both tables have, each once."""
    return a.select(key).distinct().join(b.select(key).distinct(), key)


def training_ids(df: DataFrame, held_back: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not among those held back."""
    return df.join(held_back.select(key), key, "left_anti")


def explained_variance(features: DataFrame, k: int = 6) -> DataFrame:
    """component (from 1), ratio: shares of variance of at most k principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    first = features.select(F.size("features").alias("n")).first()
    if first is None:
        return features.sparkSession.createDataFrame([], "component int, ratio double")
    model = PCA(k=min(k, first.n), inputCol="v", outputCol="p").fit(features.select(array_to_vector("features").alias("v")))
    return features.sparkSession.createDataFrame([(i + 1, float(x)) for i, x in enumerate(model.explainedVariance)], "component int, ratio double")
