"""The whole run from a series to split datasets, and its command line."""

from __future__ import annotations

import argparse
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadspan.operators import activity, blocks, clusters, intervals, mapping, segmentation, split
from loadspan.operators.autoencoder import dense_autoencoder
from loadspan.plans.manifest import FeatureCache, RunManifest, Workflow, feature_key, parse_int_list, parse_steps, resolve_selection
from loadspan.sources.readers import read_csv, read_npy, read_text


# Names of the feature models that the dense autoencoder stands in for.
ENCODERS = ("autoencoder", "lstm_ae", "bilstm_ae", "bilstm_ae_attention", "cnn_ae", "detsec", "detsec_pc")


def _features(points: DataFrame, segments: DataFrame, model: str) -> DataFrame:
    if model != "dtw":
        if model not in ENCODERS:
            raise ValueError(f"{model} is not one of dtw, {', '.join(ENCODERS)}")
        if model != "autoencoder":
            warnings.warn(f"{model} needs a deep-learning library; the dense autoencoder stands in for it", stacklevel=2)
    named = segments.withColumn("id", F.row_number().over(_order()).cast("long") - 1)
    rows = mapping.segment_points(named.select("id", "activity_id", "start", "length"), points.select("activity_id", "pos", "power"))
    samples = rows.groupBy("id", "activity_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "power"))), lambda x: F.coalesce(x["power"], F.lit(0.0))).alias("samples"))
    made = segmentation.dtw_features(samples.select("id", "samples")) if model == "dtw" else dense_autoencoder(samples.select("id", "samples"))
    return made.join(named.select("id", "activity_id", "start", "length"), "id")


def _order():
    from pyspark.sql import Window

    return Window.orderBy("series_id", "activity_id", "start")  # one row a segment


def _numbered(activities: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with activity_id numbered through all series, so that later steps may join on it alone."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.orderBy("series_id", "activity_id")).cast("long") - 1  # one row an activity
    ids = activities.select("series_id", "activity_id").withColumn("_id", number)
    return tuple(df.join(ids, ["series_id", "activity_id"]).withColumn("activity_id", F.col("_id")).drop("_id") for df in (activities, points))


def build(spark: SparkSession, manifest: RunManifest, steps: list[str], chosen: dict, raw: DataFrame, mains: DataFrame | None = None, tag: str | None = None, detector=None, cache: str | None = None) -> Workflow:
    """A workflow of the steps; each reads its input from the context, else from what the manifest names."""
    root = manifest.root
    detector = detector or activity.SimpleThreshold()

    def table(context: dict, kind: str, key: str) -> DataFrame:
        return context[key] if key in context else spark.read.parquet(manifest.artifact(kind, key))

    def keep(kind: str, key: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{kind}/{key}")
        manifest.add_artifact(kind, key, f"{kind}/{key}")
        return spark.read.parquet(f"{root}/{kind}/{key}")

    def extract(context, m):
        found = detector.train(raw)
        activities, points = _numbered(found.detect(raw), found.points(raw))
        return {"activities": keep("extract_active_data", "activities", activities), "points": keep("extract_active_data", "points", points)}

    def segment(context, m):
        points = table(context, "extract_active_data", "points")
        return {"segments": keep("time_segmentation", "segments", segmentation.segmented(points, chosen["segment_method"]))}

    def feature(context, m):
        points, segments = table(context, "extract_active_data", "points"), table(context, "time_segmentation", "segments")
        make = lambda: _features(points, segments, chosen["feature_model"])
        if cache:
            samples = feature_key(points.select("series_id", "activity_id", "pos", "power"), chosen["feature_model"], {})
            return {"features": keep("feature_extract", "features", FeatureCache(spark, cache).through(feature_key(segments, chosen["feature_model"], {"samples": samples}), make)[0])}
        return {"features": keep("feature_extract", "features", make())}

    def cluster(context, m):
        features = clusters.zscored(clusters.finite_rows(table(context, "feature_extract", "features")))
        labels = keep("time_clustering", "labels", segmentation.clustered(features, chosen["cluster_method"], chosen["n_clusters"]))
        for r in labels.select("tag").distinct().collect():
            m.add_cluster_result(r[0], {"labels": "time_clustering/labels"})
        return {"labels": labels}

    def labelled(context) -> DataFrame:
        which = manifest.resolve_tag(tag)
        labels = table(context, "time_clustering", "labels").where(F.col("tag") == which)
        return table(context, "feature_extract", "features").join(labels.drop("tag"), "id").withColumn("pos", F.col("start"))

    def state_merge(context, m):
        features = clusters.zscored(clusters.finite_rows(table(context, "feature_extract", "features")))
        labels = table(context, "time_clustering", "labels")
        merged = None
        for t in m.unmerged_tags():
            one = blocks.merged_activities(features.join(labels.where(F.col("tag") == t), "id"), tolerance=2.0).withColumn("tag", F.lit(f"{t}_merged"))
            merged = one if merged is None else merged.unionByName(one)
            m.add_cluster_result(f"{t}_merged", {"blocks": "temporal_state_merge/blocks"}, kind="temporal_state_merge")
        return {"blocks": keep("temporal_state_merge", "blocks", merged)}

    def fewshot(context, m):
        rows = labelled(context)
        small = clusters.fewshot(rows)
        report = clusters.artifact_report(rows, small)
        return {"report": keep("few_shot_cluster_extract", "report", small.join(report, "label"))}

    def pam(context, m):
        rows, acts = labelled(context), table(context, "extract_active_data", "activities")
        small = table(context, "few_shot_cluster_extract", "report").where(~F.col("artifact")).select("label")
        few, others = mapping.fewshot_activities(acts, rows.select("activity_id", "label"), small)
        return {"few": keep("primitive_activity_mapping", "few", few), "others": keep("primitive_activity_mapping", "others", others)}

    def split_(context, m):
        few, others = table(context, "primitive_activity_mapping", "few"), table(context, "primitive_activity_mapping", "others")
        parts = split.assigned(spark, few, others)
        spans = few.unionByName(others).join(parts, "activity_id")
        both = intervals.aligned(raw, mains if mains is not None else raw)
        out = {}
        for name, gone in split.REMOVED.items():
            dropped = intervals.dropped(both, spans.where(F.col("part").isin(*gone)).select("series_id", "start_t", "end_t"))
            out[name] = keep("dataset_split", name, intervals.knocked_out(dropped))
        return out

    made = {"extract": extract, "segment": segment, "feature": feature, "cluster": cluster, "state_merge": state_merge, "fewshot": fewshot, "pam": pam, "split": split_}
    kinds = {"extract": "extract_active_data", "segment": "time_segmentation", "feature": "feature_extract", "cluster": "time_clustering", "state_merge": "temporal_state_merge", "fewshot": "few_shot_cluster_extract", "pam": "primitive_activity_mapping", "split": "dataset_split"}
    flow = Workflow(manifest)
    for s in steps:
        flow.add(kinds[s], made[s])
    return flow


def main(argv: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(description="From a load series to activities, segments, clusters and datasets.")
    for name in ("steps", "segment-method", "feature-model", "cluster-method", "n-clusters", "cluster-tag", "appliance", "run-id", "raw-series", "mains-series", "out"):
        p.add_argument(f"--{name}", default="")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    chosen = resolve_selection({"segment_method": a.segment_method, "feature_model": a.feature_model, "cluster_method": a.cluster_method, "n_clusters": parse_int_list(a.n_clusters) if a.n_clusters else None}, {})
    read = lambda path: {"npy": read_npy, "dat": read_text, "txt": read_text}.get(path.rsplit(".", 1)[-1], read_csv)(spark, path).withColumn("series_id", F.lit(0).cast("long"))
    manifest = RunManifest(a.out or "runs", a.run_id or "run", a.appliance)
    manifest.set_variants(**chosen)
    mains = read(a.mains_series) if a.mains_series else None
    return build(spark, manifest, parse_steps(a.steps or "extract,segment,feature"), chosen, read(a.raw_series), mains, a.cluster_tag or None).run()


if __name__ == "__main__":
    main()
