"""Run manifests, a content-addressed feature cache and the linear pipeline."""

from __future__ import annotations

import hashlib
import json
import uuid
import os
import tempfile
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The steps in their order, and the defaults of a run.
STEPS = ["extract", "segment", "feature", "cluster", "state_merge", "fewshot", "pam", "split"]
DEFAULTS = {"segment_method": "clasp", "feature_model": "detsec", "cluster_method": "kmeans", "n_clusters": [3, 4, 5]}


def parse_steps(text: str) -> list[str]:
    """Steps in their own order whatever the order given; none or 'all' is every step."""
    asked = [s.strip() for s in (text or "").split(",") if s.strip()]
    if not asked or asked == ["all"]:
        return list(STEPS)
    if unknown := [s for s in asked if s not in STEPS]:
        raise ValueError(f"unknown steps: {', '.join(unknown)}")
    return [s for s in STEPS if s in asked]


def parse_int_list(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x.strip()]


def resolve_selection(cli: dict, config: dict) -> dict:
    """What the command line says, else the configuration, else the defaults."""
    first = lambda k: next((s[k] for s in (cli, config) if s.get(k) not in (None, "", [])), DEFAULTS[k])
    found = {k: first(k) for k in DEFAULTS}
    if isinstance(found["n_clusters"], str):
        found["n_clusters"] = parse_int_list(found["n_clusters"])
    return found


def _replace(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=path.parent, delete=False) as f:
        f.write(text)
    os.replace(f.name, path)


class RunManifest:
    """What the steps of a run left where: one small JSON file, replaced as a whole."""

    def __init__(self, root: str, run_id: str, appliance: str = ""):
        self.path = Path(root) / run_id / "manifest.json"
        self.root = self.path.parent
        self.data = json.loads(self.path.read_text()) if self.path.exists() else {"run_id": run_id, "appliance": appliance, "variants": {}, "steps": {}}

    def set_variants(self, **chosen) -> None:
        self.data["variants"] |= chosen

    def add_step(self, kind: str, artifacts: dict | None = None, **info) -> None:
        """Takes the place of an earlier entry of the kind, but for its cluster results."""
        before = self.data["steps"].get(kind, {}).get("results")
        self.data["steps"][kind] = {"artifacts": artifacts or {}, **info} | ({"results": before} if before else {})

    def add_artifact(self, kind: str, key: str, path: str) -> None:
        self.data["steps"].setdefault(kind, {"artifacts": {}})["artifacts"][key] = path

    def add_cluster_result(self, tag: str, artifacts: dict, kind: str = "time_clustering") -> None:
        self.data["steps"].setdefault(kind, {"artifacts": {}}).setdefault("results", {})[tag] = artifacts

    def artifact(self, kind: str, key: str) -> str | None:
        path = self.data["steps"].get(kind, {}).get("artifacts", {}).get(key)
        return path and str(self.root / path)

    def cluster_artifact(self, tag: str, key: str, kind: str = "time_clustering") -> str | None:
        path = self.data["steps"].get(kind, {}).get("results", {}).get(tag, {}).get(key)
        return path and str(self.root / path)

    def cluster_tags(self, kind: str = "time_clustering") -> list[str]:
        return sorted(self.data["steps"].get(kind, {}).get("results", {}))

    def unmerged_tags(self) -> list[str]:
        return [t for t in self.cluster_tags() if not t.endswith("_merged")]

    def resolve_tag(self, tag: str | None = None) -> str:
        """The tag given, or the only one there is."""
        tags = self.cluster_tags()
        if tag:
            if tag not in tags:
                raise ValueError(f"no cluster result {tag}")
            return tag
        if len(tags) != 1:
            raise ValueError(f"name one of the cluster results: {', '.join(tags) or 'none'}")
        return tags[0]

    def save(self) -> None:
        _replace(self.path, json.dumps(self.data, indent=1, sort_keys=True))


class Workflow:
    """Runs steps in order on one context; the manifest is saved after each. A step is (kind, function of context and
    manifest giving a dict to add to the context)."""

    def __init__(self, manifest: RunManifest):
        self.manifest, self.steps = manifest, []

    def add(self, kind: str, step: Callable[[dict, RunManifest], dict | None]) -> Workflow:
        self.steps.append((kind, step))
        return self

    def run(self, context: dict | None = None) -> dict:
        context = dict(context or {})
        for kind, step in self.steps:
            context |= step(context, self.manifest) or {}
            if kind not in self.manifest.data["steps"]:
                self.manifest.add_step(kind)
            self.manifest.save()
        return context


def feature_key(df: DataFrame, model: str, config: dict, order: Iterable[str] = ("id",)) -> str:
    """64 hex digits that change with the rows, the model or its configuration, but not with partitioning or order."""
    rows = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h"))
    parts = rows.select([F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)").alias(f"p{i}") for i in range(4)])
    sums = parts.agg(F.count(F.lit(1)), *[F.sum(f"p{i}") for i in range(4)]).first()
    said = json.dumps([model, {k: v for k, v in config.items() if v is not None}, df.schema.simpleString(), [str(x) for x in sums]], sort_keys=True, default=str)
    return hashlib.sha256(said.encode()).hexdigest()


class FeatureCache:
    """Feature tables by key; an entry that can't be read is a miss."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def load(self, key: str) -> DataFrame | None:
        try:
            df = self.spark.read.parquet(f"{self.root}/features/{key}")
            return df if df.columns else None
        except Exception as e:  # noqa: BLE001  a missing or broken entry
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e) or "CANNOT_READ" in str(e):
                return None
            raise

    def store(self, key: str, df: DataFrame) -> DataFrame:
        """Writes beside the entry and renames, so that a write that is cut off leaves none; of two writers the first stays."""
        path, aside = f"{self.root}/features/{key}", f"{self.root}/features/_{key}-{uuid.uuid4().hex}"
        df.write.parquet(aside)
        jvm = self.spark.sparkContext._jvm
        there = jvm.org.apache.hadoop.fs.Path(path)
        fs = there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if self.load(key) is None:
            fs.delete(there, True)  # an entry that cannot be read
        if fs.exists(there) or not fs.rename(jvm.org.apache.hadoop.fs.Path(aside), there):
            fs.delete(jvm.org.apache.hadoop.fs.Path(aside), True)
        return self.spark.read.parquet(path)

    def through(self, key: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
        """(features, whether they were there already)."""
        found = self.load(key)
        return (found, True) if found is not None else (self.store(key, make()), False)
