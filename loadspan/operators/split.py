"""Seeded train/test splits of activities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def ratio_count(n: int, ratio: float) -> int:
    """n times ratio (kept to 0 to 1), rounded half to even."""
    return round(n * min(1.0, max(0.0, ratio)))


def drawn(ids: list, ratio: float, rng: np.random.Generator) -> tuple[list, list]:
    """(chosen, others), each in the order given; an empty list leaves rng as it is."""
    if not ids:
        return [], []
    chosen = set(rng.permutation(len(ids))[: ratio_count(len(ids), ratio)].tolist())
    return [x for i, x in enumerate(ids) if i in chosen], [x for i, x in enumerate(ids) if i not in chosen]


def assigned(spark: SparkSession, few: DataFrame, others: DataFrame, few_ratio: float = 0.5, other_ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """activity_id, part (few_train, few_test, non_train, non_test), from one random stream: few-shot activities first.

    Activities are the units of a split and are listed on the driver, one id each."""
    rng = np.random.default_rng(seed)
    rows = []
    for name, table, ratio in (("few", few, few_ratio), ("non", others, other_ratio)):
        train, test = drawn([r[0] for r in table.select("activity_id").distinct().orderBy("activity_id").collect()], ratio, rng)
        rows += [(x, f"{name}_train") for x in train] + [(x, f"{name}_test") for x in test]
    return spark.createDataFrame(rows, "activity_id long, part string")


#: What each dataset takes out of the series.
REMOVED = {"train": ("few_test", "non_test"), "test_a": ("few_train", "non_train"), "test_b": ("few_train", "non_train", "non_test")}
