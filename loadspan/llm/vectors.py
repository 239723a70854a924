"""Embedding near-duplicates by spherical k-means cells (operator 10).

Unit vectors are clustered on a bounded sample (SAMPLE vectors in the order of a hash; about the square root of the
table's size in cells). Every vector goes to its nearest cells and is compared within them by blocked products in double
precision; a pair that meets in several cells counts in the first. How many cells is measured: the fewest, NEAR at
least, with which QUERIES vectors of the sample meet RECALL of all their links in the sample, found by brute force; it
may come to all cells, which is exact. Equal vectors are one member that counts for all of them. Cells of more than CUT members are cut, and
each pair of cuts is a task of its own. Tasks return numbers of links and the links of a spanning forest, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadspan.llm.components import connected_components
from loadspan.llm.tables import partitions, written

SAMPLE = 20_000
NEAR = 3
RECALL, QUERIES = 0.97, 1024
CUT = 2048


def _units(vectors: list | np.ndarray, size: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors of the rows that have a direction, which rows those are); zeros fill them up to size at least."""
    size = max((len(v) for v in vectors if v is not None), default=size)
    clean = np.zeros((len(vectors), size))
    ok = np.zeros(len(vectors), bool)
    for i, v in enumerate(vectors):
        if v is not None and len(v):
            x = np.array([np.nan if e is None else e for e in v], np.float64)
            if np.isfinite(x).all() and (n := np.abs(x).max()) > 0:
                x = x / n
                clean[i, : len(x)], ok[i] = x / np.sqrt(x @ x), True
    return clean[ok], ok


def spherical_kmeans(units: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k unit centres."""
    if not len(units):
        return units
    centres = units[np.linspace(0, len(units) - 1, min(k, len(units))).astype(int)]
    for _ in range(rounds):
        of = np.concatenate([np.argmax(units[a : a + 4096] @ centres.T, axis=1) for a in range(0, len(units), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, of, units)
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-300)[:, None], centres)
    return centres


def breadth(units: np.ndarray, centres: np.ndarray, threshold: float, least: int = NEAR) -> int:
    """In how many nearest cells vectors must be for RECALL of the sample's links; least where it has none."""
    least = min(least, len(centres))
    at = np.unique(np.linspace(0, len(units) - 1, QUERIES).astype(int)) if len(units) else np.zeros(0, int)
    pairs = [np.argwhere(units[a : a + 512] @ units[at].T >= threshold) + (a, 0) for a in range(0, len(units), 512)]
    i, j = np.concatenate([*pairs, np.zeros((0, 2), int)]).T
    i, j = i[i != at[j]], at[j[i != at[j]]]
    if not len(i):
        return least
    some = np.linspace(0, len(i) - 1, min(len(i), 50_000)).astype(int)
    i, j = i[some], j[some]
    rank = np.argsort(np.argsort(-(units @ centres.T), axis=1, kind="stable"), axis=1).astype(np.int32)
    # a pair meets in its first common cell: the least over cells of the worse of its two ranks
    first = np.concatenate([np.maximum(rank[i[a : a + 4096]], rank[j[a : a + 4096]]).min(axis=1) for a in range(0, len(i), 4096)])
    return max(least, int(np.sort(first)[int(np.ceil(RECALL * len(first))) - 1]) + 1)


def _assigned(df: DataFrame, centres: np.ndarray, near: int) -> DataFrame:
    """(vec, weight, unit array<double>, cells array<int>) for rows (vec, weight, embedding), nearest cell first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, ok = _units(batch.column("embedding").to_pylist(), centres.shape[1])
            if not ok.any():
                continue
            cells = np.argsort(-(units[:, : centres.shape[1]] @ centres.T), axis=1, kind="stable")[:, :near].astype(np.int32)
            rows = batch.filter(pa.array(ok))
            listed = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.record_batch([rows.column("vec"), rows.column("weight"), listed(units), listed(cells)], names=["vec", "weight", "unit", "cells"])

    return df.mapInArrow(run, "vec long, weight long, unit array<double>, cells array<int>")


def _compare(rows: pd.DataFrame, cell: int, a: int, b: int, threshold: float) -> pd.DataFrame:
    units, cells = np.stack(rows["unit"].to_list()), np.stack(rows["cells"].to_list())
    vec, weight, cut = rows["vec"].to_numpy(), rows["weight"].to_numpy(), rows["cut"].to_numpy()
    left, right = np.flatnonzero(cut == a), np.flatnonzero(cut == b)
    links = np.zeros(len(rows), np.int64)
    root = list(range(len(rows)))
    joined: list[int] = [-1] * len(rows)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for s in range(0, len(left), 512):
        x, y = np.nonzero(units[left[s : s + 512]] @ units[right].T >= threshold)
        x, y = left[s + x], right[y]
        if a == b:
            x, y = x[x < y], y[x < y]
        shared = (cells[x][:, :, None] == cells[y][:, None, :]).any(axis=2)
        first = np.where(shared, cells[x], np.iinfo(np.int32).max).min(axis=1) == cell
        x, y = x[first], y[first]
        np.add.at(links, x, weight[y])
        np.add.at(links, y, weight[x])
        for i, j in zip(x.tolist(), y.tolist()):
            if joined[i] >= 0 and joined[i] == joined[j]:
                continue
            p, q = find(i), find(j)
            if p != q:
                root[max(p, q)] = min(p, q)
            joined[i] = joined[j] = min(p, q)
    tops = np.array([find(i) for i in range(len(rows))])
    some = (links > 0) | (tops != np.arange(len(rows)))
    return pd.DataFrame({"vec": vec[some], "links": links[some], "head": vec[tops[some]]})


def linked(df: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding", near: int = NEAR) -> DataFrame:
    """(key, n_links, component_id, kept) for every row.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing and stay. Vectors
    of unequal lengths compare as if the shorter had zeros at its end. Equal vectors link with one another at every
    threshold. Every row gives one row, whether its key repeats or is null; a class of equal vectors goes by its
    smallest key that is not null, and a component in which no row has a key has no component_id.
    kept: the row's key is the smallest of its component.
    """
    spark = df.sparkSession
    rows = written(df.select(df[key].alias("key"), df[vector].cast("array<double>").alias("embedding")), "vectors")
    sound = F.expr("embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    usable = rows.where(sound)
    # equal vectors meet by a hash of all components; the vector itself travels with its smallest key
    usable = usable.withColumn("code", F.sha2(F.array_join(F.transform("embedding", lambda x: F.hex(F.xxhash64(x + 0.0))), ""), 256))
    classes = usable.groupBy("code").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("weight"), F.any_value("embedding").alias("embedding"))
    classes = classes.withColumn("vec", F.xxhash64("code"))  # keys may repeat or be null
    classes = written(classes, "classes")
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("code")).limit(SAMPLE).select("embedding").collect()
    units, _ = _units([r[0] for r in sample])
    centres = spherical_kmeans(units, max(1, int(np.sqrt(n))))
    found = spark.createDataFrame([], "vec long, links long, head long")
    if len(centres):
        cells = _assigned(classes.select("vec", "weight", "embedding"), centres, breadth(units, centres, threshold, near))
        cells = written(cells.withColumn("cell", F.explode("cells")), "cells")
        # one row for each of at most sqrt(n) cells
        cuts = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CUT).cast("int").alias("n_cuts"))
        cut = cells.join(cuts, "cell").withColumn("cut", F.pmod(F.xxhash64("vec"), F.col("n_cuts")).cast("int"))
        pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_cuts") - 1))).drop("n_cuts")
        pairs = pairs.withColumns({"a": F.least("cut", "other"), "b": F.greatest("cut", "other")})
        run = lambda k, x: _compare(x, k[0], k[1], k[2], threshold)
        found = written(pairs.groupBy("cell", "a", "b").applyInPandas(run, "vec long, links long, head long"), "links")
    components = connected_components(found.select("vec", "head"), "vec", "head")
    direct = found.groupBy("vec").agg(F.sum("links").alias("links"))
    of_class = classes.select("code", "vec", "least", "weight").join(direct, "vec", "left").join(components.withColumnRenamed("node", "vec"), "vec", "left")
    of_class = of_class.withColumn("component", F.coalesce("component", "vec"))
    ids_of = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(ids_of, "component").select("code", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    salted = usable.select("key", "code").withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(max(16, partitions(spark)))))
    parts = salted.select("code", "_salt").distinct().join(of_class, "code")
    ids = salted.join(parts, ["code", "_salt"]).select("key", "n_links", "component_id")
    rest = rows.where(~F.coalesce(sound, F.lit(False))).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return ids.unionByName(rest).select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))
