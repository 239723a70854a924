"""Streaming forms: change points with state per series, and working intervals by session windows."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from loadspan.kernels.stream import StreamingSegmentation

SCHEMA = "series_id long, change_point long, seen long"


def detected(rows: pd.DataFrame, model: StreamingSegmentation) -> list[tuple[int, int]]:
    """(change point, values seen) for each that the rows, in order of t, bring to light."""
    out = []
    for v in rows.sort_values(["t", "event_id"])["power"]:
        if (c := model.update(0.0 if pd.isna(v) else float(v))) is not None:
            out.append((c, model.seen))
    return out


def change_points(stream: DataFrame, **options) -> DataFrame:
    """series_id, change_point, seen from a stream (or table) of series_id, t, power, event_id.

    A series's state is one binary value; within a batch its rows are taken in order of t.
    """
    if not stream.isStreaming:
        def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            found = detected(rows, StreamingSegmentation(**options))
            return pd.DataFrame({"series_id": [key[0]] * len(found), "change_point": [c for c, _ in found], "seen": [s for _, s in found]})

        return stream.groupBy("series_id").applyInPandas(whole, SCHEMA)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        model = pickle.loads(state.get[0]) if state.exists else StreamingSegmentation(**options)
        found = detected(pd.concat(list(parts)), model)
        state.update((pickle.dumps(model),))
        yield pd.DataFrame({"series_id": [key[0]] * len(found), "change_point": [c for c, _ in found], "seen": [s for _, s in found]})

    return stream.groupBy("series_id").applyInPandasWithState(step, SCHEMA, "model binary", "append", GroupStateTimeout.NoTimeout)


def activities(stream: DataFrame, threshold: float, gap: str, least: float, late: str = "1 hour") -> DataFrame:
    """series_id, start_ts, last_ts, n_active: closed working intervals; rows later than the watermark are dropped."""
    rows = stream.withWatermark("ts", late).where(~F.isnan("power") & (F.col("power") >= threshold))
    found = rows.groupBy("series_id", F.session_window("ts", gap)).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_active"))
    seconds = (F.unix_micros("last_ts") - F.unix_micros("start_ts")) / 1e6
    return found.where(seconds >= least).select("series_id", "start_ts", "last_ts", "n_active")
