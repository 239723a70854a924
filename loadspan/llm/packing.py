"""Best-fit packing of token sequences (operator 9).

Documents are tokenised, closed with an end id and cut into pieces of at most the capacity. Pieces above a third of
the capacity are the large items: no bin holds more than two of them, and greedy matching joins each, largest first,
with the largest that still fits beside it. The smaller pieces then fill the gaps by best fit, largest first; what
fits nowhere opens bins of its own. Packing works on the pieces' sizes only, in groups of about GROUP_PIECES pieces
dealt by a hash of the document's key, so no task grows with the corpus; each group leaves at most a few bins open.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadspan.llm.chunks import slices
from loadspan.llm.tables import small_batches, written
from loadspan.llm.wordpieces import chunk_encoder

GROUP_PIECES = 16_384


def pieces(df: DataFrame, tokenizer_path: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """One row per piece: key, row_hash, piece, start, length, ids_crc32, and ids if asked for.

    A document is the ids of its whole text (null: empty) and end_id; documents longer than capacity are cut every
    capacity ids. row_hash tells rows that repeat a key apart; rows that repeat entirely stay as many documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunk_encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text"):
                flat, offsets = coder(part.column("text"))
                sizes = np.diff(offsets) + 1
                full = np.full(len(flat) + len(sizes), end_id, np.uint32)
                is_end = np.zeros(len(full), bool)
                is_end[np.cumsum(sizes) - 1] = True
                full[~is_end] = flat
                counts = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), counts)
                number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = number * capacity
                length = np.minimum(capacity, sizes[row] - start)
                at = (np.cumsum(sizes) - sizes)[row] + start
                data = full.astype("<u4", copy=False)
                crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                took = pa.array(row)
                columns = [part.column("key").take(took), part.column("row_hash").take(took), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = [key, "row_hash", "piece", "start", "length", "ids_crc32"]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([at, [len(data)]]).astype(np.int32)), pa.array(data.astype(np.int32))))
                    names.append("ids")
                yield pa.record_batch(columns, names=names)

    small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias("key"), F.xxhash64(df[key], df[text]).alias("row_hash"), df[text].cast("string").alias("text"))
    schema = f"`{key}` {kind}, row_hash long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return rows.mapInArrow(run, schema)


def fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each item."""
    order = np.argsort(-sizes, kind="stable").tolist()
    of, offset, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    gaps: list[tuple[int, int]] = []  # (free space, bin), ascending

    def place(item: int, where: int) -> None:
        of[item], offset[item] = where, fill[where]
        fill[where] += int(sizes[item])

    large = [i for i in order if 3 * sizes[i] > capacity]
    waiting = [(int(sizes[i]), i) for i in reversed(large)]  # ascending by size
    while waiting:
        size, item = waiting.pop()
        fill.append(0)
        place(item, len(fill) - 1)
        mate = bisect_left(waiting, (capacity - size + 1, -1)) - 1
        if mate >= 0:
            place(waiting.pop(mate)[1], len(fill) - 1)
        insort(gaps, (capacity - fill[-1], len(fill) - 1))
    for item in order[len(large) :]:
        at = bisect_left(gaps, (int(sizes[item]), -1))
        if at < len(gaps):
            where = gaps.pop(at)[1]
        else:
            fill.append(0)
            where = len(fill) - 1
        place(item, where)
        if fill[where] < capacity:
            insort(gaps, (capacity - fill[where], where))
    return of, offset


def pack(items: DataFrame, capacity: int, size: str = "length", by: str = "row_hash") -> DataFrame:
    """items with sequence_id and offset, each item in one sequence of at most capacity, gapless from offset 0.

    Sizes are from 1 to capacity. Ties go to the order of the hash in `by`; an empty table stays empty. Columns named
    sequence_id, offset or pack_group are replaced.
    """
    items = items.drop("sequence_id", "offset", "pack_group")
    groups = max(1, round(items.count() / GROUP_PIECES))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)

    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="pack_group").sort_values([by], kind="stable", ignore_index=True)
        bins, offsets = fit(rows[size].to_numpy(), capacity)
        return rows.assign(sequence_id=(int(group[0]) << 32) + bins, offset=offsets)

    dealt = items.withColumn("pack_group", F.pmod(F.xxhash64(by, F.lit("pack")), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(run, f"{schema}, sequence_id long, offset long")


def packed(df: DataFrame, tokenizer_path: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """pieces() of df, packed. Empty and null texts are documents of the end id alone."""
    made = written(pieces(df, tokenizer_path, end_id, capacity, key, text), "pieces")
    return pack(made, capacity)
