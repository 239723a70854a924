"""Token ids in grammar-compressed files (operator 5).

A token file is a Parquet table of blocks, written by Spark to any store that it reaches. A block holds the ids of
consecutive documents as a Re-Pair grammar: its most frequent pairs of symbols were replaced by new symbols, again
and again. It stores the rules (two symbols each), the length that each rule expands to, and the sequence that is
left; a range of ids is decoded from the sums of those lengths without decoding what precedes it.

Documents lie in ascending order of the key (nulls first; rows that repeat a key in order of the hash of their
text). shard is the number of the range partition and block the number within it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadspan.llm.chunks import ragged, slices
from loadspan.llm.tables import small_batches
from loadspan.llm.wordpieces import chunk_encoder

BLOCK_IDS = 1 << 20
#: A rule takes 12 bytes (two symbols and a length) and each use of it saves one symbol of 2 bytes: rarer pairs do not pay.
LEAST_COUNT = 7
_BUCKET_BITS = 20

FILE_SCHEMA = (
    "shard int, block int, n_ids long, keys array<{kind}>, sizes array<int>, base int, "
    "rules binary, rule_lengths binary, sequence binary"
)


def compress(ids: np.ndarray, base: int, most_symbols: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, lengths, sequence): rule i, symbol base + i, stands for the two symbols rules[i], lengths[i] ids in all.

    Rounds go on until no pair is found LEAST_COUNT times; each replaces the more frequent half of such pairs. Symbols
    are 16 bits wide, so a block has most_symbols at most: wider ones would double the sequence. A pair of such symbols
    is one 32-bit number.
    """
    shift = (max(base, most_symbols) - 1).bit_length()
    kind, bits = (np.uint32, 32) if shift <= 16 else (np.uint64, 64)
    sequence = ids.astype(kind)
    rules: list[np.ndarray] = []
    lengths = np.ones(base, np.int64)
    made = 0
    number_of = np.zeros(1 << _BUCKET_BITS, np.int32)
    while True:
        room = most_symbols - base - made
        if len(sequence) < 2 or room <= 0:
            break
        key = sequence[:-1] << kind(shift) | sequence[1:]
        bucket = (key * kind(0x9E3779B97F4A7C15 >> (64 - bits)) >> kind(bits - _BUCKET_BITS)).astype(np.intp)
        often = np.bincount(bucket, minlength=1 << _BUCKET_BITS) >= LEAST_COUNT
        maybe = np.flatnonzero(often[bucket])
        key_maybe = key[maybe]
        found, counts = np.unique(key_maybe, return_counts=True)
        found, counts = found[counts >= LEAST_COUNT], counts[counts >= LEAST_COUNT]
        if not len(found):
            break
        best = found[np.argsort(-counts, kind="stable")[: min(room, max(256, len(found) // 2))]]
        # one pair a bucket, the most frequent: the others wait for a later round
        slot = (best * kind(0x9E3779B97F4A7C15 >> (64 - bits)) >> kind(bits - _BUCKET_BITS)).astype(np.intp)
        number_of[slot[::-1]] = np.arange(len(best))[::-1]
        place = number_of[bucket[maybe]]
        chosen = best[place] == key_maybe
        number_of[slot] = 0
        at, place = maybe[chosen], place[chosen]
        # of pairs that overlap in a run, every other one is replaced, from the left
        fresh = np.concatenate([[True], np.diff(at) > 1])
        number = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at, place = at[number % 2 == 0], place[number % 2 == 0]
        taken = np.zeros(len(best), bool)
        taken[place] = True
        used, symbol = np.flatnonzero(taken), (np.cumsum(taken) - 1)[place]
        pairs = np.stack([best[used] >> kind(shift), best[used] & kind((1 << shift) - 1)], axis=1).astype(np.int64)
        sequence[at] = base + made + symbol
        keep = np.ones(len(sequence), bool)
        keep[at + 1] = False
        sequence = sequence[keep]
        rules.append(pairs)
        lengths = np.concatenate([lengths, lengths[pairs].sum(axis=1)])
        made += len(pairs)
    return np.concatenate([np.zeros((0, 2), np.int64), *rules]), lengths[base:], sequence.astype(np.int64)


def expand(sequence: np.ndarray, base: int, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids that the symbols stand for."""
    sizes = np.concatenate([np.ones(base, np.int64), lengths])
    starts = np.cumsum(sizes) - sizes
    flat = np.zeros(int(sizes.sum()), np.int64)
    flat[:base] = np.arange(base)
    done, symbols = base, base + np.arange(len(rules))
    while done < len(sizes):  # rules of one round at a time: those whose parts are all known
        bad = np.flatnonzero((rules[done - base :] >= done).any(axis=1))
        stop = done + int(bad[0]) if len(bad) else len(sizes)
        now = rules[symbols[done - base : stop - base] - base].ravel()
        flat[starts[done] : starts[done] + int(sizes[done:stop].sum())] = ragged(flat, starts[now], sizes[now])
        done = stop
    return ragged(flat, starts[sequence], sizes[sequence])


def read_range(base: int, rules: np.ndarray, lengths: np.ndarray, sequence: np.ndarray, start: int, stop: int) -> np.ndarray:
    """The block's ids from start to stop; only the symbols that reach into the range are expanded."""
    ends = np.cumsum(np.concatenate([np.ones(base, np.int64), lengths])[sequence])
    first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
    before = int(ends[first - 1]) if first else 0
    return expand(sequence[first : last + 1], base, rules, lengths)[start - before : stop - before]


def write_token_file(df: DataFrame, path: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text", base: int = 50_257, shards: int | None = None) -> None:
    """Writes every row's ids (whole text; null: empty) and end_id to a token file.

    Other columns play no part. base is the tokenizer's number of ids. An empty table gives a file without blocks.
    """
    spark = df.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, number = chunk_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        held: list = []

        def block() -> pa.RecordBatch:
            nonlocal number
            ids = np.concatenate([x for x, _, _ in held])
            rules, lengths, sequence = compress(ids, base)
            row = {
                "shard": [shard], "block": [number], "n_ids": [len(ids)],
                "keys": [pa.concat_arrays([k for _, k, _ in held]).to_pylist()], "sizes": [np.concatenate([s for _, _, s in held])], "base": [base],
                "rules": [rules.astype("<u4").tobytes()], "rule_lengths": [lengths.astype("<u4").tobytes()], "sequence": [sequence.astype("<u2" if base + len(rules) <= 1 << 16 else "<u4").tobytes()],
            }
            held.clear()
            number += 1
            types = {"shard": pa.int32(), "block": pa.int32(), "n_ids": pa.int64(), "keys": pa.list_(key_type), "sizes": pa.list_(pa.int32()), "base": pa.int32(), "rules": pa.binary(), "rule_lengths": pa.binary(), "sequence": pa.binary()}
            return pa.record_batch([pa.array(v, types[k]) for k, v in row.items()], names=list(row))

        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                key_type = part.column("key").type
                flat, offsets = coder(part.column("text"))
                sizes = np.diff(offsets) + 1
                full = np.full(len(flat) + len(sizes), end_id, np.int32)
                ends = np.zeros(len(full), bool)
                ends[np.cumsum(sizes) - 1] = True
                full[~ends] = flat
                held.append((full, part.column("key"), sizes.astype(np.int32)))
                if sum(len(x) for x, _, _ in held) >= BLOCK_IDS:
                    yield block()
        if held:
            yield block()

    kind = df.schema[key].dataType.simpleString()
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(df[key].alias("key"), F.xxhash64(df[text]).alias("row_hash"), df[text].cast("string").alias("text"))
    ordered = rows.repartitionByRange(shards, F.asc_nulls_first("key"), "row_hash").sortWithinPartitions(F.asc_nulls_first("key"), "row_hash")
    ordered.select("key", "text").mapInArrow(run, FILE_SCHEMA.format(kind=kind)).write.mode("overwrite").parquet(path)


def _block(row: dict) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    rules = np.frombuffer(row["rules"], "<u4").astype(np.int64).reshape(-1, 2)
    base = row["base"]
    sequence = np.frombuffer(row["sequence"], "<u2" if base + len(rules) <= 1 << 16 else "<u4").astype(np.int64)
    return base, rules, np.frombuffer(row["rule_lengths"], "<u4").astype(np.int64), sequence


def ids_between(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(at, ids array<int>): the file's ids from start to stop (exclusive), a row for each block that holds some, at being
    the first one's place. Blocks elsewhere are not decoded, and of these only the symbols that reach into the range."""
    file, starts = _placed(spark, path)
    near = file.join(starts, ["shard", "block"]).where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                base, rules, lengths, sequence = _block(row)
                lo, hi = max(0, start - row["start"]), min(row["n_ids"], stop - row["start"])
                ids = read_range(base, rules, lengths, sequence, lo, hi).astype(np.int32)
                yield pa.record_batch([pa.array([row["start"] + lo]), pa.array([ids], pa.list_(pa.int32()))], names=["at", "ids"])

    return near.select("start", "n_ids", "base", "rules", "rule_lengths", "sequence").mapInArrow(run, "at long, ids array<int>")


def _placed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The file, and (shard, block, start): the ids before each block."""
    file = spark.read.parquet(path)
    of_shard = file.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shard_start = of_shard.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("block")
    starts = file.select("shard", "block", (F.sum("n_ids").over(within) - F.col("n_ids")).alias("block_start")).join(shard_start, "shard")
    return file, starts.select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("start"))


def documents(spark: SparkSession, path: str, ids: bool = False, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) for every document of a token file, decoded from its blocks.

    start counts the ids of all documents before it: the ids of earlier shards (one sum a shard), of earlier blocks
    of the shard, and of earlier documents of the block.
    """
    file, starts = _placed(spark, path)
    kind = file.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                values = {n: row.column(n)[0].as_py() for n in ("shard", "block", "base", "rules", "rule_lengths", "sequence")}
                base, rules, lengths, sequence = _block(values)
                data = expand(sequence, base, rules, lengths).astype("<u4")
                sizes = row.column("sizes").flatten().to_numpy().astype(np.int64)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(data[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                n = len(sizes)
                out = [row.column("keys").flatten(), pa.array([values["shard"]] * n, pa.int32()), pa.array([values["block"]] * n, pa.int32()), pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                names = [key, "shard", "block", "at", "n_tokens", "ids_crc32"]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(data.astype(np.int32))))
                    names.append("ids")
                yield pa.record_batch(out, names=names)

    schema = f"`{key}` {kind}, shard int, block int, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    found = file.drop("n_ids").mapInArrow(run, schema).join(starts, ["shard", "block"])
    return found.select(key, (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)
