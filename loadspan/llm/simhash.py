"""SimHash near-duplicates by covering-code anchors (operator 1).

Two fingerprints that differ in at most three bits agree up to one bit in one of two blocks of 31 bits. In a block,
the words of the Hamming code of length 31 are the anchors; its covering radius is 1, so each fingerprint has one
home anchor at distance 0 or 1, and every fingerprint within one bit of it lies within 2 (radius plus threshold) of
that anchor. Each fingerprint goes to its homes and to all anchors within 2 (at most 16 a block), and fingerprints
are compared per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadspan.llm.chunks import buffers, slices
from loadspan.llm.components import connected_components
from loadspan.llm.tables import small_batches, written

THRESHOLD = 3
BLOCK = 31
#: Members of an anchor that are compared in one go; larger anchors are cut into that many and compared cut by cut.
CUT = 2048
SALTS = 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes, width: int = 3) -> list[int]:
    """XXH64 (seed 42) of each run of width words, or of all words where they are fewer; nothing for no words."""
    words = text.translate(_LOWER).split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-width] + 1])
    return [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of counts hashes the bits that more than half of them set; 0 for an empty run."""
    out = np.zeros(len(counts), np.uint64)
    full = counts > 0
    if full.any():
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        at = (np.cumsum(counts) - counts)[full]
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        won = 2 * ones > counts[full][:, None]
        out[full] = np.packbits(won, axis=1).view(">u8").ravel()
    return out


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """df's other columns and fingerprint (long, the 64 bits). Null and empty texts: 0. Any length of text counts whole."""
    names = [c for c in df.columns if c not in (text, "fingerprint")]
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                data, offsets = buffers(part.column(text))
                whole = data.tobytes()
                each = [shingle_hashes(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                counts = np.array([len(x) for x in each], np.int64)
                flat = np.array([h for x in each for h in x], np.uint64)
                yield pa.record_batch([*(part.column(c) for c in names), pa.array(majority(flat, counts).view(np.int64))], names=[*names, "fingerprint"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in names)
    return df.select(*names, df[text].cast("string").alias(text)).mapInArrow(run, f"{fields}fingerprint long")


def hexadecimal(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def _syndrome(word: Column) -> Column:
    """0 for words of the Hamming code, else the number (from 1) of the bit to flip for the nearest one."""
    masks = [sum(1 << (i - 1) for i in range(1, BLOCK + 1) if i >> k & 1) for k in range(5)]
    bits = [F.shiftleft(F.bit_count(word.bitwiseAND(F.lit(m).cast("long"))) % 2, k) for k, m in enumerate(masks)]
    return bits[0] + bits[1] + bits[2] + bits[3] + bits[4]


def _flips() -> list[list[int]]:
    """For each syndrome the bits to flip for the anchors within 2, the home anchor's first."""
    near = [[0]]
    for s in range(1, BLOCK + 1):
        near.append([1 << (s - 1)] + [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, BLOCK + 1) if i < i ^ s and i != s])
    return near


def members(prints: DataFrame) -> DataFrame:
    """(block, anchor, fingerprint, home) for every anchor that a distinct fingerprint goes to."""
    table = F.array(*[F.array(*[F.lit(x).cast("long") for x in row]) for row in _flips()])
    blocks = [F.col("fingerprint").bitwiseAND(F.lit((1 << BLOCK) - 1)), F.shiftrightunsigned("fingerprint", BLOCK).bitwiseAND(F.lit((1 << BLOCK) - 1))]
    both = prints.select("fingerprint", F.posexplode(F.array(*blocks)).alias("block", "word"))
    near = both.select("fingerprint", "block", "word", F.posexplode(F.element_at(table, _syndrome(F.col("word")).cast("int") + 1)).alias("at", "flip"))
    return near.select("block", F.col("word").bitwiseXOR(F.col("flip")).alias("anchor"), "fingerprint", (F.col("at") == 0).alias("home"))


def _forest(prints: np.ndarray, home: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links that connect whatever an anchor's comparisons connect: fewer than it has members."""
    order = np.argsort(~home, kind="stable")
    prints, n_home = prints[order], int(home.sum())
    root = list(range(len(prints)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    found = []
    for a in range(0, n_home, CUT):
        for b in range(a, len(prints), CUT):
            left, right = prints[a : min(a + CUT, n_home)], prints[b : b + CUT]
            for i, j in np.argwhere(np.bitwise_count(left[:, None] ^ right[None, :]) <= threshold).tolist():
                if a + i < b + j and (x := find(a + i)) != (y := find(b + j)):
                    root[max(x, y)] = min(x, y)
                    found.append((a + i, b + j))
    values = prints.view(np.int64).tolist()
    return [(values[i], values[j]) for i, j in found]


def links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b) pairs of distinct fingerprints within threshold bits, enough of them to connect all that are.

    threshold may be 0 to 3. Each anchor's members are compared in one task, CUT by CUT; a member is 8 bytes, and equal
    fingerprints are one member however many documents have them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def compare(block: np.ndarray, anchor: np.ndarray, prints: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
            edges = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(block) != 0)) + 1
            bounds = np.concatenate([[0], edges, [len(anchor)]])
            some = np.add.reduceat(home.astype(int), bounds[:-1]) > 0
            out: list[tuple[int, int]] = []
            for i in np.flatnonzero(some & (np.diff(bounds) > 1)).tolist():
                a, b = bounds[i], bounds[i + 1]
                out += _forest(prints[a:b], home[a:b], threshold)
            pairs = np.array(out, np.int64).reshape(-1, 2)
            return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "anchor", "fingerprint", "home")]
            columns[2] = columns[2].view(np.uint64)
            held.append(columns)
            whole = [np.concatenate(x) for x in zip(*held)]
            last = (whole[0] == whole[0][-1]) & (whole[1] == whole[1][-1])
            cut = int(np.argmax(last))
            held = [[x[cut:] for x in whole]]
            if cut:
                yield compare(*(x[:cut] for x in whole))
        if held:
            yield compare(*(np.concatenate(x) for x in zip(*held)))

    dealt = members(prints).repartition("block", "anchor").sortWithinPartitions("block", "anchor")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def grouped(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(key, fingerprint, component_id): the smallest key whose fingerprint is reachable by links, itself included.

    Rows without words have fingerprint 0 and link like any others; rows with a null key get a component of the keys
    that they link with (null if none). Equal fingerprints meet as one, so groups of copies make no pairs; rows with a
    very common fingerprint are spread over SALTS parts when they fetch their component.
    """
    prints = written(fingerprints(df.select(key, text), text), "fingerprints").withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    parts = prints.groupBy("fingerprint", "_salt").agg(F.min(key).alias("least"))
    found = written(connected_components(links(prints.select("fingerprint").distinct(), threshold)), "components")
    of = parts.join(found, parts.fingerprint == found.node, "left").select("fingerprint", "_salt", "least", F.coalesce("component", "fingerprint").alias("group"))
    of = written(of, "classes")
    least = of.groupBy("group").agg(F.min("least").alias("component_id"))
    ids = of.join(least, "group").select("fingerprint", "_salt", "component_id")
    return prints.join(ids, ["fingerprint", "_salt"]).select(key, "fingerprint", "component_id")


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """df's rows with the smallest key of each near-duplicate group; rows that repeat that key all stay, null keys go."""
    kept = grouped(df, key, text, threshold).where(F.col(key) == F.col("component_id")).select(key).distinct()
    return df.join(kept, key, "left_semi")
