"""Byte-level BPE encoding and decoding (operator 4).

Each piece that the split pattern yields is merged by way of a segment tree over its byte positions. A leaf holds
the rank of the pair that starts at that position (positions that a merge has swallowed, and pairs of no rank, hold
NONE); an inner node holds the least rank below it, the left child winning ties, so the root names the leftmost
pair of minimum rank. A merge changes three leaves: the merged position's, its dead right neighbour's and its left
neighbour's, each followed up in a logarithmic number of steps. Trees of pieces of about the same length are
worked on together, as rows of one array.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loadspan.llm.chunks import ChunkEncoder, ragged, slices
from loadspan.llm.tables import small_batches

NONE = np.int32(2**31 - 1)
#: Positions that one array of trees may hold.
TREE_CELLS = 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class TokenBytes:
    """What each id of a rank file stands for."""

    def __init__(self, ranks_path: str):
        tokens = sorted((r, w) for w, r in read_ranks(ranks_path).items())
        self.sizes = np.zeros(tokens[-1][0] + 1, np.int64)
        self.sizes[[r for r, _ in tokens]] = [len(w) for _, w in tokens]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(w for _, w in tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after another."""
        return ragged(self.flat, self.starts[ids], self.sizes[ids])


class BytePairs:
    """The merges of a rank file in tiktoken's format."""

    def __init__(self, ranks_path: str, pattern: str):
        self.ranks = read_ranks(ranks_path)
        self.pattern = regex.compile(pattern)
        self.bytes_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.base = max(self.ranks.values()) + 1
        pairs = {
            self.ranks[w[:i]] * self.base + self.ranks[w[i:]]: r
            for w, r in self.ranks.items()
            for i in range(1, len(w))
            if w[:i] in self.ranks and w[i:] in self.ranks
        }
        self.pairs = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[x] for x in self.pairs.tolist()], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, which is also the id that it merges to; NONE if there is none."""
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], NONE)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list = [None] * len(pieces)
        rest = []
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = np.array([r], np.int32)
            elif p:
                rest.append(i)
            else:
                out[i] = np.zeros(0, np.int32)
        rest.sort(key=lambda i: len(pieces[i]))
        first = 0
        while first < len(rest):
            width = 1 << (len(pieces[rest[first]]) - 1).bit_length()
            stop = first
            while stop < len(rest) and len(pieces[rest[stop]]) <= width and (stop - first + 1) * width <= max(TREE_CELLS, width):
                stop += 1
            for i, ids in zip(rest[first:stop], self._merge_trees([pieces[i] for i in rest[first:stop]], width), strict=True):
                out[i] = ids
            first = stop
        return out

    def _merge_trees(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        n, size = len(pieces), np.array([len(p) for p in pieces])
        inside = np.arange(width) < size[:, None]
        ids = np.zeros((n, width), np.int32)
        ids[inside] = self.bytes_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.where(np.arange(1, width + 1) < size[:, None], np.arange(1, width + 1), -1).astype(np.int32)
        before = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int32), (n, width)).copy()
        live = inside.copy()
        tree = np.full((n, 2 * width), NONE, np.int32)
        pair = after[:, :-1] >= 0
        tree[:, width : 2 * width - 1][pair] = self.rank(ids[:, :-1][pair], ids[:, 1:][pair])
        for level in (width >> k for k in range(1, width.bit_length())):
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

        def put(row, position, value):
            node = position + width
            tree[row, node] = value
            while (node := node >> 1)[0]:
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] != NONE) if width > 1 else np.zeros(0, int)
        while len(rows):
            node = np.ones(len(rows), np.int64)
            for _ in range(width.bit_length() - 1):
                node = 2 * node + (tree[rows, 2 * node] > tree[rows, 2 * node + 1])
            at = node - width
            dead = after[rows, at]
            ids[rows, at] = tree[rows, node]
            live[rows, dead] = False
            follow = after[rows, dead]
            after[rows, at] = follow
            has = follow >= 0
            before[rows[has], follow[has]] = at[has]
            put(rows, dead, NONE)
            put(rows, at, np.where(has, self.rank(ids[rows, at], ids[rows, np.maximum(follow, 0)]), NONE))
            left = before[rows, at]
            has = left >= 0
            if has.any():
                put(rows[has], left[has], self.rank(ids[rows[has], left[has]], ids[rows[has], at[has]]))
            rows = rows[tree[rows, 1] != NONE]
        flat, ends = ids[live], np.cumsum(live.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, chunks: list[str]) -> list[np.ndarray]:
        """The ids of each chunk: those of its pattern matches, one after another."""
        split = [[m.encode() for m in self.pattern.findall(c)] for c in chunks]
        distinct = {p: i for i, p in enumerate(dict.fromkeys(p for pieces in split for p in pieces))}
        merged = self.merge(list(distinct))
        none = np.zeros(0, np.int32)
        return [
            merged[distinct[pieces[0]]] if len(pieces) == 1 else np.concatenate([none, *(merged[distinct[p]] for p in pieces)])
            for pieces in split
        ]


@lru_cache(maxsize=4)
def _coder(ranks_path: str, pattern: str) -> ChunkEncoder:
    return ChunkEncoder(BytePairs(ranks_path, pattern).encode)


@lru_cache(maxsize=4)
def _tokens(ranks_path: str) -> TokenBytes:
    return TokenBytes(ranks_path)


def _listed(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))


def encode(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) for every row: the ids of its whole text, without special tokens.

    Null and empty texts have no ids. Rows that repeat, or repeat a key, are encoded each by itself; other columns
    play no part. ranks_path is read where the tasks run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = coder(part.column("text"))
                yield pa.record_batch([part.column("key"), _listed(ids, offsets)], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    small_batches(df.sparkSession)
    return df.select(df[key].alias("key"), df[text].cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """df with a column bytes (binary): what its ids stand for; null ids have no bytes. Ids outside the ranks are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(ranks_path)
        for batch in batches:
            lists = pa.compute.fill_null(batch.column(ids), []) if batch.column(ids).null_count else batch.column(ids)
            flat, offsets = np.asarray(lists.flatten()), np.asarray(lists.offsets, dtype=np.int64)
            offsets = offsets - offsets[0]
            data = tokens.decode(flat)
            ends = np.concatenate([[0], np.cumsum(tokens.sizes[flat])])[offsets]
            made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
            yield pa.record_batch([*batch.columns, made.cast(pa.binary())], names=[*batch.schema.names, "bytes"])

    small_batches(df.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, bytes binary")
