"""Word chunks of Arrow text batches.

A batch's texts are cut, without copying, before each ASCII white-space byte that follows a character that is
not white space, and before each ASCII punctuation mark that follows an ASCII letter or digit. No pre-tokenizer used
here has a match across such a place, so a text's ids are the ids of its chunks one after another, and each distinct
chunk of a batch needs to be encoded only once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

BATCH_BYTES = 2 << 20
CACHE_CHARS = 64
#: A generation of remembered chunks, and what an entry takes beside its characters and ids.
CACHE_BYTES, ENTRY_BYTES = 40 << 20, 200
CALL_CHUNKS = 8192

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes below 0x80 that are certainly not white space to any of the libraries.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = _SOLID & ~_ALNUM
#: The UTF-8 forms of white space above 0x7F.
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE2 = np.array([int.from_bytes(c, "big") for c in _WIDE if len(c) == 2])
_WIDE3 = np.array([int.from_bytes(c, "big") for c in _WIDE if len(c) == 3])


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch whose texts have about limit bytes (a longer text is a slice of its own)."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(first, stop - first)
        first = stop


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its len + 1 offsets; nulls count as empty."""
    texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk bounds within data, and for each text the number of its first chunk (and the total last)."""
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    last = data[at - 1]
    solid = _SOLID[last]
    wide = at[~solid & (last >= 0x80)]
    pad = np.concatenate([np.zeros(3, np.uint8), data])
    two = (pad[wide + 1].astype(np.int64) << 8) | pad[wide + 2]
    three = (pad[wide].astype(np.int64) << 16) | two
    wide = wide[~np.isin(two, _WIDE2) & ~np.isin(three, _WIDE3)]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = _MARK[data[1:]] & _ALNUM[data[:-1]]
    cut[at[solid]] = cut[wide] = cut[offsets] = True
    bounds = np.flatnonzero(cut)
    return bounds, np.searchsorted(bounds, offsets)


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces flat[starts[i]:starts[i] + sizes[i]] one after another."""
    total = int(sizes.sum())
    if not total:
        return flat[:0]
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(total)]


class ChunkEncoder:
    """Ids of texts by way of their distinct chunks.

    encode: gives for a list of distinct strings their int32 ids, as arrays or their bytes. Short chunks are remembered for later batches of
    the same worker process, in two generations of about cache_bytes each: when the younger one is full, within a batch
    too, the elder one is dropped.
    bare: the encoder ignores the case of ASCII letters and white space before a word, so that chunks go without.
    """

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray | bytes]], cache_bytes: int = CACHE_BYTES, bare: bool = False):
        self.encode, self.cache_bytes, self.bare, self.known, self.elder, self.held = encode, cache_bytes, bare, {}, {}, 0

    def _remember(self, word: str, ids: bytes) -> None:
        self.held += ENTRY_BYTES + len(word) + len(ids)
        if self.held > self.cache_bytes:
            self.elder, self.known, self.held = self.known, {}, ENTRY_BYTES + len(word) + len(ids)
        self.known[word] = ids

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (int32), and the len + 1 offsets of each text's ids."""
        data, offsets = buffers(texts)
        bounds, firsts = cuts(data, offsets)
        n = len(bounds) - 1
        if n <= 0:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if self.bare:
            keep = np.ones(len(data), bool)
            keep[bounds[:-1]] = ~_SPACE[data[bounds[:-1]]]
            bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
            data = _LOWER[data[keep]]
        chunks = pa.LargeStringArray.from_buffers(n, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data))
        coded = chunks.dictionary_encode()
        codes = np.asarray(coded.indices)
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # as to_pylist(), without a scalar each
        known, elder = self.known, self.elder
        got = [known.get(w) for w in words]
        if elder:
            for i, x in enumerate(got):
                if x is None and (x := elder.get(words[i])) is not None:
                    got[i] = x
                    self._remember(words[i], x)
        new = [i for i, x in enumerate(got) if x is None]
        for a in range(0, len(new), CALL_CHUNKS):  # in parts, so that the arrays of many new chunks are not held at once
            some = new[a : a + CALL_CHUNKS]
            for i, ids in zip(some, self.encode([words[i] for i in some]), strict=True):
                got[i] = bytes(ids)
                if len(words[i]) <= CACHE_CHARS:
                    self._remember(words[i], got[i])
        sizes = np.fromiter(map(len, got), np.int64, len(got)) >> 2
        flat = np.frombuffer(b"".join(got), np.int32)
        starts = np.cumsum(sizes) - sizes
        each = sizes[codes]
        ids = ragged(flat, starts[codes], each)
        ends = np.concatenate([[0], np.cumsum(each)])
        return ids, ends[firsts]
