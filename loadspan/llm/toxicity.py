"""Toxicity by a linear-chain conditional random field (operator 7).

Labels of documents become labels of tokens first: a word is toxic in a document labelled toxic if it stands in
toxic documents far more often than its share of the labelled documents explains. The field is fitted to these
tokens, sentence by sentence. A text's score comes from its tokens' forward-backward marginals (the highest, and the
expected number of toxic tokens), by a logistic curve fitted to the same documents; the tokens over SPAN give the
offending offsets. Language, source and key of a document play no part.

Fitting reads a bounded sample: MAX_PER_CLASS labelled documents of either class, taken in the order of a hash.
Of their sentences, MAX_SENTENCES with toxic tokens and as many without fit the field; the curve is fitted to all.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadspan.llm.chunks import buffers, slices
from loadspan.llm.crf import TokenField, marginals
from loadspan.llm.tables import small_batches

MAX_PER_CLASS = 1500
MAX_SENTENCES = 4000
SPAN = 0.5
_LEAST_DOCS, _LEAST_GAIN = 3.0, 20.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 58, 59, 63, 124]] = True


@dataclass
class Tokens:
    """Words of a batch: their distinct forms, the form of each, its place in its text, and the sentences' bounds."""

    forms: list[str]
    code: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    length: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    """Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased; places are bytes of the text."""
    data, offsets = buffers(texts)
    data = _LOWER[data]
    inside = _LETTER[data]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    bounds = offsets[:-1][offsets[:-1] < len(data)]
    edge[bounds] = inside[bounds]  # texts lie one after another
    start = np.flatnonzero(edge)
    gap = ~inside
    gap[bounds[bounds > 0] - 1] |= True
    stops = np.flatnonzero(gap)
    end = np.concatenate([stops, [len(data)]])[np.searchsorted(stops, start)] if len(start) else start
    # a text that ends with a word: its last byte belongs to the word
    end = np.where((end < len(data)) & inside[np.minimum(end, max(0, len(data) - 1))] if len(data) else False, end + 1, end)
    sizes = end - start
    ends = np.concatenate([[0], np.cumsum(sizes)])
    coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[inside])).dictionary_encode()
    doc = np.searchsorted(offsets, start, "right") - 1
    stop = np.cumsum(_STOP[data], dtype=np.int32) if len(data) else np.zeros(0, np.int32)
    sentence = np.concatenate([[True], (np.diff(stop[start]) > 0) | (np.diff(doc) > 0)]) if len(start) else np.zeros(0, bool)
    first = np.flatnonzero(sentence)
    return Tokens(coded.dictionary.to_pylist(), np.asarray(coded.indices, dtype=np.int64), start - offsets[doc], end - offsets[doc], doc, first, np.diff(np.concatenate([first, [len(start)]])))


def _parts(texts: list[str]) -> Iterator[tuple[int, Tokens]]:
    """(number of the first text, words) of 100 texts at a time."""
    for a in range(0, len(texts), 100):
        yield a, tokens(pa.array(texts[a : a + 100], pa.large_string()))


def _sample_tokens(texts: list[str]) -> Tokens:
    """As tokens(), without places, read in parts so that little is held beside the words' numbers."""
    forms: dict[str, int] = {}
    code, doc, first, length, n = [], [], [], [], 0
    for a, found in _parts(texts):
        number = np.array([forms.setdefault(w, len(forms)) for w in found.forms], np.int32)
        code.append(number[found.code] if len(number) else number)
        doc.append((found.doc + a).astype(np.int32))
        first.append(found.first + n)
        length.append(found.length)
        n += len(found.code)
    return Tokens(list(forms), np.concatenate(code), np.zeros(0, int), np.zeros(0, int), np.concatenate(doc), np.concatenate(first), np.concatenate(length))


def lexicon(doc: np.ndarray, code: np.ndarray, n_forms: int, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which forms documents labelled toxic hold significantly more often than the others; (doc, code): each form that a document has, once."""
    mass = weight[doc]
    a, n = np.bincount(code, mass * toxic[doc], n_forms), np.bincount(code, mass, n_forms)
    expected = n * weight[toxic].sum() / weight.sum()
    c, rest = n - a, n - expected
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 2 * (a * np.log(a / expected) + np.where((c > 1e-9) & (rest > 0), c * np.log(c / rest), 0.0))
    return (a >= _LEAST_DOCS) & (a > 1.5 * expected) & (gain >= _LEAST_GAIN)


def _copies(doc: np.ndarray, code: np.ndarray, forms: list[str], n_docs: int) -> np.ndarray:
    """One over the number of documents with the same three least word hashes, by either of two sets of hashes: near
    copies count about once together. doc is ascending."""
    mix = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xFD7046C5], np.uint64)
    base = np.fromiter((zlib.crc32(w.encode()) for w in forms), np.uint64, len(forms))
    marks = np.zeros((n_docs, len(mix)), np.uint64)
    if len(doc):
        first = np.flatnonzero(np.concatenate([[True], np.diff(doc) > 0]))
        for k, m in enumerate(mix):
            marks[doc[first], k] = np.minimum.reduceat((((base ^ m) * m) & np.uint64(0xFFFFFFFF))[code], first)
    sizes = []
    for k in (0, 3):
        _, group, count = np.unique(marks[:, k : k + 3], axis=0, return_inverse=True, return_counts=True)
        sizes.append(count[group.ravel()])
    return 1 / np.maximum(*sizes)


def _features(word: str) -> tuple[str, str]:
    return f"w={word}", f"p={word[:5]}" if len(word) >= 5 else ""


class ToxicityModel:
    """Weights of words, scores of tag pairs and the curve over documents."""

    def __init__(self) -> None:
        self.weight: dict[str, float] = {}
        self.pair, self.first, self.bias, self.curve = np.zeros((2, 2)), 0.0, -8.0, np.array([-3.0, 0.0, 0.0])

    @staticmethod
    def fit(texts: list[str], toxic: list[bool], class_weight: tuple[float, float] = (1.0, 1.0), max_sentences: int = MAX_SENTENCES) -> ToxicityModel:
        """From whole texts and their labels. Without texts of either class, scores are constant and below 0.5."""
        model = ToxicityModel()
        if not any(toxic) or all(toxic):
            return model
        found = _sample_tokens(texts)
        labels, n_forms = np.array(toxic), max(1, len(found.forms))
        doc, code = np.divmod(np.unique(found.doc.astype(np.int64) * n_forms + found.code), n_forms)
        is_bad = lexicon(doc, code, n_forms, labels, _copies(doc, code, found.forms, len(texts)))
        tag = is_bad[found.code] & labels[found.doc] if len(found.code) else np.zeros(0, bool)
        chosen = model._sentences(found, tag, max_sentences)
        rows = np.concatenate([np.arange(a, a + n) for a, n in zip(found.first[chosen], found.length[chosen])] or [np.zeros(0, int)]).astype(int)
        if len(rows):
            model._fit_field(found, tag, rows, found.length[chosen])
        del found, doc, code, tag
        model._fit_curve(texts, labels, class_weight)
        return model

    @staticmethod
    def _sentences(found: Tokens, tag: np.ndarray, most: int) -> np.ndarray:
        marked = np.add.reduceat(tag.astype(int), found.first) > 0 if len(found.first) else np.zeros(0, bool)
        order = np.argsort((np.arange(len(marked)) * 2654435761) & 0xFFFFFFFF, kind="stable")
        return np.sort(np.concatenate([order[marked[order]][:most], order[~marked[order]][:most]]))

    def _fit_field(self, found: Tokens, tag: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> None:
        code = found.code[rows]
        counts = Counter(f for c, n in Counter(code.tolist()).items() for f in _features(found.forms[c]) * n if f)
        number = {f: i + 1 for i, f in enumerate(sorted(f for f, n in counts.items() if n >= 3))}
        table = np.full((len(found.forms), 3), -1)
        table[:, 0] = 0
        for c in np.unique(code).tolist():
            table[c, 1:] = [number.get(f, -1) for f in _features(found.forms[c])]
        field = TokenField(len(number) + 1).fit(table[code], tag[rows].astype(int), np.cumsum(lengths) - lengths, lengths)
        self.bias, self.pair, self.first = float(field.weights[0]), field.pair, field.first
        self.weight = {f: float(field.weights[i]) for f, i in number.items() if abs(field.weights[i]) > 0.01}

    def token_scores(self, found: Tokens) -> np.ndarray:
        """P(toxic) of each token."""
        get = self.weight.get
        form = np.array([self.bias + sum(get(f, 0.0) for f in _features(w)) for w in found.forms] or [0.0])
        return marginals(form[found.code], found.first, found.length, self.pair, self.first)[0] if len(found.code) else np.zeros(0)

    @staticmethod
    def _summary(found: Tokens, p: np.ndarray, n_docs: int) -> np.ndarray:
        most, total = np.zeros(n_docs), np.bincount(found.doc, p * (p > 0.05), n_docs) if len(p) else np.zeros(n_docs)
        np.maximum.at(most, found.doc, p)
        return np.stack([np.ones(n_docs), most, np.log1p(total)], axis=1)

    def _fit_curve(self, texts: list[str], labels: np.ndarray, class_weight: tuple[float, float]) -> None:
        x = np.concatenate([self._summary(found, self.token_scores(found), min(100, len(texts) - a)) for a, found in _parts(texts)])
        w, y, beta = np.where(labels, class_weight[1], class_weight[0]), labels.astype(float), np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (w * (y - p)) - 0.05 * beta)
            beta += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
        self.curve = beta

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Each text's score, and its offending spans as (first byte, end byte, probability)."""
        found = tokens(texts)
        p = self.token_scores(found)
        spans: list[list] = [[] for _ in range(len(texts))]
        for i in np.flatnonzero(p >= SPAN).tolist():
            spans[found.doc[i]].append((int(found.start[i]), int(found.end[i]), float(p[i])))
        return 1 / (1 + np.exp(-np.clip(self._summary(found, p, len(texts)) @ self.curve, -30, 30))), spans


def held_out(key: Column) -> Column:
    """Rows that no label is learned from: crc32 of the key's text, modulo 5, is 0. A null key is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_per_class: int = MAX_PER_CLASS, max_sentences: int = MAX_SENTENCES) -> ToxicityModel:
    """The model from labelled rows that are not held out, at most max_per_class of either label, whole texts.

    Rows without a label of 0 or 1, a key or a text are passed over; of a key labelled twice, the higher label counts,
    and of rows that repeat a key, the least text. max_sentences: sentences of either kind that fit the field.
    """
    known = labels.where(~held_out(F.col(key)) & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias("_toxic"))
    sizes = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = None
    for value in (0, 1):
        part = known.where(F.col("_toxic") == value).orderBy(F.xxhash64(key), key).limit(max_per_class)
        sample = part if sample is None else sample.union(part)
    # at most 2 * max_per_class keys, whatever the size of the tables
    rows = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text")).join(F.broadcast(sample), key)
    rows = rows.groupBy(key).agg(F.min("_text").alias("_text"), F.max("_toxic").alias("_toxic")).collect()  # one text a key
    rows.sort(key=lambda r: (r[0], r[1]))
    texts, toxic = [r[1] for r in rows], [bool(r[2]) for r in rows]
    del rows
    weight = tuple(sizes.get(v, 0) / max(1, sum(t == bool(v) for t in toxic)) for v in (0, 1))
    return ToxicityModel.fit(texts, toxic, weight, max_sentences)


def scored(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and toxic_spans array<struct<start,end,p>> in bytes of the UTF-8 text.

    Null and empty texts have no spans and the score of a text without toxic tokens. Columns of those names are
    replaced; rows that repeat are scored alike.
    """
    docs = docs.drop("score", "toxic_spans")
    names = docs.columns
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                score, spans = model.score(part.column(text))
                lists = pa.array([[{"start": a, "end": b, "p": p} for a, b, p in s] for s in spans], kind)
                yield pa.record_batch([*part.columns, pa.array(score), lists], names=[*names, "score", "toxic_spans"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}score double, toxic_spans array<struct<start:long,end:long,p:double>>")
