"""License scans (operator 8).

A positional rare-token index holds, for each licence template, the places of its rarest words (rarest over all texts
that are scanned) and of the rarest word of each of its mandatory phrases. A file is looked up by its licence words,
those of highest inverse document frequency first, SEEDS at a time until all have been: their postings name templates
and the places where these would begin. For each such place the words of the template are intersected with the file by
relative position (a word may stand SLACK places off), and the place holds if they weigh at least MATCH of the
template, every mandatory phrase of the template stands word by word within it, and no negation stands just before it.
Of places of one template that overlap, the heaviest stays. Exact base phrases are looked for besides, and always give
their labels.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadspan.llm.chunks import buffers, slices
from loadspan.llm.tables import small_batches

# Base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Templates in their published wording (label, text, mandatory phrases, all of which must stand in a match).
NOTICES = [
    ("agpl", "licensed under the gnu affero general public license version 3", ["under the gnu affero general public license"]),
    ("apache", "licensed under the apache license version 2.0", ["under the apache license"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0", ["in compliance with the license", "apache org licenses license 2 0"]),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ["specific language governing permissions and limitations under the license"]),
    ("apache", "spdx license identifier apache 2.0", ["license identifier apache 2 0"]),
    ("boost", "distributed under the boost software license version 1.0", ["under the boost software license"]),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["free of charge to any person or organization"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistribution and use in source and binary forms", "redistributions of source code must retain"]),
    ("bsd", "released under the bsd license", ["under the bsd license"]),
    ("bsd", "spdx license identifier bsd 3 clause", ["license identifier bsd"]),
    ("cc-by", "licensed under cc by 4.0", ["licensed under cc by", "cc by 4 0"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license", ["licensed under a creative commons attribution 4 0"]),
    ("cc-by", "this work is licensed under a creative commons attribution 3.0 unported license", ["licensed under a creative commons attribution 3 0"]),
    ("cc-by-nc", "licensed under cc by nc 4.0", ["under cc by nc"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", ["licensed under a creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under cc by sa 4.0", ["under cc by sa"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4.0 international license", ["licensed under a creative commons attribution sharealike"]),
    ("cc0", "dedicated to the public domain under cc0 1.0 universal", ["public domain", "cc0 1 0"]),
    ("epl", "made available under the terms of the eclipse public license version 2.0", ["under the terms of the eclipse public license"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["under the gnu general public license"]),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["redistribute it and or modify it under the terms of the gnu general public license", "published by the free software foundation"]),
    ("gpl", "spdx license identifier gpl 3.0 or later", ["license identifier gpl"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["for any purpose with or without fee is hereby granted"]),
    ("lgpl", "licensed under the gnu lesser general public license version 3", ["under the gnu lesser general public license"]),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["under the terms of the gnu lesser general public license"]),
    ("mit", "released under the mit license", ["under the mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["permission is hereby granted free of charge to any person obtaining", "shall be included in all copies or substantial portions"]),
    ("mit", "spdx license identifier mit", ["license identifier mit"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2.0", ["subject to the terms of the mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ["free and unencumbered software released into the public domain"]),
]

# Words that turn a grant round, in the NEGATED places before it.
NEGATIONS = {b"not", b"no", b"never", b"nor", b"neither", b"isn", b"cannot"}
NEGATED = 3

RAREST = 3
SEEDS = 16
SLACK = 3
MATCH = 0.6
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.translate(_LOWER))


def _stands(phrase: list[bytes], words: list[bytes]) -> bool:
    n = len(phrase)
    return any(words[i] == phrase[0] and words[i : i + n] == phrase for i in range(len(words) - n + 1))


class RareTokenIndex:
    """Postings of the templates' rarest words, by the document counts given."""

    def __init__(self, counts: dict[bytes, int], n_docs: int, notices=NOTICES, phrases=BASE_PHRASES):
        # a word that no file has cannot tell files apart
        self.idf = {w: math.log((n_docs + 1) / (c + 1)) + 1e-3 for w, c in counts.items() if c}
        self.base = defaultdict(list)
        for p, label in phrases.items():
            self.base[words_of(p.encode())[0]].append((words_of(p.encode()), label))
        self.templates, self.postings = [], defaultdict(list)
        rarity = lambda w: (self.idf.get(w, 0.0), w)
        for number, (label, text, phrases_) in enumerate(notices):
            words, mandatory = words_of(text.encode()), [words_of(p.encode()) for p in phrases_]
            rare = set(sorted(set(words), key=rarity, reverse=True)[:RAREST]) | {max(p, key=rarity) for p in mandatory}
            weights = [self.idf.get(w, 0.0) for w in words]
            self.templates.append((label, words, weights, sum(weights), mandatory))
            for q, w in enumerate(words):
                if w in rare:
                    self.postings[w].append((number, q))

        self.wanted = frozenset(self.postings) | frozenset(self.base)

    def _places(self, words: list[bytes], at: dict[bytes, list[int]]) -> dict[int, set[int]]:
        """Where templates would begin, by their numbers; one place stands for those that lie within SLACK after it."""
        starts: dict[int, set[int]] = defaultdict(set)
        ranked = sorted(at, key=lambda w: (-self.idf.get(w, 0.0), w))
        for seeds in (ranked[i : i + SEEDS] for i in range(0, len(ranked), SEEDS)):
            for w in seeds:
                for number, q in self.postings[w]:
                    starts[number].update(p - q for p in at[w])
        return starts

    def _weight(self, words: list[bytes], start: int, number: int) -> tuple[float, int, int]:
        """(share of the template's weight that stands by relative position, first and last place of it)."""
        _, template, weights, total, _ = self.templates[number]
        found, first, last = 0.0, len(words), -1
        for q, w in enumerate(template):
            lo = max(0, start + q - SLACK)
            near = words[lo : start + q + SLACK + 1] if start + q + SLACK + 1 > 0 else []
            if w in near:
                found += weights[q]
                exact = 0 <= start + q < len(words) and words[start + q] == w
                place = start + q if exact else lo + near.index(w)
                first, last = min(first, place), max(last, place)
        return (found / total if total else float(last >= 0)), first, last

    def scan(self, text: bytes) -> tuple[int, list[int], list[str], list[tuple]]:
        """(words, starts of base phrases, base labels, found notices as (label, start, end, score))."""
        words = words_of(text)
        starts, labels, at = [], set(), defaultdict(list)
        wanted = self.wanted
        for p, w in [(p, w) for p, w in enumerate(words) if w in wanted]:
            for phrase, label in self.base.get(w, ()):
                if words[p : p + len(phrase)] == phrase:
                    starts.append(p)
                    labels.add(label)
            if w in self.postings:
                at[w].append(p)
        found = []
        for number, places in self._places(words, at).items() if at else ():
            label, template, _, _, mandatory = self.templates[number]
            held = []
            for start in sorted(places):
                # the mandatory phrases' rarest words are posted, so a place that holds is among those of a phrase
                span = words[max(0, start - SLACK) : max(0, start + len(template) + SLACK)]
                if not all(_stands(p, span) for p in mandatory):
                    continue
                share, first, last = self._weight(words, start, number)
                if share >= MATCH and not NEGATIONS.intersection(words[max(0, first - NEGATED) : first]):
                    held.append((-share, first, last + 1))
            kept: list[tuple[int, int]] = []
            for minus, first, end in sorted(held):
                if all(end <= a or first >= b for a, b in kept):
                    kept.append((first, end))
                    found.append((label, first, end, -minus))
        return len(words), starts, sorted(labels), sorted(found)


def document_counts(df: DataFrame, notices=NOTICES, text: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many texts each word of the notices stands (so many numbers at most), and the number of texts."""
    vocabulary = {w for _, notice, keys in notices for t in (notice, *keys) for w in words_of(t.encode())}
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = dict.fromkeys(sorted(vocabulary), 0)
        n = 0
        for batch in batches:
            for part in slices(batch, "text"):
                for t in _texts(part):
                    n += 1
                    for w in vocabulary.intersection(words_of(t)):
                        counts[w] += 1
        if n:
            yield pa.record_batch([pa.array([None, *(w.decode() for w in counts)], pa.string()), pa.array([n, *counts.values()], pa.int64())], names=["word", "n"])

    got = df.select(df[text].cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in got}
    n = counts.pop(None, 0)
    return {w.encode(): c for w, c in counts.items()}, n


def _texts(part: pa.RecordBatch) -> Iterator[bytes]:
    data, offsets = buffers(part.column("text"))
    whole = data.tobytes()
    return (whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()))


def scan(df: DataFrame, notices=NOTICES, phrases=BASE_PHRASES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, base_starts, base_labels, notices array<struct<label,start,end,score>>) for every row.

    Null and empty texts have no words and nothing is found in them; rows that repeat are scanned each by itself, and
    other columns play no part. end is exclusive.
    """
    counts, n_docs = document_counts(df, notices, text)
    index = RareTokenIndex(counts, n_docs, notices, phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [index.scan(t) for t in _texts(part)]
                yield pa.record_batch([
                    part.column("key"), pa.array(np.array([r[0] for r in rows], np.int64)), pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                    pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([[dict(zip(("label", "start", "end", "score"), f)) for f in r[3]] for r in rows], kind),
                ], names=[key, "n_words", "base_starts", "base_labels", "notices"])

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words long, base_starts array<long>, base_labels array<string>, notices array<struct<label:string,start:long,end:long,score:double>>"
    return df.select(df[key].alias("key"), df[text].cast("string").alias("text")).mapInArrow(run, schema)
