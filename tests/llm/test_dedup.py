import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loadspan.llm import lines, queries, simhash, vectors
from loadspan.llm.components import connected_components
from tests.llm.conftest import SF


class Union:
    def __init__(self, n):
        self.root = list(range(n))

    def find(self, i):
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i, j):
        a, b = self.find(i), self.find(j)
        self.root[max(a, b)] = min(a, b)


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    u = Union(1100)
    for a, b in edges:
        u.join(a, b)
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {n: u.find(n) for e in edges for n in e if n in got} and {n for a, b in edges if a != b for n in (a, b)} == set(got)
    assert connected_components(df.limit(0)).count() == 0


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op1_against_brute_force(spark, texts):
    keys = sorted(texts)
    prints = [brute_fingerprint(texts[k]) for k in keys]
    u = Union(len(keys))
    for i in range(len(keys)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                u.join(i, j)
    got = {r.doc_id: r for r in queries.op1_simhash(spark, SF).collect()}
    for i, k in enumerate(keys):
        assert got[k].fingerprint == f"{prints[i]:016x}" and got[k].component_id == keys[u.find(i)]


def test_op1_finds_every_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = [int(b) for b in base]
    for b in base[:25].tolist():
        for _ in range(6):
            prints.append(b ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(1, 4), replace=False)))
    prints = sorted(set(prints))
    u = Union(len(prints))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                u.join(i, j)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")
    v, at = Union(len(prints)), {signed(p): i for i, p in enumerate(prints)}
    for r in simhash.links(df).collect():
        v.join(at[r.a], at[r.b])
    assert [u.find(i) for i in range(len(prints))] == [v.find(i) for i in range(len(prints))]


def test_op1_odd_rows(spark, odd_documents):
    got = simhash.grouped(odd_documents).collect()
    assert len(got) == 8 and {(r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id in (2, 3, 5)} == {(2, 0, 2), (3, 0, 2), (5, 0, 2)}
    assert simhash.deduplicated(odd_documents).columns == odd_documents.columns
    assert simhash.grouped(odd_documents.limit(0)).count() == 0


def shingles(line):
    return {line[i : i + 5] for i in range(len(line) - 4)} or {line}


def test_op2_against_brute_force(spark, texts):
    blank = " \t\x0b\x0c\r"
    first = {}
    for k in sorted(texts):
        for pos, raw in enumerate((texts[k] or "").split("\n")):
            if line := raw.strip(blank).lower():
                first.setdefault(line, (k, pos))
    keys = list(first)
    sets = [shingles(x) for x in keys]
    u, pairs = Union(len(keys)), []
    for i in range(len(keys)):
        for j in range(i):
            a, b = len(sets[i]), len(sets[j])
            if min(a, b) >= 0.8 * max(a, b) and (n := len(sets[i] & sets[j])) >= 0.8 * (a + b - n):
                pairs.append((i, j))
                u.join(i, j)
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(u.find(i), []).append(first[k])
    want = {min(g) for g in groups.values()}
    rows = queries.op2_minhash_lines(spark, SF).collect()
    kept = sum(r.n_kept for r in rows)
    # every exact repeat goes, nothing that is unlike all others goes, and nearly all fuzzy repeats go
    assert len(want) <= kept <= len(want) + max(1, 0.05 * len(pairs))
    wrong = sum(1 for r in rows for pos, raw in enumerate((texts[r.doc_id] or "").split("\n")) if raw.strip(blank) and (r.doc_id, pos) in want and raw not in r.text.split("\n"))
    assert wrong == 0


def test_op2_fuzzy_lines_and_odd_rows(spark, odd_documents):
    long = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil a large pot of soup by the river"
    df = spark.createDataFrame([(1, f"{long}\n\nshort"), (2, f"  {long.upper()} "), (3, long.replace("soup", "stew") + "\nnew line of its own"), (4, "short")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_kept) for r in lines.deduplicated(df).collect()}
    assert got == {1: (f"{long}\n\nshort", 2, 2), 2: ("", 1, 0), 3: ("new line of its own", 2, 1), 4: ("", 1, 0)}
    odd = lines.deduplicated(odd_documents).collect()
    assert len(odd) == 8 and next(r for r in odd if r.doc_id == 2).text is None
    assert next(r for r in odd if r.doc_id == 6).text.endswith("line") and next(r for r in odd if r.doc_id == 6).n_kept == 2
    assert lines.deduplicated(odd_documents.limit(0)).count() == 0


def line_pairs(rng):
    """(kind, a, b): lines of a Jaccard similarity from 0.8 to 0.86, by length and script."""
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    prose = lambda n: " ".join(letters(rng.randint(2, 9)) for _ in range(n))
    makers = {"cjk": lambda: han(60), "url": lambda: "https://" + letters(90), "words 8": lambda: prose(8), "words 15": lambda: prose(15), "words 60": lambda: prose(60), "words 400": lambda: prose(400)}
    for kind, make in makers.items():
        n = 0
        while n < 60:
            a = make()
            b = list(a)
            size = len(a)
            while True:
                b[rng.randrange(size)] = han(1)
                x, y = shingles(a), shingles("".join(b))
                if (j := len(x & y) / len(x | y)) < 0.86:
                    break
            if j >= 0.8:
                yield kind, a, "".join(b)
                n += 1


def test_op2_recall_by_length_and_script(spark):
    pairs = list(line_pairs(random.Random(4)))
    rows = [(i, kind, j, x) for i, (kind, *ab) in enumerate(pairs) for j, x in enumerate(ab)]
    signed = lines.signatures(spark.createDataFrame(rows, "i int, kind string, j int, _line string").repartition(4), ["i", "kind", "j"])
    left, right = (lines._prefixed(signed.where(f"j = {j}"), p) for j, p in ((0, "a"), (1, "b")))
    both = left.join(right, F.col("ai") == F.col("bi")).select(F.col("akind").alias("kind"), (F.arrays_overlap("a_bands", "b_bands") & lines._alike("a", "b")).alias("met"))
    met = {r.kind: r.n for r in both.groupBy("kind").agg(F.sum(F.col("met").cast("int")).alias("n")).collect()}
    assert all(n >= 57 for n in met.values()), met  # 95 %
    docs = [(2 * i + j, x) for i, (kind, *ab) in enumerate(pairs) for j, x in enumerate(ab)]
    kept = sum(r.n_kept for r in lines.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert len(pairs) <= kept <= len(pairs) + 0.05 * len(pairs)


def test_op2_large_buckets_are_split_and_lose_nothing(spark, monkeypatch):
    """Lines that share bands with a common first line but are like one another only in groups."""
    monkeypatch.setattr(lines, "CUT", 3)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common, docs = " ".join(word(6) for _ in range(14)), []
    for g in range(12):
        own = " ".join(word(6) for _ in range(9))
        docs += [f"{common} {own} {word(2)}" for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    u = Union(len(docs))
    sets = [shingles(x) for x in docs]
    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                u.join(i, j)
    want = len({u.find(i) for i in range(len(docs))})
    kept = sum(r.n_kept for r in lines.deduplicated(df).collect())
    assert want == 12 and want <= kept <= want + 1


def test_op2_lines_of_a_large_bucket_need_share_no_second_band(spark, monkeypatch):
    """Lines of one bucket in components of their own: every similar pair is found, whatever their other bands."""
    monkeypatch.setattr(lines, "CUT", 3)
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common, texts = letters(60), []
    for g in range(8):
        own = letters(40)
        for _ in range(5):
            line = list(common + own)
            for at in rng.sample(range(100), rng.randint(1, 3)):
                line[at] = rng.choice("0123456789")
            texts.append("".join(line))
    sets = [shingles(x) for x in texts]
    similar = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    want = {(i, j) for j in range(len(texts)) for i in range(j) if similar(i, j)}
    # one band in common and nothing known of the others: the sketches are those of lines that agree in LIKE places
    rows = [(0, i, i, 0, 0, *[-1] * 4, x) for i, x in enumerate(texts)]
    parted = spark.createDataFrame(rows, "_key long, _k1 long, _c long, _main long, _n long, _s0 long, _s1 long, _s2 long, _s3 long, _line string")
    signed = parted.drop("_n", "_line").withColumn("_s0", F.when(F.col("_k1") % 2 == 0, F.lit(-1)).otherwise(F.lit(0x7FFFFFFFFFFFFFFF)))
    met = lines._across(signed, parted.select("_k1", "_line"), 0.8)
    found = lines._similar(met, parted.select("_k1", "_line"), lines._marks(parted.select("_k1", "_line")), 0.8)
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in found.collect()} == want and 0 < len(want) < 200


def test_op2_rarest_shingles_are_found_within_rows_and_joined_in_parts(spark, monkeypatch):
    """No similar pair is lost by the counted sample or the parts, and no list of all shingles is shuffled."""
    plans, write = {}, lines.written
    monkeypatch.setattr(lines, "written", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and write(df, name))
    monkeypatch.setattr(lines, "COUNTED", 3)
    monkeypatch.setattr(lines, "PART_ROWS", 100)
    rng = random.Random(7)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common = letters(60)
    texts = ["ab", "", "日本語 ß", common]
    for own in (letters(30), letters(35), "日本" * 15):
        texts += [f"{common} {own}"[:k] + letters(2) + f"{common} {own}"[k:] for k in (5, 40, 70, 90)]
    sets = [shingles(x) for x in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    rows = spark.createDataFrame([(i, i, -1, -1, -1, -1, x) for i, x in enumerate(texts)], "_k1 long, _c long, _s0 long, _s1 long, _s2 long, _s3 long, _line string")
    met = {(r.a, r.b) for r in lines._by_rarest(rows, 0.8).collect()}
    assert len(want) > 10 and want <= met
    assert "Exchange" not in plans["rarest"] and "met" in plans


def test_op2_pairs_of_a_bucket_are_made_of_lines_that_may_be_similar(spark):
    """Lines of one bucket that are alike by sketch but not similar make no pairs, and lines alike to no other leave the bucket."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common = letters(100)
    texts = [common + letters(60) for _ in range(20)]
    texts += [texts[0][:150] + letters(10), texts[3][:155] + letters(5)]
    rows = [(0, i, i, 0, *[-1] * 4, x) for i, x in enumerate(texts)]
    parted = spark.createDataFrame(rows, "_key long, _k1 long, _c long, _main long, _s0 long, _s1 long, _s2 long, _s3 long, _line string")
    met = {(min(r.a, r.b), max(r.a, r.b)) for r in lines._across(parted.drop("_line"), parted.select("_k1", "_line"), 0.8).collect()}
    assert {(0, 20), (3, 21)} <= met and len(met) < 10  # of 231
    sketches = spark.createDataFrame([(1, 0, 0, 0, 0), (2, 0, 0, 0, 255), (3, 0, -1, -1, -1)], "_k1 long, _s0 long, _s1 long, _s2 long, _s3 long")
    stay = lines._alike_rows(sketches.selectExpr("0L as _key", "_k1"), sketches)
    assert {(r._k1, r._head) for r in stay.collect()} == {(1, 1), (2, 1)}
    assert [(r.a, r.b) for r in lines._stars(stay).collect()] == [(1, 2)]


def test_op2_repeated_shingles_leave_no_pair_open(spark):
    """Marks count distinct shingles, so that lines which share only what they repeat need no look at their texts."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    own = letters(120)
    texts = ["xy" * 200 + letters(40), "xy" * 200 + letters(40), "xy" * 200 + own, "xy" * 90 + own, "xy" * 90 + own[:110], "日本", "日本"]
    rows = spark.createDataFrame(list(enumerate(texts)), "_k1 long, _line string")
    marks = lines._marks(rows)
    assert {r._k1: r._n for r in marks.collect()} == {i: len(shingles(x)) for i, x in enumerate(texts)}
    pairs = spark.createDataFrame([(i, j) for j in range(len(texts)) for i in range(j)], "a long, b long")
    left_open = {(r.a, r.b): r._n for r in lines._open(pairs, marks, 0.8).collect()}
    want = {(2, 3), (2, 4), (3, 4), (5, 6)}
    assert left_open == {(a, b): len(shingles(texts[a])) + len(shingles(texts[b])) for a, b in want}
    assert {(r.a, r.b) for r in lines._similar(pairs, rows, marks, 0.8).collect()} == want


def test_op2_shuffle_files_go_with_their_query_and_signatures_shuffle_no_hashes(spark):
    def files():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for d in dirs for f in Path(d.getPath()).glob("*/shuffle_*.data")}

    docs = spark.createDataFrame([(i, f"line {i % 7} of a text\n\nline {i}, which is longer") for i in range(40)] + [(40, None), (None, "")], "_key long, _text string")
    signed, before = lines._signed(docs), files()
    # the texts once and one sketch a line, not the least hashes of all ranges
    plan = signed._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\((\w+)#", plan) == ["_k1", "_row"]
    table = lines.written(signed, "signatures")
    for _ in range(50):  # Spark does not wait for it
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert table.count() == 47


def test_op2_first_places_come_with_the_signatures(spark, monkeypatch):
    """Documents are split for signatures and candidates' texts only; keys that are null, repeat or are texts keep their order."""
    plans, write = {}, lines.written
    monkeypatch.setattr(lines, "written", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and write(df, name))
    long = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil a large pot of soup by the river"
    docs = [("b", f"x\n\nsame line\n{long}"), ("a", f"same line\nother\nsame line\n{long.replace('soup', 'stew')}"), ("c", "x\nother"), ("c", "other\nlast"), (None, "last\n x ")]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    signed = lines._signed(df.selectExpr("doc_id as _key", "text as _text"))
    doc = {t: xxhash.xxh64_intdigest(t.encode(), 42) for _, t in docs}
    want = {}
    for k, t in docs:
        for pos, raw in enumerate(t.split("\n")):
            if line := raw.strip():
                at = (k is not None, k or "", doc[t] - 2**64 * (doc[t] >> 63), pos)
                want[line] = min(want.get(line, at), at)
    got = [(r._at._key is not None, r._at._key or "", r._at._doc, r._at._pos) for r in signed.collect()]
    assert sorted(got) == sorted(want.values()) and len(got) == 6
    out = lines.deduplicated(df)
    assert sum("posexplode" in p for p in plans.values()) == 2 and "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()
    kept = {(r.doc_id, r.text) for r in out.collect()}
    assert kept == {("b", ""), ("a", docs[1][1].replace("\nsame line\n", "\n")), ("c", ""), (None, "last\n x ")}


def test_op2_lines_that_repeat_few_shingles_have_a_sketch(spark):
    """A line of one shingle a thousand times over may have none below the bar; it stays, and meets its like."""
    marks = [chr(0x2500 + i) for i in range(12)]
    df = spark.createDataFrame([(i, m * n) for i, m in enumerate(marks) for n in (700, 1500)], "doc_id long, text string")
    signed = lines._signed(df.selectExpr("doc_id as _key", "text as _text"))
    assert signed.count() == 24 and signed.select(*lines._SKETCH).distinct().count() == 12
    assert sum(r.n_kept for r in lines.deduplicated(df).collect()) == 12


def test_op10_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rng = np.random.default_rng(0)
    data = [(r.vec_id, [float(x) for x in r.embedding]) for r in rows]
    for i in range(300):  # near and equal copies
        v = np.array(data[i % 20][1])
        data.append((10_000 + i, (v + rng.normal(size=64) * 0.02 * (i % 3)).tolist()))
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    ids = np.array([d[0] for d in data])
    x = np.array([np.array(d[1], np.float32) for d in data], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T >= 0.9
    np.fill_diagonal(s, False)
    u = Union(len(ids))
    for i, j in np.argwhere(s).tolist():
        u.join(i, j)
    least = {}
    for i in range(len(ids)):
        least[u.find(i)] = min(least.get(u.find(i), ids[i]), ids[i])
    got = {r.vec_id: r for r in vectors.linked(df).collect()}
    assert sum(got[k].n_links for k in ids.tolist()) >= 0.99 * s.sum()
    assert all(got[k].n_links <= s[i].sum() for i, k in enumerate(ids.tolist()))
    assert sum(got[k].component_id == least[u.find(i)] for i, k in enumerate(ids.tolist())) >= 0.99 * len(ids)


def test_op10_keys_that_repeat_or_are_null(spark):
    v, u = [1.0, 0.0, 0.0], [0.0, 1.0]
    df = spark.createDataFrame([(None, v), (1, v), (1, None), (2, v), (1, u), (3, u), (None, None)], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in vectors.linked(df).collect())
    assert got == [(0, 0, 0, False), (0, 2, 1, False), (1, 0, 1, True), (1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False)]


def test_op10_recall_on_anisotropic_vectors():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 64)) / 8 * np.sqrt(0.17) + np.r_[np.sqrt(0.83), np.zeros(63)]
    x /= np.linalg.norm(x, axis=1)[:, None]
    centres = vectors.spherical_kmeans(x, 63)
    near = vectors.breadth(x, centres, 0.9)
    cells = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :near]
    i, j = np.nonzero(np.triu(x[:1500] @ x[:1500].T >= 0.9, 1))
    met = (cells[i][:, :, None] == cells[j][:, None, :]).any(axis=(1, 2))
    assert len(centres) == 63 and len(i) > 100 and met.mean() >= 0.95 and vectors.breadth(x[:0], centres, 0.9) == 3


def test_op10_cuts_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CUT", 7)
    rows = [(i, [1.0, i * 1e-4, 0.0]) for i in range(40)] + [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [None, 1.0]), (104, []), (105, [0.0, 0.0, 5.0]), (106, [0.0, 0.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.linked(df).collect()}
    assert len(got) == 47 and all(got[i] == (39, 0, i == 0) for i in range(40))
    assert all(got[i] == (0, i, True) for i in range(100, 105)) and got[105] == (1, 105, True) and got[106] == (1, 105, False)
    assert vectors.linked(df.limit(0)).count() == 0
    assert vectors.linked(df.where(F.col("vec_id").between(100, 104))).count() == 5
    assert pytest.approx(1.0) == np.linalg.norm(vectors._units([[3.0, 4.0]])[0][0])
