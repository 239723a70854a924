import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loadspan.llm import extraction, licences, quality, queries, toxicity
from loadspan.llm.crf import TokenField, marginals
from loadspan.llm.dom import Page, features
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_op3_statistics(spark, texts):
    for r in queries.op3_weak_supervision(spark, SF).collect():
        want = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)


def test_op3_odd_rows(spark, odd_documents):
    got = quality.judged(odd_documents).collect()
    assert len(got) == 8
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(r.text)
    assert quality.judged(odd_documents.limit(0)).count() == 0


def test_op3_learns_which_rules_agree():
    good, junk = (1,) * 6, (0, 0, 0, 1, 1, 1)
    prior, rates = quality.expectation_maximisation([(good, 900), (junk, 80), ((1, 1, 1, 1, 1, None), 20)])
    assert 0.85 < prior < 0.95 and quality.posterior(junk, prior, rates) < 0.5 < quality.posterior(good, prior, rates)
    assert quality.expectation_maximisation([]) == (0.9, [])


def test_op7_field_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    unary, pair, first = rng.normal(size=6), rng.normal(size=(2, 2)), 0.3
    starts, lengths = np.array([0, 4]), np.array([4, 2])
    p, _, _ = marginals(unary, starts, lengths, pair, first)
    for s, n in zip(starts, lengths):
        weight, ones = 0.0, np.zeros(n)
        for code in range(2**n):
            tags = [(code >> i) & 1 for i in range(n)]
            w = np.exp(first * tags[0] + sum(unary[s + i] * t for i, t in enumerate(tags)) + sum(pair[a, b] for a, b in zip(tags, tags[1:])))
            weight, ones = weight + w, ones + w * np.array(tags)
        assert np.allclose(p[s : s + n], ones / weight)


def test_op7_field_learns():
    feats = np.array([[0], [1], [0], [1], [0], [0]])
    tags = np.array([0, 1, 0, 1, 0, 0])
    field = TokenField(2).fit(feats, tags, np.array([0, 4]), np.array([4, 2]))
    p, _, _ = marginals(field.unary(feats), np.array([0, 4]), np.array([4, 2]), field.pair, field.first)
    assert ((p > 0.5) == tags).all()


def test_op7_planted_words(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(600):
        words = rng.choice(vocabulary, 60).tolist()
        if i % 4 == 0:
            for w in rng.choice(["zorpish", "blagrat", "Snivvle"], 3):
                words[int(rng.integers(60))] = str(w)
        rows.append((i, " ".join(words), i % 4 == 0))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity.scored(df, toxicity.fit(df, labels)).select("*", toxicity.held_out(F.col("doc_id")).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all((r.score >= 0.5) == rows[r.doc_id][2] for r in got)
    r = next(r for r in got if r.doc_id == 0)
    assert {r.text.encode()[s.start : s.end].decode().lower() for s in r.toxic_spans} <= {"zorpish", "blagrat", "snivvle"} and r.toxic_spans


def test_op7_odd_rows(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.scored(odd_documents, toxicity.fit(odd_documents, labels)).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    none = toxicity.fit(odd_documents.limit(0), labels.limit(0))
    assert toxicity.scored(odd_documents, none).where("score >= 0.5").count() == 0


def test_op7_held_out_recall_and_precision(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.op7_crf_toxicity(spark, sf).select("doc_id", "predicted", "held_out").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(labels[k], r.predicted) for k, r in rows.items() if r.held_out and k in labels]
    caught, toxic, said = (sum(x) for x in zip(*((a and b, a, b) for a, b in held)))
    assert toxic >= 50 and caught >= 0.8 * toxic and caught >= 0.95 * said


def test_op8_against_brute_force(spark, texts):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for r in queries.op8_license_scan(spark, SF).collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r.doc_id] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, label) for p, label in phrases.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
        assert r.n_words == len(words) and r.n_base == len(at) and r.base_labels == ",".join(sorted({b for _, b in at}))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_op8_notices(spark, odd_documents):
    rows = [(0, "x " * 50 + "Licensed under CC BY-NC 4.0. " + "y " * 9), (1, "This program: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."), (2, "license the by under public")]
    got = {r.doc_id: {n.label for n in r.notices} for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == {"cc-by-nc"} and "gpl" in got[1] and got[2] == set()
    assert licences.scan(odd_documents).count() == 8 and licences.scan(odd_documents.limit(0)).count() == 0


def test_op8_mentions_are_no_notices():
    prose = b"we compare the mit license with others and the apache license too , under public terms the software may be free "
    mit = dict((label, text) for label, text, _ in licences.NOTICES if text.startswith("permission is hereby granted free of charge to any person obtaining"))["mit"]
    counts, n = {}, 200
    for _, text, _ in licences.NOTICES:
        for w in set(licences.words_of(text.encode())):
            counts[w] = counts.get(w, 0) + 3
    index = licences.RareTokenIndex(counts, n)
    labels = lambda t: {f[0] for f in index.scan(t)[3]}
    assert labels(prose) == labels(b"this is not under the apache license at all") == labels(b"it was never released under the mit license") == set()
    assert index.scan(prose)[2] == ["apache", "mit"]  # base labels stay
    assert labels(prose + b"Released under the MIT License.") == {"mit"} and labels(b"Licensed under the Apache License, Version 2.0") == {"apache"}
    assert labels(b"This work is licensed under the GNU General Public License, version 3.") == {"gpl"}
    whole = b"intro " * 30 + mit.encode() + b" outro" * 30
    assert [f[:3] for f in index.scan(whole)[3]] == [("mit", 30, 30 + len(mit.split()))]
    worn = mit.replace("merge publish", "merge and publish").replace("sell copies", "sell any copies")
    assert labels(worn.encode()) == {"mit"} and labels(mit.replace("substantial portions", "parts").encode()) == set()
    assert labels(" ".join(sorted(mit.split())).encode()) == set()


def test_op8_labels_on_the_tables(spark, texts):
    """The notices that the tables hold, told by plain search."""
    plain = {"mit": "released under the mit license", "apache": "licensed under the apache license, version 2.0", "gpl": "licensed under the gnu general public license, version 3", "cc-by-nc": "licensed under cc by-nc 4.0"}
    for r in queries.op8_license_scan(spark, SF).collect():
        want = {k for k, p in plain.items() if p in (texts[r.doc_id] or "").lower()} | set(filter(None, r.base_labels.split(",")))
        assert set(filter(None, r.labels.split(","))) == want


def test_op8_every_place_of_a_notice():
    index = licences.RareTokenIndex({}, 10)
    notice = b"released under the mit license "
    found = [f for f in index.scan(notice + b"x " * 40 + notice * 2 + b"y " * 40 + notice)[3] if f[0] == "mit"]
    assert [f[1:3] for f in found] == [(0, 5), (45, 50), (50, 55), (95, 100)]
    assert [f[1:3] for f in index.scan(notice)[3] if f[0] == "mit"] == [(0, 5)]


def test_op6_marginals_by_enumeration():
    model = extraction.ContentModel()
    model.pair = [[0.4, -1.0], [-0.3, 0.8]]
    parent, unary = [-1, 0, 0, 1, 1], [0.2, -0.5, 1.0, 0.3, -1.2]
    p, pairs = model.marginals(parent, unary, True)
    weight, ones, seen = 0.0, np.zeros(5), np.zeros((2, 2))
    for code in range(32):
        s = [(code >> i) & 1 for i in range(5)]
        w = np.exp(sum(u * x for u, x in zip(unary, s)) + sum(model.pair[s[parent[i]]][s[i]] for i in range(1, 5)))
        weight, ones = weight + w, ones + w * np.array(s)
        for i in range(1, 5):
            seen[s[parent[i]], s[i]] += w
    assert np.allclose(p, ones / weight) and np.allclose(pairs, seen / weight)


def test_op6_pages(spark):
    model = extraction.default_model()
    page = '<html><body><nav><a href=x>Home</a></nav><div class="cookie">We use cookies &amp; more.</div><article><h1>A &lt;title&gt;</h1><p>First\n  part <b>bold</b>.<p>Second&nbsp;part</article><div id="comments"><p>Nice text by a reader, thanks.</p></div><footer>End</footer>'
    assert model.text(page) == "A <title>\nFirst part bold.\nSecond part"
    assert model.text("") == "" and model.text("<![if x]><p") in ("", "<p")
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (4, "u", "<div>" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = extraction.extracted(df).collect()
    assert len(got) == 5 and sorted(r.text for r in got)[:3] == ["", "", ""] and extraction.extracted(df.limit(0)).count() == 0


def test_op6_open_head_and_self_closed_elements():
    said = lambda html: " ".join("".join(t or " " for _, t in Page(html).pieces).split())
    assert said("<html><head><title>T</title><meta charset=x><body><p>Words</p></body></html>") == "Words"
    assert said("<html><head><link rel=x><script>var a</script><div>Words</div>") == "Words"
    assert said("<head><title>T</title></head><body><p>One <svg/>two <iframe src=x />three</p>") == "One two three"
    assert said("<p>One <svg><g/>no</svg>two</p>") == "One two"


def test_op6_articles_of_the_table(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op6_tree_model(spark, SF).collect():
        html = pages[r.page_id]
        tree = Page(html)
        inside = [False] * len(tree.tag)
        for i in range(1, len(tree.tag)):
            inside[i] = tree.tag[i] == "article" or inside[tree.parent[i]]
        assert r.text == "\n".join(tree.blocks(inside)) and r.n_chars == len(r.text)
        assert len(features(tree)) == len(tree.tag)


def test_tokens_of_a_batch():
    texts = ["Idiot a", "b C.d", "", "x", "éa bé", "end", "start! y"]
    t = toxicity.tokens(pa.array(texts))
    for c, a, b, d in zip(t.code, t.start, t.end, t.doc):
        assert texts[d].encode()[a:b].decode().lower() == t.forms[c]
    assert len(t.code) == 11 and t.length.sum() == 11
