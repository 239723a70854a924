import base64
import hashlib
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loadspan.llm import bpe, packing, queries, tokenfile
from loadspan.llm.wordpieces import chunk_encoder
from tests.llm.conftest import SF

RANKS = P.path("byte_bpe_50k.tiktoken")
HARD = ["", "a", "  ", "   x", "　　 é \r\n\t x'll I'VE 12 ³", "\x1c \x1d a\x1f b", "日本語 テスト   x", "a" * 3000, "é \n é", "\x85 \x85a", "<|endoftext|> x", "A ́b Σας ΣΑΣ İi", "ᄀ ᅡ", "x  y  z", "don't!!! ***"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache
def plain(name):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return t


def test_merges_as_tiktoken(reference):
    coder, tokens = bpe._coder(RANKS, P.PATTERN), bpe.TokenBytes(RANKS)
    ids, off = coder(pa.array(HARD))
    for i, t in enumerate(HARD):
        got = ids[off[i] : off[i + 1]]
        assert got.tolist() == reference.encode_ordinary(t)
        assert tokens.decode(got).tobytes() == t.encode()


@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_any_text_as_the_libraries(reference, texts):
    coder = bpe._coder(RANKS, P.PATTERN)
    ids, off = coder(pa.array(texts))
    assert [ids[off[i] : off[i + 1]].tolist() for i in range(len(texts))] == [reference.encode_ordinary(t) for t in texts]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        ids, off = chunk_encoder(P.path(name))(pa.array(texts))
        assert [ids[off[i] : off[i + 1]].tolist() for i in range(len(texts))] == [plain(name).encode(t, add_special_tokens=False).ids for t in texts]


def test_op4_round_trip(spark, texts, reference):
    for r in queries.op4_byte_bpe(spark, SF).collect():
        ids = reference.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_op4_odd_rows(spark, odd_documents):
    got = bpe.decode(bpe.encode(odd_documents, RANKS, P.PATTERN), RANKS).collect()
    assert len(got) == 8 and sorted(bytes(r.bytes).decode() for r in got) == sorted(r.text or "" for r in odd_documents.collect())
    assert bpe.decode(bpe.encode(odd_documents.limit(0), RANKS, P.PATTERN), RANKS).count() == 0


@given(st.lists(st.integers(0, 5), max_size=400))
@settings(max_examples=100, deadline=None)
def test_grammar_round_trip(ids):
    ids = np.array(ids * 9, np.int64)
    rules, lengths, seq = tokenfile.compress(ids, 6, 200)
    assert (tokenfile.expand(seq, 6, rules, lengths) == ids).all() and len(seq) <= len(ids)
    a, b = len(ids) // 3, len(ids) // 2
    if b > a:
        assert (tokenfile.read_range(6, rules, lengths, seq, a, b) == ids[a:b]).all()


def test_op5_against_whole_encoding(spark, texts):
    tokenizer, start = plain("byte_bpe_50k.json"), 0
    got = {r.doc_id: r for r in queries.op5_repair_files(spark, SF).collect()}
    assert len(got) == len(texts)
    for k in sorted(texts):
        ids = [*tokenizer.encode(texts[k] or "", add_special_tokens=False).ids, 0]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4")))
        start += len(ids)


def test_op5_ranges_and_sizes(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 5000)
    path = str(tmp_path / "f")
    tokenfile.write_token_file(documents, path, P.path("byte_bpe_50k.json"), 0, shards=3)
    every = [i for r in sorted(tokenfile.documents(spark, path, ids=True).collect(), key=lambda r: r.start) for i in r.ids]
    for start, stop in ((0, 10), (4990, 5010), (12_345, 33_333), (len(every) - 5, len(every) + 5), (7, 7)):
        got = sorted((r.at, r.ids) for r in tokenfile.ids_between(spark, path, start, stop).collect())
        assert [i for _, ids in got for i in ids] == every[start:stop] and (not got or got[0][0] == start)


def test_op5_rules_pay_and_none_is_left():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.zipf(1.3, 200_000), 50_000).astype(np.int32)
    ids[50_000:90_000] = np.tile(ids[:400], 100)
    rules, lengths, sequence = tokenfile.compress(ids, 50_257)
    assert (tokenfile.expand(sequence, 50_257, rules, lengths) == ids).all()
    assert 12 * len(rules) + 2 * len(sequence) < 0.75 * 2 * len(ids)
    pairs = np.flatnonzero(np.diff(sequence) != 0)  # pairs that cannot overlap themselves
    _, counts = np.unique(sequence[pairs] * (1 << 20) + sequence[pairs + 1], return_counts=True)
    assert counts.max() < tokenfile.LEAST_COUNT


def test_op5_odd_rows(spark, odd_documents, tmp_path):
    path = str(tmp_path / "f")
    tokenfile.write_token_file(odd_documents, path, P.path("byte_bpe_50k.json"), 0, shards=3)
    rows = sorted(tokenfile.documents(spark, path, ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6] and all(r.ids[-1] == 0 and len(r.ids) == r.n_tokens for r in rows)
    tokenfile.write_token_file(odd_documents.limit(0), path, P.path("byte_bpe_50k.json"), 0)
    assert tokenfile.documents(spark, path).count() == 0


def test_op9_against_whole_encoding(spark, texts):
    tokenizer = plain("word_bpe_49k.json")
    rows = queries.op9_best_fit(spark, SF).collect()
    whole = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for k, t in texts.items()}
    for r in rows:
        part = whole[r.doc_id][r.start : r.start + r.length]
        assert r.start == r.piece * 4096 and len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4"))
    assert sum(r.length for r in rows) == sum(map(len, whole.values()))
    check_bins([(r.sequence_id, r.offset, r.length) for r in rows], 4096)
    assert len({r.sequence_id for r in rows}) <= -(-sum(map(len, whole.values())) // 4096) * 1.02 + 1


def check_bins(rows, capacity):
    at = {}
    for s, offset, length in sorted(rows):
        assert offset == at.get(s, 0)
        at[s] = offset + length
    assert all(v <= capacity for v in at.values())


@given(st.lists(st.integers(1, 30), max_size=60))
@settings(max_examples=150, deadline=None)
def test_fit_is_gapless(sizes):
    of, offset = packing.fit(np.array(sizes, np.int64), 30)
    check_bins(list(zip(of.tolist(), offset.tolist(), sizes)), 30)
    bins = len(set(of.tolist()))
    assert bins <= 1.5 * (-(-sum(sizes) // 30)) + 1


def test_op9_odd_rows(spark, odd_documents):
    rows = packing.packed(odd_documents, P.path("word_bpe_49k.json"), 1, 4096).collect()
    check_bins([(r.sequence_id, r.offset, r.length) for r in rows], 4096)
    assert sum(r.doc_id == 1 for r in rows) == 2 and sum(r.doc_id == 4 for r in rows) == 8
    assert packing.packed(odd_documents.limit(0), P.path("word_bpe_49k.json"), 1, 4096).count() == 0


def test_op5_pairs_are_looked_up_without_a_search(monkeypatch):
    """Pairs whose numbers fall together wait for a later round, and none is left out."""
    ids = np.tile(np.random.default_rng(1).integers(0, 50, 300), 30)
    monkeypatch.setattr(tokenfile, "_BUCKET_BITS", 3)
    monkeypatch.delattr(np, "searchsorted")
    rules, lengths, sequence = tokenfile.compress(ids, 50)
    assert (tokenfile.expand(sequence, 50, rules, lengths) == ids).all() and 12 * len(rules) + 2 * len(sequence) < 2 * len(ids)
