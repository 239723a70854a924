import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loadspan.kernels import clustering, evaluation, signals
from loadspan.kernels.segmenting import BinarySegmentation
from loadspan.kernels.selfsim import _predicted, dtw, dtw_pairs, nearest_windows, profile, smallest, window_stats, windows
from loadspan.kernels.stream import StreamingSegmentation
from loadspan.kernels.widths import WIDTHS, dominant_fourier_frequency, highest_autocorrelation, suss

RNG = np.random.default_rng(0)


def regimes(*lengths):
    parts = [np.sin(np.arange(n) / (3 + 4 * i)) * (1 + i) for i, n in enumerate(lengths)]
    return np.concatenate(parts) + np.random.default_rng(1).normal(size=sum(lengths)) * 0.05


@pytest.mark.parametrize("score", ["roc_auc", "f1"])
def test_profile_is_that_of_every_split_by_itself(score):
    near = RNG.integers(0, 150, (150, 3))
    p = profile(near, 7, 20, score)
    side = np.arange(150)
    for s in range(20, 137):
        y, right = _predicted(near, s, 7) == 1, side >= s
        if score == "roc_auc":
            want = (1 + (right & y).sum() / y.sum() - (right & ~y).sum() / (~y).sum()) / 2
        else:
            f = lambda a, b: 2 * (a & b).sum() / (a.sum() + b.sum())
            want = (f(y, right) + f(~y, ~right)) / 2
        assert p[s] == pytest.approx(want, abs=1e-12)
    assert np.isneginf(p[:20]).all() and np.isneginf(p[137:]).all()


@pytest.mark.parametrize("distance", ["znormed_euclidean_distance", "euclidean_distance", "cinvariant_euclidean_distance"])
def test_nearest_windows_by_brute_force(distance):
    x, w, k = RNG.normal(size=80), 6, 3
    got = nearest_windows(x, w, k, distance, [(0, 80)])[(0, 80)]
    v = windows(x, w)
    if distance.startswith("znormed"):
        v = (v - v.mean(1)[:, None]) / v.std(1)[:, None]
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    if distance.startswith("cinv"):
        ce = (np.diff(windows(x, w), axis=1) ** 2).sum(1) + 1e-5
        d = d * np.maximum(ce[:, None], ce) / np.minimum(ce[:, None], ce)
    for i in range(len(v)):
        row = d[i].copy()
        row[max(0, i - 3) : i + 4] = row.max()
        assert sorted(row[got[i]]) == pytest.approx(sorted(row[smallest(row, k)]), rel=1e-6)


def test_segmentation_finds_regimes():
    found = BinarySegmentation().fit_predict(regimes(500, 600, 450))
    assert len(found) == 2 and abs(found[0] - 500) < 40 and abs(found[1] - 1100) < 40


@pytest.mark.parametrize("n", [0, 1, 5, 60])
def test_short_and_constant_series_stay_whole(n):
    assert BinarySegmentation().fit_predict(np.zeros(n)) == []


def test_stream_finds_regimes_and_pickles():
    import pickle

    x = regimes(600, 600)
    m = StreamingSegmentation(n_timepoints=1000, n_warmup=300, window_size=20, threshold=1e-12)
    with pytest.raises(RuntimeError):
        m.predict()
    for v in x[:700]:
        m.update(v)
    m = pickle.loads(pickle.dumps(m))
    for v in x[700:]:
        m.update(v)
    assert any(abs(c - 600) < 60 for c in m.found) and m.predict() == m.found[-1]
    with pytest.raises(ValueError):
        StreamingSegmentation(distance="shape_dtw")


def test_window_sizes():
    x = np.sin(np.arange(1000) * 2 * np.pi / 50)
    assert dominant_fourier_frequency(x) == 50 and highest_autocorrelation(x) == 50
    assert suss(np.zeros(1000)) == 10
    assert all(f(np.zeros(1)) == 1 for f in WIDTHS.values())


def test_metrics_known_values():
    assert evaluation.covering({1: [10, 20], 2: [10], 3: [0, 5]}, [10, 20], 45) == pytest.approx(0.7962962962962963)
    assert evaluation.f_measure({1: [], 2: [10], 3: [50]}, [10]) == pytest.approx(0.9090909090909091)
    assert evaluation.matched([10, 20], [11, 12], 2) == 1


@given(st.lists(st.floats(-100, 100), min_size=1, max_size=12), st.lists(st.floats(-100, 100), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_dtw_by_table(a, b):
    t = np.full((len(a) + 1, len(b) + 1), np.inf)
    t[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(t[i, j], t[i, j + 1], t[i + 1, j])
    assert dtw(a, b) == pytest.approx(t[-1, -1], abs=1e-6)


@given(st.integers(8, 300))
@settings(max_examples=40, deadline=None)
def test_wavelet_parts_add_up(n):
    x = np.random.default_rng(n).normal(size=n)
    low, high = signals.wavelet_split(x)
    assert np.allclose(low + high, x)


def test_wavelet_keeps_lines_low():
    low, high = signals.wavelet_split(np.arange(96.0) * 2 + 5)
    assert np.abs(high[20:-20]).max() < 1e-9


def test_median_filter_pads_with_zeros():
    assert signals.median_filter5([9.0, 8, 7, 1, 9]).tolist() == [7, 7, 8, 7, 1]


def test_likelihood_and_arc_segmenters():
    x = np.concatenate([np.zeros(100), np.full(120, 50.0), np.sin(np.arange(100)) * 10])
    assert all(min(abs(c - t) for t in (100, 220)) < 5 for c in signals.prim_glr(x)) and signals.prim_glr(x)
    assert len(signals.fluss(x, 20, 3, 2)) <= 2
    assert signals.prim_glr(np.ones(5)) == [] == signals.fluss(np.ones(500))


def test_synthesis():
    assert signals.synthesised([10, 50], [12, 40, 90]) == [11.0, 45.0, 90.0]
    assert signals.synthesised([], []) == []


def blobs(centres, n, dims, spread):
    return np.concatenate([RNG.normal(c, spread, (n, dims)) for c in centres])


def test_clusterings_of_blobs():
    x = blobs((0, 5, 10), 20, 8, 0.05)
    truth = np.repeat([0, 1, 2], 20)
    same = lambda a: len(set(zip(a, truth))) == 3 and len(set(a)) == 3
    assert same(clustering.lloyd_best(x, 3)[0]) and same(clustering.density_peaks(x, 3)[0])
    d = clustering._distances(x, x)
    assert same(clustering.dbscan(d, 1.0, 3)) and same(clustering.hdbscan(x, 5))
    assert (clustering.dbscan(d, 1e-9, 3) == -1).all()
    assert window_stats(np.ones(5), 2)[1].tolist() == [1.0] * 4


def test_clusterings_in_parts_give_what_whole_matrices_give(monkeypatch):
    """No kernel holds all distances: with room for a few rows at once the results are those of the full matrix."""
    x = np.concatenate([blobs((0, 1.2, 5), 30, 4, 0.5), RNG.uniform(-2, 8, (25, 4)), np.zeros((3, 4))])
    d = clustering._distances(x, x)
    monkeypatch.setattr(clustering, "HELD", 500)
    for metric, f in clustering.METRICS.items():
        for eps, least in ((0.9, 4), (0.05, 2), (2.0, 6)):
            assert (clustering.dbscan_rows(x, eps, least, metric) == clustering.dbscan(f(x, x), eps, least)).all()
    for percent in (0.5, 2.0, 30.0, 100.0):
        assert clustering.cutoff(x, percent) == pytest.approx(clustering._cutoff(d, percent), abs=1e-7)
        assert clustering.cutoff(x, percent, bins=4) == pytest.approx(clustering._cutoff(d, percent), abs=1e-7)
    core = np.sort(d, axis=1)[:, 4]
    whole = clustering._tree(np.maximum(d, np.maximum(core[:, None], core[None, :])))
    assert [e[0] for e in clustering._reach_tree(x, core)] == pytest.approx([e[0] for e in whole], abs=1e-7)
    monkeypatch.setattr(clustering, "_distances", lambda a, b, f=clustering._distances: f(a, b) if len(a) * len(b) <= 500 else pytest.fail("too many distances at once"))
    for labels in (clustering.density_peaks(x, 3)[0], clustering.hdbscan(x, 5), clustering.dbscan_rows(x, 0.9, 4)):
        assert len(labels) == len(x) and len(set(labels.tolist())) > 1
    assert clustering.dbcv_simplified(x, np.arange(len(x)) % 3) > 0


@pytest.mark.parametrize("n, m", [(1, 1), (1, 6), (7, 4)])
def test_dtw_of_many_pairs(n, m):
    a, b = RNG.normal(size=(5, n)), RNG.normal(size=(3, m))
    assert dtw_pairs(a, b) == pytest.approx(np.array([[dtw(s, t) for t in b] for s in a]))


def test_tree_of_many_nested_clusters_holds_no_rows_twice():
    import tracemalloc

    n = 4000  # pairs of rows, and each pair joins all before it
    edges = [(1e-4, i, i + 1) for i in range(0, n, 2)] + [(1.0 + i / n, i, i + 2) for i in range(0, n - 2, 2)]
    tracemalloc.start()
    label = clustering.stable_clusters(edges, n, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (label[::2] == label[1::2]).all() and len(set(label.tolist())) == n // 2 and label[0] == 0
    assert peak < 10e6


@pytest.mark.parametrize("n", [2, 7, 97, 400])
def test_strips_of_rows_give_what_whole_matrices_give(n, monkeypatch):
    for name, size in (("STRIP", 64), ("TILE", 100), ("TREE_ROWS", 70)):
        monkeypatch.setattr(clustering, name, size)
    x = np.concatenate([blobs((0, 2), n // 2, 4, 0.6), RNG.normal(1, 2, (n % 2, 4))])
    x[: n // 40] = x[-1]  # copies
    d, r, parts = clustering._distances(x, x), clustering.lifted(x), clustering.strips(n)
    np.fill_diagonal(d, 0)
    deals = [parts[::2], parts[1::2]]
    assert sum(clustering.density_parts(r, p, 1.3) for p in deals) == pytest.approx(np.exp(-((d / 1.3) ** 2)).sum(1) - 1)
    near = np.minimum.reduce([clustering.nearest_before(r, p) for p in deals])
    assert near[1:] == pytest.approx([d[:i, i].min() ** 2 for i in range(1, n)], abs=1e-9)
    pairs = d[np.triu_indices(n, 1)] ** 2
    below, held = zip(*[clustering.pairs_between(r, p, 0.5, 2.0) for p in deals])
    assert sum(below) == (pairs < 0.5).sum() and np.sort(np.concatenate(held)) == pytest.approx(np.sort(pairs[(pairs >= 0.5) & (pairs < 2)]))
    assert sum(clustering.pairs_between(r, p, 0.5, 2.0, 8)[1].sum() for p in deals) == sum(map(len, held))
    core = np.concatenate([clustering.core_distances(r, i, j, 5) for i, j in parts])
    far = np.sort(d, axis=1)[:, min(5, n) - 1]
    assert np.sqrt(core) == pytest.approx(far, abs=1e-7)
    blocks = [(i, min(i + 70, n)) for i in range(0, n, 70)]
    trees, room = [clustering.block_tree(r, core, *b) for b in blocks], np.full((140, 140), np.inf)
    joint = [clustering.joint_tree(r, core, blocks[i], blocks[j], (trees[i], trees[j]), room) for i in range(len(blocks)) for j in range(i + 1, len(blocks))]
    tree = clustering.sparse_tree(np.concatenate([*trees, *joint], axis=1), n)
    whole = clustering._tree(np.maximum(d, np.maximum(far[:, None], far[None, :])))
    assert np.sort(np.sqrt(tree[0])) == pytest.approx(np.sort([e[0] for e in whole]), abs=1e-6)


def test_scores_hold_one_tile_of_distances_at_a_time():
    import tracemalloc

    r = clustering.lifted(np.random.default_rng(1).normal(size=(9000, 3)))
    labels = [np.arange(9000) % k for k in (2, 3)]
    tile = clustering.STRIP * max(4500, clustering.TILE) * 8  # every second row, by which the nearest are bounded
    tracemalloc.start()
    try:
        found = clustering.score_parts(r, [(0, clustering.STRIP)], labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == 2 and peak < 1.5 * tile


def test_tiles_of_32_bits_give_what_64_bits_give(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32))
    x[1500:1503] = x[7] + 1e-3 * rng.normal(size=(3, 32))  # copies
    x /= np.linalg.norm(x, axis=1)[:, None]
    labels = [np.where(np.isin(np.arange(3000), (7, 1500, 1502)), k, np.arange(3000) % k) for k in (2, 3)]  # the last label has near copies only
    for rows, kind in ((x, "float32"), (np.concatenate([x[:1500], x[1500:] + 30]), "float64"), (x * 1e25, "float64")):  # 32 bits are too few for the latter
        r, strips, seen = clustering.lifted(rows), [(0, 512), (1024, 1536)], set()
        find = lambda: ([clustering.nearest_rows(r, i, j, 16, lambda c, e, d: seen.add(str(d.dtype))) for i, j in strips], clustering.score_parts(r, strips, labels))  # noqa: B023, E731
        monkeypatch.undo()
        near, scores = find()
        assert kind in seen
        monkeypatch.setattr(clustering, "NARROW", 1e-30)  # all are measured with 64 bits
        whole, want = find()
        for (a, b, d), (p, q, h) in zip(near, whole):
            first, other = clustering._rank(a) < 16, clustering._rank(p) < 16
            assert (a[first] == p[other]).all() and d[first] == pytest.approx(h[other], rel=1e-9, abs=1e-9)
        for some, every in zip(scores, want):
            assert some[0] == pytest.approx(every[0], rel=1e-6) and some[1] == pytest.approx(every[1], rel=1e-6)
