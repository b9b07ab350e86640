"""Nearest clusters by products of parts: right at ties, and few copies of a row."""

import numpy as np
import pytest

from loomgraph.operators import clustering


@pytest.mark.parametrize("run", [1, 16, 128])
@pytest.mark.parametrize("threshold", [0.3, 1.0, 2.5])
def test_nearest_of_products_with_ties(run, threshold):
    w = np.unique(np.random.default_rng(3).integers(-1, 2, (900, 5)).astype(float), axis=0)  # many equal distances
    w = w[np.abs(w).sum(1) > 0]
    w /= np.linalg.norm(w, axis=1, keepdims=True)

    def plain(cos):
        return np.where(1 - cos.max(1) <= threshold, cos.argmax(1), np.iinfo(np.int64).max).tolist()

    cos = np.clip(np.round(w @ w.T, 12), -1, 1)
    np.fill_diagonal(cos, -2)
    assert clustering._best_of_products(w, w, threshold, True, run)[0].at.tolist() == plain(cos)
    x, y = w[:77], w[77:]
    cos = np.clip(np.round(x @ y.T, 12), -1, 1)
    assert [b.at.tolist() for b in clustering._best_of_products(x, y, threshold, False, run)] == [plain(cos), plain(cos.T)]


def test_nearest_tells_apart_what_single_precision_cannot():
    rng = np.random.default_rng(4)
    u = np.tile(rng.standard_normal((1, 64)), (700, 1)) + 1e-5 * rng.standard_normal((700, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cos = np.round(u @ u.T, 12)
    np.fill_diagonal(cos, -2)
    best = clustering._best_of_products(u, u, 0.7, True)[0]
    assert (np.abs(best.cos - cos.max(1)) < 2e-12).all() and (cos[np.arange(700), best.at] >= cos.max(1) - 2e-12).all()


def test_rounds_deal_a_row_to_few_parts(spark, monkeypatch):
    seen, nearest = [], clustering._nearest
    monkeypatch.setattr(clustering, "_nearest", lambda live, threshold, strict, parts: seen.append(parts) or nearest(live, threshold, strict, parts))
    v = np.random.default_rng(5).standard_normal((320, 6))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id long, vector array<double>")
    got, whole = ({r["id"]: r["cluster"] for r in clustering.average_linkage(df, 0.4, block=b).collect()} for b in (16, 4096))
    assert got == whole and 1 < len(set(got.values())) < 320
    assert seen and max(seen) == 8  # one for each block before, so 20


@pytest.mark.parametrize("threshold", [0.05, 0.3, 1.0])
def test_chains_without_a_matrix(threshold):
    rng = np.random.default_rng(6)
    tied = np.unique(rng.integers(-1, 2, (150, 4)).astype(float), axis=0)
    for w in (tied[np.abs(tied).sum(1) > 0], rng.standard_normal((300, 5)), rng.standard_normal((1, 5)) + 0.1 * rng.standard_normal((200, 5))):
        w = w / np.linalg.norm(w, axis=1, keepdims=True)
        size = rng.integers(1, 4, len(w)).astype(float)
        labels, sums, sizes = clustering.chains(w * size[:, None], size, threshold)
        assert labels.tolist() == clustering.linkage(w * size[:, None], size, threshold, False).tolist()
        for x in np.unique(labels):
            assert sizes[x] == size[labels == x].sum() and np.allclose(sums[x], (w * size[:, None])[labels == x].sum(0))


def test_near_copies_need_no_round_each(spark, monkeypatch):
    seen, nearest = [], clustering._nearest
    monkeypatch.setattr(clustering, "_nearest", lambda live, *more: seen.append(1) or nearest(live, *more))
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.standard_normal((60, 16)), *[rng.standard_normal((1, 16)) + np.append(np.zeros((1, 16)), 0.08 * rng.standard_normal((70, 16)), axis=0) for _ in "ab"]])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rng.permutation(v).tolist())], "id long, vector array<double>")
    got, whole = ({r["id"]: r["cluster"] for r in clustering.average_linkage(df, 0.5, block=b).collect()} for b in (16, 4096))
    assert got == whole and len(set(got.values())) < 60
    assert len(seen) < 8, len(seen)
    seen.clear()
    monkeypatch.setattr(clustering, "TIGHT", 40)  # larger groups go through the rounds
    assert {r["id"]: r["cluster"] for r in clustering.average_linkage(df, 0.5, block=100).collect()} == whole and seen
