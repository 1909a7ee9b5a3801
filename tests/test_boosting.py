"""Softmax boosting against plain numpy on the same bins, and on rows that only a tree can tell."""

import numpy as np
import pytest

from retort.operators import boosting as B

R = np.random.default_rng(4)


def frames(spark, x, label):
    rows = spark.createDataFrame([(k, [float(v) for v in a]) for k, a in enumerate(x)], "sample_id long, x array<double>").repartition(3)
    return rows, spark.createDataFrame([(k, f"c{v}") for k, v in enumerate(label)], "sample_id long, label string")


def plain(x, place, held, edges, rounds, depth, rate, smooth):
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], 1)
    classes = place.max() + 1
    scores = np.zeros((len(x), classes))
    for _ in range(rounds):
        p = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
        more = np.zeros_like(scores)
        for c in range(classes):
            g, h = p[:, c] - (place == c), p[:, c] * (1 - p[:, c])

            def grow(rows, level, c=c, g=g, h=h):
                own = rows[~held[rows]]
                value = lambda r: g[r].sum() ** 2 / (h[r].sum() + smooth)
                best = (1e-9, None)
                if level < depth:
                    for f in range(x.shape[1]):
                        for b in range(31):
                            left, right = own[binned[own, f] <= b], own[binned[own, f] > b]
                            if h[left].sum() >= B.LEAST_WEIGHT and h[right].sum() >= B.LEAST_WEIGHT:
                                gain = round(value(left) + value(right) - value(own), 9)
                                if gain > best[0]:
                                    best = (gain, (f, b))
                if best[1] is None:
                    more[rows, c] = -rate * (classes - 1) / classes * g[own].sum() / (h[own].sum() + smooth)
                else:
                    f, b = best[1]
                    grow(rows[binned[rows, f] <= b], level + 1)
                    grow(rows[binned[rows, f] > b], level + 1)

            grow(np.arange(len(x)), 0)
        scores = scores + more
    return scores


def test_is_that_of_plain_numpy(spark):
    x, place = R.normal(size=(90, 3)), np.arange(90) % 3
    x[:, 1] += place * (x[:, 0] > 0)
    rows, labels = frames(spark, x, place)
    held = np.arange(90) % 5 == 0
    test = labels.where("sample_id % 5 = 0")
    edges = [np.array(e) for e in B.feature_edges(rows.where("sample_id % 5 <> 0"))]
    want = plain(x, place, held, edges, 2, 2, 0.5, 1.0).argmax(1)
    got = {r.sample_id: (r.y_true, r.y_pred) for r in B.boosted_classes(rows, labels, test, rounds=2, depth=2, rate=0.5).collect()}
    assert got == {int(k): (f"c{place[k]}", f"c{want[k]}") for k in np.flatnonzero(held)}


def test_tells_what_no_single_feature_tells(spark):
    x = R.uniform(-1, 1, size=(300, 2))
    place = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] > 0)
    place = np.where(place == 3, 0, place)  # opposite quarters are one class
    rows, labels = frames(spark, x, place)
    out = B.boosted_classes(rows, labels, labels.where("sample_id % 4 = 0"), rounds=4, depth=2).collect()
    assert len(out) == 75 and np.mean([r.y_true == r.y_pred for r in out]) > 0.9


def test_odd_tables(spark):
    rows, labels = frames(spark, np.ones((6, 2)), [1] * 6)
    test = labels.where("sample_id < 2")
    assert {r.y_pred for r in B.boosted_classes(rows, labels, test, rounds=1).collect()} == {"c1"}
    assert B.boosted_classes(rows, labels, labels.limit(0), rounds=1).collect() == []
    assert [r.y_pred for r in B.boosted_classes(rows, labels, labels, rounds=1).collect()] == [None] * 6


@pytest.mark.parametrize("seed", [1, 2])
def test_best_cut(seed):
    r = np.random.default_rng(seed)
    g, h = r.normal(size=(3, 8)), r.random((3, 8)) + 0.1
    g *= np.array([[1], [1], [1]])
    gain, f, b = B.best_cut(g, h, 1.0)
    part = lambda a, c: a**2 / (c + 1)
    every = {(k, c): part(g[k, : c + 1].sum(), h[k, : c + 1].sum()) + part(g[k, c + 1 :].sum(), h[k, c + 1 :].sum()) - part(g[k].sum(), h[k].sum()) for k in range(3) for c in range(7)}
    assert abs(gain - max(every.values())) < 1e-9 and every[f, b] == pytest.approx(gain)
