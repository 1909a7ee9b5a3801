"""Greedy selection against plain numpy loops on the same folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retort.operators import selection as G
from retort.operators import signals as S
from retort.operators import splits as P
from retort.operators import survival as V

R = np.random.default_rng(5)
N, CLASSES = 36, 3
LABEL = np.arange(N) % CLASSES
X = R.normal(size=(N, 6)) * [1, 5, 1, 2, 1, 1]
X[:, 1] += LABEL * 4
X[:, 3] += (LABEL == 2) * 3


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, [float(v) for v in x]) for k, x in enumerate(X)], "sample_id long, x array<double>").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, f"c{c}") for k, c in enumerate(LABEL)], "sample_id long, label string")


def told(x, train, test, alpha=1.0):
    if x.shape[1] == 0:
        return np.full(len(test), np.bincount(LABEL[train], minlength=CLASSES).argmax())
    y = np.where(LABEL[:, None] == np.arange(CLASSES), 1.0, -1.0)
    d = x[train] - x[train].mean(0)
    w = np.linalg.solve(d.T @ d + alpha * np.eye(x.shape[1]), d.T @ (y[train] - y[train].mean(0)))
    return ((x[test] - x[train].mean(0)) @ w + y[train].mean(0)).argmax(1)


def balanced(x, train, test):
    p = told(x, train, test)
    return np.mean([np.mean(p[LABEL[test] == c] == c) for c in np.unique(LABEL[test])])


def folds_of(test):
    out = {}
    for r in test.collect():
        out.setdefault(r.split_id, []).append(r.sample_id)
    return [np.array(sorted(v)) for _, v in sorted(out.items())]


def cv(x, folds, among):
    return round(np.mean([balanced(x, np.setdiff1d(among, f), f) for f in folds]), 12)


@pytest.mark.parametrize("mode", ["remove", "add"])
def test_shared_survival(rows, labels, mode):
    cubes = [[0, 1], [2], [3, 4], [5]]
    got = [(r.step, r.cube, r.accuracy) for r in G.shared_survival(rows, labels, cubes, mode, folds=4).orderBy("step").collect()]
    folds = folds_of(P.stratified_folds(labels, "label", 4))
    chosen = set(range(4)) if mode == "remove" else set()
    for step in range(4):
        left = sorted(chosen) if mode == "remove" else sorted(set(range(4)) - chosen)
        score = {c: cv(X[:, [p for k in sorted(chosen ^ {c}) for p in cubes[k]]], folds, np.arange(N)) for c in left}
        best = max(left, key=lambda c: (score[c], -c))
        assert got[step][:2] == (step, best) and abs(got[step][2] - score[best]) < 1e-9
        chosen ^= {best}
    assert len(got) == 4


def test_drawn_candidates_are_seeded(rows, labels):
    runs = [[tuple(r) for r in G.shared_survival(rows, labels, [[k] for k in range(6)], "add", 3, 4, drawn=2, seed=s).orderBy("step").collect()] for s in (1, 1)]
    assert runs[0] == runs[1] and len(runs[0]) == 3


def test_averages_and_concatenations():
    assert G.channel_places([0, 2], 2) == [[0], [1], [4], [5]]
    assert G.channel_places([0, 2], 2, "average") == [[0, 4], [1, 5]]
    assert G.channel_places([], 2, "average") == []
    with pytest.raises(ValueError):
        G.channel_places([0], 1, "sum")


@pytest.mark.parametrize("mode", ["add", "remove"])
def test_nested_channels(rows, labels, mode):
    repeats, folds, least = 2, 3, 2
    got = G.nested_channels(rows, labels, 6, mode=mode, count=3, repeats=repeats, folds=folds, least=least).collect()
    order = rows.select("sample_id", *[F.xxhash64("sample_id", F.lit(g), F.lit(0)).alias(f"h{g}") for g in range(repeats)]).collect()
    splits = folds_of(P.stratified_folds(labels, "label", 5, repeats))
    for g in range(repeats):
        test = splits[5 * g]
        train = np.setdiff1d(np.arange(N), test)
        x = (X - X[train].mean(0)) / X[train].std(0)
        key = {r.sample_id: r[f"h{g}"] for r in order}
        of = {c: sorted([k for k in train if LABEL[k] == c], key=lambda k: (key[k], k)) for c in range(CLASSES)}
        inner = [np.array(sorted(of[c][f % len(of[c])] for c in range(CLASSES))) for f in range(folds)]
        chosen = list(range(6)) if mode == "remove" else []
        each = lambda c: np.array([balanced(x[:, sorted(c)], np.setdiff1d(train, f), f) for f in inner])
        base = each(chosen).mean()
        mine = {r.step: r for r in got if r.repeat == g}
        assert abs(mine[-1].validation - base) < 1e-9 and abs(mine[-1].test - balanced(x[:, chosen], train, test)) < 1e-9
        for step in range(3):
            left = sorted(chosen) if mode == "remove" else sorted(set(range(6)) - set(chosen))
            after = {c: [o for o in chosen if o != c] if mode == "remove" else [*chosen, c] for c in left}
            scores = {c: each(after[c]) for c in left}
            wins = {c: 0 for c in left}
            for f in range(folds):
                wins[max(left, key=lambda c: (round(scores[c][f], 12), -c))] += 1
            snr = {c: round((scores[c].mean() - base) / (scores[c].std() + 1e-8), 9) for c in left}
            best = max(left, key=lambda c: (wins[c] >= least, snr[c], -c))
            assert mine[step].channel == best and mine[step].wins == wins[best]
            chosen, base = after[best], scores[best].mean()
            assert abs(mine[step].validation - base) < 1e-9
            assert abs(mine[step].test - balanced(x[:, sorted(chosen)], train, test)) < 1e-9


def test_count_map(rows, labels):
    """3 bins of 2 channels; counts 2 and 1 by 2 and 1."""
    got = {(r.rt_bins, r.mz_channels): r.accuracy for r in G.count_map(rows, labels, 3, 2, [2, 1], [2, 1], folds=3).collect()}
    half = {r.sample_id: r.split_id for r in P.stratified_folds(labels, "label", 2).collect()}
    sides = [np.array([k for k in range(N) if half[k] == s]) for s in (0, 1)]
    folds = [folds_of(P.stratified_folds(labels.where(F.col("sample_id").isin([int(k) for k in s])), "label", 3, seed=1)) for s in sides]
    places = lambda b, c: [r * 2 + k for r in b for k in c]
    bins = [0, 1, 2]
    for keep in (2, 1):
        while len(bins) > keep:
            score = {b: cv(X[:, places([o for o in bins if o != b], [0, 1])], folds[0], sides[0]) for b in bins}
            bins.remove(max(bins, key=lambda b: (score[b], -b)))
        channels = [0, 1]
        for k in (2, 1):
            while len(channels) > k:
                score = {c: cv(X[:, places(bins, [o for o in channels if o != c])], folds[1], sides[1]) for c in channels}
                channels.remove(max(channels, key=lambda c: (score[c], -c)))
            x = X[:, places(bins, channels)]
            right = np.mean([told(x, np.setdiff1d(sides[1], [k]), np.array([k]))[0] == LABEL[k] for k in sides[1]])
            assert abs(got[keep, k] - right) < 1e-9
    assert len(got) == 4


def test_weighted_peak_distance(spark):
    peaks = spark.createDataFrame([(1, 10, 2.0), (1, 15, 4.0), (1, 40, 1.0), (2, 0, 5.0)], "sample_id long, scan_idx int, prominence double")
    ref = spark.createDataFrame([(10, 4.0), (20, 2.0)], "scan_idx int, prominence double")
    got = {r.sample_id: (r.distance, r.n) for r in S.weighted_peak_distance(peaks, ref).collect()}
    # 15 lies between both: the earlier one counts
    assert got == {1: ((0.5 * 0 + 1.0 * 5 + 0.5 * 20) / 2.0, 3), 2: (10.0, 1)}
    assert {r.sample_id: r.distance for r in S.weighted_peak_distance(peaks, ref, square=True).collect()}[1] == (25 + 200) / 2
    assert S.weighted_peak_distance(peaks, ref.limit(0)).count() == 0


def grams_of(cubes):
    return {c: X[:, p] @ X[:, p].T for c, p in cubes.items()}


@pytest.mark.parametrize(("mode", "ahead"), [("remove", 0.0), ("add", 0.0), ("add", 0.5)])
def test_survival_by_folds_is_that_of_gram_matrices(spark, rows, labels, monkeypatch, mode, ahead):
    monkeypatch.setattr(G, "BLOCK_ROWS", 9)
    monkeypatch.setattr(G, "CHUNK", 2)
    cubes = {10_001: [0, 1], 10_002: [2], 20_001: [3, 4], 20_002: [5]}
    test = P.stratified_folds(labels, "label", 3)
    got = {(r.fold, r.step): (r.cube, r.inner_accuracy, r.outer_accuracy) for r in G.survival(rows, labels, test, cubes, mode, look_ahead=ahead).collect()}
    held = {(r.split_id, r.sample_id) for r in test.collect()}
    order = np.array(sorted(range(len(X)), key=str))
    names = np.array([r.label for r in sorted(labels.collect(), key=lambda r: str(r.sample_id))])
    for f in range(3):
        inside = np.array([(f, int(k)) in held for k in order])
        m = {c: g[np.ix_(order, order)] for c, g in grams_of(cubes).items()}
        want = V.greedy(m, names, np.flatnonzero(~inside), np.flatnonzero(inside), mode, 9, 3, 1.0, ahead)
        assert len(want) == 4
        for step, cube, inner, outer in want:
            assert got[f, step][0] == cube and np.allclose(got[f, step][1:], (inner, outer))


def test_scores_of_sets(spark, rows, labels):
    sets = [(3, [0]), (9, [1, 4]), (10, [0, 1, 2, 3, 4, 5])]
    got = {r.set_id: r.accuracy for r in G.set_scores(rows, labels, sets).collect()}
    order = np.array(sorted(range(len(X)), key=str))
    names = np.array([r.label for r in sorted(labels.collect(), key=lambda r: str(r.sample_id))])
    for k, p in sets:
        x = X[order][:, p]
        assert abs(got[k] - V.cv_score(x @ x.T, names, np.arange(len(x)), 3, 1.0)) < 1e-12


def test_cubes_become_places(spark):
    f = spark.createDataFrame([("a", 7, 1, 2.0), ("a", 3, 5, 1.0), ("b", 7, 2, 4.0)], "sample_id string, cube int, pos long, value double")
    rows, places = G.wide_cubes(f)
    assert places == {3: [0], 7: [1, 2]} and {r.sample_id: r.x for r in rows.collect()} == {"a": [1.0, 2.0, 0.0], "b": [0.0, 0.0, 4.0]}
