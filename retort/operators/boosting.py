"""Boosted trees of several classes, from histograms of gradients that are summed in Spark.

Features are cut to bins once. A round grows one tree for each class on the gradients of
the softmax loss. A level of all these trees is one job: each task sums gradients by
(class, node, feature, bin), the sums of a node meet in one small group that picks its
best cut, and the driver gets a row for each node. Rows carry their scores in a table
that is written once a round, so a lost executor costs a round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.sources.shared import stored

#: A cut has to leave so much of the second derivatives on either side.
LEAST_WEIGHT = 1e-3


def feature_edges(rows: DataFrame, bins: int = 32) -> list[list[float]]:
    """The inner edges of each feature's bins, from approximate quantiles; a fixed number for each feature."""
    shares = [k / bins for k in range(1, bins)]
    each = rows.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.percentile_approx("v", F.array(*map(F.lit, shares)), 10_000).alias("e"))
    return [sorted(set(r.e)) for r in each.orderBy("pos").collect()]


class Tree:
    """Nodes in the order of a heap: cuts (feature, bin) of inner nodes, values of leaves."""

    def __init__(self) -> None:
        self.cuts: dict[int, tuple[int, int]] = {}
        self.values: dict[int, float] = {}

    def nodes(self, binned: np.ndarray) -> np.ndarray:
        """The node that each row has come to so far."""
        at = np.ones(len(binned), np.int64)
        for node in sorted(self.cuts):
            feature, cut = self.cuts[node]
            own = at == node
            at[own] = 2 * node + (binned[own, feature] > cut)
        return at

    def told(self, binned: np.ndarray) -> np.ndarray:
        at = self.nodes(binned)
        out = np.zeros(len(binned))
        for node, value in self.values.items():
            out[at == node] = value
        return out


def softmax_gradients(scores: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the softmax loss by class."""
    p = np.exp(scores - scores.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    y = place[:, None] == np.arange(scores.shape[1])
    return p - y, p * (1 - p)


def best_cut(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best cut by sums of (feature, bin); gain 0 where none helps; ties to the first."""
    left_g, left_h = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
    all_g, all_h = g.sum(1)[:, None], h.sum(1)[:, None]
    part = lambda a, b: a * a / (b + smooth)
    gain = part(left_g, left_h) + part(all_g - left_g, all_h - left_h) - part(all_g, all_h)
    gain[(left_h < LEAST_WEIGHT) | (all_h - left_h < LEAST_WEIGHT)] = 0
    k = int(np.argmax(np.round(gain, 9))) if gain.size else 0
    return (float(gain.ravel()[k]), *map(int, divmod(k, gain.shape[1]))) if gain.size and gain.ravel()[k] > 1e-9 else (0.0, 0, 0)


def _grown(state: DataFrame, classes: int, bins: int, depth: int, rate: float, smooth: float) -> list[Tree]:
    """One tree for each class on the gradients of the rows' scores; a job for each level."""
    trees = [Tree() for _ in range(classes)]
    for level in range(depth + 1):
        front = range(2**level, 2 ** (level + 1))

        def sums(frames: Iterator[pd.DataFrame], trees=trees, front=front) -> Iterator[pd.DataFrame]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for frame in frames:
                if not len(frame):
                    continue
                binned = np.array(frame["binned"].tolist(), np.int64)
                g, h = softmax_gradients(np.array(frame["scores"].tolist()), frame["place"].to_numpy())
                flat = binned + bins * np.arange(binned.shape[1])
                size = bins * binned.shape[1]
                for c, tree in enumerate(trees):
                    at = tree.nodes(binned)
                    for node in np.unique(at):
                        if node in front:
                            own = at == node
                            cells = flat[own].ravel()
                            more = [np.bincount(cells, np.repeat(d[own, c], binned.shape[1]), size) for d in (g, h)]
                            held[c, node] = held.get((c, node), 0) + np.concatenate(more)
            if held:
                yield pd.DataFrame([(c, int(n), v) for (c, n), v in held.items()], columns=["c", "node", "v"])

        def cut(part: pd.DataFrame) -> pd.DataFrame:
            g, h = np.sum(part["v"].tolist(), axis=0).reshape(2, -1, bins)
            gain, feature, at = best_cut(g, h, smooth)
            return pd.DataFrame({"c": part["c"].iloc[:1], "node": part["node"].iloc[:1], "gain": gain, "feature": feature, "cut": at, "g": g[0].sum(), "h": h[0].sum()})

        found = state.mapInPandas(sums, "c int, node int, v array<double>").groupBy("c", "node").applyInPandas(cut, "c int, node int, gain double, feature int, cut int, g double, h double")
        for r in found.collect():  # a row for each node of the level
            if level < depth and r.gain > 0:
                trees[r.c].cuts[r.node] = (r.feature, r["cut"])
            else:
                trees[r.c].values[r.node] = -rate * (classes - 1) / classes * r.g / (r.h + smooth)
    return trees


def boosted_classes(rows: DataFrame, labels: DataFrame, test: DataFrame, rounds: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 32, smooth: float = 1.0) -> DataFrame:
    """(sample_id, y_true, y_pred) of the rows of ``test`` (sample_id), by softmax boosting on all other rows; ties to the first class.

    ``rows`` is (sample_id, x), ``labels`` (sample_id, label). Bins are cut by the training
    rows alone. All rows carry scores; only training rows give gradients.
    """
    named = rows.join(labels.select("sample_id", F.col("label").cast("string").alias("label")), "sample_id").join(test.select("sample_id").distinct().withColumn("_t", F.lit(True)), "sample_id", "left")
    named = stored(named.select("sample_id", "x", "label", F.coalesce("_t", F.lit(False)).alias("held")), "boosting-rows")
    train = named.where("NOT held")
    classes = [r.label for r in train.select("label").distinct().orderBy("label").collect()]
    edges = [np.array(e) for e in feature_edges(train, bins)]
    known = {c: k for k, c in enumerate(classes)}

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array(frame["x"].tolist(), float).reshape(len(frame), -1)
            binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], 1) if len(frame) and edges else np.zeros((len(frame), 0), int)
            yield frame[["sample_id", "label", "held"]].assign(place=[known.get(v, -1) for v in frame["label"]], binned=list(binned.astype(np.int32)), scores=[np.zeros(len(classes))] * len(frame))

    schema = f"sample_id {dict(rows.dtypes)['sample_id']}, label string, held boolean, place int, binned array<int>, scores array<double>"
    state = stored(named.mapInPandas(begin, schema), "boosting")
    for _ in range(rounds if len(classes) > 1 else 0):
        trees = _grown(state.where("NOT held"), len(classes), bins, depth, rate, smooth)

        def add(frames: Iterator[pd.DataFrame], trees=trees) -> Iterator[pd.DataFrame]:
            for frame in frames:
                binned = np.array(frame["binned"].tolist(), np.int64).reshape(len(frame), -1)
                more = np.stack([t.told(binned) for t in trees], 1)
                yield frame.assign(scores=list(np.array(frame["scores"].tolist()).reshape(len(frame), -1) + more))

        state = stored(state.mapInPandas(add, schema), "boosting")
    names = F.array(*map(F.lit, classes)) if classes else F.array().cast("array<string>")
    return state.where("held").select("sample_id", F.col("label").alias("y_true"), F.get(names, F.array_position("scores", F.array_max("scores")).cast("int") - 1).alias("y_pred"))
