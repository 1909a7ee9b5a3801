"""Greedy survival of cubes (retention bins x m/z bins) and search of channel sets.

Features of disjoint cubes concatenate, so the Gram matrix of a set of cubes is the sum of
theirs. Each cube's matrix is built once in Spark; removing or adding a cube then is one
matrix sum. An outer fold is one task that holds the cubes' n x n matrices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.operators.models import ridge_classes



def cube_features(binned: DataFrame, kind: str = "flat") -> DataFrame:
    """(sample_id, cube, pos, value) of scans with rt_bin and mz_bin; kinds flat, tic and tis are taken inside each cube."""
    pos = {"flat": F.col("mz") * 1_000_000 + F.col("scan_idx"), "tic": F.col("scan_idx"), "tis": F.col("mz")}[kind]
    return binned.groupBy("sample_id", (F.col("rt_bin") * 10_000 + F.col("mz_bin")).alias("cube"), pos.cast("long").alias("pos")).agg(F.sum("intensity").alias("value"))


def cube_grams(features: DataFrame) -> DataFrame:
    """(cube, a, b, dot), a <= b. Cubes are told apart by moving their positions to blocks of their own."""
    width = 1 << 40
    moved = features.withColumn("pos", F.col("cube").cast("long") * width + F.col("pos"))
    kind = dict(features.dtypes)["sample_id"]

    def product(part: pd.DataFrame) -> pd.DataFrame:
        wide = part.pivot_table(index="sample_id", columns="pos", values="value", fill_value=0.0, aggfunc="sum")
        ids, m = wide.index.to_numpy(), wide.to_numpy()
        dots = m @ m.T
        a, b = np.triu_indices(len(ids))
        return pd.DataFrame({"cube": part["cube"].iloc[0], "a": ids[a], "b": ids[b], "dot": dots[a, b]})

    blocks = moved.withColumn("_blk", F.expr("pmod(xxhash64(pos), 64)"))
    return blocks.groupBy("cube", "_blk").applyInPandas(product, f"cube int, a {kind}, b {kind}, dot double").groupBy("cube", "a", "b").agg(F.sum("dot").alias("dot"))


def balanced_accuracy(true: np.ndarray, predicted: np.ndarray) -> float:
    return float(np.mean([np.mean(predicted[true == c] == c) for c in np.unique(true)]))


def inner_folds(labels: np.ndarray, folds: int) -> np.ndarray:
    """Each class is dealt round-robin, in the order of its samples."""
    out = np.zeros(len(labels), int)
    for c in np.unique(labels):
        at = np.flatnonzero(labels == c)
        out[at] = np.arange(len(at)) % folds
    return out


def cv_score(k: np.ndarray, labels: np.ndarray, rows: np.ndarray, folds: int, alpha: float) -> float:
    """Mean balanced accuracy of ridge over folds within ``rows``."""
    fold = inner_folds(labels[rows], folds)
    scores = []
    for f in range(folds):
        train, test = rows[fold != f], rows[fold == f]
        if len(test) and len(train):
            scores.append(balanced_accuracy(labels[test], ridge_classes(k, labels, train, test, alpha)[0]))
    return float(np.mean(scores)) if scores else 0.0


def greedy(matrices: dict[int, np.ndarray], labels: np.ndarray, train: np.ndarray, test: np.ndarray, mode: str, steps: int, folds: int, alpha: float, look_ahead: float = 0.0) -> list[tuple[int, int, float, float]]:
    """(step, cube, inner, outer) of each greedy step; ties go to the smallest cube.

    Removing starts with all cubes, adding with none; an empty set scores 1 / classes.
    With ``look_ahead`` the gain of the best pair, times it, is added to a cube's score.
    """
    chance = 1 / len(np.unique(labels))
    chosen = set(matrices) if mode == "remove" else set()
    k = sum(matrices.values()) if mode == "remove" else np.zeros_like(next(iter(matrices.values())))
    sign = -1 if mode == "remove" else 1
    out = []
    for step in range(min(steps, len(matrices))):
        left = sorted(chosen) if mode == "remove" else sorted(set(matrices) - chosen)

        def score(m: np.ndarray, size: int) -> float:
            return cv_score(m, labels, train, folds, alpha) if size else chance

        size = len(chosen) + sign
        scores = {c: score(k + sign * matrices[c], size) for c in left}
        if look_ahead:
            scores = {c: s + look_ahead * max([score(k + sign * (matrices[c] + matrices[o]), size + sign) - s for o in left if o != c], default=0.0) for c, s in scores.items()}
        best = max(left, key=lambda c: (scores[c], -c))
        chosen ^= {best}
        k = k + sign * matrices[best]
        outer = balanced_accuracy(labels[test], ridge_classes(k, labels, train, test, alpha)[0]) if chosen else chance
        out.append((step, best, float(scores[best]), outer))
    return out


def survival_map(grams: DataFrame, labels: DataFrame, test: DataFrame, mode: str = "remove", steps: int = 1 << 30, folds: int = 3, alpha: float = 1.0, look_ahead: float = 0.0) -> DataFrame:
    """(fold, step, rt_bin, mz_bin, inner_accuracy, outer_accuracy): leak-free greedy removal or addition.

    Cubes are chosen by cross-validation inside the outer fold's training rows only;
    ``test`` is (split_id, sample_id). Samples of classes with a single row in training
    stay there and are left out of inner folds' test rows by chance of dealing only.
    """

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cube": [part["cube"].iloc[0]], "a": [part["a"].to_numpy()], "b": [part["b"].to_numpy()], "dot": [part["dot"].to_numpy()]})

    packed = grams.select("cube", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "dot").groupBy("cube").applyInPandas(pack, "cube int, a array<string>, b array<string>, dot array<double>")
    held = test.groupBy(F.col("split_id").cast("int").alias("fold")).agg(F.collect_set(F.col("sample_id").cast("string")).alias("held"))
    names = labels.select(F.struct(F.col("sample_id").cast("string").alias("i"), F.col("label").cast("string").alias("l")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("names"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        ids, lab = np.array([x["i"] for x in first["names"]]), np.array([x["l"] for x in first["names"]])
        matrices = {}
        for r in part.itertuples():
            m = np.zeros((len(ids), len(ids)))
            a, b = np.searchsorted(ids, np.asarray(r.a, str)), np.searchsorted(ids, np.asarray(r.b, str))
            m[a, b] = m[b, a] = r.dot
            matrices[int(r.cube)] = m
        inside = np.isin(ids, np.asarray(first["held"], str))
        rows = greedy(matrices, lab, np.flatnonzero(~inside), np.flatnonzero(inside), mode, steps, folds, alpha, look_ahead)
        return pd.DataFrame([(int(first["fold"]), s, c // 10_000, c % 10_000, i, o) for s, c, i, o in rows], columns=["fold", "step", "rt_bin", "mz_bin", "inner_accuracy", "outer_accuracy"])

    each = packed.crossJoin(held).crossJoin(names)  # cubes times folds, one row of names
    return each.groupBy("fold").applyInPandas(run, "fold int, step int, rt_bin int, mz_bin int, inner_accuracy double, outer_accuracy double")


def cell_map(grams: DataFrame, labels: DataFrame, folds: int = 3, alpha: float = 1.0) -> DataFrame:
    """(rt_bin, mz_bin, accuracy): cross-validated score of each cube on its own, a task for each."""
    named = grams.join(labels.select(F.col("sample_id").alias("a"), F.col("label").cast("string").alias("la")), "a")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.r_[part["a"], part["b"]])
        m = np.zeros((len(ids), len(ids)))
        a, b = np.searchsorted(ids, part["a"]), np.searchsorted(ids, part["b"])
        m[a, b] = m[b, a] = part["dot"]
        lab = np.empty(len(ids), object)
        lab[a] = part["la"].to_numpy()
        c = int(part["cube"].iloc[0])
        return pd.DataFrame({"rt_bin": [c // 10_000], "mz_bin": [c % 10_000], "accuracy": [cv_score(m, lab.astype(str), np.arange(len(ids)), folds, alpha)]})

    return named.groupBy("cube").applyInPandas(run, "rt_bin int, mz_bin int, accuracy double")


def channel_grams(scans: DataFrame) -> DataFrame:
    """(cube, a, b, dot) with one cube per channel, over the samples' summed spectra."""
    tis = scans.groupBy("sample_id", F.col("mz").alias("cube")).agg(F.sum("intensity").alias("value"))
    return cube_grams(tis.withColumn("pos", F.lit(0).cast("long")))


def random_sets(spark, channels: list[int], sizes: list[int], draws: int, seed: int = 0) -> DataFrame:
    """(set_id, k, channels): for each size so many random sets, drawn by hashes."""
    base = spark.range(len(sizes) * draws).select(F.col("id").alias("set_id"), F.element_at(F.array(*map(F.lit, sizes)), (F.col("id") / draws).cast("int") + 1).alias("k"))
    pairs = F.transform(F.array(*map(F.lit, channels)), lambda c: F.struct(F.xxhash64(F.col("set_id"), c, F.lit(seed)).alias("h"), c.alias("c")))
    return base.withColumn("channels", F.array_sort(F.transform(F.slice(F.array_sort(pairs), F.lit(1), F.col("k")), lambda x: x.c)))


def score_sets(grams: DataFrame, labels: DataFrame, sets: DataFrame, folds: int = 3, alpha: float = 1.0) -> DataFrame:
    """(set_id, k, channels, accuracy): each set's matrix is summed in Spark, then scored in a task of its own."""
    wanted = sets.select("set_id", F.explode("channels").alias("cube")).join(grams, "cube").groupBy("set_id", "a", "b").agg(F.sum("dot").alias("dot"))
    scored = cell_map(wanted.withColumnRenamed("set_id", "cube"), labels, folds, alpha)
    return sets.join(scored.select((F.col("rt_bin") * 10_000 + F.col("mz_bin")).cast("long").alias("set_id"), "accuracy"), "set_id")
