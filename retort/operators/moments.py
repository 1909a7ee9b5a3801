"""Models of many samples with few features, from mergeable moments of the rows.

A table of rows is (sample_id, x array<double>[, y array<double>]). Each task merges the
moments of its rows (number, means, products about the means) and emits one matrix for
each key; the matrices are moved to one common centre, near the means, where they add up
without cancelling, whatever the offset of a feature. A split's training moments are all
moments less those of its test rows, so no row is sent to a split that trains on it, and
scaling a model by its training rows is a change of units of that small matrix. Fits
happen on these matrices, one task for each split, predictions in the rows' own tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.sources.shared import stored

#: Rows of one side of a neighbour search tile.
TILE_ROWS = 4096
#: Blocks of both sides that a task holds when all pairs of blocks are met.
LEFT_BLOCKS, RIGHT_BLOCKS = 1, 16
#: Rows that one task scores beside a leave-one-out model, and numbers of its batch of systems.
LOO_ROWS, LOO_CELLS = 4096, 1 << 22


def wide(features: DataFrame) -> DataFrame:
    """(sample_id, x) of long (sample_id, pos, value) features; all samples have the same positions."""
    return features.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_x")).select("sample_id", F.transform("_x", lambda e: e.value.cast("double")).alias("x"))


def _merged(a: tuple, b: tuple) -> tuple:
    """The moments (n, means, products about the means) of two sets of rows together."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _key_schema(rows: DataFrame, keys: tuple[str, ...]) -> str:
    kinds = dict(rows.dtypes)
    return "".join(f"`{k}` {kinds[k]}, " for k in keys)


def parts(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, p, n, mean, products), written: the moments of (x, y) of each key that a task has met; ``p`` features come first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple] = {}
        size: dict[tuple, int] = {}  # keys may differ in their number of features
        for frame in frames:
            for key, part in frame.groupby(list(keys), dropna=False, sort=False) if keys else [((), frame)]:
                if len(part):
                    x, y = np.array(part["x"].tolist(), float), np.array(part["y"].tolist(), float)
                    z = np.c_[x, y.reshape(len(part), -1)]
                    mean = z.mean(0)
                    own = (len(part), mean, (z - mean).T @ (z - mean))
                    key = key if isinstance(key, tuple) else (key,)
                    held[key], size[key] = _merged(held[key], own) if key in held else own, x.shape[1]
        if held:
            yield pd.DataFrame([(*key, size[key], float(n), mean, m.ravel()) for key, (n, mean, m) in held.items()], columns=[*keys, "p", "n", "mean", "products"])

    y = F.col("y") if "y" in rows.columns else F.array().cast("array<double>")
    return stored(rows.select(*keys, "x", y.alias("y")).mapInPandas(run, _key_schema(rows, keys) + "p int, n double, mean array<double>, products array<double>"), "moments")


def sums(rows: DataFrame, *keys: str, centre: DataFrame | str | None = None) -> DataFrame:
    """(keys, p, c, m): ``m`` is the matrix of sums of z z' with z = (1, x - c, y - c), row by row, for each key.

    ``c`` is one vector for all keys of ``p`` features: the mean of all rows, that of
    another table of sums given as ``centre``, or zero. Matrices of one centre add up.
    """
    own = parts(rows, *keys)
    if isinstance(centre, DataFrame):
        middle = centre.select("p", "c").distinct()
    elif centre == "zero":
        middle = own.select("p", F.transform("mean", lambda v: F.lit(0.0)).alias("c")).distinct()
    else:
        each = own.select("p", "n", F.posexplode("mean").alias("_k", "_v")).groupBy("p", "_k").agg((F.sum(F.col("n") * F.col("_v")) / F.sum("n")).alias("_v"))
        middle = each.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("_k", "_v"))).alias("_c")).select("p", F.transform("_c", lambda e: e["_v"]).alias("c"))

    def move(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for n, mean, products, c in zip(frame["n"], frame["mean"], frame["products"], frame["c"], strict=True):
                gap = np.asarray(mean) - np.asarray(c)
                full = np.empty((len(gap) + 1, len(gap) + 1))
                full[0, 0], full[0, 1:], full[1:, 0] = n, n * gap, n * gap
                full[1:, 1:] = np.asarray(products).reshape(len(gap), -1) + n * np.outer(gap, gap)
                out.append(full.ravel())
            yield frame[[*keys, "p"]].assign(m=out)

    moved = own.join(F.broadcast(middle), "p").mapInPandas(move, _key_schema(rows, keys) + "p int, m array<double>")  # one centre for each number of features
    added = moved.select(*keys, "p", F.posexplode("m").alias("_k", "_v")).groupBy(*keys, "p", "_k").agg(F.sum("_v").alias("_v"))
    whole = added.groupBy(*keys, "p").agg(F.array_sort(F.collect_list(F.struct("_k", "_v"))).alias("_m")).select(*keys, "p", F.transform("_m", lambda e: e["_v"]).alias("m"))
    return whole.join(F.broadcast(middle), "p").select(*keys, "p", "c", "m")


def without(whole: DataFrame, held: DataFrame, *keys: str) -> DataFrame:
    """Sums of the rows of ``whole`` but those of ``held``, which have the same centre; ``keys`` are those of ``whole``."""
    left = held.drop("p", "c").withColumnRenamed("m", "_held")
    joined = left.join(whole.withColumnRenamed("m", "_all"), list(keys)) if keys else left.crossJoin(whole.withColumnRenamed("m", "_all"))  # one row of all sums
    return joined.withColumn("m", F.zip_with("_all", "_held", lambda a, b: a - b)).drop("_all", "_held")


def training_sums(rows: DataFrame, test: DataFrame) -> DataFrame:
    """(split_id, p, c, m) of the rows that each split does not test."""
    whole = sums(rows)
    return without(whole, sums(rows.join(test, "sample_id"), "split_id", centre=whole))


class Sums:
    """The parts of one matrix of sums about ``c``: n, means, and products about the means.

    ``by`` are the units of the features: 1, or their deviations after ``scaled``.
    """

    def __init__(self, p: int, m, c=None) -> None:
        size = int(round(np.sqrt(len(m))))
        full = np.asarray(m, float).reshape(size, size)
        c = np.zeros(size - 1) if c is None else np.asarray(c, float)
        self.n = full[0, 0]
        near = full[0] / max(self.n, 1)
        centred = full - np.outer(near, near) * self.n
        self.x_mean, self.y_mean = c[:p] + near[1 : 1 + p], c[p:] + near[1 + p :]
        self.xx, self.xy, self.yy = centred[1 : 1 + p, 1 : 1 + p], centred[1 : 1 + p, 1 + p :], centred[1 + p :, 1 + p :]
        self.y_sum = self.n * self.y_mean
        self.by = np.ones(p)

    def scaled(self, scale: str | None) -> Sums:
        """The same with features in units of their population deviations; constant features keep theirs."""
        if scale is None:
            return self
        if scale != "standard":
            raise ValueError("scale must be standard or None")
        out = object.__new__(Sums)
        out.__dict__ |= self.__dict__
        deviation = np.sqrt(np.maximum(np.diag(self.xx), 0) / max(self.n, 1))
        # what rounding leaves of a constant counts as constant
        out.by = np.where(deviation > 1e-13 * (1 + np.abs(self.x_mean)), deviation, 1.0)
        out.xx, out.xy = self.xx / np.outer(out.by, out.by), self.xy / out.by[:, None]
        return out

    def unscaled(self, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and intercepts on the features from those on (x - mean) / by."""
        w = w / self.by[:, None]
        return w, b - self.x_mean @ w


def ridge_fit(s: Sums, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights, intercepts) of ridge with an intercept that is not penalised; a column for each target."""
    return s.unscaled(np.linalg.solve(s.xx + alpha * np.eye(len(s.xx)), s.xy), s.y_mean)


def reduced_ridge_fit(s: Sums, alpha: float, components: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ridge on so many principal components of the targets, brought back to the targets; all components give plain ridge.

    Ridge is linear in its targets, so the scores need not be made: its weights are
    projected on the leading axes of the targets' own products.
    """
    w, b = ridge_fit(s, alpha)
    if components is None:
        return w, b
    v = np.linalg.eigh(s.yy)[1][:, ::-1][:, :components]
    w = w @ v @ v.T
    return w, s.y_mean - s.x_mean @ w


def class_ridge_fit(s: Sums, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """One-versus-rest ridge on targets of plus and minus 1, from targets of 1 and 0; classes without rows get no score."""
    w, b = ridge_fit(s, alpha)
    return 2 * w, np.where(s.y_sum > 0.5, 2 * b - 1, -np.inf)


def axes(s: Sums, components: int | None = None, variance: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(directions as columns, variances), so many components or as many as reach a share of variance; a direction's largest part is positive."""
    values, vectors = np.linalg.eigh(s.xx)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    keep = int((values > values[0] * 1e-12).sum()) if len(values) and values[0] > 0 else 0
    if variance is not None and keep:
        keep = min(keep, int(np.argmax(np.cumsum(values) / values.sum() >= variance - 1e-12)) + 1)
    keep = keep if components is None else min(keep, components)
    vectors = vectors[:, :keep]
    return vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(keep)]), values[:keep]


def class_lda_fit(s: Sums, variance: float = 0.97) -> tuple[np.ndarray, np.ndarray]:
    """Linear discriminants on principal components with class shares, as weights and intercepts on the features."""
    v, _ = axes(s, variance=variance)
    known = s.y_sum > 0.5
    count = np.where(known, s.y_sum, 1)
    means = (s.xy / count).T @ v  # of the classes, from the mean of all rows
    between = (means * np.where(known, s.y_sum, 0)[:, None]).T @ means
    inverse = np.linalg.pinv((v.T @ s.xx @ v - between) / max(1, s.n - known.sum()))
    b = -0.5 * np.einsum("ij,jk,ik->i", means, inverse, means) + np.log(count / s.n)
    w, b = s.unscaled(v @ inverse @ means.T, b)
    return w, np.where(known, b, -np.inf)


def fitted(train: DataFrame, fit: Callable[[Sums], tuple[np.ndarray, np.ndarray]], *keys: str, scale: str | None = None) -> DataFrame:
    """(keys, weights, intercepts): a linear model for each row of sums; weights has a list for each target.

    With ``scale`` standard the model is fitted on features in units of the deviations of
    these sums, which are those of the training rows alone, and brought back to x.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            models = [fit(Sums(int(p), m, c).scaled(scale)) for p, m, c in zip(frame["p"], frame["m"], frame["c"], strict=True)]
            yield frame[list(keys)].assign(weights=[list(w.T) for w, _ in models], intercepts=[b for _, b in models])

    return train.mapInPandas(run, _key_schema(train, keys) + "weights array<array<double>>, intercepts array<double>")


def scored(x: Column, weights: Column, intercepts: Column) -> Column:
    """The array of a linear model's values."""
    dot = F.transform(weights, lambda w: F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v))
    return F.zip_with(dot, intercepts, lambda a, b: a + b)


def regress(rows: DataFrame, names: list[str], test: DataFrame, alpha: float = 1.0, scale: str | None = None, components: int | None = None) -> DataFrame:
    """(split_id, sample_id, attribute, y_true, y_pred) of multi-target ridge; ``y`` holds the values of ``names``.

    With ``components`` the targets are reduced to so many principal components of the
    training rows, and predictions brought back (:func:`reduced_ridge_fit`).
    """
    models = fitted(training_sums(rows, test), lambda s: reduced_ridge_fit(s, alpha, components), "split_id", scale=scale)
    out = rows.join(test, "sample_id").join(models, "split_id").withColumn("_p", scored(F.col("x"), F.col("weights"), F.col("intercepts")))
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("attribute"), F.col("y").alias("y_true"), F.col("_p").alias("y_pred"))).alias("e")
    return out.select("split_id", "sample_id", each).select("split_id", "sample_id", "e.attribute", "e.y_true", "e.y_pred")


def regress_folds(rows: DataFrame, names: list[str], *keys: str, alpha: float = 1.0, scale: str | None = None) -> DataFrame:
    """(keys, fold, sample_id, attribute, y_true, y_pred): for each key and ``fold`` of the rows, ridge on the key's other folds.

    Rows with a null fold train only.
    """
    whole = sums(rows, *keys)
    train = without(whole, sums(rows.where("fold IS NOT NULL"), *keys, "fold", centre=whole), *keys)
    models = fitted(train, lambda s: ridge_fit(s, alpha), *keys, "fold", scale=scale)
    out = rows.join(models, [*keys, "fold"]).withColumn("_p", scored(F.col("x"), F.col("weights"), F.col("intercepts")))
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("attribute"), F.col("y").alias("y_true"), F.col("_p").alias("y_pred"))).alias("e")
    return out.select(*keys, "fold", "sample_id", each).select(*keys, "fold", "sample_id", "e.attribute", "e.y_true", "e.y_pred")


def loo_fit(s: Sums, x: np.ndarray, y: np.ndarray, alpha: float, scale: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(predictions, weights in the model's units) of ridge without each of the given rows, which are among those of the sums.

    In unscaled units a row's residual without itself is its residual over one less its
    leverage, and the weights follow from one inverse. With scaling each row has its own
    units, so its moments are taken off and the system is solved again.
    """
    d, e = x - s.x_mean, y - s.y_mean[0]
    if s.n <= 1:
        return np.full(len(x), np.nan), np.full(x.shape, np.nan)
    if scale is None:
        inverse = np.linalg.inv(s.xx + alpha * np.eye(len(s.xx)))
        w, moved = inverse @ s.xy[:, 0], d @ inverse
        with np.errstate(divide="ignore", invalid="ignore"):
            off = (e - d @ w) / (1 - 1 / s.n - (moved * d).sum(1))
        return y - off, w - moved * off[:, None]
    left, out, weights = s.n - 1, np.empty(len(x)), np.empty(x.shape)
    less = s.n / left
    step = max(1, LOO_CELLS // max(1, s.xx.size))
    for a in range(0, len(x), step):
        dk, ek = d[a : a + step], e[a : a + step]
        xx = s.xx - less * dk[:, :, None] * dk[:, None, :]
        variance = np.maximum(np.diagonal(xx, axis1=1, axis2=2), 0) / left
        by = np.where(np.sqrt(variance) > 1e-13 * (1 + np.abs(s.x_mean)), np.sqrt(variance), 1.0)
        xy = s.xy[:, 0] - less * dk * ek[:, None]
        w = np.linalg.solve(xx + alpha * np.eye(len(s.xx)) * (by**2)[:, None, :], xy[:, :, None])[:, :, 0]
        out[a : a + step] = s.y_mean[0] - ek / left + less * (dk * w).sum(1)
        weights[a : a + step] = w * by
    return out, weights


def leave_one_out(rows: DataFrame, *keys: str, alpha: float = 1.0, scale: str | None = None, coefficients: bool = False) -> DataFrame:
    """(keys, sample_id, y_true, y_pred[, weights]): ridge on all other rows of the key; the first target counts.

    ``weights`` are each fold's, on the scaled features where they are scaled. A key's
    rows are dealt to groups of about LOO_ROWS; each group meets the key's matrix once.
    """
    whole = stored(sums(rows, *keys).withColumn("_salts", F.greatest(F.lit(1), F.ceil(F.get("m", F.lit(0)) / LOO_ROWS)).cast("int")), "loo-sums")
    few = whole.select(*keys, "_salts")
    dealt = rows.join(few, list(keys)) if keys else rows.crossJoin(F.broadcast(few))  # one row
    dealt = dealt.select(*keys, F.pmod(F.xxhash64("sample_id"), F.col("_salts")).cast("int").alias("_salt"), "sample_id", "x", F.get("y", F.lit(0)).alias("y"))
    models = whole.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).select(*keys, "_salt", "p", "c", "m")

    def run(own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        y = own["y"].to_numpy(float)
        out = own[[*keys, "sample_id"]].assign(y_true=y)
        if len(own):
            told, weights = loo_fit(Sums(int(model["p"].iloc[0]), model["m"].iloc[0], model["c"].iloc[0]), np.array(own["x"].tolist(), float), y, alpha, scale)
            out["y_pred"] = told
            if coefficients:
                out["weights"] = list(weights)
        else:
            out = out.assign(y_pred=y, **({"weights": y} if coefficients else {}))
        return out

    schema = _key_schema(rows, keys) + f"sample_id {dict(rows.dtypes)['sample_id']}, y_true double, y_pred double" + (", weights array<double>" if coefficients else "")
    return dealt.groupBy(*keys, "_salt").cogroup(models.groupBy(*keys, "_salt")).applyInPandas(run, schema)


def with_classes(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with their label, ``classes`` in order, and ``y``, 1 for the own class and 0 for others; classes are few."""
    named = rows.join(labels.select("sample_id", F.col("label").cast("string").alias("label")), "sample_id")
    classes = labels.agg(F.array_sort(F.collect_set(F.col("label").cast("string"))).alias("classes"))
    return named.crossJoin(classes).withColumn("y", F.transform("classes", lambda c: (c == F.col("label")).cast("double")))  # one row


def classify(rows: DataFrame, labels: DataFrame, test: DataFrame, model: str = "ridge", alpha: float = 1.0, variance: float = 0.97, scale: str | None = None) -> DataFrame:
    """(split_id, sample_id, y_true, y_pred) of ridge, discriminants or 3 nearest neighbours for each split; ``scale`` as in :func:`fitted`."""
    named = with_classes(rows, labels)
    if model == "knn":
        return nearest(named.select("sample_id", "x", "label"), test, scales=None if scale is None else units(named, test, scale))
    fit = {"ridge": lambda s: class_ridge_fit(s, alpha), "lda": lambda s: class_lda_fit(s, variance)}[model]
    models = fitted(training_sums(named.select("sample_id", "x", "y"), test), fit, "split_id", scale=scale)
    scores = named.join(test, "sample_id").join(models, "split_id").withColumn("_s", scored(F.col("x"), F.col("weights"), F.col("intercepts")))
    return scores.select("split_id", "sample_id", F.col("label").alias("y_true"), F.element_at("classes", F.array_position("_s", F.array_max("_s")).cast("int")).alias("y_pred"))


def hold_out(rows: DataFrame, labels: DataFrame, test: DataFrame, model: str = "ridge", scale: str | None = "standard", alpha: float = 1.0, variance: float = 0.97) -> DataFrame:
    """:func:`classify` for splits that share no row, each told after its rows are scaled by their own means and deviations.

    A model is fitted on the training rows in units of their own moments; the split's test
    rows come with theirs, so that an offset or a gain of the split's source drops out.
    """
    named = with_classes(rows, labels)
    fit = {"ridge": lambda s: class_ridge_fit(s, alpha), "lda": lambda s: class_lda_fit(s, variance)}[model]
    whole = sums(named.select("sample_id", "x", "y"))
    held = stored(sums(named.select("sample_id", "x", "y").join(test, "sample_id"), "split_id", centre=whole), "held")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = [Sums(int(p), m, c).scaled(scale) for p, m, c in zip(frame["p"], frame["_own"], frame["c"], strict=True)]
            models = []
            for p, m, c in zip(frame["p"], frame["m"], frame["c"], strict=True):
                s = Sums(int(p), m, c).scaled(scale)
                w, b = fit(s)
                models.append((w * s.by[:, None], b + s.x_mean @ w))  # on (x - mean) / by
            yield frame[["split_id"]].assign(
                weights=[list((w / t.by[:, None]).T) for (w, _), t in zip(models, own, strict=True)],
                intercepts=[b - (t.x_mean / t.by) @ w for (w, b), t in zip(models, own, strict=True)],
            )

    train = without(whole, held).join(held.select("split_id", F.col("m").alias("_own")), "split_id")
    models = train.mapInPandas(run, _key_schema(train, ("split_id",)) + "weights array<array<double>>, intercepts array<double>")
    scores = named.join(test, "sample_id").join(models, "split_id").withColumn("_s", scored(F.col("x"), F.col("weights"), F.col("intercepts")))
    return scores.select("split_id", "sample_id", F.col("label").alias("y_true"), F.element_at("classes", F.array_position("_s", F.array_max("_s")).cast("int")).alias("y_pred"))


def units(rows: DataFrame, test: DataFrame, scale: str | None = "standard") -> DataFrame:
    """(split_id, by): the deviation of each feature over the training rows of each split."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["split_id"]].assign(by=[Sums(int(p), m, c).scaled(scale).by for p, m, c in zip(frame["p"], frame["m"], frame["c"], strict=True)])

    train = training_sums(rows.select("sample_id", "x"), test)
    return train.mapInPandas(run, _key_schema(train, ("split_id",)) + "by array<double>")


def block_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of ``left`` beside each of ``right``, two small written tables of packed blocks of rows.

    A task holds about LEFT_BLOCKS by RIGHT_BLOCKS of them. Blocks are dealt once, and a
    task reads those that it needs: no block is copied for its pairs, so what is shuffled
    grows with the rows, only the work with their square.
    """
    left, right = (t.repartition(max(1, -(-t.count() // most))) for t, most in ((left, LEFT_BLOCKS), (right, RIGHT_BLOCKS)))
    return left.crossJoin(right.hint("shuffle_replicate_nl"))  # all pairs of blocks: the definition of an exact search


def dealt_blocks(rows: DataFrame, size: int, *keys: str) -> DataFrame:
    """Rows with ``_g``, a block of about ``size`` rows by the hash of the keys."""
    n = rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias("_n"))
    return rows.crossJoin(n).withColumn("_g", F.pmod(F.xxhash64(*keys), F.col("_n")).cast("int")).drop("_n")  # one row


def floats(rows: pd.Series) -> np.ndarray:
    """A matrix of the arrays of a column."""
    return np.array(rows.tolist(), float)


def unpacked(x: bytes, n: int) -> np.ndarray:
    """The matrix of n rows that a block holds as bytes."""
    return np.frombuffer(x, float).reshape(n, -1)


def _centred(x: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, the squares of their features about ``middle``, and these features as 32-bit shares of the largest of each."""
    c = x - middle
    largest = np.abs(c).max(0)
    largest[largest == 0] = 1
    return x, c * c, (c / largest).astype(np.float32), largest


def _candidates(own: tuple, low: int, high: int, others: tuple, train: np.ndarray, by: np.ndarray, neighbours: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(t, j, d): the ``train`` rows that may be among the nearest of each own row from low to high, all at one distance included, and squared distances.

    ``most`` is the squared distance of each row beyond which nothing counts. Products in 32
    bits only sort out, with more slack than their error; the distances of what is left are
    summed from differences, so that equal rows have equal distances.
    """
    p, k, out = len(by), min(neighbours, len(train)), []
    q, r = own[1][low:high] @ by**-2.0, (others[1] @ by**-2.0)[train]
    unit = max(q.max(), r.max()) or 1.0
    q, r = q / unit, r / unit
    slack = 2.0**-23 * (p + 8) * (2 * np.sqrt(q * r.max()) + r.max()) + 1e-11 * q + 1e-37
    limit = most / unit - q + slack
    near, far = np.ones((high - low, p + 1), np.float32), np.empty((len(train), p + 1), np.float32)
    near[:, :p] = own[2][low:high] * (own[3] * (-2 / np.sqrt(unit)) / by).astype(np.float32)
    far[:, :p], far[:, p] = others[2][train] * (others[3] / np.sqrt(unit) / by).astype(np.float32), r
    products, hits = np.empty((128, len(train)), np.float32), np.empty((128, len(train)), bool)
    for at in range(0, high - low, 128):
        n, edge = min(128, high - low - at), limit[at : at + 128]
        d, hit = products[:n], hits[:n]
        np.matmul(near[at : at + n], far.T, out=d)
        if np.isinf(edge).any():
            edge = np.minimum(edge, np.partition(d, k - 1, axis=1)[:, k - 1] + 2 * slack[at : at + n])
        np.less_equal(d, np.nextafter(edge.astype(np.float32), np.float32(np.inf))[:, None], out=hit)
        t, j = np.divmod(np.flatnonzero(hit), len(train))
        for part in range(0, len(t), 1 << 16):
            one, other = t[part : part + (1 << 16)] + (low + at), train[j[part : part + (1 << 16)]]
            gap = (own[0][one] - others[0][other]) / by
            out.append((one, other, (gap * gap).sum(1)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))


def _places(groups: np.ndarray) -> np.ndarray:
    """The place of each element in its run of equal elements."""
    first = np.r_[True, groups[1:] != groups[:-1]]
    return np.arange(len(groups)) - np.flatnonzero(first)[np.cumsum(first) - 1]


def nearest_rows(named: DataFrame, test: DataFrame, neighbours: int, scales: DataFrame | None = None) -> DataFrame:
    """(split_id, sample_id, y_true, t): the labels (t.vote) of the nearest training rows of each test row, as a short array.

    ``scales`` (split_id, by) are the units of each split's features. Rows are dealt to
    blocks by hash, test rows once for each of their splits; a task keeps the best few of
    each test row only, so distances are never stored, and looks closer at nothing beyond
    them. Rows at one distance count in the order of their ids, so of a block's equal rows
    only the first few can.
    """
    kinds, split_kind = dict(named.dtypes), dict(test.dtypes)["split_id"]
    held = test.groupBy("sample_id").agg(F.array_sort(F.collect_set("split_id")).alias("splits"))
    every = named.select("sample_id", "x", "label").join(held, "sample_id", "left")
    tests = every.select(F.explode("splits").alias("split_id"), "sample_id", "x", "label")
    tests = tests.withColumn("by", F.array().cast("array<double>")) if scales is None else tests.join(scales, "split_id")

    def pack_tests(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["split_id", "sample_id"])
        units_of = floats(part["by"][~part["split_id"].duplicated()])
        return pd.DataFrame({"a": part["_g"].iloc[:1].to_numpy(), "a_split": [part["split_id"].to_numpy()], "a_id": [part["sample_id"].to_numpy()], "a_label": [part["label"].to_numpy()], "a_x": [floats(part["x"]).tobytes()], "a_by": [units_of.tobytes()]})

    def pack_trains(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sample_id")
        splits = [list(s) if s is not None else [] for s in part["splits"]]
        at = np.repeat(np.arange(len(part)), [len(s) for s in splits])
        x = floats(part["x"])
        same = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1]
        return pd.DataFrame({"b_split": [[v for s in splits for v in s]], "b_at": [at], "b_same": [same.astype(np.int32)], "b_id": [part["sample_id"].to_numpy()], "b_label": [part["label"].to_numpy()], "b_x": [x.tobytes()]})

    a = stored(dealt_blocks(tests, TILE_ROWS, "sample_id", "split_id").groupBy("_g").applyInPandas(pack_tests, f"a int, a_split array<{split_kind}>, a_id array<{kinds['sample_id']}>, a_label array<{kinds['label']}>, a_x binary, a_by binary"), "test-blocks")
    b = stored(dealt_blocks(every, TILE_ROWS, "sample_id").groupBy("_g").applyInPandas(pack_trains, f"b_split array<{split_kind}>, b_at array<int>, b_same array<int>, b_id array<{kinds['sample_id']}>, b_label array<{kinds['label']}>, b_x binary"), "train-blocks")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple] = {}
        most: dict[int, np.ndarray] = {}
        names: dict[int, tuple] = {}
        for frame in frames:
            for r in frame.itertuples(index=False):
                x, y, split, ids, label = unpacked(r.a_x, len(r.a_id)), unpacked(r.b_x, len(r.b_id)), np.asarray(r.a_split), np.asarray(r.b_id), np.asarray(r.b_label)
                held_by, held_at, same = np.asarray(r.b_split), np.asarray(r.b_at, int), np.asarray(r.b_same)
                names[r.a] = (split, r.a_id, r.a_label)
                limit = most.setdefault(r.a, np.full(len(x), np.inf))
                ends = np.r_[0, np.flatnonzero(split[1:] != split[:-1]) + 1, len(split)]
                by, found, middle = unpacked(r.a_by, len(ends) - 1), [], y.mean(0)
                own, others = _centred(x, middle), _centred(y, middle)
                for s, (low, high) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    train = np.ones(len(y), bool)
                    train[held_at[held_by == split[low]]] = False
                    train = np.flatnonzero(train)
                    if same.max() + 1 < len(same):
                        order = np.argsort(same[train], kind="stable")
                        train = np.sort(train[order[_places(same[train][order]) < neighbours]])
                    if len(train):
                        t, j, d = _candidates(own, low, high, others, train, by[s] if by.shape[1] else np.ones(x.shape[1]), neighbours, limit[low:high])
                        found.append((t, d, ids[j], label[j]))
                if any(len(c[0]) for c in found):
                    new = np.zeros(len(x), bool)
                    new[np.concatenate([c[0] for c in found])] = True
                    kept = best.get(r.a, (np.empty(0, int), np.empty(0), ids[:0], label[:0]))
                    again = new[kept[0]]
                    rest = [c[~again] for c in kept]
                    t, d, other, vote = (np.concatenate(c) for c in zip([c[again] for c in kept], *found, strict=True))
                    order = np.lexsort((np.unique(other, return_inverse=True)[1], d, t))
                    place = _places(t[order])
                    last, keep = order[place == neighbours - 1], order[place < neighbours]
                    limit[t[last]] = d[last]
                    best[r.a] = tuple(np.concatenate(c) for c in zip(rest, (t[keep], d[keep], other[keep], vote[keep]), strict=True))
        for block, (t, d, other, vote) in best.items():
            split, ids, label = names[block]
            yield pd.DataFrame({"split_id": split[t], "sample_id": ids[t], "y_true": label[t], "distance": d, "other": other, "vote": vote})

    # written, as metrics read the predictions more than once
    near = stored(block_pairs(a, b).mapInPandas(run, f"split_id {split_kind}, sample_id {kinds['sample_id']}, y_true {kinds['label']}, distance double, other {kinds['sample_id']}, vote {kinds['label']}"), "near")
    return near.groupBy("split_id", "sample_id", "y_true").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "other", "vote"))), 1, neighbours).alias("t"))


def nearest(named: DataFrame, test: DataFrame, neighbours: int = 3, scales: DataFrame | None = None) -> DataFrame:
    """(split_id, sample_id, y_true, y_pred): majority of the nearest training rows, ties to the class that sorts first."""
    votes = nearest_rows(named, test, neighbours, scales).select("split_id", "sample_id", "y_true", F.explode("t").alias("t")).groupBy("split_id", "sample_id", "y_true", "t.vote").count()
    first = votes.groupBy("split_id", "sample_id", "y_true").agg(F.min(F.struct((-F.col("count")).alias("n"), "vote")).alias("v"))
    return first.select("split_id", "sample_id", "y_true", F.col("v.vote").alias("y_pred"))


def nearest_mean(rows: DataFrame, values: DataFrame, test: DataFrame, neighbours: int = 5) -> DataFrame:
    """(split_id, sample_id, y_true, y_pred): the mean value of the nearest training rows; ``values`` is (sample_id, value)."""
    named = rows.join(values.select("sample_id", F.col("value").cast("double").alias("label")), "sample_id").select("sample_id", "x", "label")
    mean = F.aggregate("t", F.lit(0.0), lambda a, t: a + t.vote) / F.size("t")
    return nearest_rows(named, test, neighbours).select("split_id", "sample_id", "y_true", mean.alias("y_pred"))


def pca(rows: DataFrame, components: int | None = None, variance: float | None = None, scale: str | None = None) -> DataFrame:
    """(sample_id, component, score) of all rows on the principal axes of their covariance, or of their correlation if scaled."""

    def fit(s: Sums) -> tuple[np.ndarray, np.ndarray]:
        v, _ = axes(s, components, variance)
        return s.unscaled(v, np.zeros(v.shape[1]))

    model = fitted(sums(rows), fit, scale=scale)
    out = rows.crossJoin(model).select("sample_id", F.posexplode(scored(F.col("x"), F.col("weights"), F.col("intercepts"))).alias("component", "score"))  # one row
    return out
