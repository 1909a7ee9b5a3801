"""Models fitted per split: ridge in its dual form, PCA, nearest neighbours, discriminants, and Spark ML estimators.

These are for samples that are few next to their features: ridge and PCA work on the Gram
matrix of the samples, and a split's task holds one n x n matrix. For many samples of few
features ``moments`` has the same models from sums over rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.operators.clustering import Points, kmeans
from retort.sources.shared import stored


def centred(k: np.ndarray, train: np.ndarray) -> np.ndarray:
    """A Gram matrix as if features had their training means taken off."""
    row = k[:, train].mean(1)
    return k - row[:, None] - row[None, :] + k[np.ix_(train, train)].mean()


def dual_ridge(k: np.ndarray, y: np.ndarray, train: np.ndarray, test: np.ndarray, alpha: float) -> np.ndarray:
    """Predictions for ``test`` of ridge with an intercept, from the Gram matrix; y has one column per target."""
    c, mean = centred(k, train), y[train].mean(0)
    weights = np.linalg.solve(c[np.ix_(train, train)] + alpha * np.eye(len(train)), y[train] - mean)
    return c[np.ix_(test, train)] @ weights + mean


def ridge_classes(k: np.ndarray, labels: np.ndarray, train: np.ndarray, test: np.ndarray, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(predicted, scores, classes): one-versus-rest ridge on targets of plus and minus 1; two classes share one score."""
    classes = np.unique(labels[train])
    if len(classes) == 1:
        return np.repeat(classes, len(test)), np.ones((len(test), 1)), classes
    if len(classes) == 2:
        s = dual_ridge(k, np.where(labels == classes[1], 1.0, -1.0)[:, None], train, test, alpha)
        scores = np.c_[-s, s]
    else:
        scores = dual_ridge(k, np.where(labels[:, None] == classes[None, :], 1.0, -1.0), train, test, alpha)
    return classes[scores.argmax(1)], scores, classes


def knn_classes(k: np.ndarray, labels: np.ndarray, train: np.ndarray, test: np.ndarray, neighbours: int = 3):
    """Majority of the nearest training samples; ties to the class that sorts first."""
    d = np.diag(k)
    dist = d[test][:, None] + d[train][None, :] - 2 * k[np.ix_(test, train)]
    classes = np.unique(labels[train])
    near = labels[train][np.argsort(dist, axis=1, kind="stable")[:, :neighbours]]
    votes = (near[:, :, None] == classes[None, None, :]).sum(1).astype(float)
    return classes[votes.argmax(1)], votes / votes.sum(1, keepdims=True), classes


def gram_scores(k: np.ndarray, train: np.ndarray, components: int | None = None, variance: float | None = None) -> np.ndarray:
    """PCA scores of all samples from the Gram matrix, axes from ``train``; k components, or as many as reach a share of variance.

    The sign of an axis makes its largest training score positive.
    """
    c = centred(k, train)
    values, vectors = np.linalg.eigh(c[np.ix_(train, train)])
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    keep = int((values > values[0] * 1e-12).sum()) if len(values) and values[0] > 0 else 0
    if variance is not None:
        keep = min(keep, int(np.argmax(np.cumsum(values) / values.sum() >= variance)) + 1)
    if components is not None:
        keep = min(keep, components)
    scores = c[:, train] @ (vectors[:, :keep] / np.sqrt(values[:keep]))
    top = np.abs(scores[train]).argmax(0)
    return scores * np.sign(scores[train][top, np.arange(keep)])


def lda_classes(k: np.ndarray, labels: np.ndarray, train: np.ndarray, test: np.ndarray, variance: float = 0.97):
    """Linear discriminants on PCA scores: nearest class mean in the pooled covariance, with class shares."""
    x = gram_scores(k, train, variance=variance)
    classes = np.unique(labels[train])
    means = np.array([x[train][labels[train] == c].mean(0) for c in classes])
    inner = x[train] - means[np.searchsorted(classes, labels[train])]
    inverse = np.linalg.pinv(inner.T @ inner / max(1, len(train) - len(classes)))
    prior = np.log([np.mean(labels[train] == c) for c in classes])
    scores = x[test] @ inverse @ means.T - 0.5 * np.einsum("ij,jk,ik->i", means, inverse, means) + prior
    return classes[scores.argmax(1)], scores, classes


CLASSIFIERS: dict[str, Callable] = {"ridge": ridge_classes, "knn": knn_classes, "lda": lda_classes}


def gram_rows(gram: DataFrame) -> DataFrame:
    """(a, cols, dots): the full rows of a Gram matrix given as a <= b."""
    full = gram.select("a", "b", "dot").unionByName(gram.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "dot"))
    return full.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", "dot"))).alias("row")).select("a", F.transform("row", lambda r: r.b).alias("cols"), F.transform("row", lambda r: r.dot).alias("dots"))


#: Samples of one dual fit at most: its task holds a few matrices of this many rows and columns.
DUAL_MOST = 8192


def dual_folds(gram: DataFrame, labels: DataFrame, test: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(split_id, sample_id, y_true, y_pred): class ridge of each split, for few samples of however many features.

    One task inverts the centred Gram matrix (``gram`` as a <= b) and writes the rows of
    the matrix from targets to fitted values, with each row's residuals. A split's own
    task then needs the rows of its test samples only: what they would be without
    themselves is their residuals times the inverse of one less their block, so no model
    is fitted again. Classes without training rows get no score.
    """
    kind, split_kind = dict(gram.dtypes)["a"], dict(test.dtypes)["split_id"]
    named = labels.select("sample_id", F.col("label").cast("string").alias("label"))
    rows = gram_rows(gram).withColumnRenamed("a", "sample_id").join(named, "sample_id")

    def invert(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sample_id").reset_index(drop=True)
        ids, n = part["sample_id"].to_numpy(), len(part)
        if n > DUAL_MOST:
            raise ValueError(f"{n} samples are too many for one matrix of samples; use wide.primal_folds or the models from moments")
        k = np.array([np.asarray(d)[np.searchsorted(c, ids)] for c, d in zip(part["cols"], part["dots"], strict=True)])
        c = centred(k, np.arange(n))
        hat = np.eye(n) - alpha * np.linalg.inv(c + alpha * np.eye(n)) + 1 / n  # the mean fits itself
        classes, place = np.unique(part["label"].to_numpy(str), return_inverse=True)
        y = np.where(place[:, None] == np.arange(len(classes)), 1.0, -1.0)
        return pd.DataFrame({"sample_id": ids, "label": part["label"], "_at": np.arange(n), "_hat": list(hat), "_off": list(y - hat @ y), "_y": list(y), "_classes": [list(classes)] * n})

    fitted = stored(rows.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(invert, f"sample_id {kind}, label string, _at int, _hat array<double>, _off array<double>, _y array<double>, _classes array<string>"), "dual")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        at = part["_at"].to_numpy()
        block = np.array(part["_hat"].tolist())[:, at]
        y, classes = np.array(part["_y"].tolist()), np.array(part["_classes"].iloc[0])
        scores = y - np.linalg.solve(np.eye(len(at)) - block, np.array(part["_off"].tolist()))
        left = part["_n"].iloc[0] - (y > 0).sum(0)
        scores[:, left < 1] = -np.inf
        return pd.DataFrame({"split_id": part["split_id"], "sample_id": part["sample_id"], "y_true": part["label"], "y_pred": classes[scores.argmax(1)]})

    sizes = named.join(fitted.select("sample_id"), "sample_id").groupBy("label").count().agg(F.array_sort(F.collect_list(F.struct("label", "count"))).alias("_s")).select(F.transform("_s", lambda s: s["count"]).alias("_n"))
    return fitted.join(test, "sample_id").crossJoin(sizes).groupBy("split_id").applyInPandas(run, f"split_id {split_kind}, sample_id {kind}, y_true string, y_pred string")  # one row


def classify_splits(gram: DataFrame, labels: DataFrame, test: DataFrame, model: str = "ridge", **options) -> DataFrame:
    """(split_id, sample_id, y_true, y_pred, scores) of a classifier fitted anew for each split.

    ``labels`` is (sample_id, label), ``test`` the splits' test rows. One task fits one split.
    """
    fit = CLASSIFIERS[model]
    kind, split_kind = dict(labels.dtypes)["sample_id"], dict(test.dtypes)["split_id"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sample_id").reset_index(drop=True)
        ids = part["sample_id"].to_numpy()
        k = np.array([np.asarray(d)[np.searchsorted(c, ids)] for c, d in zip(part["cols"], part["dots"], strict=True)])
        labels_, held = part["label"].to_numpy(str), part["held"].to_numpy(bool)
        tests = np.flatnonzero(held)
        predicted, scores, _ = fit(k, labels_, np.flatnonzero(~held), tests, **options)
        return pd.DataFrame({"split_id": part["split_id"].iloc[0], "sample_id": ids[tests], "y_true": labels_[tests], "y_pred": predicted.astype(str), "scores": list(scores)})

    rows = gram_rows(gram).withColumnRenamed("a", "sample_id").join(labels.select("sample_id", F.col("label").cast("string").alias("label")), "sample_id")
    held = rows.crossJoin(test.select("split_id").distinct()).join(test.withColumn("_h", F.lit(True)), ["split_id", "sample_id"], "left").withColumn("held", F.coalesce("_h", F.lit(False))).drop("_h")  # splits times samples
    return held.groupBy("split_id").applyInPandas(run, f"split_id {split_kind}, sample_id {kind}, y_true string, y_pred string, scores array<double>")


def regress_splits(gram: DataFrame, targets: DataFrame, test: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(split_id, sample_id, attribute, y_true, y_pred): multi-target ridge per split; ``targets`` is (sample_id, attribute, value)."""
    kind, split_kind = dict(targets.dtypes)["sample_id"], dict(test.dtypes)["split_id"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sample_id").reset_index(drop=True)
        ids, names = part["sample_id"].to_numpy(), sorted(part["y"].iloc[0])
        k = np.array([np.asarray(d)[np.searchsorted(c, ids)] for c, d in zip(part["cols"], part["dots"], strict=True)])
        y = np.array([[r[n] for n in names] for r in part["y"]], float)
        held = part["held"].to_numpy(bool)
        tests = np.flatnonzero(held)
        out = dual_ridge(k, y, np.flatnonzero(~held), tests, alpha)
        return pd.DataFrame({"split_id": part["split_id"].iloc[0], "sample_id": np.repeat(ids[tests], len(names)), "attribute": np.tile(names, len(tests)), "y_true": y[tests].ravel(), "y_pred": out.ravel()})

    y = targets.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("attribute", "value"))).alias("y"))
    rows = gram_rows(gram).withColumnRenamed("a", "sample_id").join(y, "sample_id").withColumn("y", F.col("y").cast("map<string,double>"))
    held = rows.crossJoin(test.select("split_id").distinct()).join(test.withColumn("_h", F.lit(True)), ["split_id", "sample_id"], "left").withColumn("held", F.coalesce("_h", F.lit(False))).drop("_h")  # splits times samples
    return held.groupBy("split_id").applyInPandas(run, f"split_id {split_kind}, sample_id {kind}, attribute string, y_true double, y_pred double")


def pca(gram: DataFrame, components: int | None = None, variance: float | None = None) -> DataFrame:
    """(sample_id, component, score) of all samples, in one task that holds the n x n matrix."""
    kind = dict(gram.dtypes)["a"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("a").reset_index(drop=True)
        k = np.array([np.asarray(d) for d in part["dots"]])
        s = gram_scores(k, np.arange(len(k)), components, variance)
        return pd.DataFrame({"sample_id": np.repeat(part["a"].to_numpy(), s.shape[1]), "component": np.tile(np.arange(s.shape[1], dtype=np.int32), len(s)), "score": s.ravel()})

    return gram_rows(gram).withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(run, f"sample_id {kind}, component int, score double")


def ml_classifier(kind: str):
    """A Spark ML classifier by its short name, over columns features and label."""
    from pyspark.ml import classification as c

    makers = {
        "lr": lambda: c.LogisticRegression(), "rfc": lambda: c.RandomForestClassifier(seed=0), "dtc": lambda: c.DecisionTreeClassifier(seed=0), "gnb": lambda: c.NaiveBayes(modelType="gaussian"),
        "gbc": lambda: c.OneVsRest(classifier=c.GBTClassifier(seed=0), parallelism=4), "svm": lambda: c.OneVsRest(classifier=c.LinearSVC(maxIter=20), parallelism=4),
    }
    if kind not in makers:
        raise ValueError(f"unknown classifier {kind}; ridge, knn and lda are fitted by classify_splits")
    return makers[kind]()


def ml_regressor(kind: str, alpha: float = 1.0, ratio: float = 0.5, n: int = 0, label_std: tuple[float, float] = (0.0, 0.0)):
    """A Spark ML regressor; penalties are given in the usual sense and converted.

    ``label_std`` is the label's (population, sample) deviation and ``n`` the training
    rows, which the conversion of ridge and elastic net penalties needs.
    """
    from pyspark.ml import regression as r

    pop, samp = label_std
    if kind == "ridge":
        return r.LinearRegression(solver="normal", standardization=False, elasticNetParam=0.0, regParam=alpha / n * pop)
    if kind == "lasso":
        return r.LinearRegression(solver="l-bfgs", standardization=False, elasticNetParam=1.0, regParam=alpha, maxIter=500, tol=1e-9)
    if kind == "elasticnet":
        lam = alpha * ratio + samp * alpha * (1 - ratio)
        return r.LinearRegression(solver="l-bfgs", standardization=False, elasticNetParam=alpha * ratio / lam, regParam=lam, maxIter=500, tol=1e-9)
    return {"rf": lambda: r.RandomForestRegressor(seed=0), "gbr": lambda: r.GBTRegressor(seed=0), "dt": lambda: r.DecisionTreeRegressor(seed=0)}[kind]()


def ml_evaluate(vectors: DataFrame, kind: str, held: str) -> DataFrame:
    """(sample_id, y_true, y_pred) of the held-out rows of (sample_id, label double, features array, held boolean)."""
    data = vectors.withColumn("features", array_to_vector(F.transform("features", lambda x: x.cast("double")))).withColumn("label", F.col("label").cast("double"))
    fitted = ml_classifier(kind).fit(data.where(f"NOT {held}"))
    return fitted.transform(data.where(held)).select("sample_id", F.col("label").cast("int").cast("string").alias("y_true"), F.col("prediction").cast("int").cast("string").alias("y_pred"))


def ml_regress(vectors: DataFrame, kind: str, held: str, alpha: float = 1.0, ratio: float = 0.5) -> DataFrame:
    """(sample_id, y_true, y_pred) of a regressor on the held-out rows of (sample_id, label double, features array, held boolean)."""
    data = vectors.withColumn("features", array_to_vector(F.transform("features", lambda x: x.cast("double"))))
    train = data.where(f"NOT {held}")
    known = train.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("pop"), F.stddev_samp("label").alias("samp")).collect()[0]
    if not known.n:
        return vectors.select("sample_id", F.col("label").alias("y_true"), F.lit(None).cast("double").alias("y_pred")).where(held)
    fitted = ml_regressor(kind, alpha, ratio, known.n, (known["pop"], known.samp or 0.0)).fit(train)
    return fitted.transform(data.where(held)).select("sample_id", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))


def kmeans_best(points: DataFrame, columns: list[str], most: int = 9) -> DataFrame:
    """(k, silhouette, best): k-means for k from 2 on, marked at the largest silhouette."""
    held = Points(points, columns)
    found = sorted(held.silhouettes(kmeans(held, list(range(2, most + 1)))).items())
    best = max(found, key=lambda x: (x[1], -x[0]))[0]
    return points.sparkSession.createDataFrame([(k, s, k == best) for k, s in found], "k int, silhouette double, best boolean")
