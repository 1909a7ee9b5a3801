"""Whole analyses composed of the operators: pooled and crossed models, regressions, sensory models.

Tables of rows are (sample_id, x array[, y array]), as in ``retort.operators.moments``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retort.operators import metrics as M
from retort.operators import models as D
from retort.operators import moments as X
from retort.operators import scaling as Z
from retort.operators import splits as P
from retort.operators import statistics as T
from retort.operators import wide as W
from retort.sources.shared import stored


def classification_job(rows: DataFrame, labels: DataFrame, test: DataFrame, model: str = "ridge", scale: str | None = None) -> DataFrame:
    """Metrics of each split: scaled by its training rows, fitted and told per split, metrics in SQL."""
    return M.fold_metrics(X.classify(rows, labels, test, model, scale=scale), "split_id")


def wide_classification_job(features: DataFrame, labels: DataFrame, test: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Metrics of each split for samples of many features (sample_id, pos, value), by ridge.

    The model is told from one Gram matrix where samples are not more than features, else
    from matrices of the features; both give the same predictions.
    """
    rows = W.sparse_rows(features)
    found = W.places(rows)
    if found is not None and len(found[0]) < rows.count():
        return M.fold_metrics(W.primal_folds(rows, labels, test, *found, alpha), "split_id")
    cells = rows.select("sample_id", F.explode(F.arrays_zip("pos", "value")).alias("c")).select("sample_id", "c.pos", "c.value")
    return M.fold_metrics(D.dual_folds(T.gram(cells), labels, test, alpha), "split_id")


def per_origin(rows: DataFrame, labels: DataFrame, test: DataFrame, origins: DataFrame, model: str = "ridge", scale: str | None = None) -> DataFrame:
    """Metrics of a pooled model for each origin (sample_id, origin) of its test rows."""
    return M.fold_metrics(X.classify(rows, labels, test, model, scale=scale).join(origins, "sample_id"), "origin")


def hold_out_origin(rows: DataFrame, labels: DataFrame, origins: DataFrame, model: str = "ridge", scale: str | None = None, by_itself: bool = False) -> DataFrame:
    """For each origin: trained on all others, tested on it.

    With ``by_itself`` each origin's features are in units of its own deviations, about
    its own means: the side that is tested is scaled by its own statistics, not by those
    of the origins that the model has seen.
    """
    test = origins.select(F.col("origin").cast("string").alias("split_id"), "sample_id")
    return M.fold_metrics(X.hold_out(rows, labels, test, model, scale) if by_itself else X.classify(rows, labels, test, model, scale=scale), "split_id").withColumnRenamed("split_id", "origin")


def with_targets(rows: DataFrame, values: DataFrame, *columns: str) -> DataFrame:
    """Rows with ``y``, the columns of (sample_id, columns) in their order."""
    return rows.join(values.select("sample_id", F.array(*[F.col(c).cast("double") for c in columns]).alias("y")), "sample_id")


def vintage_regression(rows: DataFrame, years: DataFrame, alpha: float = 1.0, scale: str | None = None, coefficients: bool = False) -> DataFrame:
    """Leave-one-out predictions (sample_id, y_true, y_pred[, weights]) of a number by ridge; ``years`` is (sample_id, value).

    With ``scale`` standard every fold is scaled by its own training rows; ``weights`` are
    then the fold's coefficients on the scaled features.
    """
    return X.leave_one_out(with_targets(rows, years, "value"), alpha=alpha, scale=scale, coefficients=coefficients)


def vintage_report(told: DataFrame) -> DataFrame:
    """One row of leave-one-out predictions: the regression metrics, the shares within 1 to 5, and the line of told on true."""
    return M.regression_metrics(told).crossJoin(M.fit_line(told))  # one row each


def fold_coefficients(told: DataFrame) -> DataFrame:
    """(pos, mean, std, agree): each feature's coefficient over the folds of leave-one-out, and the share of folds with the mean's sign."""
    each = told.select(F.posexplode("weights").alias("pos", "w"))
    g = each.groupBy("pos").agg(F.avg("w").alias("mean"), F.stddev_pop("w").alias("std"), F.avg(F.signum("w")).alias("_sign"))
    return g.select("pos", "mean", "std", ((1 + F.col("_sign") * F.signum("mean")) / 2).alias("agree"))


def random_subsets(rows: DataFrame, years: DataFrame, size: int, repeats: int, seed: int = 0, alpha: float = 1.0, scale: str | None = None) -> DataFrame:
    """Regression metrics (mae, rmse, r2, r) by repeat of leave-one-out within random subsets of one size, all in one job."""
    order = Window.partitionBy("repeat").orderBy(F.xxhash64("sample_id", "repeat", F.lit(seed)), "sample_id")
    drawn = years.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= size)
    return M.regression_metrics(X.leave_one_out(with_targets(rows, years, "value").join(drawn.select("sample_id", "repeat"), "sample_id"), "repeat", alpha=alpha, scale=scale), "repeat")


def one_hot(taster: Column, tasters: list[str], constant: bool = False) -> Column:
    """1 at the taster's place and 0 at the others'; a constant column in its stead as a control."""
    return F.array(F.lit(1.0)) if constant else F.transform(F.array(*map(F.lit, tasters)), lambda t: (t == taster).cast("double"))


def exchanged(scores: DataFrame, seed: int = 0, buckets: int = 64) -> DataFrame:
    """Scores (row_id, y) that rows have exchanged by two seeded orders within hash buckets: the control that must fail."""
    bucket = F.pmod(F.xxhash64("row_id", F.lit(seed + 1)), F.lit(buckets))
    place = lambda *order: F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    dealt = scores.withColumn("_b", bucket)
    a = dealt.select("_b", "row_id", place("row_id").alias("_k"))
    return a.join(dealt.select("_b", "y", place(F.xxhash64("row_id", F.lit(seed)), "row_id").alias("_k")), ["_b", "_k"]).select("row_id", "y")


def sensory_model(wines: DataFrame, rows: DataFrame, names: list[str], tasters: list[str], folds: int = 5, alpha: float = 1.0, constant: bool = False, shuffled: bool = False, seed: int = 0, scale: str | None = None, components: int | None = None, centred: bool = False) -> DataFrame:
    """Held-out predictions (sample_id, attribute, y_true, y_pred) of scores by ridge; wines never straddle folds.

    ``wines`` is (wine, x), ``rows`` (row_id, wine, taster, y) with the scores of ``names``.
    A row's features are its wine's, followed by the taster's one-hot. ``scale`` standard
    scales features by the training rows, ``components`` reduces the targets to principal
    components and brings predictions back, ``centred`` takes each taster's mean score off.
    """
    if centred:
        rows = about_taster_means(rows, len(names))
    if shuffled:
        rows = rows.drop("y").join(exchanged(rows.select("row_id", "y"), seed), "row_id")
    full = rows.join(wines, "wine").select(F.col("row_id").alias("sample_id"), "wine", "y", F.concat("x", one_hot(F.col("taster"), tasters, constant)).alias("x"))
    test = P.group_folds(full.select("sample_id", "wine"), "wine", folds, seed)
    return X.regress(full.drop("wine"), names, test, alpha, scale, components).drop("split_id")


def about_taster_means(rows: DataFrame, size: int) -> DataFrame:
    """Rows (taster, y) with the mean of each of the ``size`` scores over the taster's rows taken off."""
    means = rows.groupBy("taster").agg(F.array(*[F.avg(F.col("y")[k]) for k in range(size)]).alias("_m"))
    return rows.join(means, "taster").withColumn("y", F.zip_with("y", "_m", lambda a, b: a - b)).drop("_m")


def scaled_taster_model(wines: DataFrame, rows: DataFrame, names: list[str], tasters: list[str], folds: int = 5, inner: int = 5, alpha: float = 1.0, seed: int = 0, scale: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Held-out predictions (split_id, row_id, taster, attribute, y_true, y_pred), plain and with each taster's factor.

    Factors come from the training rows of each outer split alone: their wines are dealt to
    inner folds, told by models of the other inner folds, and each (taster, attribute) gets
    the non-negative factor that fits its told scores best. Inner models come from the
    split's training moments less those of the fold; wines straddle neither kind of fold.
    """
    full = rows.join(wines, "wine").select("row_id", "wine", "taster", "y", F.concat("x", one_hot(F.col("taster"), tasters)).alias("x"))
    each_wine = full.select(F.col("wine").alias("sample_id")).distinct().withColumn("wine", F.col("sample_id"))
    outer = P.group_folds(each_wine, "wine", folds, seed).select(F.col("sample_id").alias("wine"), F.col("split_id").alias("_own"))
    dealt = outer.withColumn("split_id", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("_test", F.col("_own") == F.col("split_id"))
    k = F.row_number().over(Window.partitionBy("split_id", "_test").orderBy(F.xxhash64("wine", "split_id", F.lit(seed + 1)), "wine")) - 1
    placed = dealt.withColumn("fold", F.when(~F.col("_test"), (k % inner).cast("int"))).select("wine", "split_id", "fold")
    every = full.join(placed, "wine").withColumnRenamed("row_id", "sample_id")
    named = full.select("row_id", "taster")

    def told(t: DataFrame) -> DataFrame:
        found = X.regress_folds(t.select("split_id", "fold", "sample_id", "x", "y"), names, "split_id", alpha=alpha, scale=scale)
        return found.withColumnRenamed("sample_id", "row_id").join(named, "row_id").select("split_id", "row_id", "taster", "attribute", "y_true", "y_pred")

    plain = told(every.withColumn("fold", F.when(F.col("fold").isNull(), 0)))
    factors = Z.taster_factors(told(every.where("fold IS NOT NULL")), "split_id")
    return plain, Z.apply_factors(plain, factors, "split_id")


def _folded(rows: DataFrame, folds: int, seed: int) -> DataFrame:
    """Rows with ``fold``, whole wines dealt round-robin."""
    test = P.group_folds(rows.select(F.col("wine").alias("sample_id")).distinct().withColumn("wine", F.col("sample_id")), "wine", folds, seed)
    return rows.join(test.select(F.col("sample_id").alias("wine"), F.col("split_id").alias("fold")), "wine")


def self_and_group_models(wines: DataFrame, scores: DataFrame, names: list[str], folds: int = 5, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """(taster, attribute, r2_self, r2_group): a taster's own model against a model of the other tasters' means.

    ``scores`` is (wine, taster, y), one row each. Both are tested on the taster's scores
    of wines that were not trained on. The others' mean is the wine's sum less one's own.
    """
    place = [F.col("y")[k] for k in range(len(names))]
    wines, scores = stored(wines, "wines"), stored(scores, "scores")  # met by many steps; else each of them gathers them anew
    wine_sums = scores.groupBy("wine").agg(F.count("*").alias("_n"), F.array(*[F.sum(p) for p in place]).alias("_s"))
    rows = _folded(scores.join(wine_sums, "wine").join(wines, "wine").withColumn("sample_id", F.col("wine")), folds, seed)
    own = X.regress_folds(rows.select("taster", "sample_id", "fold", "x", "y"), names, "taster", alpha=alpha)
    others = F.zip_with("_s", "y", lambda s, v: (s - v)).alias("_o")
    group = rows.where("_n > 1").select("taster", "sample_id", "fold", "x", F.col("_n"), others).select("taster", "sample_id", "fold", "x", F.transform("_o", lambda v: v / (F.col("_n") - 1)).alias("y"))
    told = X.regress_folds(group, names, "taster", alpha=alpha).drop("y_true").join(own.select("taster", "sample_id", "attribute", "y_true"), ["taster", "sample_id", "attribute"])
    score = lambda p, name: M.regression_metrics(p, "taster", "attribute").select("taster", "attribute", F.col("r2").alias(name))
    return score(own, "r2_self").join(score(told, "r2_group"), ["taster", "attribute"])


def self_versus_group(scores: DataFrame) -> DataFrame:
    """(taster, attribute, r2_group, r): how well the mean of the other tasters tells a taster's scores of the same wines, without a model.

    ``scores`` is (wine, taster, attribute, value), one row each.
    """
    whole = scores.groupBy("wine", "attribute").agg(F.sum("value").alias("_s"), F.count("*").alias("_n")).where("_n > 1")
    pairs = scores.join(whole, ["wine", "attribute"]).withColumn("y_true", F.col("value")).withColumn("y_pred", (F.col("_s") - F.col("value")) / (F.col("_n") - 1))
    return M.regression_metrics(pairs, "taster", "attribute").select("taster", "attribute", F.col("r2").alias("r2_group"), "r")


def taster_models(wines: DataFrame, scores: DataFrame, names: list[str], repeats: int = 10, share: float = 0.2, least: int = 5, alpha: float = 1.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Per-taster models over repeated random splits: metrics by (taster, attribute), and mean weights by (taster, target, pos).

    Metrics are means over repeats; tasters with fewer rows than ``least`` are passed over.
    """
    enough = scores.groupBy("taster").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    rows = scores.join(enough, "taster").join(wines, "wine").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    k = F.row_number().over(Window.partitionBy("taster", "repeat").orderBy(F.xxhash64("wine", "taster", "repeat", F.lit(seed)), "wine"))
    rows = rows.withColumn("_k", k).select("taster", "repeat", F.col("wine").alias("sample_id"), "x", "y", F.when(F.col("_k") <= F.ceil(F.col("_n") * share), 0).alias("fold"))
    tested = M.regression_metrics(X.regress_folds(rows, names, "taster", "repeat", alpha=alpha), "taster", "attribute", "repeat")
    metrics = tested.groupBy("taster", "attribute").agg(*[F.avg(c).alias(c) for c in ("mae", "rmse", "r2")], F.count("*").alias("repeats"))
    models = X.fitted(X.sums(rows.where("fold IS NULL"), "taster", "repeat"), lambda s: X.ridge_fit(s, alpha), "taster", "repeat")
    weights = models.select("taster", F.posexplode("weights").alias("target", "w")).select("taster", "target", F.posexplode("w").alias("pos", "w")).groupBy("taster", "target", "pos").agg(F.avg("w").alias("weight"))
    return metrics, weights


def profile_labels(rows: DataFrame, labels: DataFrame, test: DataFrame, folds: int, model: str = "ridge") -> tuple[DataFrame, DataFrame]:
    """Labels told from sensory profiles: (repeat, accuracy, balanced_accuracy) of predictions pooled over a repeat's folds, and the confusion in shares of each class."""
    pooled = X.classify(rows, labels, test, model).withColumn("repeat", F.floor(F.col("split_id") / folds).cast("int"))
    counts = M.confusion(pooled)
    every = counts.groupBy("y_true").agg(F.sum("n").alias("_all"))
    return M.fold_metrics(pooled, "repeat").select("repeat", "accuracy", "balanced_accuracy"), counts.join(every, "y_true").select("y_true", "y_pred", (F.col("n") / F.col("_all")).alias("share"))


def age_folds(ages: DataFrame, width: int, folds: int, repeats: int, seed: int = 0) -> DataFrame:
    """Test rows of (sample_id, age): each age bin is dealt round-robin to the folds of each repeat."""
    return P.stratified_folds(ages.withColumn("_bin", F.floor(F.col("age") / width)), "_bin", folds, repeats, seed)


def age_regression(rows: DataFrame, ages: DataFrame, width: int = 5, folds: int = 5, repeats: int = 3, alpha: float = 1.0) -> DataFrame:
    """Regression metrics of the age by repeat, over folds stratified on age bins."""
    out = X.regress(with_targets(rows, ages, "age"), ["age"], age_folds(ages, width, folds, repeats), alpha)
    return M.regression_metrics(out.withColumn("repeat", F.floor(F.col("split_id") / folds).cast("int")), "repeat")


def age_classes(rows: DataFrame, ages: DataFrame, width: int = 5, folds: int = 5, repeats: int = 3) -> DataFrame:
    """Accuracy and balanced accuracy of the age bin by repeat, over the same folds."""
    labels = ages.select("sample_id", F.floor(F.col("age") / width).cast("string").alias("label"))
    return profile_labels(rows, labels, age_folds(ages, width, folds, repeats), folds)[0]


def pca_classification(rows: DataFrame, labels: DataFrame, repeats: int = 20, variance: float = 0.97, model: str = "lda") -> DataFrame:
    """(mean, spread, repeats): accuracy of discriminants on the principal components of the training rows, one row of each class out; spread is 2 deviations."""
    out = X.classify(rows, labels, P.one_per_class(labels, "label", repeats), model, variance=variance)
    return M.fold_metrics(out, "split_id").agg(F.avg("accuracy").alias("mean"), (2 * F.stddev_pop("accuracy")).alias("spread"), F.count("*").alias("repeats"))


def combined_quality(points: DataFrame, labels: DataFrame, rows: DataFrame, bins: int) -> DataFrame:
    """embedding_quality with the adjusted Rand index of labels against an equal-width cut of the first component, and the mean of all three brought to 0 to 1."""
    ends = points.agg(F.min("score").alias("_a"), F.max("score").alias("_b"))
    cut = points.crossJoin(ends).select("sample_id", F.least(F.lit(bins - 1), F.floor((F.col("score") - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins)).alias("cut"))  # one row
    rand = T.adjusted_rand(cut.join(labels, "sample_id"), "label", "cut")
    q = embedding_quality(rows, labels).crossJoin(rand)  # one row each
    ch = F.col("calinski_harabasz")
    return q.withColumn("combined", ((F.col("silhouette") + 1) / 2 + ch / (1 + ch) + (F.col("adjusted_rand") + 1) / 2) / 3)


def embedding_quality(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(silhouette, calinski_harabasz) of labelled rows (sample_id, x), without pairs of samples."""
    return T.silhouette(rows, labels).crossJoin(T.calinski_harabasz(rows, labels))  # one row each


def ranked_channels(scored: DataFrame, channels: list[int]) -> DataFrame:
    """(set_id, k, channels): cumulative sets of channels by their own accuracy, best first; ties to the smaller channel."""
    ranked = scored.where(F.col("mz_bin").isNotNull()).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("accuracy")).alias("s"), (F.col("rt_bin") * 10_000 + F.col("mz_bin")).alias("c")))), lambda x: x.c).alias("r"))
    return ranked.select(F.explode(F.sequence(F.lit(1), F.lit(len(channels)))).alias("k"), "r").select(F.col("k").cast("long").alias("set_id"), "k", F.slice("r", F.lit(1), F.col("k")).alias("channels"))
