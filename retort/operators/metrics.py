"""Metrics of predictions (split_id, sample_id, y_true, y_pred), in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retort.operators.signals import smooth


def confusion(predictions: DataFrame, *keys: str) -> DataFrame:
    return predictions.groupBy(*keys, "y_true", "y_pred").agg(F.count("*").alias("n"))


def class_scores(predictions: DataFrame, *keys: str) -> DataFrame:
    """Per class: support, hits, predicted, precision, recall, f1; a class never predicted has precision 0."""
    c = confusion(predictions, *keys)
    t = c.groupBy(*keys, F.col("y_true").alias("y")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("hits"))
    p = c.groupBy(*keys, F.col("y_pred").alias("y")).agg(F.sum("n").alias("predicted"))
    j = t.join(p, [*keys, "y"], "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))
    recall, precision = F.col("hits") / F.col("support"), F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0)
    j = j.withColumn("recall", recall).withColumn("precision", precision)
    return j.withColumn("f1", F.when(F.col("hits") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def fold_metrics(predictions: DataFrame, *keys: str) -> DataFrame:
    """Accuracy, balanced accuracy (mean recall over true classes), support-weighted precision, recall and f1."""
    s = class_scores(predictions, *keys)
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}")
    return s.groupBy(*keys).agg((F.sum("hits") / F.sum("support")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), weighted("precision"), weighted("recall"), weighted("f1"))


def summary(metrics: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean, population deviation, least, most, median and interquartile range over splits."""
    return metrics.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"),
        F.percentile(value, 0.5).alias("median"), (F.percentile(value, 0.75) - F.percentile(value, 0.25)).alias("iqr"),
    )


def mean_confusion(predictions: DataFrame) -> DataFrame:
    """Counts averaged over the splits in which a true class occurs, then as shares of the class."""
    rows = predictions.groupBy("y_true").agg(F.countDistinct("split_id").alias("_s"))
    c = confusion(predictions).join(rows, "y_true").withColumn("mean_n", F.col("n") / F.col("_s"))
    return c.select("y_true", "y_pred", "mean_n", (F.col("mean_n") / F.sum("mean_n").over(Window.partitionBy("y_true"))).alias("share"))


def percent_rows(counts: DataFrame, key: str, item: str, n: str = "n") -> DataFrame:
    """Whole percents that sum up to 100 per key, by largest remainder; ties by item."""
    w = Window.partitionBy(key)
    raw = counts.withColumn("_x", 100.0 * F.col(n) / F.sum(n).over(w)).withColumn("_f", F.floor("_x"))
    k = F.row_number().over(w.orderBy(F.desc(F.round(F.col("_x") - F.col("_f"), 9)), item))
    return raw.withColumn("_k", k).withColumn("_left", 100 - F.sum("_f").over(w)).select(key, item, (F.col("_f") + (F.col("_k") <= F.col("_left")).cast("int")).cast("long").alias("percent"))


def chance_level(labels: DataFrame, label: str) -> DataFrame:
    """The sum of squared class shares."""
    n = labels.groupBy(label).count()
    return n.agg((F.sum(F.pow("count", F.lit(2))) / F.pow(F.sum("count"), F.lit(2))).alias("chance"))


def regression_metrics(pairs: DataFrame, *keys: str) -> DataFrame:
    """MAE, RMSE, R2, Pearson r, residual mean and deviations of (y_true, y_pred) by keys, and rounded hits."""
    r = pairs.withColumn("_e", F.col("y_pred") - F.col("y_true"))
    sst = F.var_pop("y_true") * F.count("*")
    return r.groupBy(*keys).agg(
        F.avg(F.abs("_e")).alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), (1 - F.sum(F.col("_e") * F.col("_e")) / sst).alias("r2"), F.corr("y_true", "y_pred").alias("r"),
        F.avg("_e").alias("bias"), F.stddev_pop("_e").alias("residual_pop"), F.stddev_samp("_e").alias("residual_samp"), F.avg((F.rint("y_pred") == F.rint("y_true")).cast("double")).alias("rounded"),
        *[F.avg((F.abs("_e") <= k).cast("double")).alias(f"within_{k}") for k in range(1, 6)],
    )


def fit_line(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, slope, intercept): the least-squares line of y_pred on y_true."""
    return pairs.groupBy(*keys).agg(F.regr_slope("y_pred", "y_true").alias("slope"), F.regr_intercept("y_pred", "y_true").alias("intercept"))


def mode_per(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value per key and its share; ties to the smallest."""
    c = df.groupBy(key, value).count()
    w = Window.partitionBy(key)
    k = F.row_number().over(w.orderBy(F.desc("count"), value))
    return c.withColumn("_k", k).withColumn("_n", F.sum("count").over(w)).where("_k = 1").select(key, value, (F.col("count") / F.col("_n")).alias("share"))


def first_hits(survival: DataFrame, steps: int) -> DataFrame:
    """(step, rt_bin, n, cumulative): folds in which a bin is first chosen at a step, and running sums over all steps."""
    first = survival.groupBy("fold", "rt_bin").agg(F.min("step").alias("step")).groupBy("step", "rt_bin").agg(F.count("*").alias("n"))
    dense = first.select("rt_bin").distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    filled = dense.join(first.withColumn("step", F.col("step").cast("int")), ["step", "rt_bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.withColumn("cumulative", F.sum("n").over(Window.partitionBy("rt_bin").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))


def normalise_frequencies(freq: DataFrame, how: str) -> DataFrame:
    """Frequencies (step, rt_bin, n) over the largest (fraction, global), the step's sum (column) or the bin's largest (row)."""
    if how in ("fraction", "global"):
        top = freq.agg(F.max("n").alias("_d"))
        out = freq.crossJoin(top)  # one row
    else:
        part = {"column": (F.sum("n"), "step"), "row": (F.max("n"), "rt_bin")}[how]
        out = freq.withColumn("_d", part[0].over(Window.partitionBy(part[1])))
    return out.withColumn("value", F.when(F.col("_d") > 0, F.col("n") / F.col("_d")).otherwise(0.0)).drop("_d")


def ranked_focus(weights: DataFrame, k: int, n_bins: int, size: int) -> DataFrame:
    """(taster, bin, focus): the k largest weights of each (taster, attribute); rank r adds 1 / (r + 1) to its bin."""
    w = Window.partitionBy("taster", "attribute").orderBy(F.desc(F.abs("weight")), "pos")
    top = weights.withColumn("_r", F.row_number().over(w) - 1).where(F.col("_r") < k)
    return top.groupBy("taster", F.least(F.expr(f"int(pos div {size})"), F.lit(n_bins - 1)).alias("bin")).agg(F.sum(1 / (F.col("_r") + 1)).alias("focus"))


def smoothed_focus(focus: DataFrame, n_bins: int, sigma: float, *keys: str) -> DataFrame:
    """(keys, bin, focus): the focus summed over everything but the keys, bins without any as 0, smoothed along the bins."""
    total = focus.groupBy(*keys, "bin").agg(F.sum("focus").alias("focus")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "focus"))).alias("_m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda b: F.coalesce(F.try_element_at("_m", b), F.lit(0.0)))
    return total.select(*keys, F.posexplode(smooth(every, sigma)).alias("bin", "focus"))


def average_by(rows: DataFrame, key: str, value: str, *more: str) -> DataFrame:
    """(key, more, value): the mean over all rows of a key."""
    return rows.groupBy(key, *more).agg(F.avg(value).alias(value))


def mean_predictions(predictions: DataFrame, *keys: str) -> DataFrame:
    """(keys, y_true, y_pred, repeats): means over the repeats of (repeat, keys, y_true, y_pred)."""
    return predictions.groupBy(*keys).agg(F.avg("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred"), F.count_distinct("repeat").alias("repeats"))


def mean_scores(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, values): the mean of each value over all rows of the keys."""
    return rows.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def spread_by_attribute(rows: DataFrame, values: list[str]) -> DataFrame:
    """(attribute, std, least, most) of each named column, with the sample deviation."""
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(v).alias("attribute"), F.col(v).cast("double").alias("v")) for v in values])).alias("e")).select("e.*")
    return each.groupBy("attribute").agg(F.stddev_samp("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("most"))


def centred_by(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """Rows with the mean over their key taken off each value, from one aggregation that is joined back."""
    means = rows.groupBy(key).agg(*[F.avg(v).alias(f"_m_{v}") for v in values]).withColumnRenamed(key, "_key")
    joined = rows.join(means, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    return joined.withColumns({v: F.col(v) - F.col(f"_m_{v}") for v in values}).drop(*[f"_m_{v}" for v in values])


def numbered_replicates(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows with ``replicate``, their number from 1 within the keys."""
    return rows.withColumn("replicate", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def step_curve(scores: DataFrame, step: str, value: str) -> DataFrame:
    """(step, mean, std, n) of a score over repeats, with the population deviation."""
    return scores.groupBy(step).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("n"))
