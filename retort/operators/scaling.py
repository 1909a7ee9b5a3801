"""Scalers fitted on long features (pos, value) and applied to others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_scaler(features: DataFrame, kind: str, *keys: str) -> DataFrame:
    """(keys, pos, centre, scale): standard (population deviation), minmax or robust (median, interquartile range); scale 0 counts as 1."""
    rules = {
        "standard": (F.avg("value"), F.stddev_pop("value")),
        "minmax": (F.min("value"), F.max("value") - F.min("value")),
        "robust": (F.percentile("value", 0.5), F.percentile("value", 0.75) - F.percentile("value", 0.25)),
    }
    if kind not in rules:
        raise ValueError(kind)
    centre, scale = rules[kind]
    fitted = features.groupBy(*keys, "pos").agg(centre.alias("centre"), scale.alias("scale"))
    return fitted.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0))


def apply_scaler(features: DataFrame, scaler: DataFrame, *keys: str) -> DataFrame:
    return features.join(scaler, [*keys, "pos"]).withColumn("value", (F.col("value") - F.col("centre")) / F.col("scale")).drop("centre", "scale")


def taster_factors(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, taster, attribute, factor): the non-negative factor of predictions with the least squared error; none below two rows."""
    f = F.greatest(F.lit(0.0), F.sum(F.col("y_pred") * F.col("y_true")) / F.sum(F.col("y_pred") * F.col("y_pred")))
    return pairs.groupBy(*keys, "taster", "attribute").agg(f.alias("factor"), F.count("*").alias("_n")).where("_n >= 2").drop("_n")


def apply_factors(predictions: DataFrame, factors: DataFrame, *keys: str) -> DataFrame:
    """Predictions times their taster's factor; tasters without one keep theirs."""
    joined = predictions.join(factors, [*keys, "taster", "attribute"], "left")
    return joined.withColumn("y_pred", F.col("y_pred") * F.coalesce("factor", F.lit(1.0))).select(*predictions.columns)
