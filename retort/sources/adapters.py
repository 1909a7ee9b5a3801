"""The given tables seen as chromatography data; see the README for the mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.session import table


def scans(spark: SparkSession, sf_dir: str, by_dataset: bool = False) -> DataFrame:
    """lineitem as long scans: sample_id, scan_idx, rt_ms, mz, intensity (and dataset)."""
    keys = [F.col("l_suppkey").cast("long").alias("sample_id"), (F.col("l_partkey") % 200).cast("int").alias("scan_idx"), (40 + F.col("l_linenumber")).cast("int").alias("mz")]
    if by_dataset:
        keys.insert(0, F.col("l_returnflag").alias("dataset"))
    out = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.sum("l_quantity").alias("intensity"))
    return out.withColumn("rt_ms", F.col("scan_idx") * 100.0)


#: The same as SQL, without and with the dataset.
SCANS = "scans AS (SELECT l_suppkey::BIGINT AS sample_id, (l_partkey % 200)::INTEGER AS scan_idx, (40 + l_linenumber)::INTEGER AS mz, sum(l_quantity) AS intensity, (l_partkey % 200) * 100.0::DOUBLE AS rt_ms FROM lineitem GROUP BY l_suppkey, l_partkey % 200, l_linenumber)"
DSCANS = "dscans AS (SELECT l_returnflag AS dataset, l_suppkey::BIGINT AS sample_id, (l_partkey % 200)::INTEGER AS scan_idx, (40 + l_linenumber)::INTEGER AS mz, sum(l_quantity) AS intensity FROM lineitem GROUP BY ALL)"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as the readings whose sums are :func:`scans`, for sums that need no scan by itself."""
    keys = [F.col("l_suppkey").cast("long").alias("sample_id"), (F.col("l_partkey") % 200).cast("int").alias("scan_idx"), (40 + F.col("l_linenumber")).cast("int").alias("mz")]
    return table(spark, sf_dir, "lineitem").select(*keys, F.col("l_quantity").alias("intensity"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as long features: sample_id, label, pos, value."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("sample_id"), "label", F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.col("value").cast("double"))


FEATURES = "features AS (SELECT vec_id::BIGINT AS sample_id, label, (unnest(range(1, len(embedding) + 1)) - 1)::INTEGER AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings)"


def sensory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as (wine, taster, fruity, citrus): nations as wines, market segments as tasters, orders as scorings."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.select(F.col("n_name").alias("wine"), F.col("c_mktsegment").alias("taster"), (F.col("o_totalprice") / 1000).alias("fruity"), (F.col("c_acctbal") / 100).alias("citrus"), "o_orderkey")


SENSORY = "sensory AS (SELECT n_name AS wine, c_mktsegment AS taster, o_totalprice / 1000 AS fruity, c_acctbal / 100 AS citrus, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split_id, sample_id, y_true, y_pred): quality as truth, toxic reversed as prediction, five splits by doc_id."""
    lab = table(spark, sf_dir, "labels")
    return lab.select((F.col("doc_id") % 5).cast("int").alias("split_id"), F.col("doc_id").alias("sample_id"), F.col("quality").cast("string").alias("y_true"), (1 - F.col("toxic")).cast("string").alias("y_pred"))


PREDICTIONS = "predictions AS (SELECT (doc_id % 5)::INTEGER AS split_id, doc_id AS sample_id, quality::VARCHAR AS y_true, (1 - toxic)::VARCHAR AS y_pred FROM labels)"
