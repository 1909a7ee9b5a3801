"""Means in the order of rows: the last digit does not hang on partitions, and it is that of SQL in one thread."""

import shutil
from functools import reduce

import duckdb

from retort.operators import statistics as T
from retort.plans import registry


def test_partitions_do_not_change_a_mean(spark):
    values = [0.1, 0.2, 0.3, 0.7, 1e16, 1.0, -1e16]
    rows = spark.createDataFrame([(0, k, v) for k, v in enumerate(values)] + [(1, 7, None), (2, 8, None), (2, 9, 4.0)], "g int, at int, v double")
    for n in (1, 2, 5):
        got = {r.g: r.m for r in rows.repartition(n, "at").groupBy("g").agg(T.mean_in_order("v", "at").alias("m")).collect()}
        assert got == {0: reduce(float.__add__, values) / 7, 1: None, 2: 4.0}


def test_best_decile_is_that_of_sql_in_one_thread(spark, tmp_path):
    """5225 means of this table lie within 1e-12 of the percentile."""
    shutil.copy("/root/testdata/sf0.1/lineitem.parquet", tmp_path)
    db = duckdb.connect(config={"threads": 1})
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = sorted(db.execute(registry.ORACLES["best_decile_channels"]).fetchall())
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = sorted((r.channel, r.n) for r in registry.QUERIES["best_decile_channels"](spark, str(tmp_path)).collect())
            assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
