"""Targeted compounds: retention windows joined with scans, peak areas, pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_join(scans: DataFrame, compounds: DataFrame) -> DataFrame:
    """Scans inside a compound's channels and window (minutes, both ends in), with its name: an equi join on mz, then the range."""
    c = compounds.select("name", F.explode("mz").alias("mz"), "rt_start", "rt_stop")
    return scans.join(c, "mz").where((F.col("rt_ms") / 60000 >= F.col("rt_start")) & (F.col("rt_ms") / 60000 <= F.col("rt_stop")))


def integrate(scans: DataFrame, compounds: DataFrame) -> DataFrame:
    """(sample_id, name, mz, area): trapezoid areas over minutes of each compound's channels.

    Without a scan in the window the area is 0, with an mz that no scan has it is null.
    """
    inside = window_join(scans, compounds)
    w = Window.partitionBy("sample_id", "name", "mz").orderBy("rt_ms")
    step = (F.col("rt_ms") - F.lag("rt_ms").over(w)) / 60000 * (F.col("intensity") + F.lag("intensity").over(w)) / 2
    areas = inside.withColumn("_a", step).groupBy("sample_id", "name", "mz").agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("_area"))
    samples, channels = scans.select("sample_id").distinct(), scans.select("mz").distinct().withColumn("_there", F.lit(True))
    wanted = samples.crossJoin(compounds.select("name", F.explode("mz").alias("mz")).distinct().join(channels, "mz", "left"))  # samples times the short list
    return wanted.join(areas, ["sample_id", "name", "mz"], "left").select("sample_id", "name", "mz", F.when(F.col("_there"), F.coalesce("_area", F.lit(0.0))).alias("area"))


def integrate_by_index(values: DataFrame, start: int, stop: int, value: str = "tic") -> DataFrame:
    """(sample_id, area): the sum over scans start to stop, both in; 0 where none is."""
    return values.groupBy("sample_id").agg(F.coalesce(F.sum(F.when(F.col("scan_idx").between(start, stop), F.col(value))), F.lit(0.0)).alias("area"))


def peak_table(areas: DataFrame, names: list[str], drop: str | None = None) -> DataFrame:
    """One row per sample, one column per compound: the first area by row number, 0 where none is."""
    first = areas.groupBy("sample_id").pivot("name", names).agg(F.min_by("area", "row_no")).na.fill(0.0)
    return first.drop(drop) if drop else first


def nearest_peak(peaks: DataFrame, reference: DataFrame, tolerance: int) -> DataFrame:
    """(sample_id, scan_idx, ref_idx): the closest reference peak within a tolerance; ties to the earlier one.

    Both sides are cut into stretches of the tolerance, so the range join is an equi join on neighbouring stretches.
    """
    step = max(1, tolerance)
    r = reference.select(F.col("scan_idx").alias("ref_idx")).distinct().withColumn("_s", F.explode(F.array(*[F.expr(f"ref_idx div {step} + {d}") for d in (-1, 0, 1)])))
    j = peaks.select("sample_id", "scan_idx").withColumn("_s", F.expr(f"scan_idx div {step}")).join(r, "_s").where(F.abs(F.col("scan_idx") - F.col("ref_idx")) <= tolerance)
    return j.groupBy("sample_id", "scan_idx").agg(F.min_by("ref_idx", F.struct(F.abs(F.col("scan_idx") - F.col("ref_idx")), F.col("ref_idx"))).alias("ref_idx"))
