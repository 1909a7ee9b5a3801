"""An archive of run files beside the same files in folders."""

import os

import pytest
from pyspark.sql import functions as F

from retort.plans import source_queries as Q
from retort.sources import runs as R


def both(spark, tmp_path, files):
    for name, text in files.items():
        (tmp_path / "runs" / f"{name}.D").mkdir(parents=True)
        (tmp_path / "runs" / f"{name}.D" / f"{name}.csv").write_text(text)
    spark.createDataFrame([(f"{n}.D/{n}.csv", t) for n, t in files.items()], "path string, content string").write.parquet(str(tmp_path / "packed"))
    return str(tmp_path / "runs"), str(tmp_path / "packed")


def rows(frame):
    return frame.columns, sorted(map(str, frame.collect()))


def test_archive_reads_as_folders(spark, tmp_path):
    """Rows out of order, blank lines, no time, no number, quotes, a column that is no channel, one run without rows."""
    plain, packed = both(spark, tmp_path, {"B 1": 't,40,note,41\n300,3,"x,y",\n\n100,1,,5\nx,9,9,9\n200,bad,z,"7"\n', "A": "t,40,note,41\r\n5,1,a,2\r\n4,NaN,b,1\r\n", "C": "t,40,note,41\n"})
    for given in ({}, {"row_start": 0}, {"row_start": 1, "row_end": 2, "dataset": "d"}, {"row_start": 2, "row_end": 1}):
        assert rows(R.read_runs(spark, plain, **given)) == rows(R.read_runs(spark, packed, **given, packed=True))
    assert R.read_runs(spark, packed, 0, packed=True).count() == (3 + 2) * 2
    assert R.run_margins(spark, plain).collect() == R.run_margins(spark, packed, packed=True).collect()


def test_archive_of_chromatograms_and_other_channels(spark, tmp_path):
    plain, packed = both(spark, tmp_path / "a", {"A": "Ret. Time,TIC\n1,2\n2,3\n", "B": "Ret. Time,TIC\n1,4\n"})
    assert rows(R.read_runs(spark, plain, 0)) == rows(R.read_runs(spark, packed, 0, packed=True))
    assert R.run_margins(spark, plain).collect() == R.run_margins(spark, packed, packed=True).collect()
    _, packed = both(spark, tmp_path / "b", {"A": "rt,40\n1,2\n", "B": "rt,50\n1,2\n"})
    with pytest.raises(ValueError, match="headers"):
        R.read_runs(spark, packed, packed=True)


def test_files_do_not_grow_with_runs(spark, data):
    """A folder for each run made as many files and folders as suppliers."""
    path = Q._run_files(spark, data).removeprefix("file://")
    found = spark.read.parquet(path)
    assert sum(len(f) for _, _, f in os.walk(path)) <= 2 * 4 + 2
    assert found.count() == spark.read.parquet(f"{data}/lineitem.parquet").agg(F.count_distinct("l_suppkey")).collect()[0][0]
