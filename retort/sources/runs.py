"""Reading run files into long scans, uniting data sets, and writing results."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retort.functions import labels as L


def channel_columns(columns: list[str]) -> list[str]:
    """Columns whose names are all digits: the m/z channels."""
    return [c for c in columns if c.isdigit()]


def pack_runs(lines: DataFrame, path: str, columns: list[str]) -> None:
    """Write an archive of run files, a row (path, content) for each: ``<name>.D/<name>.csv`` and its whole text, from (name, order, columns).

    A file system that keeps a folder and a file for each of very many runs costs more
    than their bytes; an archive has as many files as tasks wrote.
    """
    rows = lines.select("name", F.struct("order", F.to_csv(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("line")).alias("_l"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("_l")), lambda x: x["line"]), "\n")
    packed = rows.groupBy("name").agg(text.alias("_t"))
    packed.select(F.concat("name", F.lit(".D/"), "name", F.lit(".csv")).alias("path"), F.concat(F.lit(",".join(columns) + "\n"), "_t", F.lit("\n")).alias("content")).write.parquet(path)


def _lines(content: Column) -> Column:
    """The lines of a run's text that are not blank."""
    return F.filter(F.split(content, r"\r?\n"), lambda x: F.trim(x) != "")


def _names(header: str) -> list[str]:
    return next(csv.reader([header]))


def _packed_rows(spark: SparkSession, directory: str, row_start: int, row_end: int | None) -> tuple[DataFrame, list[str]]:
    """((sample_id, scan_idx, rt_ms, a column for each channel), the channels) of an archive of run files; a run is one row until its scans are numbered."""
    files = spark.read.parquet(directory).select("path", _lines(F.col("content")).alias("_l"))
    heads = files.agg(F.min(F.get("_l", F.lit(0))).alias("low"), F.max(F.get("_l", F.lit(0))).alias("high")).collect()[0]  # one row
    if heads.low is None:
        raise ValueError(f"no run in {directory}")
    if heads.low != heads.high:
        raise ValueError(f"headers of runs differ: {heads.low} and {heads.high}")
    names = _names(heads.low)
    mz = channel_columns(names[1:]) or names[1:2]
    cells = ", ".join(f"_c{k} string" for k in range(len(names)))
    number = lambda x, k: x[f"_c{k}"].try_cast("double")
    parsed = F.transform(F.slice("_l", F.lit(2), F.size("_l")), lambda x, k: F.struct(F.from_csv(x, cells).alias("c"), k.alias("k")))
    timed = F.transform(parsed, lambda x: F.struct(number(x["c"], 0).alias("rt_ms"), x["k"].alias("k"), *[number(x["c"], names.index(c)).alias(c) for c in mz]))
    ordered = F.array_sort(F.filter(timed, lambda x: x["rt_ms"].isNotNull()))
    kept = F.slice(ordered, F.lit(row_start + 1), F.size(ordered) if row_end is None else F.lit(max(0, row_end - row_start)))
    each = files.select(F.regexp_extract("path", r"([^/]+)\.D/[^/]+\.csv$", 1).alias("sample_id"), F.posexplode(kept).alias("scan_idx", "_r"))
    return each.select("sample_id", "scan_idx", "_r.rt_ms", *[F.col(f"_r.`{c}`").alias(c) for c in mz]), mz


def read_runs(spark: SparkSession, directory: str, row_start: int = 1, row_end: int | None = None, dataset: str | None = None, packed: bool = False) -> DataFrame:
    """Long scans of every ``<name>.D/<name>.csv`` below a directory, or in an archive of :func:`pack_runs` if ``packed``.

    Column 0 is the retention time in ms; a file of two columns is a chromatogram, kept
    as channel 0. ``row_start`` data rows are passed over. Scans are numbered in the
    order of their retention time. Rows whose time is not a number are dropped. Runs whose
    headers differ, and so their channels, raise an error.
    """
    if packed:
        kept, mz = _packed_rows(spark, directory, row_start, row_end)
    else:
        raw = spark.read.option("header", True).option("enforceSchema", False).csv(f"{directory}/*.D/*.csv").withColumn("_path", F.col("_metadata.file_path"))
        names = [c for c in raw.columns if c != "_path"]
        rt, mz = names[0], channel_columns(names[1:]) or names[1:2]
        rows = raw.select(F.regexp_extract(F.url_decode("_path"), r"([^/]+)\.D/[^/]+\.csv$", 1).alias("sample_id"), F.expr(f"try_cast(`{rt}` AS DOUBLE)").alias("rt_ms"), *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in mz]).where("rt_ms IS NOT NULL")
        k = F.row_number().over(Window.partitionBy("sample_id").orderBy("rt_ms")) - 1
        kept = rows.withColumn("_k", k).where(F.col("_k") >= row_start)
        if row_end is not None:
            kept = kept.where(F.col("_k") < row_end)
        kept = kept.withColumn("scan_idx", F.col("_k") - row_start)
    if len(mz) == 1 and not mz[0].isdigit():
        kept = kept.withColumnRenamed(mz[0], "0")
        mz = ["0"]
    long = kept.unpivot(["sample_id", "scan_idx", "rt_ms"], mz, "mz", "intensity").withColumn("mz", F.col("mz").cast("int"))
    return long if dataset is None else long.withColumn("dataset", F.lit(dataset))


def run_margins(spark: SparkSession, directory: str, packed: bool = False) -> DataFrame:
    """(rows, first, last) of the first run below a directory, or in an archive: its lines with the header, and the places of the first and last channel column.

    A file of two columns is a chromatogram, whose one channel has place 1. No row comes
    back where the first run has no channel column.
    """
    if packed:
        run = spark.read.parquet(directory).agg(F.min_by("content", "path").alias("_t")).select(_lines(F.col("_t")).alias("_l")).where("_l IS NOT NULL")
        head = run.select(F.get("_l", F.lit(0))).collect()  # the header of one run
        if not head:
            raise ValueError(f"no run in {directory}")
        columns, count = _names(head[0][0] or ""), F.max(F.size("_l")).cast("long")
    else:
        files = sorted(spark.read.option("header", True).csv(f"{directory}/*.D/*.csv").inputFiles())
        if not files:
            raise ValueError(f"no run below {directory}")
        run = spark.read.option("header", True).csv(files[0])
        columns, count = run.columns, F.count("*") + 1
    at = [1] if len(columns) == 2 else [k for k, c in enumerate(columns) if c.isdigit()]
    counted = run.agg(count.alias("rows"), F.lit(at[0] if at else None).cast("int").alias("first"), F.lit(at[-1] if at else None).cast("int").alias("last"))
    return counted.where(F.lit(bool(at)))


def centroids_to_grid(centroids: DataFrame, mz_min: int = 40, mz_max: int = 220, dense: bool = False) -> DataFrame:
    """Centroids (sample_id, scan_idx, rt_ms, mz, intensity) to unit masses: half-even rounding, sums of what meets.

    With ``dense`` each scan has a row for every mass, 0 where nothing was seen.
    """
    unit = centroids.withColumn("mz", F.rint("mz").cast("int")).where(F.col("mz").between(mz_min, mz_max)).groupBy("sample_id", "scan_idx", "mz").agg(F.first("rt_ms").alias("rt_ms"), F.sum("intensity").alias("intensity"))
    if not dense:
        return unit
    every = centroids.groupBy("sample_id", "scan_idx").agg(F.first("rt_ms").alias("rt_ms")).withColumn("mz", F.explode(F.sequence(F.lit(mz_min), F.lit(mz_max))))
    return every.join(unit.drop("rt_ms"), ["sample_id", "scan_idx", "mz"], "left").withColumn("intensity", F.coalesce("intensity", F.lit(0.0)))


def read_paired_columns(spark: SparkSession, path: str, header: str = r"^(Tr|Ab) Bois (\S+)", look: int = 100, average: bool = False) -> DataFrame:
    """(sample_id, scan_idx, rt, value) of a headerless export with Tr and Ab columns side by side; one file, as its rows are told by their order.

    The header is the first of ``look`` rows that matches. Rows empty in both columns are
    dropped. With ``average`` replicates (ids that differ in a final -n) are averaged by
    row without their nulls; else a repeated id is numbered -1, -2 and so on.
    """
    raw = spark.read.csv(path).withColumn("_row", F.monotonically_increasing_id())
    cols = [c for c in raw.columns if c != "_row"]
    cells = raw.unpivot(["_row"], cols, "col", "cell").withColumn("col", F.substring("col", 3, 9).cast("int"))
    heads = cells.where(F.col("cell").rlike(header)).where(F.col("_row") < look)
    first = heads.agg(F.min("_row").alias("_head"))
    named = heads.join(first, F.col("_row") == F.col("_head")).select("col", "_head", F.regexp_extract("cell", header, 1).alias("kind"), F.regexp_extract("cell", header, 2).alias("id"))
    named = named.withColumn("_n", F.row_number().over(Window.partitionBy("kind", "id").orderBy("col"))).withColumn("_m", F.count("*").over(Window.partitionBy("kind", "id")))
    named = named.withColumn("sample_id", F.when(F.lit(average), F.regexp_replace("id", r"-\d+$", "")).when(F.col("_m") > 1, F.concat("id", F.lit("-"), F.col("_n"))).otherwise(F.col("id")))
    body = cells.join(named, "col").where("_row > _head").withColumn("v", F.expr("try_cast(cell AS DOUBLE)"))
    pair = body.groupBy("sample_id", "id", "_n", "_row").agg(F.max(F.when(F.col("kind") == "Tr", F.col("v"))).alias("rt"), F.max(F.when(F.col("kind") == "Ab", F.col("v"))).alias("value")).where("rt IS NOT NULL OR value IS NOT NULL")
    k = F.row_number().over(Window.partitionBy("sample_id", "id", "_n").orderBy("_row")) - 1
    out = pair.withColumn("scan_idx", k)
    if average:
        return out.groupBy("sample_id", "scan_idx").agg(F.avg("rt").alias("rt"), F.avg("value").alias("value"))
    return out.select("sample_id", "scan_idx", "rt", "value")


#: Headers of exports by letter and year, with an optional letter of the replicate.
_ESTER = r"(?i)^\s*(Tr|Ab)\s*(?:Bois|Esters)\s*[_\-\s]*([A-Za-z])[_\-\s]*(\d{2,4})(?:[_\-\s]*([A-Za-z]))?\s*$"


def ester_name(header: Column) -> Column:
    """(kind, base, replicate) of a header such as ``Tr Esters V_1990-A``: Tr, V1990 and A; null where it does not parse, replicate null where there is none."""
    group = lambda k: F.regexp_extract(header, _ESTER, k)
    parsed = F.struct(F.initcap(group(1)).alias("kind"), F.concat(F.upper(group(2)), group(3)).alias("base"), F.nullif(F.upper(group(4)), F.lit("")).alias("replicate"))
    return F.when(header.rlike(_ESTER), parsed)


def read_ester_columns(spark: SparkSession, path: str, look: int = 200) -> DataFrame:
    """(sample_id, scan_idx, rt, value) of a headerless export whose headers name letter and year: replicates are averaged line by line.

    The header is the first of ``look`` lines with a cell that parses (:func:`ester_name`).
    Samples without both Tr and Ab columns are left out; cells that are no numbers do not
    count, and lines without any number of a sample are dropped from it.
    """
    raw = spark.read.csv(path).withColumn("_row", F.monotonically_increasing_id())
    cells = raw.unpivot(["_row"], [c for c in raw.columns if c != "_row"], "col", "cell").withColumn("_name", ester_name(F.col("cell")))
    heads = cells.where(F.col("_name").isNotNull() & (F.col("_row") < look))
    first = heads.agg(F.min("_row").alias("_head"))
    named = heads.join(first, F.col("_row") == F.col("_head")).select("col", "_head", "_name.kind", F.col("_name.base").alias("sample_id"))
    both = named.groupBy("sample_id").agg(F.count_distinct("kind").alias("_k")).where("_k = 2").select("sample_id")
    body = cells.drop("_name").join(named.join(both, "sample_id"), "col").where("_row > _head").withColumn("v", F.expr("try_cast(cell AS DOUBLE)"))
    mean = body.groupBy("sample_id", "_row").agg(F.avg(F.when(F.col("kind") == "Tr", F.col("v"))).alias("rt"), F.avg(F.when(F.col("kind") == "Ab", F.col("v"))).alias("value")).where("rt IS NOT NULL OR value IS NOT NULL")
    return mean.select("sample_id", (F.row_number().over(Window.partitionBy("sample_id").orderBy("_row")) - 1).alias("scan_idx"), "rt", "value")


def read_alternating_columns(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, scan_idx, rt, value): names in row 1 over pairs of (RT, TIC) columns; repeated names are numbered -1, -2."""
    raw = spark.read.csv(path).withColumn("_row", F.monotonically_increasing_id())
    cols = [c for c in raw.columns if c != "_row"]
    cells = raw.unpivot(["_row"], cols, "col", "cell").withColumn("col", F.substring("col", 3, 9).cast("int")).withColumn("pair", F.expr("col div 2"))
    first = cells.agg(F.min("_row").alias("_head"))
    names = cells.join(first, F.col("_row") == F.col("_head")).where("col % 2 = 0 AND cell IS NOT NULL").select("pair", "_head", "cell")
    n, m = F.row_number().over(Window.partitionBy("cell").orderBy("pair")), F.count("*").over(Window.partitionBy("cell"))
    names = names.withColumn("sample_id", F.when(m > 1, F.concat("cell", F.lit("-"), n)).otherwise(F.col("cell"))).drop("cell")
    body = cells.join(names, "pair").where("_row > _head").withColumn("v", F.expr("try_cast(cell AS DOUBLE)"))
    pair = body.groupBy("sample_id", "_row").agg(F.max(F.when(F.col("col") % 2 == 0, F.col("v"))).alias("rt"), F.max(F.when(F.col("col") % 2 == 1, F.col("v"))).alias("value")).where("rt IS NOT NULL")
    return pair.select("sample_id", (F.row_number().over(Window.partitionBy("sample_id").orderBy("_row")) - 1).alias("scan_idx"), "rt", "value")


def sheet_to_vectors(sheet: DataFrame, order: str, pattern: str = r"Ab \S*[_ ]?([A-Z][ _]?\d{4})") -> DataFrame:
    """(sample_id, values): columns of a sheet whose names hold AREA or match the pattern, as vectors in the order of a column."""
    import re

    cols = [c for c in sheet.columns if c != order and ("AREA" in c.upper() or re.search(pattern, c))]
    quoted = [F.col(f"`{c}`").cast("double").alias(c) for c in cols]
    long = sheet.select(F.col(order).alias("_o"), *quoted).unpivot(["_o"], cols, "name", "value")
    return long.groupBy(F.regexp_replace("name", pattern, "$1").alias("sample_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "value"))), lambda x: x.value).alias("values"))


def read_sensory(spark: SparkSession, path: str) -> DataFrame:
    """Scores per (wine, taster): the first line is passed over, a repeated header row dropped, names made lower case.

    In a folder the first file by name has the lines above the scores; the others go on
    with scores, so that an export may be written and read in parts.
    """
    files = sorted(map(unquote, spark.read.text(path).inputFiles()))
    lines = spark.read.csv(files[:1] or path).withColumn("_row", F.monotonically_increasing_id())
    found = lines.where("_row > 0").orderBy("_row").limit(1).collect()
    if not found:
        raise ValueError(f"no header row in {path}")
    head = found[0]
    names = {c: (head[c] or f"unnamed {c}").strip().lower() for c in lines.columns if c != "_row"}
    keep = [c for c in names if not names[c].startswith("unnamed")]
    every = lines.where(F.col("_row") > head["_row"]).drop("_row")
    if files[1:]:
        every = every.unionByName(spark.read.schema(every.schema).csv(files[1:]))
    body = every.where(~F.lower(F.trim(F.col(keep[0]))).eqNullSafe(names[keep[0]]))
    return body.select(*[F.col(c).alias(names[c]) for c in keep])


def read_acquisitions(spark: SparkSession, glob: str) -> DataFrame:
    """(sample_id, acquired, origin): the AcqTime of every sample_info.xml, its time zone dropped, in the order of time; runs without one come first.

    ``origin`` is the region that the first letter of the run's name stands for, or Unknown.
    """
    text = spark.read.option("wholetext", True).text(glob).withColumn("_p", F.url_decode(F.col("_metadata.file_path")))
    at = F.regexp_extract("value", r"(?s)<DisplayName>AcqTime</DisplayName>.*?<Value>\s*(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)", 1)
    found = text.select(F.regexp_extract("_p", r"([^/]+)\.D/", 1).alias("sample_id"), F.to_timestamp(F.nullif(at, F.lit("")), "yyyy-MM-dd'T'HH:mm:ss").alias("acquired"))
    return found.withColumn("origin", L.origin(F.col("sample_id"))).orderBy("acquired", "sample_id")


def join_datasets(parts: list[DataFrame]) -> DataFrame:
    """Union in the given order: a sample of several parts is stacked in time and keeps its first origin.

    Parts whose channels (column mz, if they have it) differ raise an error.
    """
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("_d", F.lit(k))
        out = p if out is None else out.unionByName(p)
    if "mz" in out.columns:
        kinds = out.groupBy("_d").agg(F.array_sort(F.collect_set("mz")).alias("_c")).agg(F.count_distinct("_c").alias("_kinds"))  # channels are few
        out = out.crossJoin(kinds).where(F.expr("_kinds <= 1 OR raise_error('data sets of different channels') IS NULL")).drop("_kinds")  # one row
    w = Window.partitionBy("sample_id")
    place = F.dense_rank().over(w.orderBy("_d", "scan_idx")) - 1
    return out.withColumn("origin", F.min("_d").over(w)).withColumn("scan_idx", place.cast("int")).drop("_d")


def check_one_kind(paths: DataFrame) -> DataFrame:
    """The paths, or an error when their wine kinds differ."""
    from retort.functions.labels import wine_kind

    kinds = paths.agg(F.count_distinct(wine_kind(F.col("path"))).alias("_n"))
    return paths.crossJoin(kinds).where(F.expr("_n <= 1 OR raise_error('data sets of several wine kinds') IS NULL")).drop("_n")  # one row


def write_results(df: DataFrame, path: str, partition: str | None = None, form: str = "parquet") -> None:
    """Write a result table as Parquet or CSV with a header, partitioned by a column if one is named."""
    writer = df.write.mode("errorifexists")
    if partition:
        writer = writer.partitionBy(partition)
    (writer.option("header", True).csv if form == "csv" else writer.parquet)(path)
