"""Queries on signals, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from retort.operators import signals as S
from retort.session import table
from retort.sources.adapters import DSCANS, SCANS, scans
from retort.sources.shared import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under a name with its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _r(*cols: str, digits: int = 6):
    return [F.round(c, digits).alias(c) for c in cols]


TIC = f"{SCANS}, tic AS (SELECT sample_id, scan_idx, sum(intensity) AS tic FROM scans GROUP BY ALL)"


@query("tic", f"WITH {TIC} SELECT sample_id, scan_idx, round(tic, 6) AS tic FROM tic")
def _(spark, d):
    return S.tic(scans(spark, d)).select("sample_id", "scan_idx", *_r("tic"))


@query("tis", f"WITH {SCANS} SELECT sample_id, mz, round(sum(intensity), 6) AS tis FROM scans GROUP BY ALL")
def _(spark, d):
    return S.tis(scans(spark, d)).select("sample_id", "mz", *_r("tis"))


@query("tic_zscore", f"WITH {TIC}, z AS (SELECT *, avg(tic) OVER w AS m, stddev_pop(tic) OVER w AS s FROM tic WHERE scan_idx % 2 = 0 AND scan_idx // 2 >= 10 AND scan_idx // 2 < 90 WINDOW w AS (PARTITION BY sample_id)) SELECT sample_id, (scan_idx // 2)::INTEGER AS scan_idx, round(CASE WHEN s > 0 THEN (tic - m) / s ELSE 0 END, 6) AS tic FROM z")
def _(spark, d):
    """Decimated, cropped and standardised chromatograms."""
    cut = S.crop(S.decimate(scans(spark, d), 2), 20, 180, n=2)
    return S.standardise(S.tic(cut), "tic", "sample_id").select("sample_id", "scan_idx", *_r("tic"))


@query("decimate_crop_cap", f"WITH {SCANS} SELECT sample_id, (scan_idx // 4)::INTEGER AS scan_idx, mz, intensity FROM scans WHERE scan_idx % 4 = 0 AND scan_idx // 4 >= 5 AND scan_idx // 4 < 30")
def _(spark, d):
    return S.cap(S.crop(S.decimate(scans(spark, d), 4), 5, 40, unit="decimated"), 30).select("sample_id", "scan_idx", "mz", "intensity")


@query("truncate_common", f"WITH {DSCANS}, e AS (SELECT sample_id, dataset, max(scan_idx) AS m FROM dscans GROUP BY ALL), x AS (SELECT min(m) AS m FROM (SELECT sample_id, max(m) AS m FROM e GROUP BY 1)) SELECT dataset, sample_id, scan_idx, mz, intensity FROM dscans, x WHERE scan_idx <= x.m")
def _(spark, d):
    return S.truncate_common(scans(spark, d, True)).select("dataset", "sample_id", "scan_idx", "mz", "intensity")


@query("keep_samples", f"WITH {SCANS} SELECT sample_id, scan_idx, mz, intensity FROM scans WHERE sample_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) AND left(sample_id::VARCHAR, 1) IN ('1', '2')")
def _(spark, d):
    keys = table(spark, d, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("sample_id"))
    return S.keep_first_letters(S.keep_keys(scans(spark, d), keys), "12").select("sample_id", "scan_idx", "mz", "intensity")


@query("drop_dead_channels", f"WITH {SCANS}, z AS (SELECT * REPLACE (CASE WHEN mz = 47 THEN 0 ELSE intensity END AS intensity) FROM scans), v AS (SELECT mz FROM z GROUP BY mz HAVING var_pop(intensity) > 1e-8) SELECT sample_id, scan_idx, mz, intensity FROM z WHERE mz IN (SELECT mz FROM v)")
def _(spark, d):
    z = scans(spark, d).withColumn("intensity", F.when(F.col("mz") == 47, 0.0).otherwise(F.col("intensity")))
    return S.drop_dead_channels(z).select("sample_id", "scan_idx", "mz", "intensity")


@query("valid_rows", "SELECT event_id, value FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND event_type IS NOT NULL")
def _(spark, d):
    return S.valid_rows(table(spark, d, "events").where("event_type IS NOT NULL"), "value").select("event_id", "value")


@query("filter_singletons", "WITH n AS (SELECT p_partkey, p_brand || p_size::VARCHAR AS k, p_type FROM part), c AS (SELECT k FROM n GROUP BY 1 HAVING count(DISTINCT p_type) >= 2) SELECT p_partkey, k FROM n WHERE k IN (SELECT k FROM c)")
def _(spark, d):
    n = table(spark, d, "part").select("p_partkey", F.concat("p_brand", F.col("p_size").cast("string")).alias("k"), "p_type")
    return S.filter_singletons(n, "k", "p_type").select("p_partkey", "k")


_E7, _E3 = S.linspace_edges(200, 7), S.linspace_edges(7, 3)
CUBES = f"{SCANS}, cubes AS (SELECT *, (len(list_filter({_E7}, lambda e: e <= scan_idx)) - 1)::INTEGER AS rt_bin, (len(list_filter({_E3}, lambda e: e <= mz - 41)) - 1)::INTEGER AS mz_bin FROM scans)"


def cubes(spark, d):
    return S.with_cubes(scans(spark, d), 200, 7, 41, 7, 3)


@query("cube_sums", f"WITH {CUBES} SELECT sample_id, rt_bin, mz_bin, sum(intensity) AS total FROM cubes WHERE rt_bin NOT IN (2, 5) GROUP BY ALL")
def _(spark, d):
    return S.remove_bins(cubes(spark, d), [2, 5]).groupBy("sample_id", "rt_bin", "mz_bin").agg(F.sum("intensity").alias("total"))


for _mode, _test in (("remove", ""), ("add", "NOT ")):

    @query(f"cube_mask_{_mode}", f"WITH {CUBES} SELECT sample_id, scan_idx, mz, CASE WHEN {_test}((rt_bin = 1 AND mz_bin = 0) OR (rt_bin = 3 AND mz_bin = 2)) THEN 0 ELSE intensity END AS intensity FROM cubes")
    def _(spark, d, mode=_mode):
        listed = spark.createDataFrame([(1, 0), (3, 2)], "rt_bin int, mz_bin int")
        return S.cube_mask(cubes(spark, d), listed, mode).select("sample_id", "scan_idx", "mz", "intensity")


@query("window_index", f"WITH {SCANS}, a AS (SELECT DISTINCT scan_idx, rt_ms FROM scans), s AS (SELECT p_partkey AS name, p_retailprice * 12 AS at_ms FROM part), m AS (SELECT max(scan_idx) + 1 AS e FROM scans) SELECT name, coalesce(min(scan_idx), any_value(e))::INTEGER AS idx FROM s LEFT JOIN a ON rt_ms >= at_ms CROSS JOIN m GROUP BY name")
def _(spark, d):
    starts = table(spark, d, "part").select(F.col("p_partkey").alias("name"), (F.col("p_retailprice") * 12).alias("at_ms"))
    return S.window_index(scans(spark, d), starts).select("name", F.col("idx").cast("int").alias("idx"))


@query("pad_truncate_resample", "WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT vec_id, list_concat(v[1:70], list_transform(range(0, greatest(0, 70 - len(v))), lambda x: 0.0)) AS v FROM a), i AS (SELECT vec_id, v, unnest(range(0, 40)) AS k FROM p), x AS (SELECT vec_id, k, v, k * 69 / 39.0 AS x FROM i), l AS (SELECT *, least(floor(x)::INTEGER, 68) AS lo FROM x) SELECT vec_id, k::INTEGER AS pos, round(v[lo + 1] + (v[lo + 2] - v[lo + 1]) * (x - lo), 6) AS value FROM l")
def _(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", S.pad_or_truncate(F.transform("embedding", lambda x: x.cast("double")), 70).alias("v"))
    return v.select("vec_id", F.posexplode(S.resample_linear(F.col("v"), 40)).alias("pos", "value")).withColumn("value", F.round("value", 6))


@query("remove_peak", "WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), i AS (SELECT vec_id, v, unnest(range(0, 64)) AS k FROM a) SELECT vec_id, k::INTEGER AS pos, round(CASE WHEN k BETWEEN 57 AND 63 THEN v[58] + (v[64] - v[58]) * (k - 57) / 6.0 ELSE v[k + 1] END, 6) AS value FROM i")
def _(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return v.select("vec_id", F.posexplode(S.remove_peak(F.col("v"), 61, 4)).alias("pos", "value")).withColumn("value", F.round("value", 6))


_K = S.gaussian_kernel(1.5)


@query("gaussian_smooth", f"WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), i AS (SELECT vec_id, v, unnest(range(0, 64)) AS k FROM a), j AS (SELECT vec_id, k, v, unnest(range(0, {len(_K)})) AS t, unnest({_K}) AS w FROM i), f AS (SELECT *, (((k + t - {len(_K) // 2}) % 128) + 128) % 128 AS q FROM j) SELECT vec_id, k::INTEGER AS pos, round(sum(w * v[(CASE WHEN q < 64 THEN q ELSE 127 - q END) + 1]), 5) AS value FROM f GROUP BY ALL")
def _(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return v.select("vec_id", F.posexplode(S.smooth(F.col("v"), 1.5)).alias("pos", "value")).withColumn("value", F.round("value", 5))


@query("scale_range", f"WITH {TIC} SELECT sample_id, scan_idx, round(CASE WHEN max(tic) OVER w > min(tic) OVER w THEN -1 + (tic - min(tic) OVER w) / (max(tic) OVER w - min(tic) OVER w) * 2 ELSE -1 END, 6) AS tic FROM tic WINDOW w AS (PARTITION BY sample_id)")
def _(spark, d):
    return S.scale_range(S.tic(scans(spark, d)), "tic", "sample_id", low=-1.0, high=1.0).select("sample_id", "scan_idx", *_r("tic"))


@query("channel_standardise", f"WITH {SCANS} SELECT sample_id, scan_idx, mz, round(CASE WHEN stddev_pop(intensity) OVER w > 0 THEN (intensity - avg(intensity) OVER w) / stddev_pop(intensity) OVER w ELSE 0 END, 5) AS intensity FROM scans WINDOW w AS (PARTITION BY sample_id, mz)")
def _(spark, d):
    return S.standardise(scans(spark, d), "intensity", "sample_id", "mz").select("sample_id", "scan_idx", "mz", *_r("intensity", digits=5))


@query("emphasise_peaks", f"WITH {TIC} SELECT sample_id, scan_idx, round(pow(tic, 1.5), 4) AS tic FROM tic")
def _(spark, d):
    return S.emphasised(S.tic(scans(spark, d))).select("sample_id", "scan_idx", F.round("tic", 4).alias("tic"))


@query("merge_renamed", "WITH a AS (SELECT c_custkey::VARCHAR AS sample_id, c_acctbal AS v FROM customer), b AS (SELECT p_partkey::VARCHAR AS sample_id, p_retailprice AS v FROM part) SELECT * FROM a UNION ALL SELECT CASE WHEN sample_id IN (SELECT sample_id FROM a) THEN sample_id || 'b' ELSE sample_id END, v FROM b")
def _(spark, d):
    """Two sources whose names overlap in part."""
    a = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"), F.col("c_acctbal").alias("v"))
    b = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("sample_id"), F.col("p_retailprice").alias("v"))
    return S.merge_renamed(a, b)


@query("concat_lists", "WITH a AS (SELECT n_regionkey AS k, list(n_nationkey ORDER BY n_nationkey) AS v FROM nation GROUP BY 1), b AS (SELECT s_nationkey AS k, list(s_suppkey ORDER BY s_suppkey) AS v FROM supplier GROUP BY 1), j AS (SELECT coalesce(a.k, b.k) AS k, list_concat(coalesce(a.v, []), coalesce(b.v, [])) AS v FROM a FULL JOIN b USING (k)) SELECT k, array_to_string(v, ',') AS v FROM j")
def _(spark, d):
    part = lambda t, k, v: table(spark, d, t).groupBy(F.col(k).cast("long").alias("k")).agg(F.array_sort(F.collect_list(F.col(v).cast("long"))).alias("v"))
    both = S.concat_lists(part("nation", "n_regionkey", "n_nationkey"), part("supplier", "s_nationkey", "s_suppkey"), "k", "v")
    return both.select("k", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("v"))


@query("wide_samples", f'WITH {SCANS} SELECT scan_idx, sum(intensity) FILTER (sample_id = 1) AS "1", sum(intensity) FILTER (sample_id = 2) AS "2", sum(intensity) FILTER (sample_id = 3) AS "3" FROM scans WHERE sample_id IN (1, 2, 3) GROUP BY 1')
def _(spark, d):
    return S.wide(scans(spark, d).where("sample_id IN (1, 2, 3)"), [1, 2, 3])


@query("feature_assembly", f"WITH {TIC}, f AS (SELECT sample_id, 0 AS part, scan_idx AS a, tic AS v FROM tic UNION ALL SELECT sample_id, 1, mz, sum(intensity) FROM scans GROUP BY 1, mz), p AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY part, a) - 1 AS pos FROM f) SELECT sample_id, pos::INTEGER AS pos, v AS value FROM p")
def _(spark, d):
    v = S.feature_vectors(scans(spark, d), "tic_tis")
    return v.select("sample_id", F.posexplode("features").alias("pos", "value"))


@query("feature_concatenated", f"WITH {SCANS} SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY mz, scan_idx) - 1)::INTEGER AS pos, intensity AS value FROM scans")
def _(spark, d):
    return S.feature_vectors(scans(spark, d), "concatenated").select("sample_id", F.posexplode("features").alias("pos", "value"))


for _how, _agg in (("mean", "avg"), ("max", "max"), ("median", "median")):

    @query(f"aggregate_windows_{_how}", f"WITH {SCANS} SELECT sample_id, (scan_idx // 30)::INTEGER AS win, mz, round({_agg}(intensity), 6) AS value FROM scans WHERE scan_idx < 180 GROUP BY ALL")
    def _(spark, d, how=_how):
        return S.aggregate_windows(scans(spark, d), 30, 200, how).select("sample_id", F.col("window").alias("win"), "mz", *_r("value"))


@query("bin_max", f"WITH {SCANS} SELECT sample_id, (scan_idx // 22)::INTEGER AS bin, mz, max(intensity) AS value FROM scans WHERE scan_idx < 198 GROUP BY ALL")
def _(spark, d):
    return S.bin_max(scans(spark, d), 9, 200)


@query("bin_middle", f"WITH {SCANS} SELECT sample_id, (scan_idx // 22)::INTEGER AS bin, mz, intensity AS value FROM scans WHERE scan_idx < 198 AND scan_idx % 22 = 11")
def _(spark, d):
    return S.bin_middle(scans(spark, d), 9, 200)


for _how, _agg in (("sum", "sum"), ("mean", "avg")):

    @query(f"group_channels_{_how}", f"WITH {SCANS} SELECT sample_id, scan_idx, least((mz - 41) // 3, 1)::INTEGER AS mz_group, round({_agg}(intensity), 6) AS intensity FROM scans GROUP BY ALL")
    def _(spark, d, how=_how):
        return S.group_channels(scans(spark, d), 3, 41, 7, how).select("sample_id", "scan_idx", "mz_group", *_r("intensity"))


@query("bin_means", f"WITH {TIC}, w AS (SELECT scan_idx AS pos, avg(tic) AS value FROM tic GROUP BY 1) SELECT (pos // 15)::INTEGER AS bin, round(avg(value), 6) AS value FROM w GROUP BY 1")
def _(spark, d):
    w = S.mean_chromatogram(S.tic(scans(spark, d))).select(F.col("scan_idx").alias("pos"), F.col("mean_tic").alias("value"))
    return S.bin_means(w, 15).select("bin", *_r("value"))


@query("channel_snr", f"WITH {SCANS} SELECT mz, round(avg(intensity) / (stddev_pop(intensity) + 1e-10), 6) AS snr FROM scans GROUP BY mz")
def _(spark, d):
    return S.channel_snr(scans(spark, d)).select("mz", *_r("snr"))


MEAN = f"{TIC}, m AS (SELECT scan_idx, avg(tic) AS mean_tic FROM tic GROUP BY 1), c AS (SELECT sample_id, corr(tic, mean_tic) AS r, sqrt(sum(pow(tic - mean_tic, 2))) AS distance FROM tic JOIN m USING (scan_idx) GROUP BY 1)"


@query("closeness_to_mean", f"WITH {MEAN} SELECT sample_id, round(r, 6) AS r, round(distance, 4) AS distance FROM c")
def _(spark, d):
    return S.closeness_to_mean(S.tic(scans(spark, d))).select("sample_id", F.round("r", 6).alias("r"), F.round("distance", 4).alias("distance"))


@query("closest_to_mean", f"WITH {MEAN} SELECT sample_id, round(r, 6) AS r FROM c WHERE r > -1 ORDER BY c.r DESC, sample_id LIMIT 1")
def _(spark, d):
    return S.closest_to_mean(S.tic(scans(spark, d))).select("sample_id", *_r("r"))


@query("medoid", f"WITH {MEAN}, b AS (SELECT sample_id FROM c ORDER BY distance, sample_id LIMIT 1), s AS (SELECT scan_idx, avg(tic) AS m, stddev_pop(tic) AS s FROM tic GROUP BY 1) SELECT sample_id, scan_idx, round((tic - s.m) / CASE WHEN s.s > 0 THEN s.s ELSE 1 END, 5) AS z FROM tic JOIN b USING (sample_id) JOIN s USING (scan_idx)")
def _(spark, d):
    return S.medoid(S.tic(scans(spark, d))).select("sample_id", "scan_idx", *_r("z", digits=5))


@query("overlapping_windows", f"WITH {TIC}, w AS (SELECT unnest(range(0, 8))::INTEGER AS win) SELECT sample_id, win, sum(tic) AS total, count(*) AS n FROM tic JOIN w ON scan_idx >= win * 20 AND scan_idx < win * 20 + 50 GROUP BY ALL")
def _(spark, d):
    w = S.overlapping_windows(S.tic(scans(spark, d)), 50, 20, 200)
    return w.groupBy("sample_id", F.col("window").alias("win")).agg(F.sum("tic").alias("total"), F.count("*").alias("n"))


@query("tiles", f"WITH {SCANS}, r AS (SELECT unnest(range(0, 4))::INTEGER AS r), c AS (SELECT unnest(range(0, 3))::INTEGER AS c) SELECT sample_id, r AS row_no, c AS col_no, sum(intensity) AS total FROM scans JOIN r ON scan_idx >= r * 40 AND scan_idx < r * 40 + 60 JOIN c ON mz - 41 >= c * 2 AND mz - 41 < c * 2 + 3 GROUP BY ALL")
def _(spark, d):
    t = S.tiles(scans(spark, d), 60, 3, 40, 2, 200, 41, 7)
    return t.groupBy("sample_id", F.col("row").alias("row_no"), F.col("col").alias("col_no")).agg(F.sum("intensity").alias("total"))


PEAKS = f"{TIC}, n AS (SELECT *, CASE WHEN tic = lag(tic) OVER w THEN 0 ELSE 1 END AS new FROM tic WINDOW w AS (PARTITION BY sample_id ORDER BY scan_idx)), g AS (SELECT *, sum(new) OVER (PARTITION BY sample_id ORDER BY scan_idx) AS run FROM n), l AS (SELECT sample_id, run, first(tic) AS tic, min(scan_idx) AS a, max(scan_idx) AS b FROM g GROUP BY 1, 2), q AS (SELECT *, lag(tic) OVER w AS p, lead(tic) OVER w AS x FROM l WINDOW w AS (PARTITION BY sample_id ORDER BY run)), peaks AS (SELECT sample_id, ((a + b) // 2)::INTEGER AS scan_idx, tic FROM q WHERE p < tic AND x < tic)"


@query("local_maxima", f"WITH {PEAKS} SELECT * FROM peaks")
def _(spark, d):
    return S.local_maxima(S.tic(scans(spark, d)))


@query("tallest_per_segment", f"WITH {PEAKS}, s AS (SELECT *, least(scan_idx // 28, 6)::INTEGER AS segment FROM peaks), k AS (SELECT *, row_number() OVER (PARTITION BY sample_id, segment ORDER BY tic DESC, scan_idx) AS k FROM s) SELECT sample_id, segment, scan_idx, tic FROM k WHERE k = 2")
def _(spark, d):
    return S.tallest_per_segment(S.local_maxima(S.tic(scans(spark, d))), 200, 7, order=1).select("sample_id", "segment", "scan_idx", "tic")


@query("peak_prominences", f"WITH {PEAKS}, b AS (SELECT p.sample_id, p.scan_idx, p.tic, coalesce(max(t.scan_idx) FILTER (t.scan_idx < p.scan_idx AND t.tic > p.tic), -1) AS lo, coalesce(min(t.scan_idx) FILTER (t.scan_idx > p.scan_idx AND t.tic > p.tic), 1000) AS hi FROM peaks p JOIN tic t USING (sample_id) GROUP BY ALL HAVING bool_or(t.scan_idx = p.scan_idx)), h AS (SELECT b.sample_id, b.scan_idx, b.tic, min(t.tic) FILTER (t.scan_idx > lo AND t.scan_idx <= b.scan_idx) AS x, min(t.tic) FILTER (t.scan_idx >= b.scan_idx AND t.scan_idx < hi) AS y FROM b JOIN tic t USING (sample_id) GROUP BY ALL) SELECT sample_id, scan_idx, tic, tic - greatest(x, y) AS prominence FROM h")
def _(spark, d):
    return S.peak_prominences(S.tic(scans(spark, d)))


@query("join_datasets", "WITH u AS (SELECT 0 AS d, c_custkey AS sample_id, o_totalprice AS v, o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' UNION ALL SELECT 1, c_custkey, o_totalprice, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F') SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY d, k) - 1)::INTEGER AS scan_idx, first_value(d) OVER (PARTITION BY sample_id ORDER BY d, k)::INTEGER AS origin, v FROM u")
def _(spark, d):
    """Union of two data sets: a sample in both is stacked in time and keeps its first origin."""
    from retort.sources.runs import join_datasets

    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    base = o.join(c, o.o_custkey == c.c_custkey)
    part = lambda s: base.where(F.col("o_orderstatus") == s).select(F.col("c_custkey").alias("sample_id"), F.col("o_orderkey").alias("scan_idx"), F.col("o_totalprice").alias("v"))
    return join_datasets([part("O"), part("F")]).select("sample_id", "scan_idx", "origin", "v")


WITH_MEAN = PEAKS.replace(TIC, TIC.replace("tic AS", "own AS") + ", tic AS (SELECT * FROM own UNION ALL SELECT -1, scan_idx, avg(tic) FROM own GROUP BY scan_idx)")
PROMINENCES = "b AS (SELECT p.sample_id, p.scan_idx, p.tic, coalesce(max(t.scan_idx) FILTER (t.scan_idx < p.scan_idx AND t.tic > p.tic), -1) AS lo, coalesce(min(t.scan_idx) FILTER (t.scan_idx > p.scan_idx AND t.tic > p.tic), 1000) AS hi FROM peaks p JOIN tic t USING (sample_id) GROUP BY ALL HAVING bool_or(t.scan_idx = p.scan_idx)), h AS (SELECT b.sample_id, b.scan_idx, b.tic, min(t.tic) FILTER (t.scan_idx > lo AND t.scan_idx <= b.scan_idx) AS x, min(t.tic) FILTER (t.scan_idx >= b.scan_idx AND t.scan_idx < hi) AS y FROM b JOIN tic t USING (sample_id) GROUP BY ALL), prominences AS (SELECT sample_id, scan_idx, (tic - greatest(x, y))::DOUBLE AS prominence FROM h)"


@query("weighted_peak_distance", f"WITH {WITH_MEAN}, {PROMINENCES}, near AS (SELECT p.sample_id, p.scan_idx, p.prominence AS u, r.prominence AS v, abs(p.scan_idx - r.scan_idx) AS d, row_number() OVER (PARTITION BY p.sample_id, p.scan_idx ORDER BY abs(p.scan_idx - r.scan_idx), r.scan_idx) AS k FROM prominences p JOIN prominences r ON r.sample_id = -1 AND p.sample_id <> -1) SELECT sample_id, round(sum(least(u, v) / greatest(u, v) * d) / sum(least(u, v) / greatest(u, v)), 6) AS distance, count(*) AS n FROM near WHERE k = 1 GROUP BY 1")
def _(spark, d):
    """Peaks of each sample against those of the mean chromatogram."""
    tics = stored(S.tic(scans(spark, d)), "tics")
    mean = tics.groupBy("scan_idx").agg(F.avg("tic").alias("tic")).select(F.lit(-1).cast("long").alias("sample_id"), "scan_idx", "tic")
    out = S.weighted_peak_distance(stored(S.peak_prominences(tics).select("sample_id", "scan_idx", "prominence"), "prominences"), S.peak_prominences(mean))
    return out.select("sample_id", *_r("distance"), "n")
