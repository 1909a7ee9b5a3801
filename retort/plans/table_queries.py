"""Queries on labels, joins, compounds, splits, metrics and statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from retort.functions import labels as L
from retort.operators import compounds as C
from retort.operators import metrics as M
from retort.operators import scaling as Z
from retort.operators import signals as S
from retort.operators import splits as P
from retort.operators import statistics as T
from retort.plans.signal_queries import PEAKS, TIC
from retort.session import table
from retort.sources import runs as R
from retort.sources.adapters import FEATURES, PREDICTIONS, SCANS, SENSORY, features, predictions, scans, sensory
from retort.sources.shared import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Sample names made of the given tables: a winery letter, two or four digits, a replicate.
def names(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(F.substring(F.lit("DEQPRZCKWYMNJLHUX"), F.col("p_partkey").cast("int") % 17 + 1, 1), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit("-"), (F.col("p_size") % 3 + 1).cast("string")).alias("name"))


NAMES = "names AS (SELECT p_partkey, substr('DEQPRZCKWYMNJLHUX', (p_partkey % 17)::INTEGER + 1, 1) || lpad((p_partkey % 100)::VARCHAR, 2, '0') || '-' || (p_size % 3 + 1)::VARCHAR AS name FROM part)"


def _case(groups: dict[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN contains('{letters}', left(name, 1)) THEN '{g}'" for g, letters in groups.items()) + f" ELSE {other} END"


@query("winery_labels", f"WITH {NAMES} SELECT p_partkey, left(name, 1) AS winery, {_case(L.COUNTRIES, 'NULL')} AS country, {_case(L.CONTINENTS, 'NULL')} AS continent, {_case(L.ORIGINS, chr(39) + 'Unknown' + chr(39))} AS origin, {_case(L.ESTATES, 'left(name, 1)')} AS estate, CASE WHEN contains('DEQ', left(name, 1)) THEN 'Burgundy_North' WHEN contains('PRZ', left(name, 1)) THEN 'Burgundy_South' ELSE {_case(L.ORIGINS, chr(39) + 'Unknown' + chr(39))} END AS split_origin, regexp_replace(name, '-[^-]*$', '') AS base_id, CASE WHEN substr(name, 2, 2)::INTEGER > 50 THEN 1900 + substr(name, 2, 2)::INTEGER ELSE 2000 + substr(name, 2, 2)::INTEGER END AS vintage, right(name, 2) AS suffix FROM names")
def _(spark, d):
    n = F.col("name")
    return names(spark, d).select("p_partkey", L.letter(n).alias("winery"), L.country(n).alias("country"), L.continent(n).alias("continent"), L.origin(n).alias("origin"), L.estate(n).alias("estate"), L.origin(n, True).alias("split_origin"), L.base_id(n).alias("base_id"), L.full_vintage(n).alias("vintage"), L.year_suffix(n).alias("suffix"))


@query("burgundy_sides", f"WITH {NAMES} SELECT p_partkey, CASE WHEN contains('QRZ', left(name, 1)) THEN 'NB' ELSE 'SB' END AS side FROM names WHERE contains('DEQPRZ', left(name, 1))")
def _(spark, d):
    return S.keep_first_letters(names(spark, d), "DEQPRZ", "name").select("p_partkey", L.burgundy_side(F.col("name")).alias("side"))


@query("press_labels", "WITH n AS (SELECT p_partkey, 'Est' || lpad((p_partkey % 40)::VARCHAR, 2, '0') || 'CS' || substr('ABCD', (p_size % 4)::INTEGER + 1, 1) || (p_partkey % 12)::VARCHAR || '-' || (p_size % 3)::VARCHAR AS s FROM part) SELECT p_partkey, CASE WHEN substr(s, 4, 2)::INTEGER >= 20 THEN 2000 + substr(s, 4, 2)::INTEGER ELSE 1900 + substr(s, 4, 2)::INTEGER END AS year, nullif(regexp_extract(s, '([ABC])[0-9]', 1), '') AS class, nullif(regexp_extract(s, '[A-C][0-9]+'), '') AS composite FROM n")
def _(spark, d):
    s = F.concat(F.lit("Est"), F.lpad((F.col("p_partkey") % 40).cast("string"), 2, "0"), F.lit("CS"), F.substring(F.lit("ABCD"), F.col("p_size") % 4 + 1, 1), (F.col("p_partkey") % 12).cast("string"), F.lit("-"), (F.col("p_size") % 3).cast("string"))
    n = table(spark, d, "part").select("p_partkey", s.alias("s"))
    return n.select("p_partkey", L.press_year(F.col("s")).alias("year"), L.press_class(F.col("s")).alias("class"), L.press_composite(F.col("s")).alias("composite"))


@query("bordeaux_labels", "WITH n AS (SELECT o_orderkey, substr('ABC', (o_orderkey % 3)::INTEGER + 1, 1) || CASE WHEN o_orderkey % 5 = 0 THEN '_' ELSE '' END || CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE year(o_orderdate)::VARCHAR END || 'B' AS s FROM orders) SELECT o_orderkey, nullif(regexp_extract(s, '.[0-9]{4}'), '') AS label, nullif(regexp_extract(s, '[0-9]{4}'), '') AS year, nullif(regexp_extract(s, '^[^0-9]*?([^0-9])_?[0-9]', 1), '') AS chateau, nullif(regexp_extract(s, '[0-9].*$'), '') AS tail, regexp_extract(s, '^[A-Za-z]+') AS prefix FROM n")
def _(spark, d):
    o = table(spark, d, "orders")
    s = F.concat(F.substring(F.lit("ABC"), (F.col("o_orderkey") % 3 + 1).cast("int"), 1), F.when(F.col("o_orderkey") % 5 == 0, "_").otherwise(""), F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.year("o_orderdate").cast("string")), F.lit("B"))
    n = o.select("o_orderkey", s.alias("s"))
    c = F.col("s")
    return n.select("o_orderkey", L.bordeaux_label(c).alias("label"), L.bordeaux_label(c, True).alias("year"), L.chateau_letter(c).alias("chateau"), L.from_first_digit(c).alias("tail"), L.alphabetic_prefix(c).alias("prefix"))


@query("split_labels", "SELECT o_orderkey, o_clerk AS by_name, nullif(regexp_extract(o_clerk, '.[0-9]{4}'), '') AS by_year, left(o_clerk, 1) AS press, nullif(regexp_extract(o_clerk, '[0-9]{4}'), '') AS bordeaux_year, o_clerk AS pinot FROM (SELECT o_orderkey, substr('ABC', (o_orderkey % 3)::INTEGER + 1, 1) || CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE year(o_orderdate)::VARCHAR END || '-1' AS o_clerk FROM orders)")
def _(spark, d):
    """Labels by which names are split, by name or year, and by the kind of wine."""
    name = F.concat(F.substring(F.lit("ABC"), (F.col("o_orderkey") % 3 + 1).cast("int"), 1), F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.year("o_orderdate").cast("string")), F.lit("-1"))
    n = table(spark, d, "orders").select("o_orderkey", name.alias("s"))
    kinds = {"press": ("press_wines", False), "bordeaux_year": ("bordeaux", True), "pinot": ("pinot_noir", False)}
    return n.select("o_orderkey", L.bordeaux_split_label(F.col("s")).alias("by_name"), L.bordeaux_split_label(F.col("s"), True).alias("by_year"), *[L.strategy_label(F.col("s"), k, y).alias(c) for c, (k, y) in kinds.items()])


@query("name_functions", "SELECT doc_id, regexp_replace(text, '[^a-zA-Z0-9_\\-.()+]', '_', 'g') AS safe, CASE WHEN source = 'src1' THEN 'bordeaux' WHEN source = 'src2' THEN 'pinot_noir' END AS kind, CASE WHEN regexp_matches(source, '[0-9]') THEN length(regexp_extract(source, '^[^0-9]*'))::INTEGER ELSE -1 END AS first_at, CASE WHEN regexp_matches(source, '[0-9]') THEN 3 ELSE -1 END AS last_at FROM documents")
def _(spark, d):
    t = table(spark, d, "documents")
    path = F.concat(F.lit("/data/"), F.when(F.col("source") == "src1", "Bordeaux").when(F.col("source") == "src2", "PINOT_NOIR").otherwise("x"))
    return t.select("doc_id", L.safe_file_name(F.col("text")).alias("safe"), L.wine_kind(path).alias("kind"), L.first_number_at(F.col("source")).alias("first_at"), L.last_number_at(F.col("source")).alias("last_at"))


@query("age_bins", "WITH r AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part WHERE p_size < 25) SELECT p_partkey, (p_size >= 0)::INTEGER + (p_size >= 5)::INTEGER + (p_size >= 10)::INTEGER + (p_size >= 15)::INTEGER + (p_size >= 20)::INTEGER + (p_size >= 25)::INTEGER + (p_size >= 30)::INTEGER AS age_bin, least(greatest(floor((p_retailprice - a) / (b - a) * 8), 0), 7)::INTEGER AS price_bin FROM part, r")
def _(spark, d):
    p = table(spark, d, "part")
    r = p.where("p_size < 25").agg(F.min("p_retailprice").alias("a"), F.max("p_retailprice").alias("b"))
    return p.crossJoin(r).select("p_partkey", L.age_bin(F.col("p_size"), list(range(0, 31, 5))).alias("age_bin"), L.equal_width_bin(F.col("p_retailprice"), F.col("a"), F.col("b"), 8).alias("price_bin"))


@query("unit_norm", f"WITH {FEATURES} SELECT sample_id, pos, round(value / CASE WHEN sqrt(sum(value * value) OVER w) > 0 THEN sqrt(sum(value * value) OVER w) ELSE 1 END, 5) AS value FROM features WINDOW w AS (PARTITION BY sample_id)")
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), L.unit_norm(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    return v.select("sample_id", F.posexplode("v").alias("pos", "value")).withColumn("value", F.round("value", 5))


for _by, _pick in ((5, "greatest(pos - 5, 0)"), (-7, "least(pos + 7, 63)")):

    @query(f"shift_edge_{'right' if _by > 0 else 'left'}", f"WITH {FEATURES} SELECT a.sample_id, a.pos, round(b.value, 6) AS value FROM (SELECT sample_id, pos, {_pick} AS q FROM features) a JOIN features b ON a.sample_id = b.sample_id AND a.q = b.pos")
    def _(spark, d, by=_by):
        v = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), L.shift_edge_fill(F.transform("embedding", lambda x: x.cast("double")), by).alias("v"))
        return v.select("sample_id", F.posexplode("v").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query("shift_scans", f"WITH {TIC}, a AS (SELECT DISTINCT sample_id, scan_idx FROM tic) SELECT a.sample_id, a.scan_idx, coalesce(t.tic, 0) AS tic FROM a LEFT JOIN tic t ON t.sample_id = a.sample_id AND t.scan_idx = a.scan_idx - 3")
def _(spark, d):
    """Signals moved by three scans, zeros where nothing came from."""
    return S.shifted_scans(S.tic(scans(spark, d)), 3)


@query("natural_order", "SELECT source, (row_number() OVER (ORDER BY regexp_replace(source, '[0-9]+', ''), coalesce(try_cast(regexp_extract(source, '[0-9]+') AS BIGINT), -1)))::INTEGER AS place FROM (SELECT DISTINCT source FROM documents)")
def _(spark, d):
    s = table(spark, d, "documents").select("source").distinct()
    return s.withColumn("place", F.row_number().over(Window.orderBy(L.natural_key(F.col("source")))))


@query("custom_order", "SELECT o_orderpriority, (row_number() OVER (ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_orderpriority))::INTEGER AS place FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def _(spark, d):
    s = table(spark, d, "orders").select("o_orderpriority").distinct()
    return s.withColumn("place", F.row_number().over(Window.orderBy(L.class_rank(F.col("o_orderpriority"), ["3-MEDIUM", "1-URGENT"]))))


# Joins and set operations


@query("labels_to_scores", f"WITH {SENSORY}, l AS (SELECT DISTINCT wine, taster, length(wine) AS label FROM sensory) SELECT s.o_orderkey, s.wine, s.taster, l.label::INTEGER AS label FROM sensory s JOIN l USING (wine, taster)")
def _(spark, d):
    s = sensory(spark, d)
    lab = s.select("wine", "taster", F.length("wine").alias("label")).dropDuplicates(["wine", "taster"])
    return s.join(lab, ["wine", "taster"]).select("o_orderkey", "wine", "taster", "label")


@query("prefix_join", "SELECT s.s_suppkey AS wine, p.p_partkey AS run FROM supplier s JOIN part p ON starts_with(p.p_partkey::VARCHAR, s.s_suppkey::VARCHAR)")
def _(spark, d):
    """Runs whose id begins with a wine's code."""
    wines = table(spark, d, "supplier").select(F.col("s_suppkey").alias("wine"))
    return S.prefix_matches(wines, table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"))).withColumnRenamed("sample_id", "run")


#: Nations' keys as wines: a supplier belongs to each whose key begins its number.
_WINES = "wines AS (SELECT DISTINCT n_nationkey::VARCHAR AS wine FROM nation)"


@query("replicate_average", f"WITH {SCANS}, {_WINES} SELECT w.wine, s.scan_idx, s.mz, round(avg(CASE WHEN scan_idx % 97 = 0 THEN 'nan'::DOUBLE ELSE intensity END), 6) AS value FROM wines w JOIN scans s ON starts_with(s.sample_id::VARCHAR, w.wine) WHERE scan_idx % 97 <> 0 GROUP BY ALL UNION ALL SELECT w.wine, s.scan_idx, s.mz, 0.0 FROM wines w JOIN scans s ON starts_with(s.sample_id::VARCHAR, w.wine) WHERE scan_idx % 97 = 0 GROUP BY ALL")
def _(spark, d):
    """Means over the samples that begin with a wine's name; scans that are not numbers, here each 97th, become 0."""
    s = scans(spark, d).select("sample_id", "scan_idx", "mz", F.when(F.col("scan_idx") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("intensity")).alias("value"))
    wines = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("wine"))
    return S.replicate_average(s, wines, "scan_idx", "mz").select("wine", "scan_idx", "mz", F.round("value", 6).alias("value"))


@query("wines_without_replicates", f"WITH {SCANS}, {_WINES} SELECT wine FROM wines w WHERE NOT EXISTS (SELECT 1 FROM scans s WHERE starts_with(s.sample_id::VARCHAR, w.wine))")
def _(spark, d):
    """Wines whose name begins no sample's."""
    return S.without_replicates(scans(spark, d), table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("wine")))


_CLASSES = "u AS (SELECT s_suppkey AS sample_id, s_nationkey % 3 AS label, row_number() OVER (PARTITION BY s_nationkey % 3 ORDER BY s_suppkey) - 1 AS k, count(*) OVER (PARTITION BY s_nationkey % 3) AS n FROM supplier)"


def _three(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample_id"), (F.col("s_nationkey") % 3).alias("label"))


@query("drawn_one_per_class", f"WITH {_CLASSES}, r AS (SELECT unnest(range(0, 200))::INTEGER AS split_id) SELECT split_id, sample_id FROM u, r WHERE k = CAST('0x' || substr(md5(label || '/' || split_id || '/7'), 1, 15) AS BIGINT) % n")
def _(spark, d):
    """200 independent draws of one supplier of each class."""
    return P.drawn_one_per_class(_three(spark, d), "label", 200, seed=7)


@query("all_one_per_class", f"WITH {_CLASSES}, a AS (SELECT * FROM u WHERE label = 0), b AS (SELECT * FROM u WHERE label = 1), c AS (SELECT * FROM u WHERE label = 2), t AS (SELECT (a.k + coalesce(a.n, 1) * (b.k + b.n * c.k))::BIGINT AS split_id, [a.sample_id, b.sample_id, c.sample_id] AS s FROM a, b, c) SELECT split_id, unnest(s) AS sample_id FROM t WHERE split_id BETWEEN 5 AND 3004")
def _(spark, d):
    """Three thousand of the splits that test one supplier of each class, from number 5 on."""
    return P.all_one_per_class(_three(spark, d), "label", 5, 3000)


#: A compound for each brand: the list stays short while parts grow in number.
COMPOUNDS = "compounds AS (SELECT p_brand AS name, (41 + sum(p_size) % 8)::INTEGER AS mz, (sum(p_partkey) % 150) / 600.0 AS rt_start, (sum(p_partkey) % 150 + max(p_size)) / 600.0 AS rt_stop FROM part GROUP BY p_brand)"


def compounds(spark, d):
    start = F.sum("p_partkey") % 150
    own = table(spark, d, "part").groupBy(F.col("p_brand").alias("name"))
    return own.agg(F.array((41 + F.sum("p_size") % 8).cast("int")).alias("mz"), (start / 600.0).alias("rt_start"), ((start + F.max("p_size")) / 600.0).alias("rt_stop"))


INSIDE = f"{SCANS}, {COMPOUNDS}, hit AS (SELECT s.sample_id, c.name, c.mz, s.scan_idx, s.rt_ms, s.intensity FROM scans s JOIN compounds c ON s.mz = c.mz AND s.rt_ms / 60000 >= c.rt_start AND s.rt_ms / 60000 <= c.rt_stop)"
AREAS = f"{INSIDE}, step AS (SELECT sample_id, name, mz, (rt_ms - lag(rt_ms) OVER w) / 60000 * (intensity + lag(intensity) OVER w) / 2 AS a FROM hit WINDOW w AS (PARTITION BY sample_id, name, mz ORDER BY rt_ms)), area AS (SELECT sample_id, name, mz, coalesce(sum(a), 0) AS area FROM step GROUP BY ALL), areas AS (SELECT s.sample_id, c.name, c.mz, CASE WHEN c.mz IN (SELECT mz FROM scans) THEN coalesce(a.area, 0) END AS area FROM (SELECT DISTINCT sample_id FROM scans) s CROSS JOIN compounds c LEFT JOIN area a ON a.sample_id = s.sample_id AND a.name = c.name AND a.mz = c.mz)"


@query("compound_hits", f"WITH {INSIDE} SELECT sample_id, name, scan_idx, intensity FROM hit")
def _(spark, d):
    return C.window_join(scans(spark, d), compounds(spark, d)).select("sample_id", "name", "scan_idx", "intensity")


@query("compound_mask", f"WITH {INSIDE} SELECT s.sample_id, s.scan_idx, s.mz, CASE WHEN EXISTS (SELECT 1 FROM hit h WHERE h.sample_id = s.sample_id AND h.scan_idx = s.scan_idx AND h.mz = s.mz) THEN 0 ELSE s.intensity END AS intensity FROM scans s")
def _(spark, d):
    return S.compound_mask(scans(spark, d), compounds(spark, d)).select("sample_id", "scan_idx", "mz", "intensity")


@query("compound_areas", f"WITH {AREAS} SELECT sample_id, name, mz, round(area, 6) AS area FROM areas")
def _(spark, d):
    return C.integrate(scans(spark, d), compounds(spark, d)).select("sample_id", "name", "mz", F.round("area", 6).alias("area"))


@query("index_areas", f"WITH {TIC} SELECT sample_id, coalesce(sum(tic) FILTER (scan_idx BETWEEN 30 AND 60), 0) AS area FROM tic GROUP BY 1")
def _(spark, d):
    return C.integrate_by_index(S.tic(scans(spark, d)), 30, 60)


@query("peak_table", "SELECT l_suppkey AS sample_id, coalesce(arg_min(l_quantity, l_orderkey * 10 + l_linenumber) FILTER (l_returnflag = 'A'), 0) AS \"A\", coalesce(arg_min(l_quantity, l_orderkey * 10 + l_linenumber) FILTER (l_returnflag = 'N'), 0) AS \"N\" FROM (SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("area"))
    areas = li.select(F.col("l_suppkey").alias("sample_id"), F.col("l_returnflag").alias("name"), "area", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"))
    return C.peak_table(areas, ["A", "N", "R"], drop="R")


@query("nearest_peak", f"WITH {PEAKS}, r AS (SELECT scan_idx AS ref_idx FROM peaks WHERE sample_id = 1), j AS (SELECT sample_id, scan_idx, ref_idx, row_number() OVER (PARTITION BY sample_id, scan_idx ORDER BY abs(scan_idx - ref_idx), ref_idx) AS k FROM peaks JOIN r ON abs(scan_idx - ref_idx) <= 4) SELECT sample_id, scan_idx, ref_idx FROM j WHERE k = 1")
def _(spark, d):
    p = S.local_maxima(S.tic(scans(spark, d)))
    return C.nearest_peak(p, p.where("sample_id = 1"), 4)


@query("common_samples", "SELECT DISTINCT l_partkey AS part, l_suppkey AS sample_id FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def _(spark, d):
    li = table(spark, d, "lineitem")
    part = lambda f: li.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("sample_id"))
    return part("A").intersect(part("R"))


@query("remaining_candidates", "SELECT l_partkey AS part, l_suppkey AS sample_id FROM lineitem EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N'")
def _(spark, d):
    """Candidates that no run of one kind has used."""
    every = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("sample_id"), "l_returnflag")
    return every.select("part", "sample_id").distinct().join(every.where("l_returnflag = 'N'"), ["part", "sample_id"], "left_anti")


@query("one_kind", "SELECT 'pinot_noir/' || r_name AS path FROM region")
def _(spark, d):
    return R.check_one_kind(table(spark, d, "region").select(F.concat(F.lit("pinot_noir/"), "r_name").alias("path")))


@query("centroid_grid", "WITH c AS (SELECT l_suppkey AS sample_id, (l_partkey % 50)::INTEGER AS scan_idx, 40 + l_extendedprice / 2000 AS mz, l_quantity AS intensity FROM lineitem), u AS (SELECT sample_id, scan_idx, round_even(mz, 0)::INTEGER AS mz, sum(intensity) AS intensity FROM c GROUP BY ALL) SELECT e.sample_id, e.scan_idx, e.mz, coalesce(u.intensity, 0) AS intensity FROM (SELECT DISTINCT sample_id, scan_idx, unnest(range(42, 49))::INTEGER AS mz FROM c) e LEFT JOIN u USING (sample_id, scan_idx, mz)")
def _(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample_id"), (F.col("l_partkey") % 50).cast("int").alias("scan_idx"), F.lit(0.0).alias("rt_ms"), (40 + F.col("l_extendedprice") / 2000).alias("mz"), F.col("l_quantity").alias("intensity"))
    return R.centroids_to_grid(c, 42, 48, dense=True).select("sample_id", "scan_idx", "mz", "intensity")


@query("all_pairs", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey WHERE a.s_nationkey = b.s_nationkey")
def _(spark, d):
    """Unordered pairs within a group, as the definition asks."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return s.select(F.col("s_suppkey").alias("a"), "s_nationkey").join(s.select(F.col("s_suppkey").alias("b"), "s_nationkey"), "s_nationkey").where("a < b").select("a", "b")


# Sensory aggregates


@query("score_means", f"WITH {SENSORY} SELECT wine, taster, round(avg(fruity), 6) AS fruity, round(avg(citrus), 6) AS citrus FROM sensory GROUP BY ALL")
def _(spark, d):
    return M.mean_scores(sensory(spark, d), ["wine", "taster"], ["fruity", "citrus"]).select("wine", "taster", F.round("fruity", 6).alias("fruity"), F.round("citrus", 6).alias("citrus"))


@query("attribute_spread", f"WITH {SENSORY}, u AS (SELECT 'fruity' AS attribute, fruity AS v FROM sensory UNION ALL SELECT 'citrus', citrus FROM sensory) SELECT attribute, round(stddev_samp(v), 4) AS std, min(v) AS least, max(v) AS most FROM u GROUP BY 1")
def _(spark, d):
    return M.spread_by_attribute(sensory(spark, d), ["fruity", "citrus"]).select("attribute", F.round("std", 4).alias("std"), "least", "most")


@query("centre_by_taster", f"WITH {SENSORY} SELECT o_orderkey, round(fruity - avg(fruity) OVER (PARTITION BY taster), 5) AS fruity FROM sensory")
def _(spark, d):
    return M.centred_by(sensory(spark, d), "taster", "fruity").select("o_orderkey", F.round("fruity", 5).alias("fruity"))


@query("taster_scaling", f"WITH {SENSORY} SELECT taster, round(greatest(0, sum(fruity * citrus) / sum(fruity * fruity)), 6) AS factor FROM sensory GROUP BY 1 HAVING count(*) >= 2")
def _(spark, d):
    s = sensory(spark, d).select("taster", F.lit("citrus").alias("attribute"), F.col("fruity").alias("y_pred"), F.col("citrus").alias("y_true"))
    return Z.taster_factors(s).select("taster", F.round("factor", 6).alias("factor"))


@query("replicate_numbers", "SELECT c_custkey, (row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey))::INTEGER AS replicate FROM customer")
def _(spark, d):
    return M.numbered_replicates(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey").select("c_custkey", "replicate")


# Scaling


for _kind, _sql in (
    ("standard", "(value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w > 0 THEN stddev_pop(value) OVER w ELSE 1 END"),
    ("minmax", "(value - min(value) OVER w) / CASE WHEN max(value) OVER w > min(value) OVER w THEN max(value) OVER w - min(value) OVER w ELSE 1 END"),
    ("robust", "(value - median(value) OVER w) / (quantile_cont(value, 0.75) OVER w - quantile_cont(value, 0.25) OVER w)"),
):

    @query(f"scale_features_{_kind}", f"WITH {FEATURES} SELECT sample_id, pos, round({_sql}, 5) AS value FROM features WINDOW w AS (PARTITION BY pos)")
    def _(spark, d, kind=_kind):
        f = features(spark, d)
        return Z.apply_scaler(f, Z.fit_scaler(f, kind)).select("sample_id", "pos", F.round("value", 5).alias("value"))


@query("scale_on_train", f"WITH {FEATURES}, f AS (SELECT pos, avg(value) AS m, stddev_pop(value) AS s FROM features WHERE sample_id % 5 <> 0 GROUP BY 1) SELECT sample_id, pos, round((value - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 5) AS value FROM features JOIN f USING (pos) WHERE sample_id % 5 = 0")
def _(spark, d):
    f = features(spark, d)
    return Z.apply_scaler(f.where("sample_id % 5 = 0"), Z.fit_scaler(f.where("sample_id % 5 <> 0"), "standard")).select("sample_id", "pos", F.round("value", 5).alias("value"))


# Splits: their properties, which SQL can state, and the rows themselves


def samples(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), "label", (F.col("vec_id") % 50).alias("wine"))


@query("loo_sizes", "SELECT vec_id % 50 AS wine, count(*) AS n FROM embeddings GROUP BY 1")
def _(spark, d):
    return P.leave_one_out(samples(spark, d), "wine").groupBy(F.col("split_id").cast("long").alias("wine")).agg(F.count("*").alias("n"))


@query("loo_rows", "SELECT (vec_id % 50)::VARCHAR AS split_id, vec_id AS sample_id FROM embeddings")
def _(spark, d):
    """A split for each wine, with its rows."""
    return P.leave_one_out(samples(spark, d), "wine")


def _drawn(*parts: str) -> str:
    """The draw of the splits as SQL."""
    return "CAST('0x' || substr(md5(" + " || '/' || ".join(parts) + "), 1, 15) AS BIGINT)"


_E = "e AS (SELECT vec_id AS sample_id, label, vec_id % 50 AS wine FROM embeddings)"


@query("one_per_class_rows", f"WITH {_E}, k AS (SELECT sample_id, row_number() OVER (PARTITION BY label ORDER BY {_drawn('sample_id', '3')}, sample_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM e) SELECT r::INTEGER AS split_id, sample_id FROM k, (SELECT unnest(range(0, 20)) AS r) WHERE k = r % n")
def _(spark, d):
    return P.one_per_class(samples(spark, d), "label", 20, seed=3)


@query("group_shuffle_rows", f"WITH {_E}, g AS (SELECT DISTINCT wine FROM e), k AS (SELECT r, wine, row_number() OVER (PARTITION BY r ORDER BY {_drawn('wine', 'r', '0')}, wine) AS k, count(*) OVER (PARTITION BY r) AS n FROM g, (SELECT unnest(range(0, 20)) AS r)) SELECT r::INTEGER AS split_id, sample_id FROM k JOIN e USING (wine) WHERE k <= floor(n * 0.2)")
def _(spark, d):
    """A fifth of the wines, whole, in each of twenty repeats."""
    return P.group_shuffle(samples(spark, d), "wine", 0.2, 20)


@query("stratified_fold_rows", f"WITH {_E} SELECT (r * 5 + (row_number() OVER (PARTITION BY r, label ORDER BY {_drawn('sample_id', 'r', '1')}, sample_id) - 1) % 5)::INTEGER AS split_id, sample_id FROM e, (SELECT unnest(range(0, 3)) AS r)")
def _(spark, d):
    return P.stratified_folds(samples(spark, d), "label", 5, 3, seed=1)


@query("three_way_split_rows", f"WITH {_E}, k AS (SELECT sample_id, row_number() OVER (PARTITION BY label ORDER BY {_drawn('sample_id', '0')}, sample_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM e) SELECT sample_id, CASE WHEN k <= floor(n * 0.3) THEN 'test' WHEN k <= floor(n * 0.3) + floor(n * 0.2) THEN 'val' ELSE 'train' END AS role FROM k")
def _(spark, d):
    return P.train_val_test(samples(spark, d), "label", 0.2, 0.3)


@query("group_fold_rows", f"WITH {_E}, g AS (SELECT DISTINCT wine FROM e), k AS (SELECT r, wine, (r * 4 + (row_number() OVER (PARTITION BY r ORDER BY {_drawn('wine', 'r', '2')}, wine) - 1) % 4)::INTEGER AS split_id FROM g, (SELECT unnest(range(0, 2)) AS r)) SELECT split_id, sample_id FROM k JOIN e USING (wine)")
def _(spark, d):
    return P.group_folds(samples(spark, d), "wine", 4, seed=2, repeats=2)


@query("one_per_class_sizes", "SELECT unnest(range(0, 20))::INTEGER AS split_id, (SELECT count(DISTINCT label) FROM embeddings) AS n")
def _(spark, d):
    return P.one_per_class(samples(spark, d), "label", 20).groupBy("split_id").agg(F.count("*").alias("n"))


@query("group_shuffle_sizes", "SELECT unnest(range(0, 20))::INTEGER AS split_id, (SELECT floor(count(DISTINCT vec_id % 50) * 0.2)::BIGINT FROM embeddings) AS groups, 0::BIGINT AS straddling")
def _(spark, d):
    s = samples(spark, d)
    test = P.group_shuffle(s, "wine", 0.2, 20).join(s.select("sample_id", "wine"), "sample_id")
    size = s.groupBy("wine").agg(F.count("*").alias("_all"))
    per = test.groupBy("split_id", "wine").agg(F.count("*").alias("_n")).join(size, "wine")
    return per.groupBy("split_id").agg(F.count("*").alias("groups"), F.sum((F.col("_n") != F.col("_all")).cast("long")).alias("straddling"))


@query("stratified_fold_sizes", "WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT f.split_id::INTEGER AS split_id, label, ((n + 4 - f.split_id % 5) // 5)::BIGINT AS n FROM n, (SELECT unnest(range(0, 10)) AS split_id) f")
def _(spark, d):
    s = samples(spark, d)
    return P.stratified_folds(s, "label", 5, 2).join(s, "sample_id").groupBy("split_id", "label").agg(F.count("*").alias("n"))


@query("three_way_split_sizes", "SELECT label, floor(count(*) * 0.2)::BIGINT AS test, floor(count(*) * 0.25)::BIGINT AS val, count(*) AS total FROM embeddings GROUP BY 1")
def _(spark, d):
    s = samples(spark, d)
    r = P.train_val_test(s, "label", 0.25, 0.2).join(s, "sample_id")
    n = lambda role: F.sum((F.col("role") == role).cast("long")).alias(role)
    return r.groupBy("label").agg(n("test"), n("val"), F.count("*").alias("total"))


@query("group_fold_sizes", "SELECT vec_id % 50 AS wine, count(*) AS n, 1::BIGINT AS folds FROM embeddings GROUP BY 1")
def _(spark, d):
    s = samples(spark, d)
    return P.group_folds(s, "wine", 10).join(s, "sample_id").groupBy("wine").agg(F.count("*").alias("n"), F.countDistinct("split_id").alias("folds"))


@query("training_rows", "SELECT a.split_id, b.sample_id FROM (SELECT DISTINCT (doc_id % 5)::INTEGER AS split_id FROM labels) a, (SELECT DISTINCT doc_id AS sample_id FROM labels) b WHERE b.sample_id % 5 <> a.split_id")
def _(spark, d):
    p = predictions(spark, d)
    return P.training_rows(p, p.select("split_id", "sample_id"))


# Metrics

SCORES = f"{PREDICTIONS}, c AS (SELECT split_id, y_true, y_pred, count(*) AS n FROM predictions GROUP BY ALL), t AS (SELECT split_id, y_true AS y, sum(n) AS support, coalesce(sum(n) FILTER (y_true = y_pred), 0) AS hits FROM c GROUP BY 1, 2), p AS (SELECT split_id, y_pred AS y, sum(n) AS predicted FROM c GROUP BY 1, 2), s AS (SELECT split_id, y, support, hits, hits / support AS recall, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS prec, CASE WHEN hits > 0 THEN 2 * (hits / predicted) * (hits / support) / (hits / predicted + hits / support) ELSE 0 END AS f1 FROM t LEFT JOIN p USING (split_id, y)), fold AS (SELECT split_id, sum(hits) / sum(support) AS accuracy, avg(recall) AS balanced_accuracy, sum(prec * support) / sum(support) AS weighted_precision, sum(recall * support) / sum(support) AS weighted_recall, sum(f1 * support) / sum(support) AS weighted_f1 FROM s GROUP BY 1)"


@query("fold_metrics", f"WITH {SCORES} SELECT split_id, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(weighted_precision, 6) AS weighted_precision, round(weighted_recall, 6) AS weighted_recall, round(weighted_f1, 6) AS weighted_f1 FROM fold")
def _(spark, d):
    m = M.fold_metrics(predictions(spark, d), "split_id")
    return m.select("split_id", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


@query("metric_summary", f"WITH {SCORES} SELECT round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std, round(min(accuracy), 6) AS least, round(max(accuracy), 6) AS most, round(median(accuracy), 6) AS median, round(quantile_cont(accuracy, 0.75) - quantile_cont(accuracy, 0.25), 6) AS iqr FROM fold")
def _(spark, d):
    m = M.summary(M.fold_metrics(predictions(spark, d), "split_id"), "accuracy")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("mean_confusion", f"WITH {PREDICTIONS}, r AS (SELECT y_true, count(DISTINCT split_id) AS s FROM predictions GROUP BY 1), c AS (SELECT y_true, y_pred, count(*) / any_value(s) AS mean_n FROM predictions JOIN r USING (y_true) GROUP BY 1, 2) SELECT y_true, y_pred, round(mean_n, 6) AS mean_n, round(mean_n / sum(mean_n) OVER (PARTITION BY y_true), 6) AS share FROM c")
def _(spark, d):
    return M.mean_confusion(predictions(spark, d)).select("y_true", "y_pred", F.round("mean_n", 6).alias("mean_n"), F.round("share", 6).alias("share"))


@query("percent_rows", "WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), x AS (SELECT *, 100.0 * n / sum(n) OVER (PARTITION BY c_nationkey) AS x FROM c), k AS (SELECT *, floor(x) AS f, row_number() OVER (PARTITION BY c_nationkey ORDER BY round(x - floor(x), 9) DESC, c_mktsegment) AS k FROM x) SELECT c_nationkey, c_mktsegment, (f + (k <= 100 - sum(f) OVER (PARTITION BY c_nationkey))::INTEGER)::BIGINT AS percent FROM k")
def _(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return M.percent_rows(c, "c_nationkey", "c_mktsegment")


@query("chance_level", "WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT round(sum(n * n) / pow(sum(n), 2), 8) AS chance FROM n")
def _(spark, d):
    return M.chance_level(table(spark, d, "documents"), "lang").select(F.round("chance", 8).alias("chance"))


@query("class_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("regression_metrics", f"WITH {SENSORY}, e AS (SELECT taster, fruity AS t, citrus AS p, citrus - fruity AS e FROM sensory) SELECT taster, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(1 - sum(e * e) / (var_pop(t) * count(*)), 4) AS r2, round(corr(t, p), 4) AS r, round(avg(e), 4) AS bias, round(stddev_pop(e), 4) AS residual_pop, round(avg((abs(e) <= 5)::INTEGER), 6) AS within_5 FROM e GROUP BY 1")
def _(spark, d):
    m = M.regression_metrics(sensory(spark, d).select("taster", F.col("fruity").alias("y_true"), F.col("citrus").alias("y_pred")), "taster")
    return m.select("taster", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "r2", "r", "bias", "residual_pop")], F.round("within_5", 6).alias("within_5"))


@query("mode_per_key", "WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_linenumber) AS k, sum(n) OVER (PARTITION BY l_suppkey) AS t FROM c) SELECT l_suppkey, l_linenumber, round(n / t, 6) AS share FROM k WHERE k = 1")
def _(spark, d):
    return M.mode_per(table(spark, d, "lineitem"), "l_suppkey", "l_linenumber").select("l_suppkey", "l_linenumber", F.round("share", 6).alias("share"))


SURVIVAL = "v AS (SELECT DISTINCT (l_suppkey % 20)::INTEGER AS fold, (l_partkey % 12)::INTEGER AS step, (l_orderkey % 997)::INTEGER AS rt_bin FROM lineitem), f AS (SELECT step, rt_bin, count(*) AS n FROM (SELECT fold, rt_bin, min(step) AS step FROM v GROUP BY 1, 2) GROUP BY 1, 2), dense AS (SELECT s.step, b.rt_bin, coalesce(f.n, 0)::BIGINT AS n FROM (SELECT unnest(range(0, 12))::INTEGER AS step) s CROSS JOIN (SELECT DISTINCT rt_bin FROM f) b LEFT JOIN f ON f.step = s.step AND f.rt_bin = b.rt_bin)"


def survival(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).cast("int").alias("fold"), (F.col("l_partkey") % 12).cast("int").alias("step"), (F.col("l_orderkey") % 997).cast("int").alias("rt_bin")).distinct()


@query("first_hits", f"WITH {SURVIVAL} SELECT step, rt_bin, n, sum(n) OVER (PARTITION BY rt_bin ORDER BY step)::BIGINT AS cumulative FROM dense")
def _(spark, d):
    return M.first_hits(survival(spark, d), 12)


for _how, _sql in (("global", "max(n) OVER ()"), ("column", "sum(n) OVER (PARTITION BY step)"), ("row", "max(n) OVER (PARTITION BY rt_bin)")):

    @query(f"frequencies_{_how}", f"WITH {SURVIVAL} SELECT step, rt_bin, round(CASE WHEN {_sql} > 0 THEN n / {_sql} ELSE 0 END, 6) AS value FROM dense")
    def _(spark, d, how=_how):
        return M.normalise_frequencies(M.first_hits(survival(spark, d), 12).drop("cumulative"), how).select("step", "rt_bin", F.round("value", 6).alias("value"))


@query("focus_map", "WITH w AS (SELECT l_suppkey % 7 AS taster, l_returnflag AS attribute, l_partkey % 200 AS pos, sum(l_quantity) - 25 * count(*) AS weight FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY taster, attribute ORDER BY abs(weight) DESC, pos) - 1 AS r FROM w) SELECT taster, least(pos // 20, 9)::INTEGER AS bin, round(sum(1 / (r + 1)), 6) AS focus FROM k WHERE r < 15 GROUP BY ALL")
def _(spark, d):
    w = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("taster"), F.col("l_returnflag").alias("attribute"), (F.col("l_partkey") % 200).alias("pos")).agg((F.sum("l_quantity") - 25 * F.count("*")).alias("weight"))
    return M.ranked_focus(w, 15, 10, 20).select("taster", "bin", F.round("focus", 6).alias("focus"))


_KERNEL = S.gaussian_kernel(1.0)
_FOCUS = "WITH w AS (SELECT l_suppkey % 7 AS taster, l_returnflag AS attribute, l_partkey % 200 AS pos, sum(l_quantity) - 25 * count(*) AS weight FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY taster, attribute ORDER BY abs(weight) DESC, pos) - 1 AS r FROM w) SELECT taster, least(pos // 20, 9)::INTEGER AS bin, round(sum(1 / (r + 1)), 6) AS focus FROM k WHERE r < 15 GROUP BY ALL"


@query(
    "focus_map_smoothed",
    f"WITH f AS ({_FOCUS}), b AS (SELECT r.bin, coalesce(sum(f.focus), 0) AS v FROM (SELECT unnest(range(0, 10)) AS bin) r LEFT JOIN f ON f.bin = r.bin GROUP BY 1), "
    f"i AS (SELECT b.bin, t, w, (b.bin + t - {len(_KERNEL) // 2} + 20) % 20 AS q FROM b CROSS JOIN (SELECT unnest(range(0, {len(_KERNEL)})) AS t, unnest({_KERNEL}) AS w)) "
    "SELECT i.bin::INTEGER AS bin, round(sum(w * v), 4) AS focus FROM i JOIN b ON b.bin = CASE WHEN q < 10 THEN q ELSE 19 - q END GROUP BY 1",
)
def _(spark, d):
    """The focus of all tasters together."""
    w = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("taster"), F.col("l_returnflag").alias("attribute"), (F.col("l_partkey") % 200).alias("pos")).agg((F.sum("l_quantity") - 25 * F.count("*")).alias("weight"))
    return M.smoothed_focus(M.ranked_focus(w, 15, 10, 20), 10, 1.0).select("bin", F.round("focus", 4).alias("focus"))


@query("scale_scans_by_channel", f"WITH {SCANS} SELECT sample_id, mz, scan_idx AS pos, round((intensity - avg(intensity) OVER w) / CASE WHEN stddev_pop(intensity) OVER w > 0 THEN stddev_pop(intensity) OVER w ELSE 1 END, 5) AS value FROM scans WINDOW w AS (PARTITION BY mz, scan_idx)")
def _(spark, d):
    """Each channel's scans are scaled on their own."""
    f = scans(spark, d).select("sample_id", "mz", F.col("scan_idx").alias("pos"), F.col("intensity").alias("value"))
    return Z.apply_scaler(f, Z.fit_scaler(f, "standard", "mz"), "mz").select("sample_id", "mz", "pos", F.round("value", 5).alias("value"))


# Statistics


@query("pearson_summary", f"WITH {FEATURES}, r AS (SELECT corr(a.value, b.value) AS r FROM features a JOIN features b ON a.pos = b.pos AND a.sample_id < b.sample_id GROUP BY a.sample_id, b.sample_id) SELECT round(avg(r), 5) AS mean, round(stddev_pop(r), 5) AS std, count(*) AS n FROM r")
def _(spark, d):
    """Mean and deviation over all pairs, without forming them."""
    return T.pearson_summary(features(spark, d)).select(F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "n")


@query("cluster_spread", "WITH p AS (SELECT least(a.label, b.label) AS g, greatest(a.label, b.label) AS h, sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2)))) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id), m AS (SELECT g, h, avg(dist) AS m FROM p GROUP BY ALL) SELECT round(avg(m) FILTER (g = h), 5) AS within, round(avg(m) FILTER (g <> h), 5) AS between, round(stddev_pop(m) FILTER (g <> h), 5) AS between_std, count(*) FILTER (g <> h) AS n_pairs FROM m WHERE g <> 0 AND h <> 0")
def _(spark, d):
    """Distances within and between labels, one label left out."""
    out = T.cluster_spread(T.cluster_distances(features(spark, d)), [0])
    return out.select(*[F.round(c, 5).alias(c) for c in ("within", "between", "between_std")], "n_pairs")


@query("pairwise_pearson", "WITH v AS (SELECT vec_id, embedding[1:64] AS e FROM embeddings), f AS (SELECT vec_id, unnest(range(0, 64)) AS p, unnest(e)::DOUBLE AS x FROM v) SELECT a.vec_id AS a, b.vec_id AS b, round(corr(a.x, b.x), 5) AS r FROM f a JOIN f b ON a.p = b.p AND a.vec_id < b.vec_id GROUP BY ALL")
def _(spark, d):
    return T.pairwise_pearson(features(spark, d), digits=5)


@query("channel_correlations", f"WITH {SCANS}, c AS (SELECT a.sample_id, a.mz AS a, b.mz AS b, count(*) AS n, round(corr(a.intensity, b.intensity), 4) AS r FROM scans a JOIN scans b ON a.sample_id = b.sample_id AND a.scan_idx = b.scan_idx AND a.mz <= b.mz GROUP BY ALL) SELECT sample_id, a, b, n, r FROM c WHERE n > 2")
def _(spark, d):
    return T.channel_correlations(scans(spark, d)).where("n > 2").select("sample_id", "a", "b", "n", F.round("r", 4).alias("r"))


@query("compare_weights", "WITH w AS (SELECT unnest(range(0, 64)) AS pos, unnest((SELECT embedding FROM embeddings WHERE vec_id = 0))::DOUBLE AS x, unnest((SELECT embedding FROM embeddings WHERE vec_id = 1))::DOUBLE AS y) SELECT round(corr(x, y), 5) AS r, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 5) AS intercept, round(avg(y - x), 6) AS difference FROM w")
def _(spark, d):
    f = features(spark, d)
    part = lambda k: f.where(F.col("sample_id") == k).select("pos", "value")
    c = T.compare_weights(part(0), part(1))
    return c.select(*[F.round(x, 5).alias(x) for x in ("r", "slope", "intercept")], F.round("difference", 6).alias("difference"))


@query("cluster_distances", "WITH f AS (SELECT vec_id, label, embedding FROM embeddings), p AS (SELECT least(a.label, b.label) AS g, greatest(a.label, b.label) AS h, sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2)))) AS dist FROM f a JOIN f b ON a.vec_id < b.vec_id) SELECT g, h, round(avg(dist), 5) AS mean_distance, count(*) AS n FROM p GROUP BY ALL")
def _(spark, d):
    return T.cluster_distances(features(spark, d)).select("g", "h", F.round("mean_distance", 5).alias("mean_distance"), "n")


@query("group_dispersion", "WITH p AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), g AS (SELECT label, avg(x) AS mx, avg(y) AS my, var_samp(x) * 0.4 + 0.001 AS xx, covar_samp(x, y) * 0.4 AS xy, var_samp(y) * 0.4 + 0.001 AS yy FROM p GROUP BY 1) SELECT label, round(mx, 5) AS mx, round(my, 5) AS my, round(xx * yy - xy * xy, 6) AS det, round(greatest(0.1, 1 / (1 + 1.5 * (xx * yy - xy * xy))), 5) AS alpha FROM g")
def _(spark, d):
    e = table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    g = T.group_dispersion(e, "label")
    return g.select("label", F.round("mx", 5).alias("mx"), F.round("my", 5).alias("my"), F.round("det", 6).alias("det"), F.round("alpha", 5).alias("alpha"))


@query("linear_attribution", f"WITH {FEATURES}, c AS (SELECT pos, avg(value) AS m FROM features GROUP BY 1) SELECT pos, round(avg((pos % 5 - 2) * (value - m)), 6) + 0 AS mean_attribution, round(avg(abs((pos % 5 - 2) * (value - m))), 5) AS mean_abs FROM features JOIN c USING (pos) GROUP BY 1")
def _(spark, d):
    f = features(spark, d)
    coef = f.select("pos").distinct().withColumn("coef", (F.col("pos") % 5 - 2).cast("double"))
    a = T.linear_attribution(f, coef)
    return a.groupBy("pos").agg((F.round(F.avg("attribution"), 6) + 0).alias("mean_attribution"), F.round(F.avg(F.abs("attribution")), 5).alias("mean_abs"))


@query("best_decile_channels", "WITH s AS (SELECT l_orderkey, list(DISTINCT l_linenumber) AS chans, avg(l_discount) AS acc FROM lineitem GROUP BY 1), q AS (SELECT quantile_cont(acc, 0.9) AS q FROM s), b AS (SELECT unnest(chans) AS channel FROM s, q WHERE acc >= q) SELECT channel, count(*) AS n FROM b GROUP BY 1")
def _(spark, d):
    """Many means lie a last digit beside the percentile, so they are added in the order of the table's rows."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = lines.select("_file").distinct().withColumn("_at", F.row_number().over(Window.orderBy("_file")))  # one row for each file
    s = lines.join(F.broadcast(files), "_file").groupBy(F.col("l_orderkey").alias("set_id")).agg(F.collect_set("l_linenumber").alias("channels"), T.mean_in_order("l_discount", "_at", "_row").alias("accuracy"))
    return T.best_decile_channels(stored(s.select("channels", "accuracy"), "sets"))


@query("best_set_per_size", "WITH s AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS k, avg(l_discount) AS acc FROM lineitem GROUP BY 1) SELECT k, min(l_orderkey) FILTER (acc = mx) AS best, round(max(acc), 6) AS accuracy, round(avg(acc), 6) AS mean, round(stddev_pop(acc), 6) AS std FROM (SELECT *, max(acc) OVER (PARTITION BY k) AS mx FROM s) GROUP BY k")
def _(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("set_id")).agg(F.count_distinct("l_linenumber").alias("k"), F.avg("l_discount").alias("accuracy"))
    return T.best_per_size(s).select("k", "best", *[F.round(c, 6).alias(c) for c in ("accuracy", "mean", "std")])


@query("step_curves", "WITH s AS (SELECT l_suppkey AS rep, l_partkey % 30 AS step, avg(l_discount) AS acc FROM lineitem GROUP BY ALL) SELECT step, round(avg(acc), 6) AS mean, round(stddev_pop(acc), 6) AS std, count(*) AS n FROM s GROUP BY 1")
def _(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 30).alias("step")).agg(F.avg("l_discount").alias("acc"))
    return M.step_curve(s, "step", "acc").select("step", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("mean_scores_per_sample", f"WITH {FEATURES} SELECT label, pos, round(avg(value), 6) AS value FROM features GROUP BY ALL")
def _(spark, d):
    return M.mean_scores(features(spark, d), ["label", "pos"], ["value"]).select("label", "pos", F.round("value", 6).alias("value"))


@query("fold_weights", f"WITH {FEATURES}, m AS (SELECT pos, avg(value) AS w FROM features GROUP BY 1), t AS (SELECT max(abs(w)) AS t FROM m) SELECT pos, round(w / t, 6) AS w, abs(w / t) >= 0.5 AS strong FROM m, t")
def _(spark, d):
    return T.fold_weights(features(spark, d).select(F.col("sample_id").alias("fold"), "pos", F.col("value").alias("coef")), 0.5).select("pos", F.round("weight", 6).alias("w"), "strong")


@query("cumulative_variance", f"WITH {FEATURES}, v AS (SELECT pos, var_pop(value) AS v FROM features GROUP BY 1), r AS (SELECT pos, sum(v) OVER (ORDER BY v DESC, pos) / sum(v) OVER () AS share, row_number() OVER (ORDER BY v DESC, pos) AS k FROM v) SELECT k::INTEGER AS k, round(share, 5) AS share FROM r")
def _(spark, d):
    v = features(spark, d).groupBy("pos").agg(F.var_pop("value").alias("v"))
    w = Window.orderBy(F.desc("v"), "pos")  # one row for each feature position
    return v.select(F.row_number().over(w).alias("k"), F.round(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("v").over(Window.partitionBy()), 5).alias("share"))


@query("average_by_wine", f"WITH {FEATURES}, {SENSORY}, y AS (SELECT wine, avg(fruity) AS y FROM sensory GROUP BY 1), x AS (SELECT n_name AS wine, pos, avg(value) AS x FROM features JOIN nation ON sample_id % 25 = n_nationkey GROUP BY ALL) SELECT wine, pos, round(x, 6) AS x, round(y, 5) AS y FROM x JOIN y USING (wine)")
def _(spark, d):
    """Features and scores of a wine averaged over all of its rows."""
    n = table(spark, d, "nation").select(F.col("n_nationkey"), F.col("n_name").alias("wine"))
    f = features(spark, d).withColumn("n_nationkey", F.col("sample_id") % 25).join(n, "n_nationkey")
    return M.average_by(f, "wine", "value", "pos").join(M.average_by(sensory(spark, d), "wine", "fruity"), "wine").select("wine", "pos", F.round("value", 6).alias("x"), F.round("fruity", 5).alias("y"))


@query("mean_predictions", f"WITH {SENSORY} SELECT wine, taster, round(avg(fruity), 5) AS y_true, round(avg(citrus), 5) AS y_pred, count(DISTINCT o_orderkey % 10) AS repeats FROM sensory GROUP BY ALL")
def _(spark, d):
    p = sensory(spark, d).select("wine", "taster", (F.col("o_orderkey") % 10).alias("repeat"), F.col("fruity").alias("y_true"), F.col("citrus").alias("y_pred"))
    return M.mean_predictions(p, "wine", "taster").select("wine", "taster", F.round("y_true", 5).alias("y_true"), F.round("y_pred", 5).alias("y_pred"), "repeats")


@query("profile_correlations", "WITH h AS (SELECT l_returnflag || l_linestatus AS name, (l_partkey % 100)::INTEGER AS pos, count(*) AS value FROM lineitem GROUP BY ALL) SELECT a.name AS a, b.name AS b, round(corr(a.value, b.value), 3) AS r FROM h a JOIN h b ON a.pos = b.pos GROUP BY ALL")
def _(spark, d):
    """Pearson matrix of histograms, one for each kind of line."""
    li = table(spark, d, "lineitem")
    h = li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("name"), (F.col("l_partkey") % 100).cast("int").alias("pos")).agg(F.count("*").alias("value"))
    return T.profile_correlations(h).select("a", "b", F.round("r", 3).alias("r"))


@query("weights_by_bin", f"WITH {FEATURES}, m AS (SELECT pos, avg(value) AS w FROM features GROUP BY 1), b AS (SELECT (pos // 8)::INTEGER AS bin, avg(abs(w)) AS v FROM m GROUP BY 1) SELECT bin, round(v / max(v) OVER (), 6) AS weight FROM b")
def _(spark, d):
    c = features(spark, d).select(F.col("sample_id").alias("fold"), "pos", F.col("value").alias("coef"))
    return T.weights_by_bin(c, 8).select("bin", F.round("weight", 6).alias("weight"))
