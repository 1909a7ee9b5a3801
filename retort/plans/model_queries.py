"""Queries that fit models; SQL can state some of their properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from retort.operators import align as A
from retort.operators import boosting as B
from retort.operators import metrics as M
from retort.operators import models as D
from retort.operators import moments as X
from retort.operators import selection as G
from retort.operators import signals as S
from retort.operators import splits as P
from retort.operators import statistics as T
from retort.operators import survival as V
from retort.plans import jobs as J
from retort.plans.signal_queries import PEAKS
from retort.session import table
from retort.sources.adapters import FEATURES, SCANS, SENSORY, features, readings, scans, sensory
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


def _rows(spark, d):
    """Embeddings as rows of features."""
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("sample_id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def _ages(spark, d):
    """An age for each embedding: the size of the part with its number."""
    return table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("sample_id"), F.col("p_size").cast("double").alias("age"))


def _wines(spark, d):
    """(wine, x): mean embeddings of the vectors dealt to each nation."""
    mean = features(spark, d).groupBy((F.col("sample_id") % 25).alias("k"), "pos").agg(F.avg("value").alias("value"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("wine"))
    return X.wide(mean.withColumnRenamed("k", "sample_id")).withColumnRenamed("sample_id", "k").join(n, "k").select("wine", "x")


def _scores(spark, d):
    """(wine, taster, y): mean fruity and citrus scores."""
    return sensory(spark, d).groupBy("wine", "taster").agg(F.array(F.avg("fruity"), F.avg("citrus")).alias("y"))


TASTERS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
NAMES = ["fruity", "citrus"]


def _rounded(df, *keys, digits=4):
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in df.columns if c not in keys])


def _labels(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("sample_id"), F.col("label").cast("string").alias("label"))


@query("gram_matrix", f"WITH {FEATURES} SELECT a.sample_id AS a, b.sample_id AS b, round(sum(a.value * b.value), 4) AS dot FROM features a JOIN features b ON a.pos = b.pos AND a.sample_id <= b.sample_id GROUP BY ALL")
def _(spark, d):
    return T.gram(features(spark, d), digits=4)


for _model in ("ridge", "knn", "lda"):

    @query(f"classify_{_model}")
    def _(spark, d, model=_model):
        """Five stratified folds; metrics of each."""
        lab = _labels(spark, d)
        return _rounded(J.classification_job(_rows(spark, d), lab, P.stratified_folds(lab, "label", 5), model), "split_id", digits=6)


@query("knn_predictions", f"WITH {FEATURES}, d AS (SELECT t.sample_id, o.sample_id AS other, sum((t.value - o.value) * (t.value - o.value)) AS d FROM features t JOIN features o ON t.pos = o.pos AND t.sample_id % 5 <> o.sample_id % 5 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d, other) AS k FROM d), v AS (SELECT vec_id AS i, label::VARCHAR AS v FROM embeddings), n AS (SELECT k.sample_id, v.v, count(*) AS n FROM k JOIN v ON v.i = k.other WHERE k.k <= 3 GROUP BY 1, 2) SELECT sample_id % 5 AS split_id, sample_id, any_value(t.v) AS y_true, first(n.v ORDER BY n.n DESC, n.v) AS y_pred FROM n JOIN v t ON t.i = n.sample_id GROUP BY ALL")
def _(spark, d):
    """Majority of the three nearest vectors outside a vector's fold."""
    rows = _rows(spark, d)
    return X.classify(rows, _labels(spark, d), rows.select((F.col("sample_id") % 5).alias("split_id"), "sample_id"), "knn")


#: Two features by sample, the training rows of each fold (all others), and their sums.
_TWO = FEATURES + ", x AS (SELECT sample_id, any_value(label)::VARCHAR AS label, max(value) FILTER (pos = 0) AS a, max(value) FILTER (pos = 1) AS b, sample_id % 5 AS split_id FROM features GROUP BY sample_id), t AS (SELECT f.split_id, x.label, a, b FROM (SELECT DISTINCT split_id FROM x) f JOIN x ON x.split_id <> f.split_id), m AS (SELECT split_id, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) * count(*) + 1 AS aa, var_pop(b) * count(*) + 1 AS bb, covar_pop(a, b) * count(*) AS ab FROM t GROUP BY 1)"
_BEST = "SELECT x.split_id, sample_id, any_value(x.label) AS y_true, first(s.label ORDER BY {score} DESC, s.label) AS y_pred FROM x JOIN s USING (split_id) GROUP BY ALL"

#: One-versus-rest ridge with penalty 1: the weights of each class from two normal equations.
_RIDGE = f"WITH {_TWO}, c AS (SELECT split_id, label, any_value(n) AS n, any_value(ma) AS ma, any_value(mb) AS mb, any_value(aa) AS aa, any_value(bb) AS bb, any_value(ab) AS ab, count(*) AS own, sum(a - ma) AS ay, sum(b - mb) AS b_y FROM t JOIN m USING (split_id) GROUP BY 1, 2), s AS (SELECT split_id, label, (ay * bb - b_y * ab) / (aa * bb - ab * ab) AS wa, (b_y * aa - ay * ab) / (aa * bb - ab * ab) AS wb, own / n - wa * ma - wb * mb AS w0 FROM c) " + _BEST.format(score="s.wa * x.a + s.wb * x.b + s.w0")
#: Linear discriminants: class means, the pooled covariance and class shares.
_LDA = f"WITH {_TWO}, c AS (SELECT split_id, label, count(*) AS own, avg(a) AS ca, avg(b) AS cb, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, covar_pop(a, b) * count(*) AS ab FROM t GROUP BY 1, 2), p AS (SELECT split_id, sum(own) AS n, sum(aa) / (sum(own) - count(*)) AS aa, sum(bb) / (sum(own) - count(*)) AS bb, sum(ab) / (sum(own) - count(*)) AS ab FROM c GROUP BY 1), s AS (SELECT split_id, label, (p.bb * ca - p.ab * cb) / (p.aa * p.bb - p.ab * p.ab) AS wa, (p.aa * cb - p.ab * ca) / (p.aa * p.bb - p.ab * p.ab) AS wb, ln(own / n) - (wa * ca + wb * cb) / 2 AS w0 FROM c JOIN p USING (split_id)) " + _BEST.format(score="s.wa * x.a + s.wb * x.b + s.w0")

for _model, _sql in (("ridge", _RIDGE), ("lda", _LDA)):

    @query(f"{_model}_predictions_two_features", _sql)
    def _(spark, d, model=_model):
        """Classes of all vectors from their first two features, each fold from the others."""
        rows = _rows(spark, d).select("sample_id", F.slice("x", 1, 2).alias("x"))
        return X.classify(rows, _labels(spark, d), rows.select((F.col("sample_id") % 5).alias("split_id"), "sample_id"), model, variance=1.0)


#: The same two features, in units of their deviations over the training rows of each fold.
_SCALED = _TWO.replace("var_pop(a) * count(*) + 1 AS aa, var_pop(b) * count(*) + 1 AS bb, covar_pop(a, b) * count(*) AS ab", "stddev_pop(a) AS da, stddev_pop(b) AS db, count(*) + 1.0 AS aa, count(*) + 1.0 AS bb, corr(a, b) * count(*) AS ab")
_RIDGE_SCALED = f"WITH {_SCALED}, c AS (SELECT split_id, label, any_value(n) AS n, any_value(ma) AS ma, any_value(mb) AS mb, any_value(da) AS da, any_value(db) AS db, any_value(aa) AS aa, any_value(bb) AS bb, any_value(ab) AS ab, count(*) AS own, sum((a - ma) / da) AS ay, sum((b - mb) / db) AS b_y FROM t JOIN m USING (split_id) GROUP BY 1, 2), s AS (SELECT split_id, label, (ay * bb - b_y * ab) / (aa * bb - ab * ab) / da AS wa, (b_y * aa - ay * ab) / (aa * bb - ab * ab) / db AS wb, own / n - (ay * bb - b_y * ab) / (aa * bb - ab * ab) / da * ma - (b_y * aa - ay * ab) / (aa * bb - ab * ab) / db * mb AS w0 FROM c) " + _BEST.format(score="s.wa * x.a + s.wb * x.b + s.w0")


def _stretched(spark, d):
    """The first two features of all vectors, one of them far from 0 and in a thousandfold unit."""
    return _rows(spark, d).select("sample_id", F.array(F.col("x")[0], F.col("x")[1] * 1000.0 + 1e6).alias("x"))


@query("ridge_scaled_two_features", _RIDGE_SCALED.replace("max(value) FILTER (pos = 1) AS b", "max(value) FILTER (pos = 1) * 1000 + 1000000 AS b"))
def _(spark, d):
    """Classes from two features of unlike units, scaled by the training rows of each fold."""
    rows = _stretched(spark, d)
    return X.classify(rows, _labels(spark, d), rows.select((F.col("sample_id") % 5).alias("split_id"), "sample_id"), scale="standard")


for _model in ("ridge", "lda", "knn"):

    @query(f"classify_{_model}_scaled")
    def _(spark, d, model=_model):
        """Five stratified folds on all features, scaled by the training rows of each."""
        lab = _labels(spark, d)
        return _rounded(J.classification_job(_rows(spark, d), lab, P.stratified_folds(lab, "label", 5), model, scale="standard"), "split_id", digits=6)


@query("knn_predictions_scaled", f"WITH {FEATURES}, u AS (SELECT f.split_id, pos, stddev_pop(value) AS by FROM (SELECT DISTINCT sample_id % 5 AS split_id FROM features) f JOIN features t ON t.sample_id % 5 <> f.split_id GROUP BY ALL), d AS (SELECT t.sample_id, o.sample_id AS other, sum((t.value - o.value) * (t.value - o.value) / (u.by * u.by)) AS d FROM features t JOIN u ON u.split_id = t.sample_id % 5 AND u.pos = t.pos JOIN features o ON t.pos = o.pos AND t.sample_id % 5 <> o.sample_id % 5 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d, other) AS k FROM d), v AS (SELECT vec_id AS i, label::VARCHAR AS v FROM embeddings), n AS (SELECT k.sample_id, v.v, count(*) AS n FROM k JOIN v ON v.i = k.other WHERE k.k <= 3 GROUP BY 1, 2) SELECT sample_id % 5 AS split_id, sample_id, any_value(t.v) AS y_true, first(n.v ORDER BY n.n DESC, n.v) AS y_pred FROM n JOIN v t ON t.i = n.sample_id GROUP BY ALL")
def _(spark, d):
    """Majority of the three nearest vectors outside a vector's fold, in the units of the others."""
    rows = _rows(spark, d)
    return X.classify(rows, _labels(spark, d), rows.select((F.col("sample_id") % 5).alias("split_id"), "sample_id"), "knn", scale="standard")


#: Leave-one-out with scaling: each row's system from the sums less the row, in its own units.
_LOO_SCALED = f"WITH {FEATURES}, x AS (SELECT sample_id, any_value(label)::DOUBLE AS y, max(value) FILTER (pos = 0) AS a, max(value) FILTER (pos = 1) * 1000 + 1000000 AS b FROM features GROUP BY 1), c AS (SELECT sample_id, y, avg(y) OVER () AS my, y - avg(y) OVER () AS dy, a - avg(a) OVER () AS da, b - avg(b) OVER () AS db, count(*) OVER ()::DOUBLE AS n FROM x), s AS (SELECT sum(da * da) AS aa, sum(db * db) AS bb, sum(da * db) AS ab, sum(da * dy) AS ay, sum(db * dy) AS b_y FROM c), r AS (SELECT sample_id, y, my, dy, da, db, n, n / (n - 1) AS f, aa - n / (n - 1) * da * da AS aa, bb - n / (n - 1) * db * db AS bb, ab - n / (n - 1) * da * db AS ab, ay - n / (n - 1) * da * dy AS ay, b_y - n / (n - 1) * db * dy AS b_y FROM c, s), v AS (SELECT *, aa * (1 + 1 / (n - 1)) AS ra, bb * (1 + 1 / (n - 1)) AS rb FROM r), w AS (SELECT *, (ay * rb - b_y * ab) / (ra * rb - ab * ab) AS wa, (b_y * ra - ay * ab) / (ra * rb - ab * ab) AS wb FROM v), p AS (SELECT sample_id, y AS y_true, my - dy / (n - 1) + f * (da * wa + db * wb) AS y_pred, wa * sqrt(aa / (n - 1)) AS ka, wb * sqrt(bb / (n - 1)) AS kb FROM w) "


def _loo_scaled(spark, d):
    return J.vintage_regression(_stretched(spark, d), _labels(spark, d).select("sample_id", F.col("label").cast("double").alias("value")), scale="standard", coefficients=True)


@query("vintage_loo_scaled", _LOO_SCALED + "SELECT sample_id, y_true, round(y_pred, 5) AS y_pred, round(ka, 5) AS coef_a, round(kb, 5) AS coef_b FROM p")
def _(spark, d):
    """Leave-one-out predictions and coefficients, every fold scaled by its own training rows."""
    return _loo_scaled(spark, d).select("sample_id", "y_true", F.round("y_pred", 5).alias("y_pred"), F.round(F.col("weights")[0], 5).alias("coef_a"), F.round(F.col("weights")[1], 5).alias("coef_b"))


@query("vintage_loo_report", _LOO_SCALED + "SELECT round(avg(abs(y_pred - y_true)), 5) AS mae, round(corr(y_true, y_pred), 4) AS r, round(regr_slope(y_pred, y_true), 5) AS slope, round(regr_intercept(y_pred, y_true), 5) AS intercept, round(avg((abs(y_pred - y_true) <= 2)::INTEGER), 6) AS within_2 FROM p")
def _(spark, d):
    r = J.vintage_report(_loo_scaled(spark, d))
    return r.select(*[F.round(c, n).alias(c) for c, n in (("mae", 5), ("r", 4), ("slope", 5), ("intercept", 5), ("within_2", 6))])


@query("vintage_loo_coefficients", _LOO_SCALED + "SELECT pos, round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS std, round(avg((sign(w) = sign(m))::INTEGER), 6) AS agree FROM (SELECT pos, w, avg(w) OVER (PARTITION BY pos) AS m FROM (SELECT 0 AS pos, ka AS w FROM p UNION ALL SELECT 1, kb FROM p)) GROUP BY pos")
def _(spark, d):
    return _rounded(J.fold_coefficients(_loo_scaled(spark, d)), "pos", digits=6)


@query("vintage_loo_scaled_all_features")
def _(spark, d):
    """The coefficients of all features over the folds of scaled leave-one-out."""
    told = J.vintage_regression(_rows(spark, d), _labels(spark, d).select("sample_id", F.col("label").cast("double").alias("value")), scale="standard", coefficients=True)
    return _rounded(J.fold_coefficients(told), "pos", digits=6)


#: One feature, two targets, and the leading axis of the targets' products over the training rows.
_REDUCED = f"WITH {FEATURES}, x AS (SELECT sample_id, sample_id % 5 AS fold, max(value) FILTER (pos = 0) AS x, max(value) FILTER (pos = 1) AS a, max(value) FILTER (pos = 2) * 3 AS b FROM features GROUP BY 1), t AS (SELECT f.fold, count(*) AS n, avg(x) AS mx, avg(a) AS ma, avg(b) AS mb, var_pop(x) * count(*) + 1 AS xx, covar_pop(x, a) * count(*) AS xa, covar_pop(x, b) * count(*) AS xb, atan2(2 * covar_pop(a, b), var_pop(a) - var_pop(b)) / 2 AS w FROM (SELECT DISTINCT fold FROM x) f JOIN x ON x.fold <> f.fold GROUP BY 1), p AS (SELECT x.fold, sample_id, a, b, ma, mb, (x.x - mx) * (xa * cos(w) + xb * sin(w)) / xx AS v, w FROM x JOIN t USING (fold)) SELECT fold AS split_id, sample_id, 'a' AS attribute, round(a, 6) AS y_true, round(ma + v * cos(w), 6) AS y_pred FROM p UNION ALL SELECT fold, sample_id, 'b', round(b, 6), round(mb + v * sin(w), 6) FROM p"


@query("target_components", _REDUCED)
def _(spark, d):
    """Two targets told through their leading principal component."""
    rows = _rows(spark, d).select("sample_id", F.array(F.col("x")[0]).alias("x"), F.array(F.col("x")[1], F.col("x")[2] * 3).alias("y"))
    test = rows.select((F.col("sample_id") % 5).alias("split_id"), "sample_id")
    return X.regress(rows, ["a", "b"], test, components=1).select("split_id", "sample_id", "attribute", F.round("y_true", 6).alias("y_true"), F.round("y_pred", 6).alias("y_pred"))


@query("classify_ridge_concatenated")
def _(spark, d):
    """All suppliers by all their scans of all channels, many features for few samples."""
    s = scans(spark, d)
    lab = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("sample_id")).distinct().withColumn("label", F.concat(F.lit("c"), (F.col("sample_id") % 4).cast("string")))
    f = S.assemble(s, "concatenated").select("sample_id", ((F.col("a") - 41) * 200 + F.col("b")).cast("long").alias("pos"), "value")
    return _rounded(J.wide_classification_job(f, lab, P.stratified_folds(lab, "label", 5)), "split_id", digits=6)


@query("ridge_one_feature", f"WITH {FEATURES}, x AS (SELECT sample_id, label::DOUBLE AS y, value AS x, sample_id % 5 AS fold FROM features WHERE pos = 0), t AS (SELECT f.fold, avg(x) AS mx, avg(y) AS my, sum((x) * (y)) - count(*) * avg(x) * avg(y) AS sxy, sum(x * x) - count(*) * avg(x) * avg(x) AS sxx FROM (SELECT DISTINCT fold FROM x) f JOIN x ON x.fold <> f.fold GROUP BY 1) SELECT x.fold AS split_id, sample_id, round(y, 6) AS y_true, round(my + (x.x - mx) * sxy / (sxx + 1), 5) AS y_pred FROM x JOIN t USING (fold)")
def _(spark, d):
    rows = _rows(spark, d).select("sample_id", F.slice("x", 1, 1).alias("x")).join(_labels(spark, d), "sample_id").select("sample_id", "x", F.array(F.col("label").cast("double")).alias("y"))
    test = rows.select((F.col("sample_id") % 5).alias("split_id"), "sample_id")
    return X.regress(rows, ["label"], test).select("split_id", "sample_id", "y_true", F.round("y_pred", 5).alias("y_pred"))


@query("pca_variance", f"WITH {FEATURES}, c AS (SELECT sample_id, pos, value - avg(value) OVER (PARTITION BY pos) AS v FROM features) SELECT round(sum(v * v), 2) AS total FROM c")
def _(spark, d):
    """All components together hold the whole variance."""
    return X.pca(_rows(spark, d)).agg(F.round(F.sum(F.col("score") * F.col("score")), 2).alias("total"))


@query("pca_scores_two_features", f"WITH {FEATURES}, x AS (SELECT sample_id, max(value) FILTER (pos = 0) AS a, max(value) FILTER (pos = 1) * 2 AS b FROM features GROUP BY 1), m AS (SELECT avg(a) AS ma, avg(b) AS mb, atan2(2 * covar_pop(a, b), var_pop(a) - var_pop(b)) / 2 AS w FROM x), v AS (SELECT ma, mb, cos(w) AS p, sin(w) AS q FROM m), s AS (SELECT *, CASE WHEN abs(p) >= abs(q) THEN sign(p) ELSE sign(q) END AS f, CASE WHEN abs(q) >= abs(p) THEN sign(-q) ELSE sign(p) END AS g FROM v) SELECT sample_id, unnest([0, 1])::INTEGER AS component, unnest([round(f * ((a - ma) * p + (b - mb) * q), 6), round(g * ((b - mb) * p - (a - ma) * q), 6)]) AS score FROM x, s")
def _(spark, d):
    """The scores of all vectors on both components of their first two features."""
    rows = _rows(spark, d).select("sample_id", F.array(F.col("x")[0], F.col("x")[1] * 2).alias("x"))
    return X.pca(rows).select("sample_id", "component", F.round("score", 6).alias("score"))


@query("kmeans_best_k")
def _(spark, d):
    p = X.pca(_rows(spark, d), components=2).groupBy("sample_id").pivot("component", [0, 1]).agg(F.first("score"))
    return D.kmeans_best(p.select(F.col("0").alias("x"), F.col("1").alias("y")), ["x", "y"], 9)


@query("classify_forest")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), "label", F.col("embedding").alias("features"), (F.col("vec_id") % 5 == 0).alias("held"))
    m = M.fold_metrics(D.ml_evaluate(e, "rfc", "held"))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


def _binned(spark, d, read=scans):
    """The scans of all suppliers in 4 x 2 cubes, and four classes."""
    s = read(spark, d)
    lab = s.select("sample_id").distinct().withColumn("label", F.concat(F.lit("c"), (F.col("sample_id") % 4).cast("string")))
    return S.with_cubes(s, 200, 4, 41, 7, 2), lab


def _survived(out):
    return out.select("fold", "step", F.expr("cube div 10000").cast("int").alias("rt_bin"), (F.col("cube") % 10_000).alias("mz_bin"), F.round("inner_accuracy", 6).alias("inner_accuracy"), F.round("outer_accuracy", 6).alias("outer_accuracy"))


for _mode in ("remove", "add"):

    @query(f"survival_{_mode}")
    def _(spark, d, mode=_mode):
        binned, lab = _binned(spark, d)
        rows, cubes = G.wide_cubes(V.cube_features(binned, "tis"))
        return _survived(G.survival(rows, lab, P.stratified_folds(lab, "label", 3), cubes, mode))


@query("survival_look_ahead")
def _(spark, d):
    """Addition with look-ahead: a cube's score and half of the best gain that a second one brings."""
    binned, lab = _binned(spark, d)
    rows, cubes = G.wide_cubes(V.cube_features(binned, "tis"))
    return _survived(G.survival(rows, lab, P.stratified_folds(lab, "label", 2), cubes, "add", count=3, look_ahead=0.5))


@query("cell_accuracy_map")
def _(spark, d):
    """Each cube's chromatogram on its own."""
    binned, lab = _binned(spark, d)
    rows, cubes = G.wide_cubes(V.cube_features(binned, "tic"))
    out = G.set_scores(rows, lab, sorted(cubes.items()))
    return out.select(F.expr("set_id div 10000").cast("int").alias("rt_bin"), (F.col("set_id") % 10_000).alias("mz_bin"), F.round("accuracy", 6).alias("accuracy"))


@query("random_channel_sets")
def _(spark, d):
    """500 random sets of each of 32 sizes, with the features of all vectors as channels."""
    sets = V.random_sets(spark, list(range(64)), list(range(1, 33)), 500)
    scored = G.set_scores(_rows(spark, d), _labels(spark, d), [(r.set_id, list(r.channels)) for r in sets.collect()])  # the list of sets is fixed by sizes and draws
    return sets.join(scored.withColumn("set_id", F.col("set_id").cast("long")), "set_id").select("set_id", "k", F.array_join(F.transform("channels", lambda c: c.cast("string")), ",").alias("channels"), F.round("accuracy", 6).alias("accuracy"))


for _how, _near in (("", 0), ("_smooth", 0), ("_chain", 0), ("_chain_scan", 2)):

    @query(f"align_to_reference{_how}")
    def _(spark, d, how=_how, near=_near):
        """Every sample warped onto the run closest to the mean, by a lag curve or by chains of peaks."""
        s = scans(spark, d)
        out = A.align_to_reference(s, S.closest_to_mean(S.tic(s)), 200, sigma=2, most=10, tolerance=10, how="chain" if "chain" in how else how[1:] or "curve", neighbours=near)
        return out.groupBy("sample_id").agg(F.first("lag").alias("lag"), F.round(F.sum("intensity"), 4).alias("total"), F.round(F.max(F.abs("scan_lag")), 4).alias("largest_lag"))


_TRACES = f"WITH {SCANS}, tic AS (SELECT sample_id, scan_idx, sum(intensity) AS tic FROM scans WHERE scan_idx BETWEEN 0 AND 199 GROUP BY ALL), trace AS (SELECT s.sample_id, r.scan_idx, coalesce(t.tic, 0)::DOUBLE AS tic FROM (SELECT DISTINCT sample_id FROM tic) s CROSS JOIN (SELECT unnest(range(0, 200)) AS scan_idx) r LEFT JOIN tic t USING (sample_id, scan_idx)), ref AS (SELECT scan_idx, tic FROM trace WHERE sample_id = (SELECT min(sample_id) FROM tic))"


@query("global_lag", _TRACES + ", c AS (SELECT y.sample_id, (x.scan_idx - y.scan_idx)::INTEGER AS lag, round(sum(x.tic * y.tic), 4) AS score FROM ref x JOIN trace y ON abs(x.scan_idx - y.scan_idx) <= 60 GROUP BY ALL) SELECT sample_id, 1.0::DOUBLE AS scale, lag, score FROM c QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, lag) = 1")
def _(spark, d):
    """The lag of the largest cross-correlation with the run of the smallest id."""
    tics = S.tic(scans(spark, d))
    out = A.global_lag(tics, tics.agg(F.min("sample_id").alias("sample_id")), 200, 60)
    return out.select("sample_id", "scale", "lag", F.round("score", 4).alias("score"))


@query("global_lag_scales")
def _(spark, d):
    """The same over five stretches of each run."""
    tics = S.tic(scans(spark, d))
    return _rounded(A.global_lag(tics, tics.agg(F.min("sample_id").alias("sample_id")), 200, 60, [0.96, 0.98, 1.0, 1.02, 1.04]), "sample_id", "lag")


@query("global_lag_leading", _TRACES + ", p AS (SELECT sample_id, scan_idx, tic - avg(tic) OVER (PARTITION BY sample_id) AS v FROM trace WHERE scan_idx < 66), r AS (SELECT scan_idx, tic - avg(tic) OVER () AS v FROM ref WHERE scan_idx < 66), c AS (SELECT p.sample_id, (r.scan_idx - p.scan_idx)::INTEGER AS lag, round(sum(r.v * p.v), 4) AS score FROM r CROSS JOIN p GROUP BY ALL) SELECT sample_id, greatest(-20, least(20, lag))::INTEGER AS lag, score FROM c QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, lag) = 1")
def _(spark, d):
    """The lag of the mean-centred first thirds, cut to 20 scans."""
    tics = S.tic(scans(spark, d))
    out = A.global_lag(tics, tics.agg(F.min("sample_id").alias("sample_id")), 200, 20, how="leading")
    return out.select("sample_id", "lag", F.round("score", 4).alias("score"))


#: The local maxima of each trace, and how their spectra go with those of the first run's.
_PEAKS = f"WITH {PEAKS}, k AS (SELECT sample_id, scan_idx FROM peaks), first AS (SELECT min(sample_id) AS i FROM scans), mz AS (SELECT DISTINCT mz FROM scans), p AS (SELECT b.sample_id, a.scan_idx AS ref_at, b.scan_idx AS own_at FROM k a JOIN first ON a.sample_id = first.i JOIN k b ON abs(a.scan_idx - b.scan_idx) <= 3), v AS (SELECT p.sample_id, ref_at, own_at, coalesce(x.intensity, 0) AS x, coalesce(y.intensity, 0) AS y FROM p CROSS JOIN mz CROSS JOIN first LEFT JOIN scans x ON x.sample_id = first.i AND x.scan_idx = ref_at AND x.mz = mz.mz LEFT JOIN scans y ON y.sample_id = p.sample_id AND y.scan_idx = own_at AND y.mz = mz.mz), c AS (SELECT sample_id, ref_at, own_at, corr(x, y) AS r, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM v GROUP BY ALL HAVING stddev_pop(x) > 0 AND stddev_pop(y) > 0)"


def _peak_candidates(spark, d):
    s = scans(spark, d)
    peaks = S.local_maxima(S.tic(s)).select("sample_id", "scan_idx")
    first = s.agg(F.min("sample_id").alias("sample_id"))
    own = s.join(peaks, ["sample_id", "scan_idx"], "left_semi").join(F.broadcast(first), "sample_id", "left_semi")
    return A.peak_candidates(peaks, own.select("scan_idx", "mz", "intensity"), s, 3)


@query("peak_candidates", _PEAKS + " SELECT sample_id, ref_at, own_at, round(r, 6) AS r FROM c")
def _(spark, d):
    """Peaks of all runs near peaks of the run with the smallest id, and how alike their spectra are."""
    return _peak_candidates(spark, d).select("sample_id", "ref_at", "own_at", F.round("r", 6).alias("r"))


@query("matched_peaks", _PEAKS.replace("WITH ", "WITH RECURSIVE ", 1) + ", o AS (SELECT sample_id, ref_at, own_at, round(r, 12) AS r, dense_rank() OVER (PARTITION BY sample_id ORDER BY ref_at) AS k FROM c WHERE r > 0.2), f AS (SELECT sample_id, 0::BIGINT AS k, -1 AS last, -1 AS ref_at, NULL::DOUBLE AS r, FALSE AS took FROM (SELECT DISTINCT sample_id FROM o) UNION ALL SELECT f.sample_id, f.k + 1, coalesce(b.b.own_at, f.last), coalesce(b.b.ref_at, f.ref_at), b.b.r, b.b IS NOT NULL FROM f LEFT JOIN LATERAL (SELECT max_by({'ref_at': o.ref_at, 'own_at': o.own_at, 'r': o.r}, {'r': o.r, 'back': -o.own_at}) AS b FROM o WHERE o.sample_id = f.sample_id AND o.k = f.k + 1 AND o.own_at > f.last) b ON TRUE WHERE f.k < (SELECT max(k) FROM o)) SELECT sample_id, ref_at::INTEGER AS ref_at, last::INTEGER AS own_at, round(r, 6) AS r FROM f WHERE took")
def _(spark, d):
    """The peaks that match those of the run with the smallest id, in rising order."""
    return A.matched_peaks(_peak_candidates(spark, d), 0.2).select("sample_id", "ref_at", "own_at", F.round("r", 6).alias("r"))


_SCORE = {"corr": "sum(x.z * y.z)", "l1": "-sum(abs(x.z - y.z))", "l2": "-sqrt(sum((x.z - y.z) * (x.z - y.z)))", "mse": "-avg((x.z - y.z) * (x.z - y.z))"}
_SIDE = "SELECT sample_id, lo, k, CASE WHEN stddev_pop(tic) OVER (PARTITION BY sample_id, lo) > 0 THEN (tic - avg(tic) OVER (PARTITION BY sample_id, lo)) / stddev_pop(tic) OVER (PARTITION BY sample_id, lo) ELSE 0 END AS z FROM (SELECT sample_id, lo, scan_idx - lo AS k, tic FROM trace, (SELECT unnest(range(0, 181)) AS lo) WHERE scan_idx - lo BETWEEN 0 AND 19)"

for _how in _SCORE:

    @query(
        f"lag_profile_{_how}",
        f"WITH {SCANS}, tic AS (SELECT sample_id, scan_idx, sum(intensity) AS tic FROM scans GROUP BY ALL), trace AS (SELECT s.sample_id, r.scan_idx, coalesce(t.tic, 0)::DOUBLE AS tic FROM (SELECT DISTINCT sample_id FROM tic) s CROSS JOIN (SELECT unnest(range(0, 200)) AS scan_idx) r LEFT JOIN tic t USING (sample_id, scan_idx)), side AS ({_SIDE}), "
        f"d AS (SELECT y.sample_id, x.lo // 20 AS w, y.lo - x.lo AS lag, round({_SCORE[_how]}, 9) AS score FROM side x JOIN side y ON x.k = y.k AND x.sample_id = (SELECT min(sample_id) FROM tic) AND x.lo % 20 = 0 AND abs(y.lo - x.lo) <= 5 GROUP BY 1, 2, 3) "
        "SELECT sample_id, w::INTEGER AS window, lag::INTEGER AS lag FROM d QUALIFY row_number() OVER (PARTITION BY sample_id, w ORDER BY score DESC, abs(lag), lag) = 1",
    )
    def _(spark, d, how=_how):
        """Lags of windows of 20 scans against the run with the smallest id."""
        tics = S.tic(scans(spark, d))
        return A.lag_profile(tics, tics.agg(F.min("sample_id").alias("sample_id")), 200, 20, 5, how)


@query("per_origin_metrics")
def _(spark, d):
    lab = _labels(spark, d)
    origins = lab.select("sample_id", (F.col("sample_id") % 3).alias("origin"))
    return _rounded(J.per_origin(_rows(spark, d), lab, P.stratified_folds(lab, "label", 5), origins), "origin", digits=6)


@query("hold_out_origin")
def _(spark, d):
    lab = _labels(spark, d)
    return _rounded(J.hold_out_origin(_rows(spark, d), lab, lab.select("sample_id", (F.col("sample_id") % 3).alias("origin"))), "origin", digits=6)


@query("hold_out_origin_two_features", f"WITH p AS ({_RIDGE.replace('sample_id % 5', 'sample_id % 3')}), c AS (SELECT split_id, y_true, count(*) AS n, sum((y_true = y_pred)::INTEGER) AS hits FROM p GROUP BY 1, 2) SELECT split_id AS origin, round(sum(hits) / sum(n), 6) AS accuracy, round(avg(hits / n), 6) AS balanced_accuracy FROM c GROUP BY 1")
def _(spark, d):
    """Each origin's vectors classified by ridge on the first two features of the others."""
    lab = _labels(spark, d)
    rows = _rows(spark, d).select("sample_id", F.slice("x", 1, 2).alias("x"))
    out = J.hold_out_origin(rows, lab, lab.select("sample_id", (F.col("sample_id") % 3).alias("origin")))
    return out.select(F.col("origin").cast("long").alias("origin"), F.round("accuracy", 6).alias("accuracy"), F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


#: An origin's own means and deviations beside those of all others.
_ITSELF = f"WITH {_SCALED.replace('sample_id % 5', 'sample_id % 3')}, o AS (SELECT split_id, avg(a) AS oa, avg(b) AS ob, stddev_pop(a) AS ua, stddev_pop(b) AS ub FROM x GROUP BY 1), c AS (SELECT split_id, label, any_value(n) AS n, any_value(aa) AS aa, any_value(bb) AS bb, any_value(ab) AS ab, count(*) AS own, sum((a - ma) / da) AS ay, sum((b - mb) / db) AS b_y FROM t JOIN m USING (split_id) GROUP BY 1, 2), s AS (SELECT split_id, label, (ay * bb - b_y * ab) / (aa * bb - ab * ab) AS wa, (b_y * aa - ay * ab) / (aa * bb - ab * ab) AS wb, own / n AS w0 FROM c) SELECT x.split_id, sample_id, any_value(x.label) AS y_true, first(s.label ORDER BY s.wa * (x.a - o.oa) / o.ua + s.wb * (x.b - o.ob) / o.ub + s.w0 DESC, s.label) AS y_pred FROM x JOIN s USING (split_id) JOIN o USING (split_id) GROUP BY ALL"


@query("hold_out_origin_scaled_by_itself", f"WITH p AS ({_ITSELF}), c AS (SELECT split_id, y_true, count(*) AS n, sum((y_true = y_pred)::INTEGER) AS hits FROM p GROUP BY 1, 2) SELECT split_id AS origin, round(sum(hits) / sum(n), 6) AS accuracy, round(avg(hits / n), 6) AS balanced_accuracy FROM c GROUP BY 1")
def _(spark, d):
    """Each origin's vectors, in units of their own deviations, by ridge on the scaled features of the others."""
    lab = _labels(spark, d)
    rows = _rows(spark, d).select("sample_id", F.slice("x", 1, 2).alias("x"))
    out = J.hold_out_origin(rows, lab, lab.select("sample_id", (F.col("sample_id") % 3).alias("origin")), scale="standard", by_itself=True)
    return out.select(F.col("origin").cast("long").alias("origin"), F.round("accuracy", 6).alias("accuracy"), F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


@query(
    "vintage_loo_regression",
    f"WITH {FEATURES}, x AS (SELECT sample_id, any_value(label)::DOUBLE AS y, max(value) FILTER (pos = 0) AS a, max(value) FILTER (pos = 1) AS b FROM features GROUP BY 1), c AS (SELECT y, y - avg(y) OVER () AS dy, a - avg(a) OVER () AS da, b - avg(b) OVER () AS db, count(*) OVER () AS n FROM x), s AS (SELECT sum(da * da) + 1 AS aa, sum(db * db) + 1 AS bb, sum(da * db) AS ab, sum(da * dy) AS ay, sum(db * dy) AS by_ FROM c), p AS (SELECT y, dy, (da * (ay * bb - by_ * ab) + db * (by_ * aa - ay * ab)) / (aa * bb - ab * ab) AS fit, 1.0 / n + (da * da * bb - 2 * da * db * ab + db * db * aa) / (aa * bb - ab * ab) AS h FROM c, s), q AS (SELECT y, y - (dy - fit) / (1 - h) AS p FROM p) SELECT round(avg(abs(p - y)), 5) AS mae, round(sqrt(avg((p - y) * (p - y))), 5) AS rmse, round(corr(y, p), 4) AS r FROM q",
)
def _(spark, d):
    rows = _rows(spark, d).select("sample_id", F.slice("x", 1, 2).alias("x"))
    out = J.vintage_regression(rows, _labels(spark, d).select("sample_id", F.col("label").cast("double").alias("value")))
    return M.regression_metrics(out).select(F.round("mae", 5).alias("mae"), F.round("rmse", 5).alias("rmse"), F.round("r", 4).alias("r"))


@query("vintage_loo_all_features")
def _(spark, d):
    out = J.vintage_regression(_rows(spark, d), _labels(spark, d).select("sample_id", F.col("label").cast("double").alias("value")))
    return out.select("sample_id", "y_true", F.round("y_pred", 6).alias("y_pred"))


@query("random_subset_regressions")
def _(spark, d):
    m = J.random_subsets(_rows(spark, d), _labels(spark, d).select("sample_id", F.col("label").cast("double").alias("value")), 40, 5)
    return m.select("repeat", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "r2", "r")])


for _control in ("", "_shuffled", "_constant"):

    @query(f"sensory_ridge{_control}")
    def _(spark, d, control=_control):
        """Scores per wine and taster from the wine's embedding and the taster, and two controls."""
        rows = _scores(spark, d).select(F.concat_ws("/", "wine", "taster").alias("row_id"), "wine", "taster", "y")
        out = J.sensory_model(_wines(spark, d), rows, NAMES, TASTERS, shuffled=control == "_shuffled", constant=control == "_constant")
        m = M.regression_metrics(out, "attribute")
        return m.select("attribute", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "r2", "r")])


for _option, _given in (("scaled", {"scale": "standard"}), ("component", {"components": 1}), ("centred", {"centred": True})):

    @query(f"sensory_ridge_{_option}")
    def _(spark, d, given=_given):
        """The sensory model with scaled features, one component of the targets, or scores about each taster's mean."""
        rows = _scores(spark, d).select(F.concat_ws("/", "wine", "taster").alias("row_id"), "wine", "taster", "y")
        m = M.regression_metrics(J.sensory_model(_wines(spark, d), rows, NAMES, TASTERS, **given), "attribute")
        return m.select("attribute", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "r2", "r")])


@query("taster_factors_held_out")
def _(spark, d):
    """Held-out R2 of scores without and with each taster's factor from inner folds."""
    rows = _scores(spark, d).select(F.concat_ws("/", "wine", "taster").alias("row_id"), "wine", "taster", "y")
    plain, scaled = J.scaled_taster_model(_wines(spark, d), rows, NAMES, TASTERS)
    r2 = lambda t, name: M.regression_metrics(t, "attribute").select("attribute", F.round("r2", 5).alias(name))
    return r2(plain, "r2_plain").join(r2(scaled, "r2_scaled"), "attribute")


@query("self_versus_group", f"WITH {SENSORY}, m AS (SELECT wine, taster, avg(fruity) AS v FROM sensory GROUP BY ALL), o AS (SELECT a.taster, a.wine, any_value(a.v) AS t, avg(b.v) AS p FROM m a JOIN m b ON a.wine = b.wine AND a.taster <> b.taster GROUP BY 1, 2) SELECT taster, round(1 - sum((p - t) * (p - t)) / (var_pop(t) * count(*)), 4) AS r2_group, round(corr(t, p), 4) AS r FROM o GROUP BY 1")
def _(spark, d):
    s = sensory(spark, d).groupBy("wine", "taster").agg(F.avg("fruity").alias("value")).withColumn("attribute", F.lit("fruity"))
    return J.self_versus_group(s).select("taster", F.round("r2_group", 4).alias("r2_group"), F.round("r", 4).alias("r"))


@query("self_and_group_models")
def _(spark, d):
    return _rounded(J.self_and_group_models(_wines(spark, d), _scores(spark, d), NAMES), "taster", "attribute")


@query("taster_model_metrics")
def _(spark, d):
    return _rounded(J.taster_models(_wines(spark, d), _scores(spark, d), NAMES)[0], "taster", "attribute")


@query("taster_model_weights")
def _(spark, d):
    return _rounded(J.taster_models(_wines(spark, d), _scores(spark, d), NAMES)[1], "taster", "target", "pos", digits=6)


def _profiles(spark, d):
    """Profiles by customer: mean scores with the taster and the wine as labels."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("taster"), F.col("c_nationkey").cast("string").alias("wine"), F.col("c_acctbal").alias("a"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("sample_id")).agg(F.avg("o_totalprice").alias("b"), F.count("*").alias("n"))
    return c.join(o, "sample_id").select("sample_id", "taster", "wine", F.array(F.col("a") / 1000, F.col("b") / 1e5, F.col("n") / 10).alias("x"))


@query("tasters_from_profiles")
def _(spark, d):
    """Stratified folds, as the label is the taster."""
    p = _profiles(spark, d)
    lab = p.select("sample_id", F.col("taster").alias("label"))
    return _rounded(J.profile_labels(p.select("sample_id", "x"), lab, P.stratified_folds(lab, "label", 10, 2), 10)[0], "repeat", digits=6)


@query("segments_from_profiles_confusion")
def _(spark, d):
    """Folds grouped by wine, as the label is not the taster: the confusion in shares."""
    p = _profiles(spark, d)
    lab = p.select("sample_id", F.when(F.col("x")[2] > 1, "many").otherwise("few").alias("label"))
    return _rounded(J.profile_labels(p.select("sample_id", F.slice("x", 1, 2).alias("x")), lab, P.group_folds(p, "wine", 10, repeats=2), 10)[1], "y_true", "y_pred", digits=6)


@query("age_regression")
def _(spark, d):
    ages = _ages(spark, d).join(_rows(spark, d).select("sample_id"), "sample_id")
    m = J.age_regression(_rows(spark, d), ages)
    return m.select("repeat", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "r2", "r", "within_5")])


@query("age_classes")
def _(spark, d):
    ages = _ages(spark, d).join(_rows(spark, d).select("sample_id"), "sample_id")
    return _rounded(J.age_classes(_rows(spark, d), ages, 10), "repeat", digits=6)


@query("pca_classification_repeats")
def _(spark, d):
    return _rounded(J.pca_classification(_rows(spark, d), _labels(spark, d)), digits=6)


def _vectors(spark, d):
    """Embeddings with the part's size as a number and a fifth held out."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("sample_id"), F.col("embedding").alias("features"), F.col("label").cast("double").alias("label"), (F.col("vec_id") % 5 == 0).alias("held"))
    return e


for _kind in ("lr", "dtc", "gnb", "svm"):

    @query(f"classify_{_kind}")
    def _(spark, d, kind=_kind):
        return _rounded(M.fold_metrics(D.ml_evaluate(_vectors(spark, d), kind, "held")), digits=6)


@query("gnb_predictions", f"WITH {FEATURES}, t AS (SELECT label, pos, value FROM features WHERE sample_id % 5 <> 0), e AS (SELECT 1e-9 * max(v) AS e FROM (SELECT var_pop(value) AS v FROM t GROUP BY pos)), s AS (SELECT label, pos, avg(value) AS mean, var_pop(value) + any_value(e) AS var FROM t, e GROUP BY 1, 2), c AS (SELECT label, ln(count(*)) AS prior FROM t WHERE pos = 0 GROUP BY 1), p AS (SELECT f.sample_id, f.label AS own, s.label, any_value(prior) - 0.5 * sum(ln(var) + (value - mean) * (value - mean) / var) AS score FROM features f JOIN s USING (pos) JOIN c ON c.label = s.label WHERE f.sample_id % 5 = 0 GROUP BY 1, 2, 3) SELECT sample_id, own::INTEGER::VARCHAR AS y_true, first(label ORDER BY score DESC, label)::INTEGER::VARCHAR AS y_pred FROM p GROUP BY 1, 2")
def _(spark, d):
    """Gaussian naive Bayes on the held-out fifth, row by row."""
    return D.ml_evaluate(_vectors(spark, d), "gnb", "held")


@query("classify_boosted")
def _(spark, d):
    """Boosted trees for all ten labels, a fifth of the vectors held out."""
    rows, lab = _rows(spark, d), _labels(spark, d)
    out = B.boosted_classes(rows, lab, rows.where("sample_id % 5 = 0"), rounds=10)
    return _rounded(M.fold_metrics(out), digits=6)


@query("classify_gbc")
def _(spark, d):
    """Boosted trees for even and odd labels."""
    few = _vectors(spark, d).withColumn("label", F.col("label") % 2)
    return _rounded(M.fold_metrics(D.ml_evaluate(few, "gbc", "held")), digits=6)


for _kind in ("ridge", "lasso", "elasticnet", "rf", "gbr", "dt"):

    @query(f"regress_{_kind}")
    def _(spark, d, kind=_kind):
        m = M.regression_metrics(D.ml_regress(_vectors(spark, d), kind, "held", alpha=0.05 if kind in ("lasso", "elasticnet") else 1.0))
        return m.select(*[F.round(c, 4).alias(c) for c in ("mae", "rmse", "r2")])


@query("regress_ridge_two_features", f"WITH {FEATURES}, x AS (SELECT sample_id, any_value(label)::DOUBLE AS y, max(value) FILTER (pos = 0) AS a, max(value) FILTER (pos = 1) AS b FROM features GROUP BY 1), m AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) * count(*) + 1 AS aa, var_pop(b) * count(*) + 1 AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS b_y FROM x WHERE sample_id % 5 <> 0) SELECT sample_id, y AS y_true, round(my + ((a - ma) * (ay * bb - b_y * ab) + (b - mb) * (b_y * aa - ay * ab)) / (aa * bb - ab * ab), 4) AS y_pred FROM x, m WHERE sample_id % 5 = 0")
def _(spark, d):
    """Labels as numbers from the first two features, the penalty converted for the estimator."""
    few = _vectors(spark, d).withColumn("features", F.slice("features", 1, 2))
    return D.ml_regress(few, "ridge", "held", alpha=1.0).select("sample_id", "y_true", F.round("y_pred", 4).alias("y_pred"))


@query("regress_knn", f"WITH {FEATURES}, d AS (SELECT t.sample_id, o.sample_id AS other, sum((t.value - o.value) * (t.value - o.value)) AS d FROM features t JOIN features o ON t.pos = o.pos AND t.sample_id % 5 <> o.sample_id % 5 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d, other) AS k FROM d), v AS (SELECT vec_id AS i, label::DOUBLE AS v FROM embeddings) SELECT k.sample_id, round(any_value(t.v), 6) AS y_true, round(avg(o.v), 6) AS y_pred FROM k JOIN v t ON t.i = k.sample_id JOIN v o ON o.i = k.other WHERE k.k <= 5 GROUP BY 1")
def _(spark, d):
    """The mean label of the five nearest vectors outside a vector's fold."""
    rows = _rows(spark, d)
    test = rows.select((F.col("sample_id") % 5).alias("split_id"), "sample_id")
    return X.nearest_mean(rows, _labels(spark, d).withColumnRenamed("label", "value"), test).select("sample_id", F.round("y_true", 6).alias("y_true"), F.round("y_pred", 6).alias("y_pred"))


@query("embedding_quality")
def _(spark, d):
    return _rounded(J.combined_quality(X.pca(_rows(spark, d), components=1), _labels(spark, d), _rows(spark, d), 10), digits=5)


_PAIRS = "WITH e AS (SELECT vec_id AS i, label AS l, embedding AS x FROM embeddings), d AS (SELECT a.i, a.l, b.l AS o, sqrt(list_sum(list_transform(range(1, 65), lambda k: pow(a.x[k]::DOUBLE - b.x[k]::DOUBLE, 2)))) AS d FROM e a JOIN e b ON a.i <> b.i), m AS (SELECT i, l, o, avg(d) AS m FROM d GROUP BY ALL), p AS (SELECT i, max(m) FILTER (l = o) AS own, min(m) FILTER (l <> o) AS apart FROM m GROUP BY i), "


@query("silhouette", _PAIRS + "s AS (SELECT avg(CASE WHEN own IS NULL OR greatest(own, apart) = 0 THEN 0 ELSE (apart - own) / greatest(own, apart) END) AS s FROM p), f AS (SELECT i, l, unnest(range(1, 65)) AS k, unnest(x)::DOUBLE AS v FROM e), t AS (SELECT sum((v - g) * (v - g)) AS t FROM (SELECT v, avg(v) OVER (PARTITION BY k) AS g FROM f)), w AS (SELECT sum((v - g) * (v - g)) AS w FROM (SELECT v, avg(v) OVER (PARTITION BY k, l) AS g FROM f)), n AS (SELECT count(*) AS n, count(DISTINCT l) AS c FROM e) SELECT round(s, 6) AS silhouette, round(((t - w) / (c - 1)) / (w / (n - c)), 4) AS calinski_harabasz FROM s, t, w, n")
def _(spark, d):
    """Silhouette and Calinski-Harabasz index of the labels, without pairs."""
    q = J.embedding_quality(_rows(spark, d), _labels(spark, d))
    return q.select(F.round("silhouette", 6).alias("silhouette"), F.round("calinski_harabasz", 4).alias("calinski_harabasz"))


@query("ranked_channel_addition")
def _(spark, d):
    """Channels by their own accuracy, added one after the other."""
    rows, lab = _spectra(spark, d)
    own = G.set_scores(rows, lab, [(c, [c]) for c in range(CHANNELS)]).select(F.lit(0).alias("rt_bin"), F.col("set_id").alias("mz_bin"), "accuracy")
    sets = J.ranked_channels(own, list(range(CHANNELS)))
    scored = G.set_scores(rows, lab, [(r.set_id, list(r.channels)) for r in sets.collect()])  # one row for each channel
    return scored.select(F.col("set_id").alias("k"), F.round("accuracy", 6).alias("accuracy"))


BINS, CHANNELS = 4, 7


def _cells(spark, d):
    """(rows, labels): each supplier's sums by 4 retention bins and 7 channels, bin by bin, and four classes; written, as every step reads them."""
    binned, lab = _binned(spark, d, readings)
    place = F.col("rt_bin") * CHANNELS + F.col("mz") - 41
    sums = binned.groupBy("sample_id", place.cast("int").alias("pos")).agg(F.sum("intensity").cast("double").alias("value"))
    found = sums.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("_m"))
    x = F.transform(F.sequence(F.lit(0), F.lit(BINS * CHANNELS - 1)), lambda p: F.coalesce(F.try_element_at("_m", p), F.lit(0.0)))
    return stored(found.select("sample_id", x.alias("x")), "cells"), stored(lab, "labels")


def _spectra(spark, d):
    """(rows, labels): each supplier's summed spectrum."""
    rows, lab = _cells(spark, d)
    total = F.transform(F.sequence(F.lit(0), F.lit(CHANNELS - 1)), lambda c: F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0.0), lambda t, b: t + F.get("x", b * CHANNELS + c)))
    return rows.select("sample_id", total.alias("x")), lab


for _mode in ("remove", "add"):

    @query(f"shared_survival_{_mode}")
    def _(spark, d, mode=_mode):
        """Cubes of a retention bin and half of the channels, by one cross-validation."""
        cubes = [[b * CHANNELS + c for c in part] for b in range(BINS) for part in (range(3), range(3, 7))]
        return _rounded(G.shared_survival(*_cells(spark, d), cubes, mode, drawn=5 if mode == "add" else None), "step", "cube", digits=6)


@query("shared_survival_bins")
def _(spark, d):
    """Removal of whole retention bins."""
    return _rounded(G.shared_survival(*_cells(spark, d), [[b * CHANNELS + c for c in range(CHANNELS)] for b in range(BINS)]), "step", "cube", digits=6)


@query("nested_channels_add")
def _(spark, d):
    """Channels of the summed spectrum, forward."""
    return _rounded(G.nested_channels(*_spectra(spark, d), CHANNELS, folds=5, least=2), "repeat", "step", "channel", "wins", digits=6)


@query("nested_channels_remove")
def _(spark, d):
    """Channels of the means over channels by retention bin, backward; three steps."""
    rows, lab = _cells(spark, d)
    by_channel = F.transform(F.sequence(F.lit(0), F.lit(BINS * CHANNELS - 1)), lambda p: F.get("x", p % BINS * CHANNELS + F.floor(p / BINS).cast("int")))
    return _rounded(G.nested_channels(rows.select("sample_id", by_channel.alias("x")), lab, CHANNELS, BINS, "average", "remove", 3, 2, 4, 2), "repeat", "step", "channel", "wins", digits=6)


@query("count_map")
def _(spark, d):
    return _rounded(G.count_map(*_cells(spark, d), BINS, CHANNELS, [3, 2], [5, 3]), "rt_bins", "mz_channels", digits=6)
