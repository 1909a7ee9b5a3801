"""Correlations, distances and summaries of features and weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retort.operators.moments import block_pairs, dealt_blocks, floats, sums, unpacked, wide
from retort.sources.shared import stored

#: Feature positions and samples of one block of the Gram product, and cells of a block of many positions.
BLOCK, SAMPLE_BLOCK, BLOCK_CELLS = 4096, 1024, 1 << 17


def rounded(values: np.ndarray, digits: int | None) -> np.ndarray:
    """Values to so many decimals, halves away from zero as in SQL."""
    if digits is None:
        return values
    whole = values * 10.0**digits
    return np.trunc(whole + np.copysign(0.5, whole)) / 10.0**digits + 0.0


def _products(features: DataFrame, value: str, block: int, sample_block: int, digits: int | None, standardised: bool = False) -> DataFrame:
    """(a, b, ``value``) of all pairs of samples, from pairs of blocks of samples.

    Blocks are ranges of ids. A task has all positions of both blocks and takes them
    ``block`` at a time, so products are whole when they leave it and no pair is shuffled.
    Standardised rows have mean 0 and length 1 (NaN if they are constant) and meet other
    rows only; equal values of a pair of blocks leave together, so that they are stored once.
    """
    kind = dict(features.dtypes)["sample_id"]
    cells = features.select("sample_id", F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))
    rows = stored(cells.groupBy("sample_id").agg(F.collect_list(F.struct("pos", F.nanvl(F.coalesce("value", F.lit(0.0)), F.lit(0.0)).alias("value"))).alias("_c")).select("sample_id", "_c.pos", "_c.value"), "gram-rows")
    n = rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / sample_block), F.ceil(F.sum(F.size("pos")) / BLOCK_CELLS)).cast("int")).first()[0]

    def unit(v: np.ndarray) -> np.ndarray:
        v = v - v.mean()
        length = np.sqrt(v @ v)
        return v / length if length > 0 else np.full(len(v), np.nan)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(frames))
        if len(part):
            part = part.sort_values("sample_id")
            at, pos = np.repeat(np.arange(len(part)), part["pos"].str.len()), np.concatenate(part["pos"].tolist())
            v, order = np.concatenate([unit(x) for x in part["value"]] if standardised else part["value"].tolist()), np.argsort(pos, kind="stable")
            yield pd.DataFrame({"a": part["_g"].iloc[:1].to_numpy(), "a_id": [part["sample_id"].to_numpy()], "a_at": [at[order].astype(np.int64).tobytes()], "a_pos": [pos[order].astype(np.int64).tobytes()], "a_v": [v[order].astype(float).tobytes()]})

    ranges = rows.repartitionByRange(n, "sample_id").withColumn("_g", F.spark_partition_id())
    a = stored(ranges.mapInPandas(pack, f"a int, a_id array<{kind}>, a_at binary, a_pos binary, a_v binary"), "gram-blocks")
    b = a.select(*[F.col(c).alias(f"b{c[1:]}") for c in a.columns])

    def side(batch: pa.RecordBatch, x: str, k: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        at, pos, v = (np.frombuffer(batch.column(f"{x}_{c}")[k].as_buffer(), t) for c, t in (("at", np.int64), ("pos", np.int64), ("v", float)))
        return batch.column(f"{x}_id")[k].values, at, pos, v

    def dense(part: tuple, where: np.ndarray) -> np.ndarray:
        ids, at, pos, v = part
        low, high = np.searchsorted(pos, [where[0], where[-1] + 1])
        cell = at[low:high] * len(where) + np.searchsorted(where, pos[low:high])
        return np.bincount(cell, v[low:high], len(ids) * len(where)).reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = side(batch, "a", k), side(batch, "b", k)
                every, dots = np.union1d(left[2], right[2]), np.zeros((len(left[0]), len(right[0])))
                for at in range(0, len(every), block):
                    dots += dense(left, every[at : at + block]) @ dense(right, every[at : at + block]).T
                dots, order = rounded(dots.ravel(), digits), None
                if batch.column("a")[k] == batch.column("b")[k]:
                    order = np.flatnonzero(np.triu(np.ones((len(left[0]), len(right[0])), bool), int(standardised)))
                if standardised:
                    order = np.argsort(dots) if order is None else order[np.argsort(dots[order])]
                if order is None:
                    x, y = np.repeat(np.arange(len(left[0])), len(right[0])), np.tile(np.arange(len(right[0])), len(left[0]))
                else:
                    (x, y), dots = np.divmod(order, len(right[0])), dots[order]
                yield pa.RecordBatch.from_arrays([left[0].take(pa.array(x)), right[0].take(pa.array(y)), pa.array(dots)], ["a", "b", value])

    return block_pairs(a, b).where("a <= b").mapInArrow(run, f"a {kind}, b {kind}, {value} double")


def gram(features: DataFrame, block: int = BLOCK, sample_block: int = SAMPLE_BLOCK, digits: int | None = None) -> DataFrame:
    """(a, b, dot) for a <= b: inner products of samples, to so many ``digits``."""
    return _products(features, "dot", block, sample_block, digits)


def pairwise_pearson(features: DataFrame, block: int = BLOCK, sample_block: int = SAMPLE_BLOCK, digits: int | None = None) -> DataFrame:
    """(a, b, r) for a < b of samples, which must have the same positions: products of standardised rows, NaN beside a constant one."""
    return _products(features, "r", block, sample_block, digits, standardised=True)


def pearson_summary(features: DataFrame) -> DataFrame:
    """(mean, std, n): mean and population deviation of r over all pairs of samples; samples of unlike lengths raise an error.

    Sums over the standardised rows and over their products by position hold all pairs, so
    no pair of samples is ever formed; the matrix of sums has the square of the positions.
    Rows without variance count as r = 0. Fewer than two samples give no row.
    """
    w = Window.partitionBy("sample_id")
    centred = features.withColumn("_c", F.col("value") - F.avg("value").over(w)).withColumn("_q", F.sum(F.col("_c") * F.col("_c")).over(w))
    unit = centred.select("sample_id", "pos", F.when(F.col("_q") > 0, F.col("_c") / F.sqrt("_q")).otherwise(0.0).alias("value"))
    rows = wide(unit)
    lengths = rows.agg(F.count_distinct(F.size("x")).alias("_kinds"))
    same = rows.crossJoin(lengths).where(F.expr("_kinds <= 1 OR raise_error('samples of unlike lengths') IS NULL"))  # one row
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x)
    diagonal = F.aggregate(F.sequence(F.lit(1), F.col("p")), F.lit(0.0), lambda t, k: t + F.get("m", k * (F.col("p") + 2)))
    found = sums(same.select("sample_id", "x"), centre="zero").select(F.get("m", F.lit(0)).alias("n"), square(F.slice("m", F.lit(2), F.col("p"))).alias("total"), square(F.col("m")).alias("all"), diagonal.alias("own"))
    found = found.where("n > 1").withColumn("pairs", F.col("n") * (F.col("n") - 1) / 2)
    mean = (F.col("total") - F.col("own")) / 2 / F.col("pairs")
    squares = (F.col("all") - F.col("n") * F.col("n") - 2 * F.col("total") - F.col("own")) / 2 / F.col("pairs")
    return found.select(mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), squares - mean * mean)).alias("std"), F.col("pairs").cast("long").alias("n"))


def channel_correlations(scans: DataFrame) -> DataFrame:
    """(sample_id, a, b, r, n) of channel pairs of each sample; channels are few by nature."""
    keys = ["sample_id", "scan_idx"]
    a, b = (scans.select(*keys, F.col("mz").alias(x), F.col("intensity").alias(f"_{x}")) for x in "ab")
    return a.join(b, keys).where("a <= b").groupBy("sample_id", "a", "b").agg(F.corr("_a", "_b").alias("r"), F.count("*").alias("n"))


def profile_correlations(profiles: DataFrame) -> DataFrame:
    """(a, b, r) of all ordered pairs of (name, pos, value) profiles, a short list, over the positions that both have."""
    a, b = (profiles.select(F.col("name").alias(x), "pos", F.col("value").alias(f"_{x}")) for x in "ab")
    return a.join(b, "pos").groupBy("a", "b").agg(F.corr("_a", "_b").alias("r"))


def compare_weights(x: DataFrame, y: DataFrame) -> DataFrame:
    """Pearson r, slope, intercept and mean difference of two (pos, value) vectors."""
    j = x.withColumnRenamed("value", "_x").join(y.withColumnRenamed("value", "_y"), "pos")
    return j.agg(F.corr("_x", "_y").alias("r"), F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.avg(F.col("_y") - F.col("_x")).alias("difference"))


def distance_sums(rows: DataFrame, labels: DataFrame, tile: int = SAMPLE_BLOCK) -> DataFrame:
    """(sample_id, label, other, d, n): the sum of Euclidean distances of each sample to the other samples of each label.

    ``rows`` is (sample_id, x). Samples are dealt to blocks by hash; a task adds up the sums
    of a block's samples over all blocks that it meets, so no pair is stored.
    """
    kind = dict(rows.dtypes)["sample_id"]
    named = rows.join(labels.select("sample_id", F.col("label").cast("string").alias("label")), "sample_id").select("sample_id", "x", "label")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"a": part["_g"].iloc[:1].to_numpy(), "a_id": [part["sample_id"].to_numpy()], "a_label": [part["label"].to_numpy()], "a_x": [floats(part["x"]).tobytes()]})

    a = stored(dealt_blocks(named, tile, "sample_id").groupBy("_g").applyInPandas(pack, f"a int, a_id array<{kind}>, a_label array<string>, a_x binary"), "blocks")
    b = a.select(F.col("a").alias("b"), F.col("a_label").alias("b_label"), F.col("a_x").alias("b_x"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, dict] = {}
        own: dict[int, tuple] = {}
        for frame in frames:
            for r in frame.itertuples(index=False):
                own[r.a] = r.a_id, r.a_label
                x, y = unpacked(r.a_x, len(r.a_id)), unpacked(r.b_x, len(r.b_label))
                names, code = np.unique(r.b_label, return_inverse=True)
                one, middle = np.eye(len(names))[code], y.mean(0)
                x, y = x - middle, y - middle
                q, total = (y * y).sum(1), np.empty((len(x), len(names)))
                for at in range(0, len(x), 256):
                    part = x[at : at + 256]
                    d = part @ y.T
                    d *= -2
                    d += q
                    d += (part * part).sum(1)[:, None]
                    np.maximum(d, 0, out=d)
                    np.sqrt(d, out=d)
                    if r.a == r.b:
                        d[np.arange(len(d)), at + np.arange(len(d))] = 0
                    total[at : at + 256] = d @ one
                for k, (name, n) in enumerate(zip(names, np.bincount(code), strict=True)):
                    sums_, count = totals.setdefault(r.a, {}).setdefault(name, (np.zeros(len(x)), np.zeros(len(x), np.int64)))
                    sums_ += total[:, k]
                    count += n - ((r.a_label == name) if r.a == r.b else 0)
        for block, by_name in totals.items():
            ids, label = own[block]
            for name, (sums_, count) in by_name.items():
                some = count > 0
                yield pd.DataFrame({"sample_id": ids[some], "label": label[some], "other": name, "d": sums_[some], "n": count[some]})

    sums_ = block_pairs(a, b).mapInPandas(run, f"sample_id {kind}, label string, other string, d double, n long")
    return sums_.groupBy("sample_id", "label", "other").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))


def cluster_distances(features: DataFrame) -> DataFrame:
    """(g, h, mean_distance, n): mean Euclidean distance of pairs within and between labels, from sums by sample and label."""
    kind = dict(features.dtypes)["label"]
    to = distance_sums(wide(features), features.select("sample_id", "label").distinct())
    ends = to.select(F.col("label").cast(kind).alias("_a"), F.col("other").cast(kind).alias("_b"), "d", "n")
    both = ends.groupBy(F.least("_a", "_b").alias("g"), F.greatest("_a", "_b").alias("h")).agg((F.sum("d") / F.sum("n")).alias("mean_distance"), F.sum("n").alias("_n"))
    return both.select("g", "h", "mean_distance", F.expr("_n div 2").alias("n"))  # every pair is counted from both ends


def silhouette(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(silhouette,) of labelled rows; samples that are alone in their label count as 0."""
    to = distance_sums(rows, labels)
    own, apart = F.when(F.col("label") == F.col("other"), F.col("d") / F.col("n")), F.when(F.col("label") != F.col("other"), F.col("d") / F.col("n"))
    per = to.groupBy("sample_id").agg(F.max(own).alias("own"), F.min(apart).alias("apart"))
    top = F.greatest("own", "apart")
    return per.agg(F.avg(F.when(F.col("own").isNull() | (top == 0), 0.0).otherwise((F.col("apart") - F.col("own")) / top)).alias("silhouette"))


def calinski_harabasz(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(calinski_harabasz,) of labelled rows, from the centred moments of each label: no pairs are formed."""
    named = rows.join(labels.select("sample_id", "label"), "sample_id")
    trace = F.aggregate(F.sequence(F.lit(1), F.col("p")), F.lit(0.0), lambda t, k: t + F.get("m", k * (F.col("p") + 2)) - F.get("m", k) * F.get("m", k) / F.get("m", F.lit(0)))
    spread = lambda t: t.select(F.get("m", F.lit(0)).alias("n"), trace.alias("w"))
    within = spread(sums(named, "label")).agg(F.sum("w").alias("within"), F.count("*").alias("k"))
    total = spread(sums(named)).select(F.col("w").alias("total"), "n")
    ch = ((F.col("total") - F.col("within")) / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return within.crossJoin(total).select(ch.alias("calinski_harabasz"))  # one row each


def cluster_spread(distances: DataFrame, without: list | None = None) -> DataFrame:
    """(within, between, between_std, n_pairs) of (g, h, mean_distance): the mean of the groups' own mean distances, and mean and deviation over pairs of groups.

    Groups in ``without`` take no part.
    """
    kept = distances.where(~(F.col("g").isin(without) | F.col("h").isin(without))) if without else distances
    own, apart = F.when(F.col("g") == F.col("h"), F.col("mean_distance")), F.when(F.col("g") != F.col("h"), F.col("mean_distance"))
    return kept.agg(F.avg(own).alias("within"), F.avg(apart).alias("between"), F.stddev_pop(apart).alias("between_std"), F.count(apart).alias("n_pairs"))


def group_dispersion(points: DataFrame, group: str, x: str = "x", y: str = "y") -> DataFrame:
    """Mean, shrunken covariance (0.4 of it plus 1e-3 on the diagonal), its determinant, and the opacity that follows."""
    g = points.groupBy(group).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), (F.var_samp(x) * 0.4 + 1e-3).alias("xx"), (F.covar_samp(x, y) * 0.4).alias("xy"), (F.var_samp(y) * 0.4 + 1e-3).alias("yy"))
    g = g.withColumn("det", F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"))
    return g.withColumn("alpha", F.greatest(F.lit(0.1), 1 / (1 + 1.5 * F.col("det"))))


def linear_attribution(features: DataFrame, coef: DataFrame) -> DataFrame:
    """(sample_id, pos, attribution): coefficient times the distance from the mean of the feature."""
    mean = features.groupBy("pos").agg(F.avg("value").alias("_m"))
    return features.join(mean, "pos").join(coef, "pos").select("sample_id", "pos", (F.col("coef") * (F.col("value") - F.col("_m"))).alias("attribution"))


def mean_in_order(value: str, *order: Column | str) -> Column:
    """The mean of a group's values, added one by one in the given order, so that partitions do not change its last digit."""
    rows = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).cast("double").alias("_v")))))
    return F.aggregate(rows, F.lit(0.0), lambda t, r: t + r["_v"]) / F.nullif(F.size(rows), F.lit(0))


def best_decile_channels(sets: DataFrame) -> DataFrame:
    """(channel, n): how often channels occur in the sets at or above the 90th percentile of accuracy."""
    q = sets.agg(F.percentile("accuracy", 0.9).alias("_q"))
    return sets.crossJoin(q).where("accuracy >= _q").select(F.explode("channels").alias("channel")).groupBy("channel").agg(F.count("*").alias("n"))  # one row


def best_per_size(sets: DataFrame) -> DataFrame:
    """The best set of each size (ties to the smallest id), its accuracy, and mean and deviation over the size."""
    return sets.groupBy("k").agg(F.max_by("set_id", F.struct("accuracy", -F.col("set_id"))).alias("best"), F.max("accuracy").alias("accuracy"), F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"))


def fold_weights(coefs: DataFrame, threshold: float) -> DataFrame:
    """(pos, weight, strong): mean coefficients over folds, over the largest of them; strong from the threshold on."""
    m = coefs.groupBy("pos").agg(F.avg("coef").alias("_w"))
    top = m.agg(F.max(F.abs("_w")).alias("_t"))
    return m.crossJoin(top).select("pos", (F.col("_w") / F.col("_t")).alias("weight")).withColumn("strong", F.abs("weight") >= threshold)  # one row


def weights_by_bin(coefs: DataFrame, width: int) -> DataFrame:
    """(bin, weight): mean absolute mean coefficient of each bin of positions, over the largest bin's."""
    m = coefs.groupBy("pos").agg(F.avg("coef").alias("_w")).groupBy(F.expr(f"int(pos div {width})").alias("bin")).agg(F.avg(F.abs("_w")).alias("_v"))
    return m.crossJoin(m.agg(F.max("_v").alias("_t"))).select("bin", (F.col("_v") / F.col("_t")).alias("weight"))  # one row


def adjusted_rand(labels: DataFrame, x: str, y: str) -> DataFrame:
    """(adjusted_rand,) of two labellings of the rows, from their contingency counts."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = labels.groupBy(x, y).agg(F.count("*").alias("n"))
    both = cells.agg(pairs("n").alias("both"), F.sum("n").alias("all"))
    rows, cols = (cells.groupBy(c).agg(F.sum("n").alias("n")).agg(pairs("n").alias(k)) for c, k in ((x, "rows"), (y, "cols")))
    one = both.crossJoin(rows).crossJoin(cols).withColumn("chance", F.col("rows") * F.col("cols") / (F.col("all") * (F.col("all") - 1) / 2))  # one row each
    most = (F.col("rows") + F.col("cols")) / 2
    return one.select(F.when(most == F.col("chance"), 1.0).otherwise((F.col("both") - F.col("chance")) / (most - F.col("chance"))).alias("adjusted_rand"))
