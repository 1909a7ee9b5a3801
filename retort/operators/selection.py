"""Greedy choice of cubes, channels and retention bins for many samples, from sums over rows.

A candidate is a list of features, each the mean of some places of ``x``: single places
concatenate channels, lists of places average them. All candidates of a step are fitted
from the folds' training sums (``moments``) and scored in one job, whatever the number of
samples; between steps the driver holds the chosen names only. Scores are balanced
accuracies of one-versus-rest ridge, and an empty choice scores chance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retort.operators import moments as X
from retort.operators import splits as P
from retort.sources.shared import stored

#: Test rows of one block, and sets that are fitted and scored together.
BLOCK_ROWS, CHUNK = 4096, 256
#: Pairs of a block and a part of the sets that a fold's work is cut in, where it has fewer blocks; scores that are held at once.
PAIRS, SCORES = 16, 1 << 17


def channel_places(chosen: list[int], width: int = 1, how: str = "concat") -> list[list[int]]:
    """Places of chosen channels where each holds ``width`` neighbouring places: all of them, or their means over the channels."""
    if how == "concat":
        return [[c * width + j] for c in chosen for j in range(width)]
    if how == "average":
        return [[c * width + j for c in chosen] for j in range(width)] if chosen else []
    raise ValueError("how must be concat or average")


def subset_ridge(s: X.Sums, places: list[list[int]], alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """class_ridge_fit on the means of the given places, as weights and intercepts on the whole ``x``."""
    to = np.zeros((len(places), len(s.xx)))
    for k, own in enumerate(places):
        to[k, own] = 1 / len(own)
    w = to.T @ np.linalg.solve(to @ s.xx @ to.T + alpha * np.eye(len(to)), to @ s.xy)
    return 2 * w, np.where(s.y_sum > 0.5, 2 * (s.y_mean - s.x_mean @ w) - 1, -np.inf)


def subset_ridges(s: X.Sums, sets: list[list[list[int]]], alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """subset_ridge of many sets, as weights (place, class, set) and intercepts (class, set); sets of single places of one size are solved together."""
    weights = np.zeros((*s.xy.shape, len(sets)))
    alike: dict[int, list[int]] = {}
    for j, places in enumerate(sets):
        if places and len({p for q in places for p in q}) == len(places) == sum(map(len, places)):
            alike.setdefault(len(places), []).append(j)
        else:
            weights[:, :, j] = subset_ridge(s, places, alpha)[0] / 2
    for k, own in alike.items():
        at = np.array([[q[0] for q in sets[j]] for j in own])
        w = np.linalg.solve(s.xx[at[:, :, None], at[:, None, :]] + alpha * np.eye(k), s.xy[at])
        weights[at, :, np.array(own)[:, None]] = w
    offset = s.y_mean[:, None] - np.tensordot(s.x_mean, weights, 1)
    return 2 * weights, np.where(s.y_sum[:, None] > 0.5, 2 * offset - 1, -np.inf)


def hits_by_class(x: np.ndarray, label: np.ndarray, weights: np.ndarray, intercepts: np.ndarray) -> np.ndarray:
    """(class, set): rows whose own class has the best score, and is the first of those that have; ``label`` is each row's class."""
    out = np.zeros(intercepts.shape, np.int64)
    flat, size = weights.reshape(len(weights), -1), max(1, SCORES // intercepts.size)
    for c in np.unique(label):
        own = x[label == c]
        for at in range(0, len(own), size):
            score = (own[at : at + size] @ flat).reshape(-1, *intercepts.shape) + intercepts
            right = np.ones((len(score), score.shape[2]), bool)
            if c:
                right &= score[:, :c].max(1) < score[:, c]
            if c + 1 < score.shape[1]:
                right &= score[:, c + 1 :].max(1) <= score[:, c]
            out[c] += right.sum(0)
    return out


def standardised(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Rows (group, x) with the means and deviations of their group's training rows taken off; constant places become 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [X.Sums(int(p), m, c) for p, m, c in zip(frame["p"], frame["m"], frame["c"], strict=True)]
            # by-products of rounding count as constant
            spread = [np.sqrt(np.maximum(np.diag(s.xx), 0) / max(s.n, 1)) for s in found]
            yield frame[["group"]].assign(_mean=[s.x_mean for s in found], _by=[np.where(d > 1e-9 * (1 + np.abs(s.x_mean)), 1 / np.maximum(d, 1e-300), 0.0) for s, d in zip(found, spread, strict=True)])

    scale = X.sums(train.drop("y"), "group").mapInPandas(run, "group int, _mean array<double>, _by array<double>")
    moved = F.zip_with(F.zip_with("x", "_mean", lambda a, b: a - b), F.col("_by"), lambda a, b: a * b)
    return rows.join(scale, "group").withColumn("x", moved).drop("_mean", "_by")


def folded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tests, sums) of rows (group, fold, x, y, label, classes): rows that a fold tests, and the sums of all its group's other rows.

    Tests are written once in blocks of rows (group, fold, block, x, label) as bytes,
    each label as its place among the classes. Rows that train have ``trains`` set. A row that several folds test is there once for
    each and once more, with a null fold, to train; rows of a fold below 0 never train.
    """
    kept = stored(rows, "selection-rows")
    tests = kept.where("fold IS NOT NULL")
    largest = tests.groupBy("group", "fold").count().agg(F.max("count")).collect()[0][0] or 1  # one number
    blocks = -(-largest // BLOCK_ROWS)
    tests = tests.withColumn("block", F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int"))
    whole = X.sums(kept.where("trains"), "group").withColumnRenamed("m", "_all")
    held = X.sums(tests, "group", "fold", centre=whole).select("group", "fold", F.col("m").alias("_held"))
    # a fold whose rows are not among the training rows (an outer test) leaves the sums whole
    left = F.when(F.col("fold") < 0, F.col("_all")).otherwise(F.zip_with("_all", "_held", lambda a, b: a - b))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        return part[["group", "fold", "block"]].iloc[:1].assign(x=[np.array(part["x"].tolist(), float).tobytes()], label=[part["label"].to_numpy(np.int32).tobytes()])

    coded = tests.select("group", "fold", "block", "x", (F.array_position("classes", F.col("label")) - 1).cast("int").alias("label"))
    packed = stored(coded.groupBy("group", "fold", "block").applyInPandas(pack, "group int, fold int, block int, x binary, label binary"), "selection-blocks")
    return packed, stored(held.join(whole, "group").select("group", "fold", "p", "c", left.alias("m"), F.lit(blocks).alias("blocks")), "selection-sums")


def candidate_scores(tests: DataFrame, sums: DataFrame, sets: list[tuple[int, int, list[list[int]]]], alpha: float = 1.0) -> DataFrame:
    """(group, candidate, fold, score): balanced accuracy over each fold's test rows of each set (group, candidate, places).

    A fold that leaves no row to train on gives no score. A task has blocks of a fold's test rows, the fold's sums and a part of the sets; it
    fits the sets and returns hits by class, so no row is joined to a model. Only where blocks are few is one copied, for parts of the sets.
    """
    dealt: dict[int, list[tuple[int, list[list[int]]]]] = {}
    for g, c, places in sets:
        dealt.setdefault(g, []).append((c, places))
    most = tests.sparkSession.createDataFrame([(g, -(-len(own) // CHUNK)) for g, own in dealt.items()], "group int, most int")
    parts = F.least("most", F.ceil(F.lit(PAIRS) / F.col("blocks")).cast("int"))
    cut = sums.select("group", "fold", "blocks").join(F.broadcast(most), "group").select("group", "fold", parts.alias("parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    pairs = tests.join(F.broadcast(cut), ["group", "fold"]).repartition("group", "fold", "block", "part").join(F.broadcast(sums.select("group", "fold", "p", "c", "m")), ["group", "fold"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int, int, int], tuple[np.ndarray, np.ndarray]] = {}
        for frame in frames:
            for r in frame.itertuples(index=False):
                s, label = X.Sums(int(r.p), r.m, r.c), np.frombuffer(r.label, np.int32)
                if s.n < 0.5:  # nothing to train on
                    continue
                x, own = X.unpacked(r.x, len(label)), [places for _, places in dealt[r.group][r.part :: r.parts]]
                hits = np.concatenate([hits_by_class(x, label, *subset_ridges(s, own[at : at + CHUNK], alpha)) for at in range(0, len(own), CHUNK)], 1)
                n, key = np.bincount(label, minlength=len(hits)), (r.group, r.fold, r.part, r.parts)
                held[key] = (held[key][0] + hits, held[key][1] + n) if key in held else (hits, n)
        for (g, fold, part, parts), (hits, n) in held.items():
            names = np.array([c for c, _ in dealt[g][part::parts]])
            for c in np.flatnonzero(n):
                yield pd.DataFrame({"group": g, "candidate": names, "fold": fold, "label": c, "hits": hits[c], "n": n[c]})

    hits = pairs.mapInPandas(run, "group int, candidate int, fold int, label int, hits long, n long")
    # one shuffle serves this sum and the means by fold and by candidate
    each = hits.repartition("group", "candidate").groupBy("group", "candidate", "fold", "label").agg((F.sum("hits") / F.sum("n")).alias("_r"))
    return each.groupBy("group", "candidate", "fold").agg(F.avg("_r").alias("score"))


def best_mean(scores: DataFrame) -> DataFrame:
    """(group, candidate, score): the candidate of the best mean over folds, rounded to 12 digits; ties to the smallest."""
    mean = scores.groupBy("group", "candidate").agg(F.round(F.avg("score"), 12).alias("score"))
    return mean.groupBy("group").agg(F.max_by(F.struct("candidate", "score"), F.struct("score", -F.col("candidate"))).alias("_b")).select("group", "_b.candidate", "_b.score")


def steps(tests: DataFrame, sums: DataFrame, begin: dict[int, list[int]], pool: list[int], places: Callable[[int, list[int]], list[list[int]]], mode: str, count: int, alpha: float = 1.0, draw: Callable[[int, int, list[int]], list[int]] | None = None, pick: Callable[[DataFrame], DataFrame] = best_mean) -> tuple[list[dict], dict[int, list[int]]]:
    """Greedy removal or addition for all groups at once: (rows of each step, what is chosen at the end).

    ``places`` gives the places of a group's choice, ``draw`` the candidates that a step
    looks at, ``pick`` the winner of each group. One job a step.
    """
    if mode not in ("remove", "add"):
        raise ValueError("mode must be remove or add")
    chosen = {g: list(c) for g, c in begin.items()}
    out = []
    for step in range(count):
        sets = []
        for g, own in chosen.items():
            left = sorted(own) if mode == "remove" else sorted(set(pool) - set(own))
            for c in draw(g, step, left) if draw and left else left:
                sets.append((g, c, places(g, [o for o in own if o != c] if mode == "remove" else [*own, c])))
        if not sets:
            break
        for r in pick(candidate_scores(tests, sums, sets, alpha)).collect():  # one row for each group
            chosen[r["group"]] = [o for o in chosen[r["group"]] if o != r["candidate"]] if mode == "remove" else [*chosen[r["group"]], r["candidate"]]
            out.append({**r.asDict(), "step": step})
    return out, chosen


def _dealt(named: DataFrame, test: DataFrame) -> DataFrame:
    """Rows of one group with the fold that tests each."""
    return named.join(test.select("sample_id", F.col("split_id").cast("int").alias("fold")), "sample_id").select(F.lit(0).alias("group"), "fold", F.lit(True).alias("trains"), "sample_id", "x", "y", "label", "classes")


def shared_survival(rows: DataFrame, labels: DataFrame, cubes: list[list[int]], mode: str = "remove", count: int | None = None, folds: int = 5, drawn: int | None = None, seed: int = 0, alpha: float = 1.0) -> DataFrame:
    """(step, cube, accuracy): greedy removal or addition of cubes, bins or channel groups by one cross-validation that all steps share.

    ``cubes`` lists the places of each. With ``drawn`` a step looks at so many
    candidates, drawn with the seed. Labels need two samples of each class.
    """
    tests, sums = folded(_dealt(X.with_classes(rows, labels), P.stratified_folds(labels, "label", folds, seed=seed)))

    def some(group: int, step: int, left: list[int]) -> list[int]:
        return sorted(np.random.default_rng([seed, step]).permutation(left)[:drawn].tolist())

    names = list(range(len(cubes)))
    out, _ = steps(tests, sums, {0: names if mode == "remove" else []}, names, lambda g, c: [[p] for k in sorted(c) for p in cubes[k]], mode, len(cubes) if count is None else min(count, len(cubes)), alpha, some if drawn else None)
    return rows.sparkSession.createDataFrame([(r["step"], r["candidate"], r["score"]) for r in out], "step int, cube int, accuracy double")


def wide_cubes(features: DataFrame) -> tuple[DataFrame, dict[int, list[int]]]:
    """(rows, places): (sample_id, x) of (sample_id, cube, pos, value), missing values as 0, and each cube's places in ``x``.

    The positions of all cubes are features of one model, so their number is that of the
    columns of a matrix that fits in a task; only their names come to the driver.
    """
    names = [tuple(r) for r in features.select("cube", "pos").distinct().orderBy("cube", "pos").collect()]
    at = features.sparkSession.createDataFrame([(c, p, k) for k, (c, p) in enumerate(names)], "cube int, pos long, _k int")
    each = features.join(F.broadcast(at), ["cube", "pos"]).groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("_k", F.col("value").cast("double")))).alias("_m"))
    places: dict[int, list[int]] = {}
    for k, (c, _) in enumerate(names):
        places.setdefault(c, []).append(k)
    x = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0.0)))
    return each.select("sample_id", x.alias("x")), places


def _inner(named: DataFrame, test: DataFrame, folds: int) -> DataFrame:
    """Rows of all outer folds: fold -1 is the outer test, the others are dealt to inner folds class by class in the order of their ids."""
    splits = test.select(F.col("split_id").cast("int").alias("group")).distinct()
    outer = test.select(F.col("split_id").cast("int").alias("group"), "sample_id", F.lit(-1).alias("fold"))
    each = named.crossJoin(F.broadcast(splits)).join(outer, ["group", "sample_id"], "left")  # splits times samples: each split deals its rows anew
    order = Window.partitionBy("group", F.col("fold").isNull(), "label").orderBy(F.col("sample_id").cast("string"))
    dealt = each.withColumn("trains", F.col("fold").isNull()).withColumn("_k", F.row_number().over(order) - 1)
    return dealt.select("group", F.coalesce("fold", F.col("_k") % folds).cast("int").alias("fold"), "trains", "sample_id", "x", "y", "label", "classes")


def survival(rows: DataFrame, labels: DataFrame, test: DataFrame, cubes: dict[int, list[int]], mode: str = "remove", count: int | None = None, folds: int = 3, alpha: float = 1.0, look_ahead: float = 0.0) -> DataFrame:
    """(fold, step, cube, inner_accuracy, outer_accuracy): leak-free greedy removal or addition of cubes for each outer fold.

    ``cubes`` names the places of each cube. Cubes are chosen by cross-validation within
    the outer fold's training rows; ``outer_accuracy`` is that of the chosen cubes on the
    rows of ``test``. With ``look_ahead`` a cube's score gains so much of the best gain
    that a second one would bring. One job a step for all folds; ties to the smallest cube.
    """
    named = X.with_classes(rows, labels)
    tests, sums = folded(_inner(named, test, folds))
    inner_tests, inner_sums, outer_tests, outer_sums = tests.where("fold >= 0"), sums.where("fold >= 0"), tests.where("fold < 0"), sums.where("fold < 0")
    groups = sorted(r[0] for r in test.select(F.col("split_id").cast("int")).distinct().collect())
    names = sorted(cubes)
    n_classes = labels.select("label").distinct().count()
    at = lambda own: [[p] for c in sorted(own) for p in cubes[c]]
    sign = -1 if mode == "remove" else 1
    chosen = {g: list(names) if mode == "remove" else [] for g in groups}
    steps_of, ends = [], []
    for step in range(min(len(names), len(names) if count is None else count)):
        left = {g: sorted(own) if mode == "remove" else [c for c in names if c not in own] for g, own in chosen.items()}
        changed = lambda own, *by: [c for c in own if c not in by] if mode == "remove" else [*own, *by]
        trials = {(g, k, k): changed(chosen[g], c) for g in groups for k, c in enumerate(names) if c in left[g]}
        if look_ahead:
            trials |= {(g, j, k): changed(chosen[g], names[j], names[k]) for g in groups for j in range(len(names)) for k in range(len(names)) if j != k and names[j] in left[g] and names[k] in left[g]}
        sets = [(g, j * len(names) + k, at(own)) for (g, j, k), own in trials.items() if own]
        mean = candidate_scores(inner_tests, inner_sums, sets, alpha).groupBy("group", "candidate").agg(F.avg("score").alias("score")) if sets else None
        told = {(r["group"], *divmod(r["candidate"], len(names))): r["score"] for r in mean.collect()} if sets else {}  # candidates times folds, which are few
        told |= {t: 0.0 if own else 1 / n_classes for t, own in trials.items() if t not in told}
        for g in groups:
            def score(k: int, g: int = g) -> float:
                more = max([told[g, k, j] - told[g, k, k] for j in range(len(names)) if j != k and (g, k, j) in told], default=0.0) if look_ahead else 0.0
                return round(told[g, k, k] + look_ahead * more, 12)

            best = max((k for k, c in enumerate(names) if c in left[g]), key=lambda k: (score(k), -k))
            chosen[g] = changed(chosen[g], names[best])
            steps_of.append((g, step, names[best], float(score(best))))
            if chosen[g]:
                ends.append((g, step, at(chosen[g])))
    outer = candidate_scores(outer_tests, outer_sums, ends, alpha).select(F.col("group").alias("fold"), F.col("candidate").alias("step"), F.col("score").alias("outer_accuracy"))
    found = rows.sparkSession.createDataFrame(steps_of, "fold int, step int, cube int, inner_accuracy double")
    return found.join(outer, ["fold", "step"], "left").withColumn("outer_accuracy", F.coalesce("outer_accuracy", F.lit(1 / n_classes)))


def set_scores(rows: DataFrame, labels: DataFrame, sets: list[tuple[int, list[int]]], folds: int = 3, alpha: float = 1.0) -> DataFrame:
    """(set_id, accuracy): cross-validated balanced accuracy of each set of places, all in one job; each class is dealt to folds in the order of ids."""
    named = X.with_classes(rows, labels)
    order = Window.partitionBy("label").orderBy(F.col("sample_id").cast("string"))
    dealt = named.withColumn("fold", ((F.row_number().over(order) - 1) % folds).cast("int")).withColumn("group", F.lit(0)).withColumn("trains", F.lit(True))
    tests, sums = folded(dealt.select("group", "fold", "trains", "sample_id", "x", "y", "label", "classes"))
    scores = candidate_scores(tests, sums, [(0, k, [[p] for p in places]) for k, places in sets], alpha)
    every = rows.sparkSession.createDataFrame([(k,) for k, _ in sets], "set_id int")
    return every.join(scores.groupBy(F.col("candidate").alias("set_id")).agg(F.avg("score").alias("accuracy")), "set_id", "left").na.fill(0.0, ["accuracy"])


def by_signal(baseline: dict[int, float], least: int) -> Callable[[DataFrame], DataFrame]:
    """The winner by gain over noise, (mean - baseline) / (deviation + 1e-8), among candidates that win in at least so many folds; where none does, among all."""

    def pick(scores: DataFrame) -> DataFrame:
        first = F.row_number().over(Window.partitionBy("group", "fold").orderBy(F.desc(F.round("score", 12)), "candidate"))
        ranked = scores.withColumn("_won", (first == 1).cast("int"))
        base = F.element_at(F.create_map(*[F.lit(v) for kv in baseline.items() for v in kv]), F.col("group"))
        each = ranked.groupBy("group", "candidate").agg(F.avg("score").alias("score"), F.stddev_pop("score").alias("_d"), F.sum("_won").cast("int").alias("wins"))
        each = each.withColumn("snr", F.round((F.col("score") - base) / (F.col("_d") + 1e-8), 9))
        order = F.struct((F.col("wins") >= least).cast("int"), F.col("snr"), -F.col("candidate"))
        return each.groupBy("group").agg(F.max_by(F.struct("candidate", "score", "wins", "snr"), order).alias("_b")).select("group", "_b.*")

    return pick


def nested_channels(rows: DataFrame, labels: DataFrame, channels: int, width: int = 1, how: str = "concat", mode: str = "add", count: int = 40, repeats: int = 3, folds: int = 3, least: int = 3, seed: int = 0, alpha: float = 1.0) -> DataFrame:
    """(repeat, step, channel, wins, snr, validation, test): greedy channels inside repeated stratified splits of 80 to 20.

    Channels are chosen on the training rows alone, standardised by them: inner fold f
    holds the sample at place f of each class in a seeded order. ``validation`` is the
    mean over inner folds, ``test`` the accuracy on the outer fifth after the step; the
    row of step -1 has the scores before any step.
    """
    named = X.with_classes(rows, labels)
    outer = P.stratified_folds(labels, "label", 5, repeats, seed).where("split_id % 5 = 0").select((F.col("split_id") / 5).cast("int").alias("group"), "sample_id", F.lit(-1).alias("fold"))
    each = named.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).join(outer, ["group", "sample_id"], "left").withColumn("trains", F.col("fold").isNull())
    scaled = standardised(each, each.where("trains"))
    w = Window.partitionBy("group", "trains", "label")
    placed = scaled.withColumn("_k", F.row_number().over(w.orderBy(F.xxhash64("sample_id", "group", F.lit(seed)), "sample_id")) - 1).withColumn("_n", F.count("*").over(w))
    # the sample at place k of a class of n is held by folds k, k + n, ...
    inner = F.when(F.col("_k") < folds, F.sequence(F.col("_k"), F.lit(folds - 1), F.col("_n").cast("int")))
    own = F.when(F.col("trains"), F.concat(F.array(F.lit(None).cast("int")), F.coalesce(inner, F.array().cast("array<int>")))).otherwise(F.array("fold"))
    dealt = placed.withColumn("fold", F.explode(own)).withColumn("trains", F.col("trains") & F.col("fold").isNull())
    tests, sums = folded(dealt.select("group", "fold", "trains", "sample_id", "x", "y", "label", "classes"))
    inner_tests, inner_sums, outer_tests, outer_sums = tests.where("fold >= 0"), sums.where("fold >= 0"), tests.where("fold < 0"), sums.where("fold < 0")

    names = list(range(channels))
    begin = {g: names if mode == "remove" else [] for g in range(repeats)}
    at = lambda g, c: channel_places(sorted(c), width, how)
    first = {r["group"]: r["score"] for r in candidate_scores(inner_tests, inner_sums, [(g, -1, at(g, c)) for g, c in begin.items()], alpha).groupBy("group").agg(F.avg("score").alias("score")).collect()}
    baseline = dict(first)

    found, chosen = [], begin
    for step in range(min(count, channels)):
        rows_of, chosen = steps(inner_tests, inner_sums, chosen, names, at, mode, 1, alpha, pick=by_signal(baseline, least))
        for r in rows_of:
            baseline[r["group"]] = r["score"]
            found.append({**r, "step": step, "chosen": list(chosen[r["group"]])})
    last = len({r["step"] for r in found}) + 1
    ends = [(g, g * last, at(g, c)) for g, c in begin.items()] + [(r["group"], r["group"] * last + 1 + r["step"], at(r["group"], r["chosen"])) for r in found]
    tested = candidate_scores(outer_tests, outer_sums, ends, alpha).select(F.col("group").alias("repeat"), (F.col("candidate") % last - 1).alias("step"), F.col("score").alias("test"))
    table = [(g, -1, None, None, None, first.get(g)) for g in begin] + [(r["group"], r["step"], r["candidate"], r["wins"], r["snr"], r["score"]) for r in found]
    return rows.sparkSession.createDataFrame(table, "repeat int, step int, channel int, wins int, snr double, validation double").join(tested, ["repeat", "step"], "left")


def count_map(rows: DataFrame, labels: DataFrame, bins: int, channels: int, bin_counts: list[int], channel_counts: list[int], folds: int = 5, seed: int = 0, alpha: float = 1.0) -> DataFrame:
    """(rt_bins, mz_channels, accuracy) for each pair of counts: bins are left by greedy removal on one stratified half, channels on the other.

    ``x`` has the places bin * channels + channel. Removals to a smaller count go on from
    those to a larger one. Channels are removed with the bins held, and the rest is
    scored by leave-one-out on the second half.
    """
    named = X.with_classes(rows, labels)
    half = P.stratified_folds(labels, "label", 2, seed=seed)
    a, b = (labels.join(half.where(F.col("split_id") == k), "sample_id", "left_semi") for k in (0, 1))
    sides = [folded(_dealt(named, P.stratified_folds(s, "label", folds, seed=seed + 1))) for s in (a, b)]

    def left_after(out: list[dict], group: int, all_of: int, keep: int) -> list[int]:
        gone = {r["candidate"] for r in out if r["group"] == group and r["step"] < all_of - keep}
        return [k for k in range(all_of) if k not in gone]

    by_bin, _ = steps(*sides[0], {0: list(range(bins))}, [], lambda g, c: [[r * channels + k] for r in c for k in range(channels)], "remove", bins - min(bin_counts), alpha)
    held = {g: left_after(by_bin, 0, bins, keep) for g, keep in enumerate(bin_counts)}
    # each count of bins is a group of its own over the same rows
    tests, sums = (t.drop("group").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(len(bin_counts) - 1)))) for t in sides[1])
    by_channel, _ = steps(tests, sums, {g: list(range(channels)) for g in held}, [], lambda g, c: [[r * channels + k] for r in held[g] for k in c], "remove", channels - min(channel_counts), alpha)
    cells = [(keep, k, [r * channels + c for r in held[g] for c in left_after(by_channel, g, channels, k)]) for g, keep in enumerate(bin_counts) for k in channel_counts]
    return loo_accuracy(named.join(b.select("sample_id"), "sample_id"), cells, alpha)


def loo_accuracy(named: DataFrame, cells: list[tuple[int, int, list[int]]], alpha: float = 1.0) -> DataFrame:
    """(rt_bins, mz_channels, accuracy): share of samples whose class ridge tells without them, for each cell's places."""
    wanted = named.sparkSession.createDataFrame(cells, "rt_bins int, mz_channels int, places array<int>")
    sub = F.transform("places", lambda p: F.get("x", p))
    each = named.crossJoin(F.broadcast(wanted)).select("rt_bins", "mz_channels", "sample_id", "label", sub.alias("x"), F.posexplode("classes").alias("class", "_c"))  # the short list of cells
    told = X.leave_one_out(each.withColumn("y", F.array(F.when(F.col("_c") == F.col("label"), 1.0).otherwise(-1.0))), "rt_bins", "mz_channels", "class", alpha=alpha)
    best = told.groupBy("rt_bins", "mz_channels", "sample_id").agg(F.max_by("y_true", F.struct(F.round("y_pred", 12), -F.col("class"))).alias("_y"))
    return best.groupBy("rt_bins", "mz_channels").agg(F.avg((F.col("_y") > 0).cast("double")).alias("accuracy"))
