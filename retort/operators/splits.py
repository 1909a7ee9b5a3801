"""Cross-validation splits as tables of test rows: (split_id, sample_id). Training rows are the others.

Draws are hashes of ids with a seed, so a split does not depend on row order or partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _draw(*parts: str | int) -> Column:
    """A number of 60 bits that is fixed by the columns and the numbers given, on any engine."""
    text = F.concat_ws("/", *[F.lit(str(p)) if isinstance(p, int) else F.col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def leave_one_out(samples: DataFrame, unit: str = "sample_id") -> DataFrame:
    """One split for each unit; with a composite unit its whole replicate group is the test set."""
    return samples.select(F.col(unit).cast("string").alias("split_id"), "sample_id")


def one_per_class(samples: DataFrame, label: str, repeats: int, seed: int = 0, unit: str = "sample_id") -> DataFrame:
    """Repeat r tests the unit at place r modulo the class size, in a seeded order, of each class; classes of one unit raise an error."""
    units = samples.select(label, F.col(unit).alias("_u")).distinct()
    w = Window.partitionBy(label)
    placed = units.withColumn("_k", F.row_number().over(w.orderBy(_draw("_u", seed), "_u")) - 1).withColumn("_n", F.count("*").over(w))
    checked = placed.withColumn("_n", F.when(F.col("_n") >= 2, F.col("_n")).otherwise(F.raise_error(F.lit("a class has fewer than two units")).cast("long")))
    chosen = checked.withColumn("split_id", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).where(F.col("_k") == F.col("split_id") % F.col("_n"))
    return chosen.join(samples.select("sample_id", F.col(unit).alias("_u"), label), ["_u", label]).select("split_id", "sample_id")


def _units_by_class(samples: DataFrame, label: str, unit: str) -> DataFrame:
    """(label, _u, _k, _n): each unit's place in the order of its class, and the class's size."""
    units = samples.select(label, F.col(unit).alias("_u")).distinct()
    w = Window.partitionBy(label)
    return units.withColumn("_k", (F.row_number().over(w.orderBy("_u")) - 1).cast("long")).withColumn("_n", F.count("*").over(w))


def _of_units(chosen: DataFrame, samples: DataFrame, label: str, unit: str) -> DataFrame:
    return chosen.join(samples.select("sample_id", F.col(unit).alias("_u"), label), ["_u", label]).select("split_id", "sample_id")


def drawn_one_per_class(samples: DataFrame, label: str, repeats: int, seed: int = 0, unit: str = "sample_id") -> DataFrame:
    """Each repeat tests one unit of each class, drawn anew and independently by a hash of class, repeat and seed; all samples of the unit are tested."""
    placed = _units_by_class(samples, label, unit).withColumn("split_id", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return _of_units(placed.where(F.col("_k") == _draw(label, "split_id", seed) % F.col("_n")), samples, label, unit)


def all_one_per_class(samples: DataFrame, label: str, first: int = 0, count: int | None = None, unit: str = "sample_id") -> DataFrame:
    """The splits that test one unit of each class, all of them or ``count`` from the number ``first`` on.

    A split's number is read as digits, the first class in order the fastest, with the
    classes' sizes as bases: split k tests the unit at place (k div product of the
    earlier sizes) mod size. So any range of splits is computed without those before it.
    """
    placed = _units_by_class(samples, label, unit)
    sizes = placed.groupBy(F.col(label).cast("string").alias("_l")).agg(F.max("_n").alias("_n"))
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct("_l", "_n"))).alias("_all"))  # one row, a value for each class
    total = F.aggregate("_all", F.lit(1).cast("decimal(38,0)"), lambda t, x: (t * x["_n"]).cast("decimal(38,0)"))
    last = total if count is None else F.least(total, F.lit(first + count).cast("decimal(38,0)"))
    base = F.aggregate(F.filter("_all", lambda x: x["_l"] < F.col("_c._l")), F.lit(1).cast("decimal(38,0)"), lambda t, x: (t * x["_n"]).cast("decimal(38,0)"))
    chosen = listed.withColumn("_last", last.cast("long")).where(F.col("_last") > first).withColumn("split_id", F.explode(F.sequence(F.lit(first).cast("long"), F.col("_last") - 1)))
    # a place for each split and class, so units are not multiplied by splits
    each = chosen.select("split_id", "_all", F.explode("_all").alias("_c")).select("split_id", F.col("_c._l").alias("_l"), F.col("_c._n").alias("_m"), base.alias("_base"))
    at = each.select("split_id", "_l", F.expr("pmod(split_id div _base, _m)").cast("long").alias("_k"))
    return _of_units(placed.withColumn("_l", F.col(label).cast("string")).join(at, ["_l", "_k"]), samples, label, unit)


def group_shuffle(samples: DataFrame, group: str, share: float, repeats: int, seed: int = 0, label: str | None = None) -> DataFrame:
    """int(groups * share) whole groups are the test set of each repeat.

    With a label, a class that got no group adds its first one by the same draw.
    """
    groups = samples.select(F.col(group).alias("_g"), *([label] if label else [])).distinct()
    each = groups.withColumn("split_id", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_d", _draw("_g", "split_id", seed))
    w = Window.partitionBy("split_id")
    ranked = each.withColumn("_k", F.row_number().over(w.orderBy("_d", "_g"))).withColumn("_n", F.count("*").over(w))
    test = F.col("_k") <= F.floor(F.col("_n") * share)
    if label:
        test = test | (F.row_number().over(Window.partitionBy("split_id", label).orderBy("_k")) == 1) & (F.max(test.cast("int")).over(Window.partitionBy("split_id", label)) == 0)
        ranked = ranked.withColumn("_t", test)
        test = F.col("_t")
    return ranked.where(test).select("split_id", "_g").join(samples.select("sample_id", F.col(group).alias("_g")), "_g").select("split_id", "sample_id")


def stratified_folds(samples: DataFrame, label: str, folds: int, repeats: int = 1, seed: int = 0) -> DataFrame:
    """Each class is dealt round-robin to the folds in a seeded order; split_id counts repeats times folds."""
    each = samples.select("sample_id", label).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    k = F.row_number().over(Window.partitionBy("_r", label).orderBy(_draw("sample_id", "_r", seed), "sample_id")) - 1
    return each.withColumn("_k", k).select((F.col("_r") * folds + F.col("_k") % folds).cast("int").alias("split_id"), "sample_id")


def train_val_test(samples: DataFrame, label: str, val: float, test: float, seed: int = 0) -> DataFrame:
    """(sample_id, role): a stratified three-way split; shares are of each class, rounded down."""
    w = Window.partitionBy(label)
    ranked = samples.select("sample_id", label).withColumn("_k", F.row_number().over(w.orderBy(_draw("sample_id", seed), "sample_id"))).withColumn("_n", F.count("*").over(w))
    n_test, n_val = F.floor(F.col("_n") * test), F.floor(F.col("_n") * val)
    return ranked.select("sample_id", F.when(F.col("_k") <= n_test, "test").when(F.col("_k") <= n_test + n_val, "val").otherwise("train").alias("role"))


def group_folds(samples: DataFrame, group: str, folds: int, seed: int = 0, repeats: int = 1) -> DataFrame:
    """Whole groups are dealt round-robin to folds in a seeded order, so that folds differ by one group at most; split_id counts repeats times folds."""
    groups = samples.select(F.col(group).alias("_g")).distinct().withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    k = F.row_number().over(Window.partitionBy("_r").orderBy(_draw("_g", "_r", seed), "_g")) - 1
    dealt = groups.withColumn("split_id", (F.col("_r") * folds + k % folds).cast("int"))
    return samples.select("sample_id", F.col(group).alias("_g")).join(dealt, "_g").select("split_id", "sample_id")


def training_rows(samples: DataFrame, test: DataFrame) -> DataFrame:
    """(split_id, sample_id) of the rows that a split does not test."""
    every = test.select("split_id").distinct().crossJoin(samples.select("sample_id").distinct())  # splits times samples: the definition of training rows
    return every.join(test, ["split_id", "sample_id"], "left_anti")
