"""Quality rules whose cutoffs carry a bound on false rejection.

Each rule is a share taken from a whole text. Labelled documents are dealt into two folds:
the first proposes, for each stratum, a ladder of cutoff sets from lenient to strict, one
cutoff for each rule; the second, the holdout, tests the ladder from its lenient end. A
set is accepted if the number of good holdout documents that *any* of its rules rejects is
so small that, with an exact binomial tail, a true joint false-rejection rate of ``risk``
or more has a probability of at most ``error`` / (number of strata). The first set that
fails ends the stratum's ladder (a fixed sequence, which needs no correction within the
ladder), so with probability 1 - ``error`` the accepted sets of all strata hold together.
The strictest accepted set is used; without one no rule rejects anything.

Only DataFrame functions are used. Everything about a text is computed in its own row,
so texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm.scratch import written

# The word separators and the symbols that the base statistics count.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaim", "n_upper")

#: Shares from 0 to 1 that the rules test; a document is rejected above a cutoff.
RULES = {
    "symbol_share": "n_symbols / word_chars",
    "repeat_share": "n_repeat_words / n_words",
    "duplicate_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "exclamation_share": "n_exclaim / word_chars",
    "upper_share": "n_upper / word_chars",
}
#: Shares are rounded up to one of so many values, which bounds what percentiles have to hold.
GRID = 10_000
#: The ladder: so much above the largest share of a good document in the proposing fold, then its quantiles.
ABOVE = (0.2, 0.1, 0.05, 0.02, 0.0)
QUANTILES = (0.999, 0.995)
#: Columns that :func:`quality_rules` adds.
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept")
_NONE = "\x02"


def _row(docs: DataFrame, columns: list[str]) -> Column:
    """The columns as one struct, so that helper columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")


def _fields(columns: list[str]) -> list[Column]:
    return [F.col("_row").getField(c).alias(c) for c in columns]


def _counted(rows: DataFrame) -> DataFrame:
    """Replaces ``_text`` by the struct ``_s`` of STATISTICS."""
    gone = lambda chars: F.length("_text") - F.length(F.translate("_text", chars, ""))
    step = rows.withColumn("_text", F.coalesce("_text", F.lit(""))).withColumn("_words", F.expr(r"filter(split(_text, '[ \\t-\\r]+'), w -> w != '')"))
    step = step.withColumn("n_words", F.size("_words").cast("long"))
    step = step.withColumn("_windows", F.expr("CASE WHEN n_words < 3 THEN array() ELSE transform(sequence(0, int(n_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) END"))
    step = step.withColumn("_again", F.expr("size(_windows) > size(array_distinct(_windows))"))
    # Windows beside an equal one in the order of (hash, place); a place is covered by itself and the two before it.
    step = step.withColumn("_placed", F.expr("CASE WHEN _again THEN sort_array(transform(_windows, (h, i) -> struct(h, i))) ELSE array() END"))
    step = step.withColumn(
        "_starts",
        F.expr("sort_array(transform(filter(transform(_placed, (p, k) -> struct(p.i, (k > 0 AND _placed[k - 1].h = p.h) OR (k + 1 < size(_placed) AND _placed[k + 1].h = p.h) AS twice)), p -> p.twice), p -> p.i))"),
    )
    step = step.withColumn("n_repeat_words", F.expr("aggregate(transform(_starts, (s, k) -> CASE WHEN k = 0 THEN 3 ELSE least(3, s - _starts[k - 1]) END), 0L, (t, x) -> t + x)"))
    step = step.withColumn("_lines", F.expr(r"filter(split(_text, '\n'), l -> l RLIKE '[^ \\t-\\r]')"))
    step = step.withColumn("n_lines", F.size("_lines").cast("long"))
    step = step.withColumn("n_dup_lines", (F.col("n_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    step = step.withColumn("word_chars", F.length(F.translate("_text", SPACE, "")).cast("long"))
    step = step.withColumn("n_symbols", gone(SYMBOLS).cast("long"))
    step = step.withColumn("n_exclaim", gone("!").cast("long"))
    step = step.withColumn("n_upper", gone("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long"))
    # A generator of one row keeps later filters from being pushed below, which would repeat all of the above in them.
    own = [c for c in rows.columns if c != "_text"]
    return step.select(*own, F.explode(F.array(F.struct(*[F.col(c) for c in STATISTICS]))).alias("_s"))


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_exclaim and n_upper.

    They replace columns of ``docs`` that have these names; other columns stay as they
    are, whatever their names. A null text counts as an empty one. Three-word windows are
    compared by a 64-bit hash, which within one text of a million words errs with a
    chance of 3e-8.
    """
    carried = [c for c in docs.columns if c not in STATISTICS]
    rows = docs.select(_row(docs, docs.columns), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return _counted(rows).select(*_fields(carried), "_s.*")


def shares(stats: DataFrame) -> DataFrame:
    """Adds the rules' shares, rounded up to the grid; they are 0 for a text without words."""
    return stats.withColumns({name: F.expr(f"CASE WHEN n_words > 0 THEN ceil({rule} * {GRID}) / {GRID}D ELSE 0D END") for name, rule in RULES.items()})


def _with(rows: DataFrame, stratum: str, values: DataFrame, value: str, how: str) -> DataFrame:
    """Rows with ``value`` of their stratum; a null stratum is one of its own. The optimiser knows the sizes of both sides."""
    found = values.select(F.coalesce("stratum", F.lit(_NONE)).alias("_key"), F.col(value).alias(f"_{value}"))
    return rows.withColumn("_key", F.coalesce(F.col(stratum), F.lit(_NONE))).join(found, "_key", how).drop("_key")


def ladders(proposing: DataFrame) -> DataFrame:
    """(stratum, ladder) from (stratum, the rules' shares) of good documents: cutoff sets from lenient to strict."""
    points = ", ".join(map(str, (1.0, *QUANTILES)))
    held = proposing.groupBy("stratum").agg(*[F.expr(f"percentile({r}, array({points}))").alias(r) for r in RULES])
    steps = [[F.col(r)[0] + F.lit(x) for r in RULES] for x in ABOVE] + [[F.col(r)[k + 1] for r in RULES] for k in range(len(QUANTILES))]
    return held.select("stratum", F.array(*[F.array(*step) for step in steps]).alias("ladder"))


def risk_cutoffs(labelled: DataFrame, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """(stratum, cutoffs, steps, n, rejected) from (stratum, holdout, the rules' shares) of good documents.

    ``cutoffs`` is the strictest accepted set, in the order of RULES, or null, ``steps``
    its place on the ladder (0: none), ``n`` the stratum's good holdout documents and
    ``rejected`` how many of them the set rejects. Only counts by stratum are shuffled.
    """
    ladder = written(ladders(labelled.where("NOT holdout")), "ladders")
    known = _with(labelled.where("holdout"), "stratum", ladder, "ladder", "inner")
    hit = lambda k: F.expr(" OR ".join(f"{r} > _ladder[{k}][{j}]" for j, r in enumerate(RULES))).cast("long")
    n_steps = len(ABOVE) + len(QUANTILES)
    tested = known.groupBy("stratum").agg(F.count("*").alias("n"), F.array(*[F.sum(hit(k)) for k in range(n_steps)]).alias("counts"))
    tests = ladder.agg(F.count("*").alias("tests"))
    limit = tested.crossJoin(tests).withColumn("allowed", F.expr(_largest_allowed(risk, error)))
    steps = F.expr("aggregate(counts, struct(0 AS steps, true AS on), (s, c) -> struct(s.steps + int(s.on AND c <= allowed) AS steps, s.on AND c <= allowed AS on), s -> s.steps)")
    found = _with(limit.withColumn("steps", steps), "stratum", ladder, "ladder", "inner")
    return found.select("stratum", F.when(F.col("steps") > 0, F.get("_ladder", F.col("steps") - 1)).alias("cutoffs"), "steps", "n", F.when(F.col("steps") > 0, F.get("counts", F.col("steps") - 1)).alias("rejected"))


def _largest_allowed(risk: float, error: float) -> str:
    """SQL for the largest k with P(Bin(n, risk) <= k) <= error / tests, or -1.

    The fold's state is (log of the last term, log of the sum, largest k so far); beyond
    the mean the sum is over any sensible error, so k need not go further.
    """
    odds = f"ln({risk}D / (1D - {risk}D))"
    log_add = "greatest(s.total, {t}) + ln(1D + exp(-abs(s.total - ({t}))))"
    term = f"s.term + ln((n - k + 1D) / k) + {odds}"
    total = log_add.format(t=term)
    first = f"n * ln(1D - {risk}D)"
    return (
        f"aggregate(sequence(1L, greatest(1L, bigint(ceil(n * {risk}D)))), "
        f"struct(double({first}) AS term, double({first}) AS total, CASE WHEN {first} <= ln({error}D / tests) THEN 0L ELSE -1L END AS most), "
        f"(s, k) -> CASE WHEN k > n THEN s ELSE struct(double({term}) AS term, double({total}) AS total, CASE WHEN {total} <= ln({error}D / tests) THEN k ELSE s.most END AS most) END, "
        "s -> s.most)"
    )


def holdout_fold() -> str:
    """SQL for the holdout: three quarters of the labelled rows, by crc32 of doc_id."""
    return "crc32(cast(doc_id AS string)) % 4 <> 0"


def _judged(docs: DataFrame, labels: DataFrame, stratum: str, risk: float, error: float, columns: list[str]) -> DataFrame:
    """(_row, _s, base_failed, rejected_by, kept) of every document; ``_row`` holds ``columns``."""
    rows = docs.select(_row(docs, columns), F.col("doc_id").alias("_id"), F.col(stratum).cast("string").alias("_stratum"), F.col("text").cast("string").alias("_text"))
    stats = shares(_counted(rows).select("_row", "_id", "_stratum", "_s", "_s.*"))
    stats = stats.select("_row", "_id", "_stratum", "_s", *RULES, F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words").alias("base_failed"))
    stats = written(stats, "statistics")
    truth = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good")).where("good")
    known = stats.where("NOT base_failed").select(F.col("_id").alias("doc_id"), F.struct(F.col("_stratum").alias("stratum"), *RULES).alias("v")).join(truth, "doc_id")
    once = known.groupBy("doc_id").agg(F.min("v").alias("v")).select(F.expr(holdout_fold()).alias("holdout"), "v.*")
    cutoffs = written(risk_cutoffs(written(once, "labelled"), risk, error).where("cutoffs IS NOT NULL"), "cutoffs")
    hits = [F.when(F.col(r) > F.get("_cutoffs", F.lit(j)), F.lit(r)) for j, r in enumerate(RULES)]
    out = _with(stats, "_stratum", cutoffs, "cutoffs", "left").withColumn("rejected_by", F.array_compact(F.array(*hits)))
    return out.select("_row", "_s", "base_failed", "rejected_by", F.expr("NOT base_failed AND size(rejected_by) = 0").alias("kept"))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, error: float = 0.05, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all, unless given) with the base statistics, base_failed, rejected_by and kept.

    base_failed: fewer than 50 words, or more than half of them in repeated three-word
    windows. kept: not base_failed, and rejected by no rule. Documents that base_failed
    take no part in choosing cutoffs. In each stratum the rules together reject good
    documents at a rate below ``risk``, in all strata at once with probability
    1 - ``error``.

    A null stratum is a stratum of its own; where a stratum has too few labels to prove a
    set of cutoffs, or none, its rules reject nothing. A doc_id with several labels counts
    as good if one says so; rows with one doc_id are judged each and count as one labelled
    document; a null doc_id has no label. Null and empty texts fail the base rule. An
    empty table gives an empty result. Columns of ``docs`` that have the name of an added
    one (ADDED) are replaced by it; :func:`kept_documents` leaves all columns alone.

    The statistics are computed once and written to the shared folder with ``columns``;
    labels are joined with the narrow columns of that table, so no text is shuffled.
    """
    carried = list(docs.columns) if columns is None else columns
    out = _judged(docs, labels, stratum, risk, error, carried)
    return out.select(*_fields([c for c in carried if c not in ADDED]), *[F.col("_s").getField(c).alias(c) for c in ADDED[:5]], *ADDED[5:])


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with their columns as they are."""
    return _judged(docs, labels, stratum, risk, error, list(docs.columns)).where("kept").select(*_fields(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over all ``documents``, their cutoffs from ``labels``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_rules(docs, labels, columns=["doc_id"]).select("doc_id", *ADDED[:6], "kept", F.concat_ws(",", "rejected_by").alias("rejected_by"))
