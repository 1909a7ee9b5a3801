"""Transcripts to canonical chat turns: a hidden Markov model recovers who speaks.

A transcript is one text of lines in order, given in one row or, as it may be long, in
several; where rows begin plays no part. Each line shows a symbol: its speaker marker, if
any, its length class, whether it ends in a question mark and whether the line before is
blank.
The hidden state is a role and whether the line opens a turn. Transitions and symbols are
counted on labelled transcripts; the Viterbi path gives roles and turns, which are
rendered in one form.

Long transcripts are decoded in blocks. The best scores from any state before a block to
any state at its end are a small matrix; chaining those fixes the states at the blocks'
borders, after which blocks decode alone. So no transcript has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm.scratch import written

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # 2 * role, plus 1 for lines that go on
#: Lines that are decoded together.
BLOCK_LINES = 1024

# Speaker markers at the start of a line.
MARKERS = {
    "system": r"(?i)^\s*(?:#{1,4}\s*)?(?:system|instructions?)\s*[:>]\s*",
    "user": r"(?i)^\s*(?:#{1,4}\s*)?(?:user|human|customer|question|q)\s*[:>]\s*",
    "assistant": r"(?i)^\s*(?:#{1,4}\s*)?(?:assistant|ai|bot|response|answer|a)\s*[:>]\s*",
}
LENGTHS = (1, 20, 60, 150, 400)
SYMBOLS = (1 + len(ROLES)) * (1 + len(LENGTHS)) * 4


def line_symbol(line: Column, before: Column) -> Column:
    """What a line shows, as a number below SYMBOLS; ``before`` is the line before or null."""
    marker = F.coalesce(*[F.when(line.rlike(MARKERS[r]), F.lit(k + 1)) for k, r in enumerate(ROLES)], F.lit(0))
    size = sum((F.length(line) >= n).cast("int") for n in LENGTHS)
    asks = line.rlike(r"\?\s*$").cast("int")
    blank = F.coalesce((F.trim(before) == "").cast("int"), F.lit(1))
    return ((marker * (1 + len(LENGTHS)) + size) * 2 + asks) * 2 + blank


def ordered_rows(turns: DataFrame) -> DataFrame:
    """Rows in the order of each transcript: conv_id, part, role, lines, from (conv_id, turn, role, text), and what stands before.

    Rows are sorted by (conv_id, turn, hash of the text) over all tasks, so that a long
    transcript spans several parts; ``first`` is the number of its first line within the
    transcript. ``before`` has the last line, the role and whether it has several lines
    of the row before it, and is null for a transcript's first row.
    """
    rows = turns.select("conv_id", "turn", "role", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"), F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_id"))
    order = ["conv_id", "turn", "_hash", "_id"]
    rows = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "rows")
    own = F.struct(F.element_at("lines", -1).alias("line"), "role", (F.size("lines") > 1).alias("long"))
    parts = rows.groupBy("conv_id", "part").agg(F.sum(F.size("lines")).alias("_lines"), F.max_by(own, F.struct(*order[1:])).alias("_last"))
    over = "OVER (PARTITION BY conv_id ORDER BY part"
    parts = parts.select("conv_id", "part", F.expr(f"coalesce(sum(_lines) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("_earlier"), F.expr(f"lag(_last) {over})").alias("_above"))
    over = "OVER (PARTITION BY conv_id, part ORDER BY turn, _hash, _id"
    rows = rows.withColumn("_own", own).withColumn("_before", F.expr(f"lag(_own) {over})")).withColumn("_inside", F.expr(f"coalesce(sum(size(lines)) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    return rows.join(parts, ["conv_id", "part"]).select("conv_id", "turn", "role", "lines", (F.col("_earlier") + F.col("_inside")).alias("first"), F.coalesce("_before", "_above").alias("before"))


def as_lines(turns: DataFrame) -> DataFrame:
    """(conv_id, block, n, turn, k, line, symbol, role, before_role, before_inner): the lines of (conv_id, turn, role, text) rows.

    ``n`` counts the lines of a transcript, and a block is BLOCK_LINES of them, so neither
    blocks nor symbols show where rows begin. A line's role is its row's, ``k`` its place
    there; ``before_role`` and ``before_inner`` tell the row of the line before it and
    whether that line goes on within its row.
    """
    each = ordered_rows(turns).select("conv_id", "first", "turn", "role", "before", "lines", F.posexplode("lines").alias("k", "line"))
    above = F.when(F.col("k") > 0, F.expr("lines[k - 1]")).otherwise(F.col("before.line"))
    n = F.col("first") + F.col("k")
    return each.select(
        "conv_id", F.floor(n / BLOCK_LINES).cast("long").alias("block"), n.cast("long").alias("n"), "turn", "k", "line", line_symbol(F.col("line"), above).alias("symbol"), "role",
        F.when(F.col("k") > 0, F.col("role")).otherwise(F.col("before.role")).alias("before_role"), F.when(F.col("k") > 0, F.col("k") > 1).otherwise(F.col("before.long")).alias("before_inner"),
    )


def fit(lines: DataFrame) -> np.ndarray:
    """Log probabilities, STATES rows: first state, transitions, symbols; counts have one added.

    ``lines`` has roles. Only counts by state and symbol, a fixed number, reach the driver.
    """
    number = lambda c: F.expr(f"CASE {c} " + " ".join(f"WHEN '{r}' THEN {k}" for k, r in enumerate(ROLES)) + " END")
    known = lines.select("n", "symbol", (number("role") * 2 + (F.col("k") > 0).cast("int")).alias("state"), (number("before_role") * 2 + F.col("before_inner").cast("int")).alias("old")).where("state IS NOT NULL")
    seen, step = np.ones((STATES, SYMBOLS)), np.ones((STATES, STATES))
    first = np.full(STATES, 1e-9)
    first[::2] = 1
    for r in known.groupBy("state", "symbol", "old", (F.col("n") == 0).alias("opening")).count().collect():
        seen[r.state, r.symbol] += r["count"]
        if r.opening:
            first[r.state] += r["count"]
        elif r.old is not None:
            step[r.old, r.state] += r["count"]
    return np.log(np.c_[first / first.sum(), step / step.sum(1, keepdims=True), seen / seen.sum(1, keepdims=True)])


def transfer(model: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Best log score from each state before the lines to each state at the last of them."""
    step, seen = model[:, 1 : 1 + STATES], model[:, 1 + STATES :]
    out = step + seen[:, symbols[0]]
    for s in symbols[1:]:
        out = (out[:, :, None] + step[None]).max(1) + seen[:, s]
    return out


def viterbi(model: np.ndarray, symbols: np.ndarray, enter: int = -1, leave: int = -1) -> np.ndarray:
    """The likeliest states of the lines; ``enter`` is the state before them (-1: none), ``leave`` that of the last (-1: free)."""
    step, seen = model[:, 1 : 1 + STATES], model[:, 1 + STATES :]
    score = (model[:, 0] if enter < 0 else step[enter]) + seen[:, symbols[0]]
    back = np.zeros((len(symbols), STATES), np.int8)
    for k, s in enumerate(symbols[1:], 1):
        ways = score[:, None] + step
        back[k] = ways.argmax(0)
        score = ways.max(0) + seen[:, s]
    path = np.zeros(len(symbols), np.int64)
    path[-1] = score.argmax() if leave < 0 else leave
    for k in range(len(symbols) - 1, 0, -1):
        path[k - 1] = back[k, path[k]]
    return path


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups from batches that are sorted by the keys."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        frame = batch.to_pandas()
        if not len(frame):
            continue
        change = np.flatnonzero((frame[keys] != frame[keys].shift()).any(axis=1).to_numpy())
        change = change[change > 0]
        if held and (held[-1][keys].iloc[-1] != frame[keys].iloc[0]).any():
            yield pd.concat(held)
            held = []
        for a, b in zip(np.r_[0, change][:-1], change, strict=True):
            yield pd.concat([*held, frame.iloc[a:b]]) if held else frame.iloc[a:b]
            held = []
        held.append(frame.iloc[change[-1] if len(change) else 0 :])
    if held:
        yield pd.concat(held)


def _chainer(model: np.ndarray):
    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        matrices = [np.array(m).reshape(STATES, STATES) for m in blocks["matrix"]]
        scores = [np.array(blocks["opening"].iloc[0])]
        for m in matrices[1:]:
            scores.append((scores[-1][:, None] + m).max(0))
        ends = [int(scores[-1].argmax())]
        for m, s in zip(matrices[:0:-1], scores[-2::-1], strict=True):
            ends.append(int((s + m[:, ends[-1]]).argmax()))
        ends.reverse()
        return pd.DataFrame({"conv_id": blocks["conv_id"].to_numpy(), "block": blocks["block"].to_numpy(), "enter": [-1, *ends[:-1]], "leave": ends})

    return run


_MATRIX = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("matrix", pa.list_(pa.float64())), ("opening", pa.list_(pa.float64()))])
_LINE = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("line", pa.string()), ("role", pa.string()), ("state", pa.int32())])


def decode(lines: DataFrame, model: np.ndarray) -> DataFrame:
    """Adds ``state`` to the lines: the Viterbi path of each transcript."""
    keys = ["conv_id", "block"]

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, keys):
            symbols = run["symbol"].to_numpy()
            opening = model[:, 0] + model[:, 1 + STATES + symbols[0]]
            if len(symbols) > 1:
                opening = (opening[:, None] + transfer(model, symbols[1:])).max(0)
            yield pa.RecordBatch.from_pylist([{"conv_id": run["conv_id"].iloc[0], "block": run["block"].iloc[0], "matrix": transfer(model, symbols).ravel(), "opening": opening}], _MATRIX)

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, keys):
            path = viterbi(model, run["symbol"].to_numpy(), int(run["enter"].iloc[0]), int(run["leave"].iloc[0]))
            yield pa.RecordBatch.from_pandas(run[["conv_id", "block", "n", "line", "role"]].assign(state=path.astype(np.int32)), _LINE, preserve_index=False)

    long = lines.groupBy("conv_id").agg(F.max("block").alias("most"), F.min("block").alias("least")).where("most > least").select("conv_id")
    dealt = lines.join(long, "conv_id", "left_semi").select("conv_id", "block", "n", "symbol").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "n")
    chain = dealt.mapInArrow(matrices, "conv_id long, block long, matrix array<double>, opening array<double>").groupBy("conv_id").applyInPandas(_chainer(model), "conv_id long, block long, enter long, leave long")
    placed = lines.select("conv_id", "block", "n", "line", "role", "symbol").join(chain, ["conv_id", "block"], "left").fillna(-1, ["enter", "leave"]).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "n")
    return placed.mapInArrow(paths, "conv_id long, block long, n long, line string, role string, state int")


def canonical_turns(decoded: DataFrame) -> DataFrame:
    """(conv_id, turn_no, role, n_lines, n_right, rendered): turns as recovered, each in canonical form.

    ``n_right`` counts the lines whose labelled role is the recovered one. Markers are
    taken off, and a text's own ``<|`` is parted so that it cannot pass for a tag. A turn
    is one row, so it has to fit in one, as any text does.
    """
    decoded = written(decoded, "decoded")
    opens = (F.col("state") % 2 == 0).cast("long")
    blocks = decoded.groupBy("conv_id", "block").agg(F.sum(opens).alias("opened"))
    earlier = blocks.select("conv_id", "block", F.expr("coalesce(sum(opened) OVER (PARTITION BY conv_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("before"))
    inside = decoded.withColumn("_n", F.expr("sum(bigint(state % 2 = 0)) OVER (PARTITION BY conv_id, block ORDER BY n ROWS UNBOUNDED PRECEDING)"))
    numbered = inside.join(earlier, ["conv_id", "block"]).withColumn("turn_no", F.greatest(F.lit(0), F.col("before") + F.col("_n") - 1))
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.expr("state div 2") + 1).cast("int"))
    bare = F.col("line")
    for marker in MARKERS.values():
        bare = F.regexp_replace(bare, marker, "")
    clean = F.when(opens == 1, bare).otherwise(F.col("line"))
    turns = numbered.withColumn("said", role).groupBy("conv_id", "turn_no").agg(
        F.min_by("said", "n").alias("role"), F.count("*").alias("n_lines"), F.sum((F.col("said") == F.col("role")).cast("long")).alias("n_right"),
        F.array_sort(F.collect_list(F.struct("n", clean.alias("line")))).alias("_lines"),
    )
    content = F.replace(F.array_join(F.transform("_lines", lambda x: x.line), "\n"), F.lit("<|"), F.lit("< |"))
    return turns.select("conv_id", "turn_no", "role", "n_lines", F.coalesce("n_right", F.lit(0)).alias("n_right"), F.concat(F.lit("<|"), "role", F.lit("|>\n"), content, F.lit("\n<|end|>")).alias("rendered"))


def format_chats(turns: DataFrame, model: np.ndarray | None = None, folds: int = 1) -> DataFrame:
    """Canonical turns of transcripts given as (conv_id, turn, text[, role]) rows in the order of ``turn``.

    Rows with one conv_id are parts of one text, joined by line breaks; a row need not be
    a speaker's turn, the model decides where turns begin. Without a ``model`` one is
    fitted on the rows' roles; with ``folds`` above 1 each hash fold of conversations is
    decoded by a model fitted on the other folds, so that ``n_right`` counts on
    conversations the model has not seen. Null texts are empty lines, null or unknown
    roles are not fitted on, rows with a null conv_id form one transcript and a null turn
    counts as -1. Of rows with one (conv_id, turn) all lines are kept, row after row, in
    the order of a hash of their texts. An empty table gives an empty result; extra
    columns are not read.
    """
    role = F.col("role") if "role" in turns.columns else F.lit(None).cast("string")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), role.alias("role"), "text")
    rows = rows.withColumn("conv_id", F.coalesce("conv_id", F.lit(-(1 << 62))))
    lines = written(as_lines(rows), "lines")
    if model is None and folds > 1:
        fold = F.pmod(F.xxhash64("conv_id"), F.lit(folds))
        parts = [decode(lines.where(fold == k), fit(lines.where(fold != k))) for k in range(folds)]
        decoded = reduce(DataFrame.unionByName, parts)
    else:
        decoded = decode(lines, fit(lines) if model is None else model)
    out = canonical_turns(decoded)
    return out.withColumn("conv_id", F.when(F.col("conv_id") != -(1 << 62), F.col("conv_id")))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Transcripts from labelled turns: markers in one of three styles, or, in a quarter of the conversations, none."""
    styles = [{"system": "System: ", "user": "User: ", "assistant": "Assistant: "}, {"system": "### System: ", "user": "### Human: ", "assistant": "### Assistant: "}, {"system": "Instructions: ", "user": "Q: ", "assistant": "A: "}]
    style = F.expr("crc32(cast(conv_id AS string)) % 4")
    marker = F.coalesce(*[F.when((style == k) & (F.col("role") == r), F.lit(m)) for k, s in enumerate(styles) for r, m in s.items()], F.lit(""))
    return conversations.select("conv_id", "turn", "role", F.concat(marker, F.coalesce("text", F.lit(""))).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` as transcripts, parsed back into turns by models that were fitted on other conversations."""
    return format_chats(transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet")), folds=2)
