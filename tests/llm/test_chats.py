"""Transcripts against a plain Python parser."""

import numpy as np
import pytest

from retort.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string"
WORDS = ["User: why is it so?", "plain words here", "", "Assistant: because of this and that", "a longer line " * 6, "System: be kind", "Q: how?", "A: so", "<|end|> tag"]


def conversations(n=25, seed=4):
    r = np.random.default_rng(seed)
    return [(c, t, C.ROLES[r.integers(0, 3)], "\n".join(WORDS[k] for k in r.integers(0, len(WORDS), r.integers(1, 6)))) for c in range(n) for t in range(int(r.integers(1, 9)))]


def brute(lines, model):
    """(role, n_lines, rendered) of each turn of one transcript, by Viterbi over all its lines."""
    import re

    symbols = []
    for k, line in enumerate(lines):
        marker = next((i + 1 for i, r in enumerate(C.ROLES) if re.search(C.MARKERS[r], line)), 0)
        size = sum(len(line) >= n for n in C.LENGTHS)
        blank = 1 if k == 0 else int(lines[k - 1].strip(" ") == "")
        symbols.append(((marker * (1 + len(C.LENGTHS)) + size) * 2 + bool(re.search(r"\?\s*$", line))) * 2 + blank)
    step, seen = model[:, 1 : 1 + C.STATES], model[:, 1 + C.STATES :]
    score, back = [model[:, 0] + seen[:, symbols[0]]], []
    for s in symbols[1:]:
        ways = score[-1][:, None] + step
        back.append(ways.argmax(0))
        score.append(ways.max(0) + seen[:, s])
    path = [int(score[-1].argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path.reverse()
    turns = []
    for state, line in zip(path, lines, strict=True):
        if state % 2 == 0 or not turns:
            turns.append([C.ROLES[state // 2], []])
        for m in C.MARKERS.values():
            line = re.sub(m, "", line) if state % 2 == 0 else line
        turns[-1][1].append(line)
    return [(r, len(x), f"<|{r}|>\n" + "\n".join(x).replace("<|", "< |") + "\n<|end|>") for r, x in turns]


@pytest.mark.parametrize("block", [3, 1024])
def test_chats_are_those_of_a_plain_parser(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK_LINES", block)
    rows = conversations()
    turns = spark.createDataFrame(rows, SCHEMA)
    model = C.fit(C.as_lines(turns))
    got = {}
    for x in C.format_chats(turns.repartition(5), model).collect():
        got.setdefault(x.conv_id, {})[x.turn_no] = (x.role, x.n_lines, x.rendered)
    for c in {r[0] for r in rows}:
        lines = "\n".join(t for i, _, _, t in rows if i == c).split("\n")
        assert [got[c][k] for k in range(len(got[c]))] == brute(lines, model)


@pytest.mark.parametrize("block", [2, 1024])
def test_row_borders_do_not_matter(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK_LINES", block)
    rows = conversations(12, 9)
    model = C.fit(C.as_lines(spark.createDataFrame(rows, SCHEMA)))
    whole = [(c, 0, None, "\n".join(t for i, _, _, t in rows if i == c)) for c in {r[0] for r in rows}]
    each = [(c, k, None, line) for c, _, _, t in whole for k, line in enumerate(t.split("\n"))]
    as_set = lambda r: {(x.conv_id, x.turn_no, x.role, x.rendered) for x in C.format_chats(spark.createDataFrame(r, SCHEMA), model).collect()}
    assert as_set(rows) == as_set(whole) == as_set(each)


def test_repeated_rows_stay_apart_and_names_may_clash(spark):
    rows = [(1, 0, "user", "a\nb\nc", "x"), (1, 0, "assistant", "e\nf", "y"), (1, 0, "user", "a\nb\nc", "z")]
    turns = spark.createDataFrame(rows, SCHEMA + ", line string").withColumn("block", C.F.lit("b")).withColumn("_id", C.F.lit(0))
    lines = [x.line for x in sorted(C.as_lines(turns).collect(), key=lambda x: x.n)]
    assert len(lines) == 8 and "".join(lines) in {"abcabcef", "abcefabc", "efabcabc"}
    assert sum(x.n_lines for x in C.format_chats(turns).collect()) == 8


def test_a_long_turn_spans_blocks(spark):
    rows = [(1, None, "assistant", "Assistant: x\n" + "more\n" * 5000), (1, None, "user", None)]
    lines = C.as_lines(spark.createDataFrame(rows, SCHEMA).withColumn("turn", C.F.coalesce("turn", C.F.lit(-1))))
    assert lines.select("block").distinct().count() == 5 and lines.groupBy("block").count().agg({"count": "max"}).collect()[0][0] == 1024
    assert sum(x.n_lines for x in C.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()) == 5003


def test_query_against_a_plain_parser(spark, data):
    """The registered query: each half of the conversations is parsed by the model of the other half."""
    turns = C.transcripts(spark.read.parquet(f"{data}/conversations.parquet"))
    lines = C.as_lines(turns).withColumn("fold", C.F.expr("pmod(xxhash64(conv_id), 2)"))
    models = [C.fit(lines.where(f"fold <> {k}").drop("fold")) for k in (0, 1)]
    texts, fold = {}, {}
    for x in sorted(lines.select("conv_id", "n", "line", "fold").collect(), key=lambda x: (x.conv_id, x.n)):
        texts.setdefault(x.conv_id, []).append(x.line)
        fold[x.conv_id] = x.fold
    rows = {c: "\n".join(r.text for r in sorted(g, key=lambda r: r.turn)) for c, g in _grouped(turns.collect()).items()}
    assert {c: "\n".join(t) for c, t in texts.items()} == rows
    got = {}
    for x in C.query(spark, data).collect():
        got.setdefault(x.conv_id, {})[x.turn_no] = (x.role, x.n_lines, x.rendered)
    assert got.keys() == texts.keys()
    for c, t in texts.items():
        assert [got[c][k] for k in range(len(got[c]))] == brute(t, models[fold[c]])


def _grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.conv_id, []).append(r)
    return out
