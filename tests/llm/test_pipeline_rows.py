"""Which rows each stage of the pipeline drops, against plain Python, with odd rows and clashing names."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from retort.llm.tokens import Encoder, default_path
from test_dedup_and_decontamination import brute
from test_decontamination_whole import all_pairs
from test_more_shards_rules_classifier import statistics
from test_secrets import plain_spans

STAGE = dict(P.STAGES)


def tables(spark, folder):
    r = np.random.default_rng(5)
    prose = lambda n: " ".join(f"v{k}" for k in r.integers(0, 5000, n))
    good = [(k, prose(int(r.integers(60, 200)))) for k in range(1200)]
    items = [(k, prose(25)) for k in range(4)] + [(9, None)]
    rows = good + [(2000 + k, good[k][1]) for k in range(5)] + [(2100 + k, good[10][1] + f" tail{k}") for k in range(20)]
    rows += [(2200, f"{prose(60)} {items[1][1]} {prose(50)}"), (2201, f"{prose(60)}\npassword: hunter22 {prose(20)}"), (2202, prose(60) + " token=abc123xyz" + " " + prose(30)), (2203, "# $ % " * 40 + prose(40))]
    rows += [(3000, None), (3001, ""), (3002, "short"), (3003, "same words again " * 60), (None, prose(70)), (4, good[4][1]), (3004, prose(20_000))]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("kept", F.lit("k")).withColumn("_row", F.lit(1)).withColumn("n_words", F.lit(-1))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(1200)] + [(2203, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def key(rows):
    return sorted((i is None, i or 0, t or "") for i, t in rows)


def test_stages_drop_what_plain_python_drops(spark, tmp_path):
    rows, items = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns

    def stage(name):
        nonlocal docs
        docs = P.written(STAGE[name](spark, docs, str(tmp_path)), name)
        assert docs.columns == columns and docs.where("kept <> 'k' OR _row <> 1 OR n_words <> -1").count() == 0
        return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]

    now = stage("quality_rules")
    counts = [(i, t, statistics(t)) for i, t in rows]
    passed = [(i, t) for i, t, (n, _, _, _, again) in counts if n >= 50 and 100 * again <= 50 * n]
    assert set(key(now)) <= set(key(passed)) and len(passed) - len(now) <= 1 + 0.02 * len(passed) and 2203 not in {i for i, _ in now}

    before, now = now, stage("near_dedup")
    root = brute([(i, t) for i, t in before if i is not None and i < 3004], 5)
    want = {i for i, (_, c) in root.items() if c == i} | {i for i, _ in before if i is None or i >= 3004}
    assert {i for i, _ in now} == want and len(now) == len(want) < len(before)

    before, now = now, stage("decontamination")
    leaked = {i for i, _ in all_pairs([x for x in before if (x[0] or 0) >= 1000], items)}
    assert key(now) == key((i, t) for i, t in before if i not in leaked) and 2200 in leaked

    before, now = now, stage("secret_scan")
    assert [i for _, i, _ in key(now)] == [i for _, i, _ in key(before)]
    text = dict(before)
    for r in docs.collect():
        spans = plain_spans(text[r.doc_id])
        assert r.n_chars == len(r.text) and (r.text == text[r.doc_id]) == (not spans) and not plain_spans(r.text)
    assert "hunter22" not in dict(now)[2201]

    pieces = STAGE["packing"](spark, docs, str(tmp_path)).collect()
    coder = Encoder(default_path()).tokenizer
    for i, t in now:
        ids = np.array([*coder.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in own) == ids and all(zlib.crc32(p.ids) == p.ids_crc32 for p in own)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
    assert re.fullmatch(r"\w+", P.STAGES[0][0])
