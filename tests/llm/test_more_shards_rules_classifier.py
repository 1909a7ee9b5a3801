import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from retort.llm import near_dedup as N
from retort.llm import quality_classifier as Q
from retort.llm import quality_rules as R
from retort.llm import sharding as H
from retort.llm.words import mix, window_hashes

ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "word " * 30_000), (904, "l one\nl one\nl one"), (5, "again again again again"), (5, "again again again again"), (None, "no id here")]


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(k % 40 if k % 3 else 7, "x" * (k % 60), f"s{k}") for k in range(300)] + [(None, None, "n"), (None, "y", "n"), (7, "z" * 900, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").withColumn("depth", F.lit(1)).withColumn("bytes", F.lit("b"))
    name = H.write_shards(docs, 200, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert name == "_shard" and sorted(got.drop(name).columns) == sorted(docs.columns)
    assert Counter(tuple(r) for r in got.select(docs.columns).collect()) == Counter(tuple(r) for r in docs.collect())
    sizes = got.groupBy(name).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("b"), F.count("*").alias("n")).collect()
    assert all(r.b <= 200 or r.n == 1 for r in sizes)
    assert H.assign_shards(docs, 200).columns == ["doc_id", "shard", "depth", "shard_bytes", "shard_docs"]


def test_shards_are_the_shortest_prefixes_that_fit(spark):
    rows = [(k, "x" * (k * 7 % 50)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = H.assign_shards(docs, 300).collect()
    bits = {r.doc_id: r.b for r in docs.select("doc_id", F.expr(H._bits("cast(doc_id AS string)")).alias("b")).collect()}
    below = lambda p: sum(len(t) for i, t in rows if bits[i].startswith(p))
    for r in got:
        want = next(bits[r.doc_id][:d] for d in range(61) if below(bits[r.doc_id][:d]) <= 300)
        assert (r.shard, r.depth, r.shard_bytes) == (want, len(want), below(want))


def test_names_of_other_columns_do_not_matter_to_dedup(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "x"), (3, "long " * 50_000)], "doc_id long, text string")
    for c in ("_gone", "_again", "kept", "component_id", "count"):
        docs = docs.withColumn(c, F.lit(c))
    left = N.without_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 3]


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules_query_against_plain_counts(spark, data):
    texts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: statistics(r.text) for r in texts}
    for r in R.query(spark, data).collect():
        n, _, _, _, again = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        assert r.base_failed == (n < 50 or 100 * again > 50 * n) and r.kept == (not r.base_failed and not r.rejected_by)


def test_rules_on_odd_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(i, t, None if i == 900 else "en") for i, t in ODD], "doc_id long, text string, lang string")
    for c in ("n_words", "kept", "base_failed", "rejected_by", "_text", "_row", "_s", "good", "stratum", "holdout"):
        docs = docs.withColumn(c, F.lit(c))
    labels = spark.createDataFrame([(5, 1), (5, 0), (903, 1), (None, 1)], "doc_id long, quality int")
    got = R.quality_rules(docs, labels)
    assert got.count() == len(ODD) and sorted(got.columns) == sorted({*docs.columns, *R.ADDED})
    assert Counter(tuple(r) for r in got.select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()) == Counter(statistics(t) for _, t in ODD)
    kept = R.kept_documents(docs.withColumn("text", F.concat_ws(" ", "text", F.lit(" ".join(f"w{k}" for k in range(60))))), labels)
    assert kept.columns == docs.columns and {r.n_words for r in kept.collect()} == {"n_words"} and kept.count() == len(ODD) - 1
    assert R.text_statistics(docs).where("n_words > 3").count() == 4 and R.quality_rules(docs.limit(0), labels.limit(0)).count() == 0


def test_bound_holds_jointly_in_all_strata(spark):
    """Shares drawn evenly from 0 to 1: a set with cutoffs c rejects 1 - prod(c) of good documents."""
    r = np.random.default_rng(2)
    rules = list(R.RULES)
    for risk in (0.05, 0.2):
        rows = [(f"s{s}", bool(r.random() < 0.75), *map(float, np.ceil(r.random(len(rules)) * R.GRID) / R.GRID)) for s in range(60) for _ in range(700)]
        labelled = spark.createDataFrame(rows, f"stratum string, holdout boolean, {', '.join(f'{x} double' for x in rules)}")
        found = R.risk_cutoffs(labelled, risk, 0.05).collect()
        accepted = [x for x in found if x.cutoffs is not None]
        assert len(found) == 60 and len(accepted) > 50
        assert all(1 - np.prod(np.minimum(1, x.cutoffs)) < risk for x in accepted)
        assert all(x.rejected <= risk * x.n for x in accepted) and max(x.steps for x in accepted) >= 5


def test_strata_with_few_labels_reject_nothing(spark):
    good = [("a", k % 4 > 0, *[0.1] * 5) for k in range(2000)] + [("b", k % 4 > 0, *[0.1] * 5) for k in range(20)] + [(None, k % 4 > 0, *[0.2] * 5) for k in range(2000)]
    labelled = spark.createDataFrame(good, f"stratum string, holdout boolean, {', '.join(f'{x} double' for x in R.RULES)}")
    found = {x.stratum: x for x in R.risk_cutoffs(labelled).collect()}
    assert found["a"].cutoffs == [0.1] * 5 and found["b"].cutoffs is None and found[None].cutoffs == [0.2] * 5


def plain_score(text, lean, bias):
    """A document's score from its words, one by one."""
    words = (text or "").split()
    word_hash = lambda w: Q.split_words(pa.array([w])).hashes()
    found = []
    for w in words:
        found.append(int(mix(word_hash(w))[0] % np.uint64(Q.BUCKETS)))
        raw = np.frombuffer(f"<{w}>".encode(), np.uint8).astype(np.uint64)
        for n in Q.NGRAMS:
            for k in range(len(raw) - n + 1):
                h = window_hashes(raw[k : k + n] + np.uint64(n << 8), n)
                found.append(int(mix(h)[0] % np.uint64(Q.BUCKETS)))
    for a, b in zip(words, words[1:], strict=False):
        found.append(int(window_hashes(np.concatenate([word_hash(a), word_hash(b)]), 2)[0] % np.uint64(Q.BUCKETS)))
    mean = np.mean(lean[found]) if found else 0.0
    return 1 / (1 + np.exp(-(mean + bias)))


def test_classifier_query_scores_as_word_by_word(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(0)
    weights, bias = r.normal(size=(Q.BUCKETS, 2)) * 3, np.array([0.1, -0.2])
    monkeypatch.setattr(Q, "fit", lambda docs, labels: (weights, bias))
    rows = [(k, " ".join(r.choice(["the", "The", "é", "ünder", "x", "longer-word!", "a"], r.integers(0, 12)))) for k in range(60)] + [x for x in ODD if len(x[1] or "") < 1000]
    spark.createDataFrame([(i, t, 1.0, "p") for i, t in rows], "doc_id long, text string, score double, predicted string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted((x.doc_id is None, x.doc_id or 0, round(x.score, 9), x.predicted) for x in Q.query(spark, str(tmp_path)).collect())
    lean = weights[:, 1] - weights[:, 0]
    want = [(i is None, i or 0, s := round(plain_score(t, lean, bias[1] - bias[0]), 9), int(s >= 0.5)) for i, t in rows]
    assert got == sorted(want)


def test_classifier_on_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "good words"), (1, "good words"), (None, "good words"), (2, "bad ### words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 0)], "doc_id long, quality int")
    assert Q.score(docs, Q.fit(docs, labels)).count() == 4
    assert Q.score(docs.limit(0), Q.fit(docs.limit(0), labels)).collect() == []


def test_many_rows_of_one_labelled_id_are_one_training_row(spark):
    docs = spark.range(10_000).select(F.lit(6).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 5000).alias("text")).unionByName(spark.createDataFrame([(7, "a b"), (7, None), (8, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(k, 1) for k in (6, 7, 8, 9)], "doc_id long, quality int")
    got = sorted((r.doc_id, r.text) for r in Q._sample(docs, labels, 100).collect())
    known = {k for k in (6, 7, 8) if zlib.crc32(str(k).encode()) % 3 != 1}
    assert known and [i for i, _ in got] == sorted(known)


def test_ten_thousand_strata(spark):
    """Strata are joined, not held in one map: one with labels enough gets cutoffs, the others and a null one reject nothing."""
    body = "plain words of some length here and there " * 8
    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(body), F.col("id")).alias("text"), F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 97 == 0, None).otherwise(F.concat(F.lit("host"), F.col("id"))).alias("host"))
    docs = docs.withColumn("text", F.concat_ws(" ", F.lit(" ".join(f"w{k}" for k in range(60))), F.col("doc_id"), F.when(F.col("doc_id") % 900 == 3, F.lit(" ".join(f"#{k}$%" for k in range(80))))))
    labels = spark.range(10_000).select(F.col("id").alias("doc_id"), (F.col("id") % 900 != 3).cast("int").alias("quality"))
    out = R.quality_rules(docs, labels, stratum="host", columns=["doc_id", "host"]).select("doc_id", "host", "base_failed", "kept").collect()
    assert len(out) == 10_000
    gone = {r.doc_id for r in out if not r.kept and not r.base_failed}
    assert gone and all(r.host == "big" for r in out if r.doc_id in gone) and {k for k in range(10_000) if k % 900 == 3} >= gone
