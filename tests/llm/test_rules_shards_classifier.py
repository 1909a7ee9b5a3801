import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from retort.llm import quality_classifier as Q
from retort.llm import quality_rules as R
from retort.llm import sharding as H


def test_statistics(spark):
    rows = [(1, "a b c a b c x"), (2, None), (3, ""), (4, " \n\t "), (5, "l one\nl one\n\n \n#x! B\nl one"), (6, "z z z z"), (7, "é \x1c#")]
    df = R.text_statistics(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in df.collect()}
    assert got == {1: (7, 7, 0, 0, 6), 2: (0, 0, 0, 0, 0), 3: (0, 0, 0, 0, 0), 4: (0, 0, 0, 0, 0), 5: (8, 16, 1, 2, 0), 6: (4, 4, 0, 0, 4), 7: (2, 3, 1, 0, 0)}
    assert R.text_statistics(spark.createDataFrame(rows, "doc_id long, text string")).where("n_words > 3").count() == 3


def test_exact_binomial_limit(spark):
    for n, risk, tests in ((50, 0.05, 1), (500, 0.05, 20), (3000, 0.01, 80), (20, 0.05, 5)):
        total, best = 0.0, -1
        for k in range(n + 1):
            total += math.comb(n, k) * risk**k * (1 - risk) ** (n - k)
            if total > 0.05 / tests:
                break
            best = k
        row = spark.createDataFrame([(n, tests)], "n long, tests long").select(F.expr(R._largest_allowed(risk, 0.05)).alias("k")).collect()[0]
        assert row.k == best


def test_rules_guard_good_documents(spark):
    good = [(k, f"lorem ipsum dolor {k} " + " ".join(f"w{k}x{j}" for j in range(60)), "en", 1) for k in range(2000)]
    bad = [(5000 + k, " ".join(f"w{k}y{j}###" for j in range(60)), "en", 0) for k in range(200)]
    rows = [(i, t, lang) for i, t, lang, _ in good + bad] + [(9000, None, None), (9001, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in good + bad], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in R.quality_rules(docs, labels, risk=0.01).collect()}
    assert sum(not got[k] for k in range(2000)) <= 20 and not any(got[5000 + k] for k in range(200)) and not got[9000] and not got[9001]
    free = R.quality_rules(docs, labels.limit(0)).where("kept").count()
    assert free == 2200
    assert R.quality_rules(docs.limit(0), labels).count() == 0


def test_shards_fit(spark):
    rows = [(k, "x" * (k % 50)) for k in range(500)] + [(None, None), (7, "y" * 5000)] + [(3, "same" * 10)] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = H.assign_shards(docs, 1000).collect()
    assert len(got) == len(rows)
    shards = {r.shard: (r.shard_bytes, r.shard_docs, r.depth) for r in got}
    assert all(n == 1 or b <= 1000 for b, n, _ in shards.values()) and all(len(s) == d for s, (_, _, d) in shards.items())
    assert sum(b for b, _, _ in shards.values()) == sum(len(t or "") for _, t in rows) and sum(n for _, n, _ in shards.values()) == len(rows)
    names = sorted(shards)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    assert {(r.shard, r.depth) for r in H.assign_shards(docs, 1 << 30).collect()} == {("", 0)}
    assert H.assign_shards(docs.limit(0), 10).collect() == []


def test_features_of_one_text_do_not_depend_on_others():
    texts = ["The the cat", None, "", "a", "b b b b"]
    alone = [list(np.sort(next(Q.rows_of(Q.featurize(pa.array([t], pa.string())))))) for t in texts]
    assert [list(np.sort(r)) for r in Q.rows_of(Q.featurize(pa.array(texts)))] == alone


def test_classifier_learns_and_scores_everything(spark):
    rows = [(k, f"plain words number {k} in a row" if k % 3 else f"JUNK!! {k} $$$ ###", "x") for k in range(240)] + [(999, None, "x"), (1000, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(240)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in Q.score(docs, Q.fit(docs, labels, rows=100)).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[k] >= 0.5) == (k % 3 > 0) for k in range(240)]) > 0.97
    none = Q.score(docs, Q.fit(docs, labels.limit(0)))
    assert {r.score for r in none.collect()} == {0.5}
