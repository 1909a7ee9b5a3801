"""The decontamination query on whole tables against alignment of every document with every item."""

import random
import re
import unicodedata
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from retort.llm import decontamination as D


def words(text):
    kept = "".join(c for c in text or "" if c in "\t\n\x0b\f\r " or unicodedata.category(c)[0] in "LN").lower()
    return re.findall(r"[^\x20\x09-\x0D]+", kept)


def best_score(item, text):
    """Smith-Waterman over words, one row of the table at a time."""
    row, best, steps = np.zeros(len(text), int), 0, np.arange(len(text))
    for w in item:
        step = np.where(text == w, 2, -1)
        step[1:] += row[:-1]
        row = np.maximum(np.maximum(step, row - 1), 0)
        row = np.maximum.accumulate(row + steps) - steps
        best = max(best, int(row.max(initial=0)))
    return best


def all_pairs(docs, items, n=3):
    number = {}
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in words(t)], int)
    texts = [(i, code(t)) for i, t in docs if t]
    scores = {}
    for j, t in items:
        item = code(t)
        for i, text in texts:
            if len(item) >= n and len(text):
                s = best_score(item, text)
                if s >= 2 * len(item) * 0.5 or s >= 100:
                    scores[i, j] = max(s, scores.get((i, j), 0))
    return scores


def found(docs, items, n=3, similarity=0.5, long_score=100):
    """Scores by the operator's task on its own, so that its constants can be set."""
    kept = [(i, " ".join(words(t))) for i, t in items if len(words(t)) >= n]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], ["doc_id", "text"])
    best = {}
    for part in D._finder(SimpleNamespace(value=D.prepared(kept, n, similarity, long_score)), n)([batch]):
        for r in part.to_pylist():
            if r["score"] >= min(2 * r["item_words"] * similarity, long_score):
                key = r["doc_id"], r["item_id"]
                best[key] = max(best.get(key, 0), r["score"])
    return best


def test_recall_on_the_given_tables_is_that_of_all_pairs(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    want = all_pairs(docs, items)
    assert want and {(r.doc_id, r.item_id): r.score for r in D.query(spark, data).collect()} == want


@pytest.mark.parametrize("n", [1, 2, 3, 4])
@pytest.mark.parametrize("chunk", [100, 1 << 20])
@pytest.mark.parametrize("needed, skipped", [(D.NEEDED, D.SKIPPED), ((4,), (3,)), ((8,), (0,)), ((1,), (20,))])
def test_any_choice_of_seeds_meets_every_copy(monkeypatch, n, chunk, needed, skipped):
    """Copies with every kind of edit, near the limit, for choices of seeds however dear."""
    monkeypatch.setattr(D, "CHUNK", chunk)
    monkeypatch.setattr(D, "NEEDED", needed)
    monkeypatch.setattr(D, "SKIPPED", skipped)
    r = random.Random(n)
    word = lambda: f"v{int(r.paretovariate(0.5)) % 300}"
    items = [(k, " ".join(word() for _ in range(r.choice((4, 5, 12, 25, 60))))) for k in range(15)] + [(20, "a b " * 9), (21, "same " * 12)]
    docs = [(k, " ".join(word() for _ in range(80))) for k in range(8)] + [(8, ""), (9, "a b a b x b a"), (10, "same other " * 30)]
    for k, (_, t) in enumerate(items):
        w = t.split()
        for e, every in enumerate((2, 3, 4)):
            docs.append((100 + 10 * k + e, " ".join(f"{x} y{j}" if j % every == 1 else x for j, x in enumerate(w))))
            docs.append((400 + 10 * k + e, " ".join("z" if j % every == 1 else x for j, x in enumerate(w))))
            docs.append((700 + 10 * k + e, f"{word()} " * 9 + " ".join(x for j, x in enumerate(w) if r.random() > 0.13 * every)))
    want = all_pairs(docs, items, n)
    assert len(want) > 60 and found(docs, items, n) == want


def test_passages_of_a_large_benchmark(spark, data, monkeypatch):
    """10,000 items cut from the given texts: few of the pairs of text and item are even looked at."""
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect() if r.text and len(r.text.split()) > 40]
    r, tried = random.Random(4), []
    own = [t.split() for _, t in texts]
    items = []
    for k in range(10_000):
        w = own[r.randrange(len(own))]
        at = r.randrange(len(w) - 30)
        items.append((k, " ".join(f"u{r.randrange(10**6)}" if r.random() < 0.7 else x for x in w[at : at + 30])))
    for k in range(0, 10_000, 500):
        items[k] = (k, " ".join(own[k % len(own)][5:35]))
    docs = [(i, " ".join(t.split()[:3000])) for i, t in texts[:100]]
    bound = D._best_sum
    monkeypatch.setattr(D, "_best_sum", lambda gains: tried.append(len(gains)) or bound(gains))
    got = found(docs, items)
    exact = {k for k in range(0, 10_000, 500) if k % len(own) < 100}
    assert exact <= {k for _, k in got}
    # Each passage is bounded twice. All pairs would be a million.
    assert sum(tried) / 2 < 20_000


def test_huge_items_common_grams_and_repeated_ids(spark):
    r = np.random.default_rng(3)
    line = "this very common line is everywhere"
    fresh = lambda n: " ".join(f"w{k}" for k in r.integers(0, 100_000, n))
    huge = fresh(6000)
    items = [(1, huge), (2, f"{line} {fresh(20)}"), (3, fresh(15)), (3, fresh(15)), (None, fresh(12))]
    docs = [(k, f"{fresh(40)} {line} {fresh(10)}") for k in range(60)]
    part = " ".join(huge.split()[3000:3080])
    docs += [(100, f"{fresh(50)} {part} {fresh(9)}"), (101, items[3][1]), (101, "nothing here"), (102, items[4][1]), (None, items[1][1]), (103, items[1][1].replace(" ", "\n")), (104, huge)]
    schema = "doc_id long, text string"
    frame = spark.createDataFrame(docs, schema).withColumn("item_id", D.F.lit("x")).withColumn("score", D.F.lit(0)).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", D.F.lit(1)).withColumn("words", D.F.lit(1))
    got = {(x.doc_id, x.item_id): x.score for x in D.contaminated(frame, bench).collect()}
    assert got == all_pairs(docs, items)
    assert {(100, 1), (101, 3), (102, None), (None, 2), (103, 2), (104, 1)} == got.keys()
