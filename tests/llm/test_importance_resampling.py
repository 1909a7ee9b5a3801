"""Importance weights and draws against plain Python over whole texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from retort.llm import importance_resampling as I

SCHEMA = "doc_id long, text string, row int, weight string"


def runs(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return words, [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def brute(docs, target, percent=5):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    own = [Counter(map(bucket, runs(t)[1])) for _, t in docs]
    s, t = sum(own, Counter()), sum((Counter(map(bucket, runs(x)[1])) for x in target), Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = []
    for (i, text), mine in zip(docs, own, strict=True):
        weight = sum(n * gain(b) for b, n in mine.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, sum(mine.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(runs(text)[0])])
    pool = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(pool[: percent * len(pool) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in frame.collect()), key=str)


def some_docs(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Émile", "ÀB", "x" * 70, "y" * 200, "日本", "a1b2", "--", "3.14", "don't"]
    common = "One common line, in many texts"
    rows = []
    for k in range(150):
        lines = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 12))) for _ in range(r.randrange(0, 7))]
        rows.append((k, "\n".join([*lines, common] if k % 3 == 0 else lines)))
    rows += [(k + 200, t) for k, (_, t) in enumerate(rows[:20])] + [(7, rows[9][1]), (7, rows[9][1]), (None, rows[12][1]), (None, "One\n\ntwo\nthree"), (300, None), (301, ""), (302, "\n\n"), (303, "\r\n. , ;\n")]
    rows += [(400, "solo word " * 20_000), (401, "\n".join(["a"] * 3000)), (402, "A" * 100_000 + " b")]
    return rows


@pytest.mark.parametrize("hot", [False, True])
def test_against_plain_python(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr("retort.llm.scratch.HOT_ROWS", 3)
        monkeypatch.setattr("retort.llm.scratch.HOT_MOST", 20)
    rows, target = some_docs(1), ["w1 w2 w3 w4\nw5 One common line", None, "Émile w7"]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA).repartition(5)
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    assert got(I.resample(docs, aim, percent=30)) == brute(rows, target, 30)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(k, "some words " * 15, 0, "x") for k in range(40)], SCHEMA)
    none = spark.createDataFrame([], "text string")
    assert I.resample(docs.limit(0), none).collect() == []
    assert got(I.resample(docs, none)) == brute([(k, "some words " * 15) for k in range(40)], [])


def test_checksums_of_joined_parts():
    r = np.random.default_rng(0)
    for n in (0, 1, 5, 63, 64, 65, 127, 128, 1000, 70_000):
        a, b = (r.integers(0, 256, k, dtype=np.uint8).tobytes() for k in (9, n))
        joined = I.carried(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0] ^ np.uint32(zlib.crc32(b))
        assert int(joined) == zlib.crc32(a + b)


def test_query_against_plain_python(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert got(I.query(spark, data)) == brute(rows, target)
