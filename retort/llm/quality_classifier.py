"""Quality classifier over supervised subword embeddings.

A text is the average of learned vectors of its words, word pairs, and the character
n-grams of each word between boundary marks, all hashed into a fixed number of buckets; a
softmax over that average gives the class. Vectors and softmax are trained together by
stochastic gradient descent in numpy, in one task, on a bounded sample of labelled rows.
Scoring reads whole texts in parallel: as average and softmax input are linear, each
bucket is reduced to one number per class before the model is broadcast, so a text
costs one lookup for each feature of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm.scratch import written
from retort.llm.words import mix, slices, split_words, window_hashes

#: Labelled rows that the model is fitted on at most: those with the smallest hashes of doc_id.
TRAIN_ROWS = 4000
BUCKETS = 1 << 16
DIMENSION = 8
#: Lengths in bytes of the character n-grams.
NGRAMS = (3, 4)
#: Bytes of text that are turned into features at once.
SLICE_BYTES = 4 << 20
#: Steps of gradient descent, at least; passes over the sample follow from it.
STEPS = 24_000
RATE = 0.5


class Features(NamedTuple):
    """Buckets of some texts' features: by distinct word (its n-grams and itself), and for each place that of its pair (or -1)."""

    bounds: np.ndarray
    codes: np.ndarray
    word_bounds: np.ndarray
    word_buckets: np.ndarray
    pair_buckets: np.ndarray


def featurize(texts: pa.Array) -> Features:
    """Features of an Arrow text column; case and marks count. The last word of a text has no pair."""
    words = split_words(texts)
    marked = [f"<{w}>".encode() for w in words.distinct.to_pylist()]
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    ends = np.cumsum(length)
    owner = np.repeat(np.arange(len(marked)), length)
    word_hash = words.hashes()
    own = np.zeros(len(marked), np.uint64)
    own[words.codes] = word_hash
    parts_of, parts = [np.arange(len(marked))], [own]
    for n in NGRAMS:
        if len(data) >= n:
            hashes = window_hashes(data + np.uint64(n << 8), n)
            inside = np.flatnonzero(np.arange(len(hashes)) + n <= ends[owner[: len(hashes)]])
            parts_of.append(owner[inside])
            parts.append(hashes[inside])
    of, values = np.concatenate(parts_of), np.concatenate(parts)
    order = np.argsort(of, kind="stable")
    bucket = (mix(values[order]) % np.uint64(BUCKETS)).astype(np.int64)
    n = len(words.codes)
    pairs = np.full(n, -1, np.int64)
    if n > 1:
        pairs[:-1] = (window_hashes(word_hash, 2) % np.uint64(BUCKETS)).astype(np.int64)
        pairs[words.bounds[1:][np.diff(words.bounds) > 0] - 1] = -1  # a text's last word has no pair
    return Features(words.bounds, words.codes, np.searchsorted(of[order], np.arange(len(marked) + 1)), bucket, pairs)


def rows_of(f: Features) -> Iterator[np.ndarray]:
    """All buckets of each text, with repeats."""
    for a, b in zip(f.bounds[:-1], f.bounds[1:], strict=True):
        codes = f.codes[a:b]
        first, n = f.word_bounds[codes], f.word_bounds[codes + 1] - f.word_bounds[codes]
        ends = np.cumsum(n)
        at = np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        pairs = f.pair_buckets[a:b]
        yield np.concatenate([f.word_buckets[at], pairs[pairs >= 0]])


def train(rows: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, n_classes: int = 2, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(bucket weights, bias): the product of learned vectors and softmax weights, by stochastic gradient descent.

    ``rows`` holds (distinct buckets, their counts) of each text. Without rows
    all weights are 0, which scores every text as undecided.
    """
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1, 1, (BUCKETS, DIMENSION)) / DIMENSION
    weights, bias = np.zeros((DIMENSION, n_classes)), np.zeros(n_classes)
    if not rows:
        return np.zeros((BUCKETS, n_classes)), bias
    passes = max(3, -(-STEPS // len(rows)))
    step, steps = 0, passes * len(rows)
    for _ in range(passes):
        for k in random.permutation(len(rows)):
            rate = RATE * (1 - step / steps)
            step += 1
            at, share = rows[k][0], rows[k][1] / max(1, int(rows[k][1].sum()))
            hidden = share @ vectors[at] if len(at) else np.zeros(DIMENSION)
            logits = hidden @ weights + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[classes[k]] -= 1
            back = weights @ p
            weights -= rate * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            if len(at):
                vectors[at] -= (rate * DIMENSION) * share[:, None] * back
    return vectors @ weights, bias


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` labelled rows outside the held-out fold: for each chosen doc_id one, that of the smallest hash of its text.

    Only the chosen ids are broadcast, a bounded number. Repeated rows of an id are told
    apart by a narrow table first, so that copies cost no shuffle of texts.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL AND crc32(cast(doc_id AS string)) % 3 <> 1").groupBy("doc_id").agg(F.max("quality").alias("label"))
    chosen = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "chosen")
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("key", F.md5(F.coalesce("text", F.lit(""))))
    least = written(own.groupBy("doc_id").agg(F.min("key").alias("key")), "least")
    # one row of at most ``rows`` for each id; equal texts of one id are one row
    return own.join(F.broadcast(least), ["doc_id", "key"]).groupBy("doc_id").agg(F.first("text").alias("text"), F.first("label").alias("label"))


def _featurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            counted = [np.unique(r, return_counts=True) for r in rows_of(featurize(part.column("text")))]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("label"), pa.array([c[0].astype("<i4").tobytes() for c in counted], pa.binary()), pa.array([c[1].astype("<i4").tobytes() for c in counted], pa.binary())],
                ["doc_id", "label", "buckets", "counts"],
            )


def _trainer(sample: pd.DataFrame) -> pd.DataFrame:
    sample = sample.sort_values(["doc_id", "buckets"])
    rows = [(np.frombuffer(b, "<i4"), np.frombuffer(c, "<i4")) for b, c in zip(sample["buckets"], sample["counts"], strict=True)]
    weights, bias = train(rows, sample["label"].to_numpy(np.int64))
    return pd.DataFrame({"weights": [weights.astype("<f8").tobytes()], "bias": [bias.astype("<f8").tobytes()]})


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most ``rows`` labelled documents, in one task; a model has a fixed size."""
    features = _sample(docs, labels, rows).mapInArrow(_featurer, "doc_id long, label int, buckets binary, counts binary")
    model = features.withColumn("model", F.lit(1)).groupBy("model").applyInPandas(_trainer, "weights binary, bias binary").collect()
    if not model:
        return train([], np.zeros(0, np.int64))
    return np.frombuffer(model[0].weights, "<f8").reshape(BUCKETS, -1), np.frombuffer(model[0].bias, "<f8")


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the probability of label 1 for every whole text, from its text alone.

    A null or empty text, or one of white space, gets the score of the bias. An empty
    table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(((model[0][:, 1] - model[0][:, 0]).astype(np.float64), float(model[1][1] - model[1][0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean, bias = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                f = featurize(part.column("text"))
                sums = np.r_[0, np.cumsum(lean[f.word_buckets])]
                by_word, n_word = np.diff(sums[f.word_bounds]), np.diff(f.word_bounds)
                has_pair = f.pair_buckets >= 0
                total = np.r_[0, np.cumsum(by_word[f.codes] + np.where(has_pair, lean[f.pair_buckets], 0))]
                n = np.r_[0, np.cumsum(n_word[f.codes] + has_pair)]
                mean = np.diff(total[f.bounds]) / np.maximum(1, np.diff(n[f.bounds]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(mean + bias, -60, 60))))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, from labels outside the held-out fold."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.expr("coalesce(crc32(cast(doc_id AS string)) % 3 = 1, false)")
    return score(docs, fit(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", F.expr("int(score >= 0.5)").alias("predicted"))
