"""Importance resampling towards a target's distribution of hashed word runs, with segments counted once.

Features are the runs of one to three words, hashed to buckets by their CRC-32. A text is
cut at line breaks. Features within a line depend on the line alone, so they are made for
each distinct line only and multiplied by its occurrences; runs that go across a break
are made from the texts and added. The same holds for weights: a distinct line's gains
are summed once, and documents meet their lines by digest. Ranks come from a range sort
with the sizes of its ranges, so no task holds all scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retort.llm.scratch import with_values, written
from retort.llm.words import Words, byte_table, slices, split_words, translated

BUCKETS = 10_000
#: Words of letters, digits and characters beyond ASCII; line breaks stay to tell lines apart.
_TABLE = byte_table("0123456789abcdefghijklmnopqrstuvwxyz\n")
#: Lengths for which the effect of so many zero bytes on a checksum is tabled; longer ones go by powers of two.
_DIRECT = 64

_PARTS = "row long, doc_id long, n_words long, lines array<struct<key: binary, n: int>>, across binary"


def _zero_bytes() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables (length, byte's place, byte) of a CRC-32 carried over zero bytes, and those of 64, 128, 256 ... bytes."""
    byte = np.arange(256, dtype=np.uint32)
    step = byte.copy()
    for _ in range(8):
        step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> 1), step >> 1).astype(np.uint32)
    one = lambda x: (x >> np.uint32(8)) ^ step[x & 255]
    direct = [np.stack([byte << np.uint32(8 * k) for k in range(4)])]
    while len(direct) <= _DIRECT:
        direct.append(one(direct[-1]))
    powers = [direct[_DIRECT]]
    while len(powers) < 26:
        powers.append(_looked_up(powers[-1].ravel(), 0, powers[-1]))
    return np.stack(direct[:_DIRECT]).ravel(), [p.ravel() for p in powers]


def _looked_up(table: np.ndarray, base: np.ndarray | int, crc: np.ndarray) -> np.ndarray:
    c = crc.astype(np.int64)
    return table[base + (c & 255)] ^ table[base + 256 + ((c >> 8) & 255)] ^ table[base + 512 + ((c >> 16) & 255)] ^ table[base + 768 + (c >> 24)]


_SHORT, _POWERS = _zero_bytes()
_SPACE = np.uint32(zlib.crc32(b" "))


def carried(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC-32 values as n further bytes leave them; the exclusive or with those bytes' own CRC-32 gives that of both joined."""
    out = _looked_up(_SHORT, (n % _DIRECT) * 1024, crc)
    big = np.flatnonzero(n >= _DIRECT)
    for k, table in enumerate(_POWERS if len(big) else []):
        at = big[(n[big] // _DIRECT >> k) & 1 == 1]
        out[at] = _looked_up(table, 0, out[at])
    return out


def run_buckets(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of the runs of one, two and three words that begin at each word; the last words have no longer runs."""
    each = [w.encode() for w in words.distinct.to_pylist()]
    crc, size = np.fromiter(map(zlib.crc32, each), np.uint32, len(each)), np.fromiter(map(len, each), np.int64, len(each))
    spaced = _looked_up(_SHORT, 1024, crc) ^ _SPACE
    crcs, sizes = crc[words.codes], size[words.codes]
    two = carried(spaced[words.codes[:-1]], sizes[1:]) ^ crcs[1:]
    three = carried(_looked_up(_SHORT, 1024, two[:-1]) ^ _SPACE, sizes[2:]) ^ crcs[2:]
    return tuple((x % np.uint32(BUCKETS)).astype("<u2") for x in (crcs, two, three))


def _picked(runs: tuple[np.ndarray, ...], masks: tuple[np.ndarray, ...], unit: np.ndarray, n_units: int) -> pa.Array:
    """The chosen runs' buckets of each unit, as bytes of unsigned 16-bit integers; ``unit`` is that of each word."""
    n = len(unit)
    table, mask = np.zeros((n, len(runs)), "<u2"), np.zeros((n, len(runs)), bool)
    for k, (x, m) in enumerate(zip(runs, masks, strict=True)):
        table[: len(x), k], mask[: len(m), k] = x, m
    ends = np.r_[0, np.cumsum(np.bincount(unit, weights=mask.sum(1), minlength=n_units).astype(np.int64))]
    return pa.Array.from_buffers(pa.binary(), n_units, [None, pa.py_buffer((2 * ends).astype(np.int32).tobytes()), pa.py_buffer(table[mask].tobytes())])


def _same(a: np.ndarray, gap: int) -> np.ndarray:
    return a[gap:] == a[:-gap]


def _line_key(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line)


def _liner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, buckets) of distinct lines (line, n)."""
    for batch in batches:
        for part in slices(batch, "line", 4 << 20):
            words = split_words(translated(part.column("line"), _TABLE))
            unit = np.repeat(np.arange(len(part)), np.diff(words.bounds))
            runs = run_buckets(words)
            found = _picked(runs, (np.ones(len(unit), bool), _same(unit, 1), _same(unit, 2)), unit, len(part))
            keys = pa.array([_line_key(x) for x in part.column("line").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, part.column("n"), found], ["key", "n", "buckets"])


def _texter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's lines by key, and the buckets of its runs across line breaks."""
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            raw = pc.split_pattern(pc.fill_null(part.column("text"), ""), "\n")
            lines = raw.flatten()
            first = raw.offsets.to_numpy().astype(np.int64)
            first = first - first[0]
            words = split_words(translated(lines, _TABLE))
            line_of_word = np.repeat(np.arange(len(lines)), np.diff(words.bounds))
            text_of_line = np.repeat(np.arange(len(part)), np.diff(first))
            text = text_of_line[line_of_word]
            runs = run_buckets(words)
            across = _picked(runs[1:], tuple(_same(text, k) & ~_same(line_of_word, k) for k in (1, 2)), text, len(part))
            n_words = np.bincount(text, minlength=len(part)) if len(part) else np.zeros(0, np.int64)
            full = np.flatnonzero(np.diff(words.bounds))
            coded = lines.take(pa.array(full)).dictionary_encode()
            keys = [_line_key(x) for x in coded.dictionary.to_pylist()]
            seen, n = np.unique(text_of_line[full] * max(1, len(keys)) + coded.indices.to_numpy(), return_counts=True)
            owner, code = seen // max(1, len(keys)), seen % max(1, len(keys))
            ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(part)))].astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(keys, pa.binary()).take(pa.array(code)), pa.array(n, pa.int32())], ["key", "n"])
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), items), across],
                ["row", "doc_id", "n_words", "lines", "across"],
            )


def segments(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, parts), both written: distinct lines (key, n, buckets), and for each row of (doc_id, text) its lines and the runs across breaks."""
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").groupBy("line").agg(F.count("*").alias("n"))
    lines = written(lines.mapInArrow(_liner, "key binary, n long, buckets binary").where("length(buckets) > 0"), "lines")
    return lines, written(texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_texter, _PARTS), "parts")


def bucket_counts(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """(bucket, n): how often features of the corpus fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            times, ends = batch.column("n").to_numpy(), np.r_[0, np.cumsum(pc.binary_length(batch.column("buckets")).to_numpy() // 2)]
            flat = np.frombuffer(b"".join(batch.column("buckets").to_pylist()), "<u2")
            total += np.bincount(flat, minlength=BUCKETS)
            for k in np.flatnonzero(times > 1):
                total += (times[k] - 1) * np.bincount(flat[ends[k] : ends[k + 1]], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    both = lines.select("n", "buckets").unionByName(parts.select(F.lit(1).cast("long").alias("n"), F.col("across").alias("buckets")))
    return both.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of every bucket, from (bucket, n) of the corpus and of the target: a fixed number of values."""
    total = lambda t: t.agg(F.coalesce(F.sum("n"), F.lit(0)))
    every = source.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket")
    every = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    every = every.crossJoin(total(source).toDF("all_s")).crossJoin(total(target).toDF("all_t"))  # one row each
    gain = F.expr(f"floor(1000D * ln((t + 1D) * (all_s + {BUCKETS}D) / ((s + 1D) * (all_t + {BUCKETS}D))))")
    out = np.zeros(BUCKETS, np.int64)
    for r in every.select("bucket", gain.alias("gain")).collect():
        out[r.bucket] = r.gain
    return out


def _weigher(gains, column: str, names: list[str]):
    """Rows' ``names`` and ``weight``, the sum of the gains of the buckets in ``column``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.r_[0, np.cumsum(pc.binary_length(batch.column(column)).to_numpy() // 2)]
            each = np.r_[0, np.cumsum(gains.value[np.frombuffer(b"".join(batch.column(column).to_pylist()), "<u2")])]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(each[ends[1:]] - each[ends[:-1]], pa.int64())], [*names, "weight"])

    return run


def weights(lines: DataFrame, parts: DataFrame, gains: np.ndarray) -> DataFrame:
    """(row, doc_id, n_words, weight), written: the sum of the gains of a text's features, line by line."""
    shared = lines.sparkSession.sparkContext.broadcast(gains)
    by_line = written(lines.mapInArrow(_weigher(shared, "buckets", ["key", "n"]), "key binary, n long, weight long"), "line-weights")
    at = parts.select("row", F.explode("lines").alias("l")).select("row", F.col("l.key").alias("key"), F.col("l.n").alias("times"))
    inside = with_values(at, by_line, "key", "n").groupBy("row").agg(F.sum(F.col("weight") * F.col("times")).alias("inside"))
    own = parts.mapInArrow(_weigher(shared, "across", ["row", "doc_id", "n_words"]), "row long, doc_id long, n_words long, weight long")
    return written(own.join(inside, "row", "left").withColumn("weight", F.col("weight") + F.coalesce("inside", F.lit(0))).drop("inside"), "weights")


def ranked(scored: DataFrame, take: int) -> DataFrame:
    """(row, rank) of the ``take`` first of (row, doc_id, n_features, score) by score, then doc_id, from 1.

    Rows are sorted in ranges; a row's rank is its place in its range after the sizes of
    the ranges before, one number for each of a fixed number of ranges.
    """
    spark = scored.sparkSession
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("row")]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(scored.select("row", "doc_id", "n_features", "score").repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", F.expr("coalesce(sum(size) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("before")).where(F.col("before") < take)
    placed = dealt.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return placed.where(F.col("rank") <= take).select("row", "rank")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Importance weights of documents towards the texts of ``target``, and a draw without replacement by them.

    Returns for each row doc_id, n_features, weight, score and rank (null if not drawn),
    all long. Of the documents with ``least_words`` words or more, ``percent`` of a hundred
    (rounded down) are drawn: the highest weights after noise that is fixed by the seed
    and the doc_id; ties go to the smaller doc_id, null first, then to fewer features.

    A null or empty text, or one without words, has weight 0 and is never drawn. Rows
    with one doc_id are drawn each for itself, with the same noise; a null doc_id is
    hashed as an empty string. An empty table gives an empty result, an empty target has
    no features, and other columns are not read. A text is worked on whole in one task.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines, parts = segments(texts)
    aim = target.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gains = bucket_gains(bucket_counts(lines, parts), bucket_counts(*segments(aim)))
    noise = f"conv(substr(sha2(concat('{seed}:', coalesce(cast(doc_id AS string), '')), 256), 1, 8), 16, 10)"
    scored = weights(lines, parts, gains).withColumn("score", F.expr(f"weight + floor(-1000D * ln(-ln((cast({noise} AS double) + 0.5D) / 4294967296D)))"))
    scored = scored.withColumn("n_features", F.expr("n_words + greatest(0, n_words - 1) + greatest(0, n_words - 2)"))
    pool = scored.where(F.col("n_words") >= least_words)
    rank = ranked(pool, pool.count() * percent // 100)
    return scored.join(rank, "row", "left").select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` weighted towards ``benchmark``, five of a hundred drawn."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target)
