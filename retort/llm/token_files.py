"""Token-id files: range asymmetric numeral system blocks in ascending doc_id order.

``write_token_files`` makes a folder with two Parquet data sets. ``blocks`` has a row for
each independent block: its file (the number of its range of doc_ids), its place in it,
its first doc_id, the documents' ids and token counts, and the coded payload as segments,
one for each checkpoint. A document longer than a block has a block of its own, whose
segments are decoded in different tasks. ``table`` has the one shared frequency table.
Executors write through Spark's committer only, so a lost task leaves no partial block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm.rans import Model, build_model, crc_of_joined, decode_segment, encode_block, segments_of
from retort.llm.scratch import new_path
from retort.llm.tokens import default_path, encode_ids, id_type

#: A block closes once it holds so many ids; a document with more of them has a block of its own.
BLOCK_IDS = 1 << 18
#: Raw bytes of ids that one file is meant to hold.
FILE_BYTES = 64 << 20
#: Files whose first places are summed up together.
FILE_GROUP = 1024

_BLOCKS = "file int, block int, first_doc long, doc_ids array<long>, doc_lengths array<long>, n_ids long, long boolean, segments array<binary>"


def count_ids(coded: DataFrame, kind: str) -> DataFrame:
    """(id, n): how often each id occurs, summed in each task before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for x in batch.column("ids"):
                more = np.bincount(np.frombuffer(x.as_buffer(), kind))
                if len(more) > len(total):
                    total = np.r_[total, np.zeros(len(more) - len(total), np.int64)]
                total[: len(more)] += more
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])

    return coded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _model(spark: SparkSession, path: str) -> Model:
    """The shared table of a folder: one row for each id of the vocabulary, a set that does not grow with the texts."""
    rows = spark.read.schema("id long, n long").parquet(f"{path}/table").collect()
    counts = np.zeros(max([1, *(r.id for r in rows)]) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return build_model(counts)


def write_token_files(coded: DataFrame, path: str, kind: str) -> None:
    """Write (doc_id, ids as bytes of type ``kind``) rows to ``path``; null doc_ids come first, equal ones in the order of their ids."""
    spark = coded.sparkSession
    count_ids(coded, kind).write.parquet(f"{path}/table")
    model = spark.sparkContext.broadcast(_model(spark, path))
    total = coded.agg(F.sum(F.length("ids"))).collect()[0][0] or 0
    files = max(1, -(-total // FILE_BYTES), spark.sparkContext.defaultParallelism if total > FILE_BYTES else 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            one = {"file": file, "block": block, "first_doc": names[0], "doc_ids": names, "doc_lengths": [len(p) for p in parts], "n_ids": len(ids), "long": len(ids) > BLOCK_IDS and len(parts) == 1, "segments": segments_of(encode_block(ids, model.value))}
            return pa.RecordBatch.from_pylist([one], schema)

        for batch in batches:
            for name, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(x.as_buffer(), kind)
                if names and len(ids) > BLOCK_IDS:
                    yield close()
                    names, parts, held, block = [], [], 0, block + 1
                names.append(name)
                parts.append(ids)
                held += len(ids)
                if held >= BLOCK_IDS:
                    yield close()
                    names, parts, held, block = [], [], 0, block + 1
        if names:
            yield close()

    schema = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("long", pa.bool_()), ("segments", pa.list_(pa.binary()))])
    # rows of one doc_id, null ones too, are parted by their first ids, in the order of which they are written
    ordered = coded.repartitionByRange(int(files), F.col("doc_id"), F.substring("ids", 1, 32)).sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, _BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _placed(blocks: DataFrame) -> DataFrame:
    """(file, block, block_start): the ids before each block, summed up by block, file and group of files."""
    before = "coalesce(sum({}) OVER ({} ORDER BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    place = blocks.select("file", "block", F.expr(before.format("n_ids", "PARTITION BY file", "block")).alias("inside"))
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("held")).withColumn("group", F.expr(f"file div {FILE_GROUP}"))
    groups = files.groupBy("group").agg(F.sum("held").alias("held"))
    groups = groups.select("group", F.expr(before.format("held", "", "`group`")).alias("earlier"))
    files = files.select("file", "group", F.expr(before.format("held", "PARTITION BY `group`", "file")).alias("before")).join(groups, "group")
    return place.join(files, "file").select("file", "block", (F.col("earlier") + F.col("before") + F.col("inside")).alias("block_start"))


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Each document of a folder: doc_id, start (ids before it), n_tokens, ids_crc32, ids (little-endian 32-bit).

    Only the small columns are read to place the blocks. A block of several documents is
    decoded in one task; the segments of a document longer than a block are dealt to
    tasks, and their checksums (and ids) are joined. Every segment's own checksum is
    compared. Without ``with_ids`` the ids stay in the tasks.
    """
    model = spark.sparkContext.broadcast(_model(spark, path))
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    names = ["file", "block", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"]
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()]

    def batch_of(*columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = b"".join(decode_segment(x, model.value).astype("<u4").tobytes() for x in row["segments"])
                ends = np.r_[0, np.cumsum(row["doc_lengths"])].astype(np.int64)
                each = [raw[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                n = len(each)
                yield batch_of([row["file"]] * n, [row["block"]] * n, row["doc_ids"], ends[:-1], row["doc_lengths"], [zlib.crc32(e) for e in each], each if with_ids else [None] * n)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = decode_segment(row["segment"], model.value).astype("<u4").tobytes()
                yield batch_of([row["file"]], [row["block"]], [row["doc_id"]], [row["k"]], [len(raw) // 4], [zlib.crc32(raw)], [raw if with_ids else None])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = row["parts"]
                yield batch_of([row["file"]], [row["block"]], [row["doc_id"]], [0], [sum(x["n"] for x in own)], [crc_of_joined([(x["crc"], 4 * x["n"]) for x in own])], [b"".join(x["ids"] for x in own) if with_ids else None])

    schema = "file int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long, ids binary"
    short = blocks.where("NOT long").select("file", "block", "doc_ids", "doc_lengths", "segments").mapInArrow(whole, schema)
    dealt = blocks.where("long").select("file", "block", F.get("doc_ids", F.lit(0)).alias("doc_id"), F.posexplode("segments").alias("k", "segment")).repartition("file", "block", "k")
    pieces = dealt.mapInArrow(parts, schema).groupBy("file", "block").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct(F.col("inside").alias("k"), F.col("n_tokens").alias("n"), F.col("ids_crc32").alias("crc"), "ids"))).alias("parts"))
    found = short.unionByName(pieces.mapInArrow(joined, schema))
    return found.join(_placed(blocks), ["file", "block"]).select("doc_id", (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_files(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode every text, write the files and return what :func:`read_token_files` reads from them.

    A null or empty text has its end id alone. An empty table writes empty files. Rows
    with a null doc_id come first, rows with one doc_id are written one after the other,
    in the order of their ids; extra columns are not read.
    """
    spark = docs.sparkSession
    tokenizer_path = tokenizer_path or default_path()
    kind = id_type(tokenizer_path)
    coded = encode_ids(docs, tokenizer_path, end_id, kind, id_col, text_col)
    path_coded = new_path(spark, "coded")
    coded.write.option("compression", "zstd").parquet(path_coded)
    write_token_files(spark.read.schema(coded.schema).parquet(path_coded), path, kind)
    return read_token_files(spark, path, with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all ``documents`` with end id 1 and give each document's digest as read back."""
    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "token-files"), with_ids=False)
