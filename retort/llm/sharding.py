"""Shards of bounded bytes by extendible hashing.

A document's hash is a string of bits: 60 of its doc_id, then 60 of its doc_id and row
number, which only tell rows with equal doc_ids apart. The directory is indexed by a
prefix of those bits. A round counts the bytes below each prefix of a depth that the
largest unresolved prefix asks for; only prefixes over the limit go on to further bits in
the next round. A shard is the shortest prefix whose documents fit the limit, so a
bucket has split on another bit exactly where it was oversized.

Only DataFrame functions are used. A round reads the narrow table of hashes and sizes;
texts are never moved.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm.scratch import written

#: Bits of a document's hash: of the doc_id, and of the doc_id with the row's number.
BITS = 60
#: A round looks so many bits deeper than evenly filled shards would need.
SPARE_BITS = 4


def _bits(text: str) -> str:
    return f"lpad(conv(substr(md5({text}), 1, 15), 16, 2), {BITS}, '0')"


def _directory(rows: DataFrame, limit: int) -> DataFrame:
    """Disjoint prefixes that cover all rows: cell, depth, bytes, n. Cells over the limit hold one row."""
    resolved, depth, todo = None, 0, rows
    largest = rows.agg(F.sum("bytes")).collect()[0][0] or 0
    while True:
        depth = min(2 * BITS, depth + max(1, math.ceil(math.log2(max(1, largest / limit))) + SPARE_BITS))
        cells = written(todo.groupBy(F.substring("bits", 1, depth).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).withColumn("depth", F.lit(depth)), "cells")
        over = cells.where((F.col("bytes") > limit) & (F.col("n") > 1))
        largest = over.agg(F.max("bytes")).collect()[0][0]
        done = cells.where((F.col("bytes") <= limit) | (F.col("n") == 1))
        if largest is None or depth == 2 * BITS:
            done = done.unionByName(over)
        resolved = done if resolved is None else resolved.unionByName(done)
        if largest is None or depth == 2 * BITS:
            return resolved
        todo = todo.join(over.select("cell"), F.substring("bits", 1, depth) == F.col("cell"), "left_semi")


def _shards(cells: DataFrame, limit: int) -> DataFrame:
    """(prefix, level, shard_bytes, shard_docs): prefixes that fit the limit and whose parent does not.

    A parent has two children at most, so no key of the join is hot. Cells over the limit,
    which hold one row, are shards too.
    """
    above = cells.select("cell", "depth", "bytes", "n", F.explode(F.expr("sequence(0, depth)")).alias("level"))
    sums = above.groupBy(F.expr("substr(cell, 1, level)").alias("prefix"), "level").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_docs"), F.max(F.col("level") == F.col("depth")).alias("_cell"))
    sums = written(sums.withColumn("_fits", (F.col("shard_bytes") <= limit) | F.col("_cell")), "prefixes")
    full = sums.where("NOT _fits").select(F.col("prefix").alias("_parent"), (F.col("level") + 1).alias("_below"))
    own = sums.where("_fits").join(full, F.expr("level = _below AND substr(prefix, 1, level - 1) = _parent"), "left").where("level = 0 OR _parent IS NOT NULL")
    return written(own.select("prefix", "level", "shard_bytes", "shard_docs"), "shards")


def _assigned(docs: DataFrame, limit: int, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """(doc_id, _row, o): each row with the struct ``_row`` of the columns in ``carry`` and its shard."""
    if limit < 1:
        raise ValueError("limit must be positive")
    own = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("boolean")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_name"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"), own.alias("_row"))
    rows = rows.withColumn("_number", F.monotonically_increasing_id())
    rows = written(rows.select("doc_id", "bytes", F.expr(f"concat({_bits('_name')}, {_bits('concat(_name, chr(47), _number)')})").alias("bits"), "_row"), "hashes")
    cells = _directory(rows.select("bytes", "bits"), limit)
    shards = _shards(cells, limit)
    least = shards.agg(F.min("level")).collect()[0][0] or 0
    below = cells.select("cell", "depth", F.explode(F.expr(f"sequence({least}, depth)")).alias("_at")).withColumn("_part", F.expr("substr(cell, 1, _at)"))
    owner = below.join(shards, F.expr("_part = prefix AND _at = level")).select("cell", "depth", F.struct("prefix", "level", "shard_bytes", "shard_docs").alias("own"))
    owner = written(owner, "directory")
    depths = sorted(r[0] for r in owner.select("depth").distinct().collect())
    out = rows
    for d in depths:
        known = owner.where(F.col("depth") == d).select(F.col("cell").alias(f"_cell{d}"), F.col("own").alias(f"_own{d}"))
        out = out.join(known, F.substring("bits", 1, d) == F.col(f"_cell{d}"), "left")
    found = F.coalesce(*[F.col(f"_own{d}") for d in depths]) if depths else F.lit(None).cast("struct<prefix:string,level:int,shard_bytes:bigint,shard_docs:bigint>")
    return out.select("doc_id", "_row", found.alias("o"))


def assign_shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, shard, depth, shard_bytes, shard_docs) for each row.

    ``shard`` is a prefix of hash bits, the empty string if all fits in one shard, and
    ``depth`` its length. ``shard_bytes`` is at most ``limit`` bytes of UTF-8 text unless
    one text alone is longer: it then has a shard of its own. A null text has 0 bytes; a
    null doc_id is hashed as an empty string. Rows with equal doc_ids may be parted. An
    empty table gives an empty result; other columns are not read.
    """
    out = _assigned(docs, limit, id_col, text_col, [])
    return out.select("doc_id", F.col("o.prefix").alias("shard"), F.col("o.level").alias("depth"), "o.shard_bytes", "o.shard_docs")


def write_shards(docs: DataFrame, limit: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write each shard of ``docs`` as a Parquet folder ``shard=b<bits>`` below ``path``; returns the partition column's name.

    Every row is written once, rows with equal or null ids too. If ``docs`` has a column
    named shard, the partition column gets underscores in front.
    """
    name = "shard"
    while name in docs.columns:
        name = f"_{name}"
    out = _assigned(docs, limit, id_col, text_col, docs.columns).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns], F.concat(F.lit("b"), F.col("o.prefix")).alias(name))
    out.repartition(name).write.partitionBy(name).parquet(path)
    return name


#: Bytes that a shard of the query holds at most.
LIMIT = 1 << 20


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards of at most 1 MiB of text."""
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), LIMIT)


ORACLE = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes,
         lpad(bin(CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) AS BIGINT)), {BITS}, '0') AS bits
  FROM documents),
levels AS (SELECT doc_id, bytes, bits, unnest(range(0, {BITS} + 1))::INTEGER AS depth FROM hashed),
sums AS (SELECT substr(bits, 1, depth) AS shard, depth, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM levels GROUP BY ALL),
fit AS (
  SELECT l.doc_id, s.shard, s.depth, s.shard_bytes, s.shard_docs,
         row_number() OVER (PARTITION BY l.doc_id ORDER BY s.depth) AS k
  FROM levels l JOIN sums s ON s.depth = l.depth AND s.shard = substr(l.bits, 1, l.depth)
  WHERE s.shard_bytes <= {LIMIT})
SELECT doc_id, shard, depth, shard_bytes, shard_docs FROM fit WHERE k = 1
"""
