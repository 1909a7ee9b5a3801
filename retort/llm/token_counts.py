"""Token counts through a cache of digests.

A text is brought to a normal form that the tokenizer cannot tell from it, and the form's
SHA-256 is looked up, with the digest of the tokenizer's version, in a table of counts.
Only distinct contents that the table lacks are encoded, each once, and their counts are
appended. The lookups move digests; texts move only for what has to be encoded, by
content and doc_id, so that copies of one text are spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm.scratch import new_path, with_values, written
from retort.llm.tokens import default_path, encoder
from retort.llm.words import slices

#: Documents of more tokens are marked.
LIMIT = 2048
#: The rule that brings texts to their normal form; a change of the rule makes other digests.
RULE = "space-1"

_CACHE = "tokenizer string, content binary, n_tokens long"
_PIECES: dict[str, sentencepiece.SentencePieceProcessor] = {}


def tokenizer_version(path: str) -> str:
    """SHA-256, in hex, of the tokenizer's file, its library with version, and the rule of normal forms."""
    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library}\n{RULE}\n".encode() + f.read()).hexdigest()


def drops_space(path: str) -> bool:
    """Whether runs of white space, and white space at the ends, make no difference to the tokenizer."""
    return not path.endswith(".model") and encoder(path).by_word


def content_digest(text: Column | str, spaceless: bool) -> Column:
    """SHA-256 of a text's normal form: with ``spaceless`` runs of ASCII white space are one space and none is at the ends."""
    text = F.col(text) if isinstance(text, str) else text
    if spaceless:
        text = F.trim(F.regexp_replace(text, "[ \\t\\n\\u000B\\f\\r]+", " "))
    return F.unhex(F.sha2(text, 256))


def count_batch(path: str, texts: pa.Array) -> np.ndarray:
    """The number of tokens of each text, as the library gives them without added special tokens."""
    if path.endswith(".model"):
        if path not in _PIECES:
            _PIECES[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        return np.array([len(ids) for ids in _PIECES[path].encode([t or "" for t in texts.to_pylist()], num_threads=1)], np.int64)
    return np.diff(encoder(path).encode(texts)[0])


def cached_counts(spark: SparkSession, cache: str) -> DataFrame:
    """The cache at ``cache``: tokenizer, content, n_tokens; made empty if there is none. Rows may repeat after racing runs."""
    spark.createDataFrame([], _CACHE).write.mode("ignore").parquet(cache)
    return spark.read.schema(_CACHE).parquet(cache)


def _append_misses(rows: DataFrame, misses: DataFrame, cache: str, path: str, version: str) -> None:
    """Encode one text of each missing content (content, who) and append the counts; a job that fails appends nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("content"), pa.array(count_batch(path, part.column("text")), pa.int64())], ["content", "n_tokens"])

    texts = rows.groupBy("content", "who").agg(F.first("text").alias("text")).join(misses.select("content", "who"), ["content", "who"])
    new = texts.select("content", "text").mapInArrow(run, "content binary, n_tokens long")
    new.select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, cache: str, tokenizer_path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row, by the counts of the cache at ``cache`` and those added to it.

    ``tokenizer_path`` names a file of the tokenizers library (.json) or of sentencepiece
    (.model). Special strings within texts count as the library takes them by default;
    nothing is truncated, padded or added. A null text is an empty one; rows with equal,
    repeated or null doc_ids are counted each; an empty table gives an empty result, and
    other columns are not read. A text, however long, is encoded whole in one task.
    """
    spark = docs.sparkSession
    path = tokenizer_path or default_path()
    version = tokenizer_version(path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("content", content_digest("text", drops_space(path))).withColumn("who", F.coalesce("doc_id", F.lit(-(2**63))))
    keys = written(rows.select("doc_id", "who", F.octet_length("text").cast("long").alias("n_bytes"), "content"), "keys")
    contents = written(keys.groupBy("content").agg(F.count("*").alias("rows"), F.min("who").alias("who")).withColumn("tokenizer", F.lit(version)), "contents")

    known = cached_counts(spark, cache).where(F.col("tokenizer") == version)
    misses = written(contents.join(known, ["tokenizer", "content"], "left_anti"), "misses")
    if not misses.isEmpty():
        _append_misses(rows, misses, cache, path, version)
        known = cached_counts(spark, cache).where(F.col("tokenizer") == version)
    stored = known.groupBy("tokenizer", "content").agg(F.max("n_tokens").alias("n_tokens"))
    counted = written(contents.join(stored, ["tokenizer", "content"]).select("content", "rows", "n_tokens"), "counted")
    return with_values(keys, counted, "content", "rows").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all ``documents``, through a cache that begins empty."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "token-counts"))
