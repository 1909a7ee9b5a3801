"""Token counts against the libraries, and what the cache holds after each run."""

import pytest
from pyspark.sql import functions as F

from retort.llm import token_counts as C
from retort.llm.tokens import default_path

TEXTS = [
    "Plain words, plain words.", " Plain\n\twords,  plain words.\r\n", "PLAIN words, plain words.", "", None, " \n", "<|endoftext|> a <|startoftext|>b", "a b c 가 é",
    "x" * 5000, "don't we'll 12345 --- ###", "word " * 30_000, "日本語の文 и русский текст",
]


def frame(spark, texts, first=0):
    rows = [(k + first, t, "other", k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, content string, n_tokens int").repartition(3)


def plain(path, text):
    text = text or ""
    if path.endswith(".model"):
        import sentencepiece

        return len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_those_of_the_library(spark, tmp_path, name):
    path = default_path(name)
    texts = [t if t is None or len(t) < 50_000 else t[:3000] for t in TEXTS]
    got = {r.doc_id: r for r in C.count_tokens(frame(spark, texts), f"{tmp_path}/cache", path, limit=20).collect()}
    for k, t in enumerate(texts):
        n = plain(path, t)
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((t or "").encode()), n, n > 20)


def test_only_missing_contents_are_encoded_and_stored_once(spark, tmp_path):
    cache = f"{tmp_path}/cache"
    docs = frame(spark, TEXTS)
    first = sorted(C.count_tokens(docs, cache).collect(), key=str)
    table = spark.read.parquet(cache)
    same = 2  # texts 0 and 1 differ by white space alone, texts 3, 4 and 5 are empty
    assert table.count() == table.select("content").distinct().count() == len(TEXTS) - 1 - same
    # stored counts are used: changed ones come back
    doubled = f"{tmp_path}/doubled"
    table.withColumn("n_tokens", F.col("n_tokens") * 2).write.parquet(doubled)
    again = sorted(C.count_tokens(docs, doubled).collect(), key=str)
    assert [r.n_tokens for r in again] == [2 * r.n_tokens for r in first]
    # new texts alone are added, under their own tokenizer
    C.count_tokens(frame(spark, ["brand new", "Plain words, plain words. ", "brand  new"], 50), cache).collect()
    assert spark.read.parquet(cache).count() == len(TEXTS) - same
    C.count_tokens(frame(spark, ["brand new"]), cache, default_path("byte_bpe_50k.json")).collect()
    assert spark.read.parquet(cache).groupBy("tokenizer").count().count() == 2
    # rows that racing runs have stored twice do not double a document
    spark.read.schema("tokenizer string, content binary, n_tokens long").parquet(cache).write.parquet(f"{tmp_path}/twice")
    spark.read.parquet(cache).write.mode("append").parquet(f"{tmp_path}/twice")
    assert sorted(C.count_tokens(docs, f"{tmp_path}/twice").collect(), key=str) == first


def test_repeated_null_and_hot_rows_and_an_empty_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("retort.llm.scratch.HOT_ROWS", 5)
    monkeypatch.setattr("retort.llm.scratch.HOT_MOST", 3)
    rows = [(None, "same text")] * 30 + [(1, "same text")] * 20 + [(1, "other text"), (2, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in C.count_tokens(docs, f"{tmp_path}/c").collect()))
    assert got == sorted((i or 0, len(t or ""), plain(default_path(), t)) for i, t in rows)
    assert spark.read.parquet(f"{tmp_path}/c").count() == 3
    assert C.count_tokens(docs.limit(0), f"{tmp_path}/c").collect() == []


def test_query_against_the_library(spark, data):
    texts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_path())
    want = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in texts}
    got = C.query(spark, data).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert {r.doc_id: r.n_bytes for r in got} == {r.doc_id: len((r.text or "").encode()) for r in texts}
