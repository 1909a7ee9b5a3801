import zlib

import numpy as np
import pytest

from retort.llm import rans, token_files
from retort.llm.scratch import new_path
from retort.llm.tokens import Encoder, default_path


@pytest.fixture(scope="module")
def coder():
    return Encoder(default_path())


def expected(coder, rows):
    """(doc_id, start, n_tokens, crc) of (doc_id, text) rows by plain encoding."""
    ids = [(i, [*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    ids.sort(key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes()))
    out, start = [], 0
    for i, one in ids:
        out.append((i, start, len(one), zlib.crc32(np.array(one, "<u4").tobytes())))
        start += len(one)
    return out


def test_crc_of_joined_parts():
    r = np.random.default_rng(0)
    parts = [r.bytes(n) for n in (0, 1, 7, 4096, 100_003, 0)]
    assert rans.crc_of_joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))
    assert rans.crc_of_joined([]) == 0


@pytest.mark.parametrize("block,group", [(40, 2), (1 << 18, 1024)])
def test_long_repeated_and_null_rows(spark, coder, monkeypatch, block, group):
    """Documents longer than a block are decoded by segment; both sizes give the same result."""
    monkeypatch.setattr(token_files, "BLOCK_IDS", block)
    monkeypatch.setattr(token_files, "FILE_BYTES", 3000)
    monkeypatch.setattr(token_files, "FILE_GROUP", group)
    monkeypatch.setattr(rans, "encode_block", lambda ids, model, own=rans.encode_block: own(ids, model, 4, 8))
    monkeypatch.setattr(token_files, "encode_block", lambda ids, model: rans.encode_block(ids, model))
    rows = [(k, f"some words {k} " * (k % 7)) for k in range(60)] + [(100, "long text of many words " * 400), (3, "again"), (3, "again"), (None, "no id"), (None, None), (61, None), (62, "")]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, ids int, segments string").repartition(4)
    got = token_files.token_files(docs, new_path(spark, "t"))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    found = sorted(got.collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found] == expected(coder, rows)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in found)


def test_query_over_a_whole_table(spark, coder, data):
    """The registered query against plain encoding."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in token_files.query(spark, data).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(expected(coder, rows))
