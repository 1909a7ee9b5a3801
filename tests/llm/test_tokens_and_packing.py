import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from retort.llm import packing as P
from retort.llm import rans, token_files
from retort.llm.scratch import new_path
from retort.llm.tokens import Encoder, default_path

TEXTS = ["Hello, hello world's 12 İx", "", None, "x<|endoftext|>Y <|ENDOFTEXT|>", "\x0bq\x1cz é é́ ǅ", "la " * 3000, "naïve façade—done\n\nnow"]


@pytest.fixture(scope="module")
def coder():
    return Encoder(default_path())


def plain(coder, text, end):
    return [*coder.tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_ids_by_words_are_those_of_whole_texts(coder):
    assert coder.by_word and coder.straight
    bounds, ids = coder.encode(pa.array(TEXTS))
    for k, t in enumerate(TEXTS):
        assert list(ids[bounds[k] : bounds[k + 1]]) == plain(coder, t, 0)[:-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_text_is_encoded_alike(texts):
    coder = Encoder(default_path())
    bounds, ids = coder.encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert list(ids[bounds[k] : bounds[k + 1]]) == plain(coder, t, 0)[:-1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=500), st.integers(1, 9), st.integers(1, 5))
def test_blocks_round_trip(ids, lanes, stride):
    model = rans.build_model(np.bincount(ids, minlength=1))
    block = rans.encode_block(np.array(ids, np.uint32), model, lanes, stride)
    assert list(rans.decode_block(block, model)) == ids
    assert list(rans.decode_block(block, model, 1, 2)) == ids[stride * lanes : 2 * stride * lanes]


def test_damage_is_seen():
    model = rans.build_model(np.array([5, 3, 1]))
    block = bytearray(rans.encode_block(np.array([0, 1, 2, 0]), model, 2, 2))
    block[40] ^= 1
    with pytest.raises(ValueError):
        rans.decode_block(bytes(block), model)


def test_files_round_trip(spark, coder, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 50)
    monkeypatch.setattr(token_files, "FILE_BYTES", 4000)
    docs = spark.createDataFrame([(7 - k, t, 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, ids int").repartition(3)
    got = sorted(token_files.token_files(docs, new_path(spark, "t")).collect())
    start = 0
    for x, t in zip(got, reversed(TEXTS), strict=True):
        ids = np.array(plain(coder, t, 1), "<u4")
        assert (x.start, x.n_tokens, x.ids_crc32, bytes(x.ids)) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    assert token_files.token_files(docs.limit(0), new_path(spark, "t")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.booleans())
def test_windows_hold_each_id_once(sizes, cut):
    windows = P.fill(np.array(sizes, np.int64), 64, cut)
    seen = {k: [] for k in range(len(sizes))}
    for w in windows:
        assert sum(n for _, _, n in w) <= 64
        for k, begin, n in w:
            seen[k].append((begin, n))
    for k, parts in seen.items():
        at = 0
        for begin, n in sorted(parts):
            assert begin == at and n > 0
            at += n
        assert at == sizes[k] and (cut or len(parts) == 1)
    if cut and sizes:
        assert len(windows) == -(-sum(sizes) // 64)


def test_differencing_balances():
    sizes = np.random.default_rng(0).integers(1, 1000, 300)
    load = np.bincount(P.difference(sizes, 20), sizes, 20)
    assert load.max() - load.min() < 40


def test_packed_pieces(spark, coder):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(3, "again", "x")], "doc_id long, text string, ids string")
    rows = P.pack(docs, 64, 2).collect()
    assert all(x.length <= 64 and zlib.crc32(x.ids) == x.ids_crc32 and len(x.ids) == 4 * x.length for x in rows)
    by = {}
    for x in sorted(rows, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == by.get(x.sequence_id, 0)
        by[x.sequence_id] = x.offset + x.length
    whole = b"".join(bytes(x.ids) for x in sorted(rows, key=lambda x: x.start) if x.doc_id == 5)
    assert list(np.frombuffer(whole, "<u4")) == plain(coder, TEXTS[5], 2)
    assert P.pack(docs.limit(0)).collect() == []


def test_query_holds_every_id_of_every_document_once(spark, coder, data):
    """All pieces of the registered query against plain encoding: start, length, checksum, doc_tokens and places in sequences."""
    want = {r.doc_id: plain(coder, r.text, 2) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    rows, used = P.query(spark, data).collect(), {}
    by_doc, by_sequence = {}, {}
    for x in rows:
        by_doc.setdefault(x.doc_id, []).append(x)
        by_sequence.setdefault(x.sequence_id, []).append(x)
    assert by_doc.keys() == want.keys()
    for i, pieces in by_doc.items():
        at = 0
        for x in sorted(pieces, key=lambda x: x.start):
            assert x.start == at and x.length > 0 and x.doc_tokens == len(want[i])
            assert x.ids_crc32 == zlib.crc32(np.array(want[i][at : at + x.length], "<u4").tobytes())
            at += x.length
        assert at == len(want[i])
    for name, pieces in by_sequence.items():
        at = 0
        for x in sorted(pieces, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        used[name] = at
    assert max(used.values()) <= 4096 and sum(used.values()) > 0.95 * 4096 * (len(used) - 1)


def test_differencing_holds_no_empty_windows():
    sizes = np.random.default_rng(1).integers(1, 3, 40_000)
    tracemalloc.start()
    load = np.bincount(P.difference(sizes, 200), sizes, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert load.max() - load.min() <= 1 and peak < 40e6


def test_a_million_empty_texts_in_one_partition(spark):
    docs = spark.range(0, 10**6, 1, 1).selectExpr("id doc_id", "if(id % 2 = 0, '', null) text")
    got = P.pack(docs, 4096, 2, with_ids=False).groupBy("sequence_id").agg({"length": "sum", "offset": "max", "doc_id": "count"}).collect()
    load = [r["sum(length)"] for r in got]
    assert sum(load) == 10**6 and max(load) <= 4096 and len(load) == -(-(10**6) // 4096)
    assert all(r["count(doc_id)"] == r["sum(length)"] == r["max(offset)"] + 1 for r in got)
