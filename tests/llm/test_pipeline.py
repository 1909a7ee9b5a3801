import zlib

import numpy as np

import corpus_pipeline as P
from retort.llm.secret_scan import redacted
from retort.llm.tokens import Encoder, default_path


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, rows = docs.columns, None
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = P.written(stage(spark, docs, data), name)
        assert docs.columns == columns
        rows = {r.doc_id: r for r in docs.collect()}
        assert rows.keys() <= before.keys()
        if name == "secret_scan":
            assert all(r.text == redacted(before[i]) and r.n_chars == len(r.text) for i, r in rows.items())
        else:
            assert all(r.text == before[i] for i, r in rows.items())
    pieces = P.STAGES[-1][1](spark, docs, data).collect()
    coder = Encoder(default_path()).tokenizer
    for i, r in rows.items():
        ids = np.array([*coder.encode(r.text, add_special_tokens=False).ids, 2], "<u4").tobytes()
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in own) == ids and all(zlib.crc32(p.ids) == p.ids_crc32 for p in own)
