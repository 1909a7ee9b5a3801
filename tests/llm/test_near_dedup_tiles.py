import random

import pytest

from retort.llm import near_dedup as N
from test_dedup_and_decontamination import SCHEMA, brute, family


@pytest.mark.parametrize("tile_from", [1, 10**6])
def test_joins_and_tiles_give_one_result(spark, monkeypatch, tile_from):
    """Every bucket in tiles, or every bucket in a join."""
    monkeypatch.setattr(N, "TILE_FROM", tile_from)
    r = random.Random(6)
    rows = []
    for k in range(4):
        rows += family(r, [f"w{r.randrange(3000)}" for _ in range(60)], 25, 1000 * (k + 1))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in N.near_duplicates(docs, shingle=4).collect()} == brute(rows, 4)


def test_recall_on_the_given_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in N.query(spark, data).collect()} == brute(rows, 4)
