"""Steps whose work or memory must follow their input."""

import numpy as np
from pyspark.sql import functions as F

from retort.operators import splits as P
from retort.plans import jobs as J
from retort.sources import runs as R


def rows_made(frame, kind, metric="numOutputRows"):
    """Rows that the nodes of a kind made in a frame that has run."""
    made, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if kind in node.nodeName() and node.metrics().contains(metric):
            made += node.metrics().get(metric).get().value()
        todo += [node.children().apply(k) for k in range(node.children().size())]
        todo += [getattr(node, m)() for m in ("executedPlan", "plan") if m in dir(node)]
    return made


def test_splits_are_not_multiplied_by_units(spark):
    samples = spark.range(3000).select(F.col("id").alias("sample_id"), (F.col("id") % 3).alias("label"))
    out = P.all_one_per_class(samples, "label", 7, 200)
    got = {}
    for r in out.collect():
        got.setdefault(r.split_id, []).append(r.sample_id)
    # the first class is the fastest digit
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted([3 * (k % 1000), 3 * (k // 1000 % 1000) + 1, 2]) for k in range(7, 207)}
    assert 0 < rows_made(out, "Generate") <= 200 * 4


def test_sensory_in_parts(spark, tmp_path):
    """The lines above are in the first file by name, which is not the largest."""
    (tmp_path / "s x").mkdir()
    (tmp_path / "s x" / "part-0.csv").write_text("titles,,\nWine,Taster,Fruity\nwine,taster,fruity\n")
    for k in (1, 2):
        (tmp_path / "s x" / f"part-{k}.csv").write_text("".join(f"W{k},T{j},{j}.5\n" for j in range(300 * k)))
    got = R.read_sensory(spark, str(tmp_path / "s x"))
    assert got.columns == ["wine", "taster", "fruity"]
    assert {(r.wine, r["count"]) for r in got.groupBy("wine").count().collect()} == {("W1", 300), ("W2", 600)}


def test_scores_are_gathered_once(spark):
    g = np.random.default_rng(2)
    met = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            met.add(len(frame))
            yield frame

    wines = spark.createDataFrame([(f"w{k}", [float(v) for v in g.normal(size=2)]) for k in range(12)], "wine string, x array<double>")
    scores = spark.createDataFrame([(f"w{k}", f"t{t}", [float(v) for v in g.normal(size=2)]) for k in range(12) for t in range(3)], "wine string, taster string, y array<double>")
    out = J.self_and_group_models(wines, scores.mapInPandas(count, scores.schema), ["a", "b"])
    assert out.count() == 6 and met.value == 36
