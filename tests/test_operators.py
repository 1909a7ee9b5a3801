import numpy as np
import pytest
from pyspark.sql import functions as F

from retort.functions import labels as L
from retort.operators import align as A
from retort.operators import models as D
from retort.operators import signals as S
from retort.operators import splits as P
from retort.operators import survival as V
from retort.operators import statistics as T
from retort.sources import runs as R


@pytest.fixture(scope="module")
def fixture(spark):
    """3 classes x 4 bases x 2 replicates, 60 scans, m/z 40 to 47, of which 47 is dead."""
    rows = []
    for c, letter in enumerate("DCM"):
        for b in range(4):
            for r in (1, 2):
                for t in range(60):
                    for mz in range(40, 48):
                        peak = 100 * np.exp(-0.5 * ((t - 12 - 14 * c) / 3) ** 2) * (1 + (mz - 40) % (c + 2)) if mz < 47 else 0.0
                        rows.append((f"{letter}0{b}-{r}", t, t * 100.0, mz, float(peak + ((t * 7 + mz * 3 + b + r) % 5) * 0.1 if mz < 47 else 0.0)))
    df = spark.createDataFrame(rows, "sample_id string, scan_idx int, rt_ms double, mz int, intensity double").repartition(3).cache()
    df.count()
    return df


def test_dead_channel_and_totals(fixture):
    assert [r.mz for r in S.live_channels(fixture).orderBy("mz").collect()] == list(range(40, 47))
    a, b = (x.agg(F.round(F.sum(c), 6)).collect()[0][0] for x, c in ((S.tic(fixture), "tic"), (S.tis(fixture), "tis")))
    assert a == b


def test_edges_are_those_of_linspace():
    assert all(S.linspace_edges(n, k) == list(np.linspace(0, n, k + 1, dtype=int)) for n in range(1, 300, 7) for k in range(1, 60))


def test_gram_of_cubes_adds_up(fixture):
    cubes = S.with_cubes(fixture, 60, 3, 40, 8, 2)
    g = V.cube_grams(V.cube_features(cubes)).groupBy("a", "b").agg(F.round(F.sum("dot"), 3).alias("dot"))
    whole = T.gram(fixture.select("sample_id", (F.col("mz") * 1000 + F.col("scan_idx")).alias("pos"), F.col("intensity").alias("value")), block=500, sample_block=10).select("a", "b", F.round("dot", 3).alias("dot"))
    assert g.exceptAll(whole).count() == 0 and g.count() == whole.count() == 24 * 25 // 2


def test_dual_ridge_is_primal_ridge():
    r = np.random.default_rng(0)
    x, y = r.normal(size=(20, 7)), r.normal(size=(20, 2))
    train, test = np.arange(15), np.arange(15, 20)
    mx, my = x[train].mean(0), y[train].mean(0)
    w = np.linalg.solve((x[train] - mx).T @ (x[train] - mx) + 2.0 * np.eye(7), (x[train] - mx).T @ (y[train] - my))
    assert np.allclose(D.dual_ridge(x @ x.T, y, train, test, 2.0), (x[test] - mx) @ w + my)
    s = D.gram_scores(x @ x.T, np.arange(20))
    c = x - x.mean(0)
    assert np.allclose(s @ s.T, c @ c.T)


def test_classes_are_told_apart(spark, fixture):
    lab = fixture.select("sample_id").distinct().withColumn("label", L.letter(F.col("sample_id")))
    f = S.tic(fixture).select("sample_id", F.col("scan_idx").alias("pos"), F.col("tic").alias("value"))
    for model in ("ridge", "knn", "lda"):
        out = D.classify_splits(T.gram(f), lab, P.one_per_class(lab.withColumn("base", L.base_id(F.col("sample_id"))), "label", 2, unit="base"), model)
        assert out.where("y_true <> y_pred").count() == 0 and out.count() == 12


def test_survival_steps(spark, fixture):
    lab = fixture.select("sample_id").distinct().withColumn("label", L.letter(F.col("sample_id")))
    g = V.cube_grams(V.cube_features(S.with_cubes(fixture, 60, 3, 40, 8, 2), "tis"))
    out = V.survival_map(g, lab, P.stratified_folds(lab, "label", 2), "add").collect()
    assert len(out) == 12 and all(0 <= r.outer_accuracy <= 1 for r in out)
    assert all(len({(r.rt_bin, r.mz_bin) for r in out if r.fold == f}) == 6 for f in (0, 1))


def test_splits(spark, fixture):
    s = fixture.select("sample_id").distinct().withColumn("label", L.letter(F.col("sample_id"))).withColumn("base", L.base_id(F.col("sample_id")))
    test = P.one_per_class(s, "label", 8, seed=3, unit="base")
    per = test.join(s, "sample_id").groupBy("split_id", "label").agg(F.countDistinct("base").alias("b"), F.count("*").alias("n")).collect()
    assert len(per) == 24 and all(r.b == 1 and r.n == 2 for r in per)
    assert P.stratified_folds(s, "label", 4).count() == 24
    g = P.group_shuffle(s, "base", 0.2, 3, label="label").join(s, "sample_id").groupBy("split_id").agg(F.countDistinct("label").alias("c")).collect()
    assert all(r.c == 3 for r in g)
    with pytest.raises(Exception, match="fewer than two"):
        P.one_per_class(s.where("base = 'D00' OR label = 'C'"), "label", 2, unit="base").collect()


def test_alignment_recovers_a_shift(fixture):
    moved = fixture.where("sample_id = 'D01-1'").withColumn("scan_idx", F.col("scan_idx") + 3).where("scan_idx < 60").withColumn("sample_id", F.lit("moved"))
    out = A.align_to_reference(fixture.where("sample_id = 'D01-1'").unionByName(moved), "D01-1", 60, sigma=1, most=8, tolerance=6)
    lags = {r.sample_id: r.lag for r in out.select("sample_id", "lag").distinct().collect()}
    assert lags == {"moved": 3, "D01-1": 0}
    wide = out.groupBy("scan_idx", "mz").pivot("sample_id", ["moved", "D01-1"]).agg(F.first("intensity")).where("scan_idx BETWEEN 5 AND 50")
    assert wide.agg(F.max(F.abs(F.col("moved") - F.col("`D01-1`")))).collect()[0][0] < 1e-6
    assert list(A.window_lags(np.sin(np.arange(60) / 3), np.sin((np.arange(70) - 2) / 3), 30, 4)) == [2, 2]


def test_readers(spark, tmp_path):
    for name, shift in (("D01-1", 0), ("D01-2", 5)):
        (tmp_path / "runs" / f"{name}.D").mkdir(parents=True)
        lines = ["Retention Time (ms),40,41"] + [f"{100 * k},{k + shift},{2 * k}" for k in range(5)]
        (tmp_path / "runs" / f"{name}.D" / f"{name}.csv").write_text("\n".join(lines))
    df = R.read_runs(spark, str(tmp_path / "runs"))
    assert df.count() == 2 * 4 * 2
    assert df.where("sample_id = 'D01-2' AND scan_idx = 0 AND mz = 40").collect()[0].intensity == 6.0
    (tmp_path / "oak.csv").write_text("x,,,\nTr Bois A1,Ab Bois A1,Tr Bois A1,Ab Bois A1\n1,10,1,20\n2,11,2,21\n,,3,22\n")
    oak = {(r.sample_id, r.scan_idx): r.value for r in R.read_paired_columns(spark, str(tmp_path / "oak.csv")).collect()}
    assert oak == {("A1-1", 0): 10.0, ("A1-1", 1): 11.0, ("A1-2", 0): 20.0, ("A1-2", 1): 21.0, ("A1-2", 2): 22.0}
    (tmp_path / "champ.csv").write_text("V1,,V1,\n1,5,1,7\n2,6,2,8\n")
    assert {(r.sample_id, r.scan_idx, r.value) for r in R.read_alternating_columns(spark, str(tmp_path / "champ.csv")).collect()} == {("V1-1", 0, 5.0), ("V1-1", 1, 6.0), ("V1-2", 0, 7.0), ("V1-2", 1, 8.0)}
    (tmp_path / "s.csv").write_text("junk,,\nCode Vin,Taster,\ncode vin,taster,\nW1,T1,x\n")
    s = R.read_sensory(spark, str(tmp_path / "s.csv"))
    assert s.columns == ["code vin", "taster"] and s.count() == 1
    (tmp_path / "runs" / "D01-1.D" / "sample_info.xml").write_text("<a><DisplayName>AcqTime</DisplayName><Value>2020-01-02T03:04:05+01:00</Value></a>")
    got = R.read_acquisitions(spark, str(tmp_path / "runs" / "*.D" / "sample_info.xml")).collect()
    assert got[0].sample_id == "D01-1" and str(got[0].acquired) == "2020-01-02 03:04:05"
    c = spark.createDataFrame([("a", 0, 1.0, 40.5, 1.0), ("a", 0, 1.0, 39.6, 2.0), ("a", 0, 1.0, 41.5, 4.0)], "sample_id string, scan_idx int, rt_ms double, mz double, intensity double")
    assert {(r.mz, r.intensity) for r in R.centroids_to_grid(c, 40, 42).collect()} == {(40, 3.0), (42, 4.0)}


def test_ester_names_and_margins(spark, tmp_path):
    names = ["Tr Esters V_1990-A", "ab bois v 1990 b", "Ab Esters F_85", "Tr Bois D2018", "Tr Esters V1990x9", "Esters V_1990", "", None]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string")
    got = [r.e and tuple(r.e) for r in df.select(R.ester_name(F.col("n")).alias("e"), "k").orderBy("k").collect()]
    assert got == [("Tr", "V1990", "A"), ("Ab", "V1990", "B"), ("Ab", "F85", None), ("Tr", "D2018", None), None, None, None, None]
    (tmp_path / "e.csv").write_text("x,,,,\nTr Esters V_1990-A,Ab Esters V_1990-A,Tr Esters V_1990-B,Ab Esters V_1990-B,Tr Bois D2018\n1,10,3,20,5\n2,12,,,6\n,,,,7\n")
    assert sorted(tuple(r) for r in R.read_ester_columns(spark, str(tmp_path / "e.csv")).collect()) == [("V1990", 0, 2.0, 15.0), ("V1990", 1, 2.0, 12.0)]
    for name, head, n in (("B", "t,40,41,x", 3), ("A", "t,note,40,41,42,y", 2)):
        (tmp_path / "runs" / f"{name}.D").mkdir(parents=True)
        (tmp_path / "runs" / f"{name}.D" / f"{name}.csv").write_text("\n".join([head, *[",".join(["1"] * len(head.split(",")))] * n]))
    assert [tuple(r) for r in R.run_margins(spark, str(tmp_path / "runs")).collect()] == [(3, 2, 4)]
    with pytest.raises(Exception):
        R.run_margins(spark, str(tmp_path / "none"))


def test_sheet(spark):
    sheet = spark.createDataFrame([(1, 5.0, 7.0), (2, 6.0, 8.0)], "`row` int, `Ab Bois_D2018` double, `other` double")
    assert [(r.sample_id, r["values"]) for r in R.sheet_to_vectors(sheet, "row").collect()] == [("D2018", [5.0, 6.0])]


def test_names(spark):
    df = spark.createDataFrame([("ML_MA1.D",), ("ML_MA1_3.D",), ("x",)], "n string")
    assert [r[0] for r in df.select(L.renamed(F.col("n"))).collect()] == ["Est21MA1-1.D", "Est21MA1-3.D", "x"]
    with pytest.raises(Exception, match="unknown winery letter"):
        df.select(L.country(F.col("n"))).collect()
    with pytest.raises(Exception, match="several wine kinds"):
        R.check_one_kind(spark.createDataFrame([("a/bordeaux",), ("a/champagne",)], "path string")).collect()
