"""Inputs that the study's tables do not hold: NULL groups, absent rows, other units, flat spectra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardlake.operators import coxnet, diff, layout, reduce, report, sampling, survival


def rows_of(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_assemble_goes_by_position(spark):
    dic = spark.createDataFrame([("m", f"f{i}", i, 3) for i in (1, 2, 3)], "modality string, feature_id string, pos int, p int")
    long = spark.createDataFrame([("m", "a", "f3", 3.0), ("m", "a", "f1", 1.0), ("m", "b", "f2", 2.0), ("m", "b", "f1", None),
                                  ("m", "b", "f3", 4.0)], "modality string, sample_id string, feature_id string, value double")
    got = {r.sample_id: r.features for r in layout.assemble(long, dic).collect()}
    assert got == {"a": [1.0, None, 3.0], "b": [None, 2.0, 4.0]}
    twice = long.unionByName(long.where("feature_id = 'f1' AND sample_id = 'a'"))
    with pytest.raises(Exception, match="two rows for one feature"):
        layout.assemble(twice, dic).collect()


def test_null_is_a_stratum(spark):
    cohort = spark.createDataFrame([(str(i), None if i % 2 else "x") for i in range(200)], "sample_id string, subtype string")
    folds = sampling.stratified_folds(cohort, ["subtype"], 5).groupBy("subtype", "fold").count().collect()
    assert len(folds) == 10 and {r["count"] for r in folds} == {20}


def test_null_group_has_a_concordance(spark):
    rng = np.random.default_rng(1)
    rows = [(None if i % 2 else "x", float(rng.normal()), int(rng.integers(1, 50)), int(rng.integers(0, 2))) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, score double, time int, event int")
    got = {r.g: r.cindex for r in survival.concordance(df, ["g"]).collect()}
    alone = survival.concordance(df.where("g IS NULL")).collect()[0].cindex
    assert set(got) == {None, "x"} and got[None] == alone


def test_null_group_is_adjusted(spark):
    df = spark.createDataFrame([(None, 0.01), (None, 0.04), ("x", 0.5), ("x", None)], "g string, p double")
    got = rows_of(diff.bh_adjust(df, "p", ["g"]), "g", "p", "padj")
    assert got == {(None, 0.01, 0.02), (None, 0.04, 0.04), ("x", 0.5, 0.5), ("x", None, None)}


def test_absent_counts_are_zero(spark):
    counts = {"a": {"g1": 10, "g2": 20, "g3": 5}, "b": {"g1": 20, "g2": 40}, "c": {"g1": 5, "g2": 10, "g3": 0}}
    df = spark.createDataFrame([(s, g, v) for s, c in counts.items() for g, v in c.items()], "sample_id string, feature_id string, value long")
    got = {r.sample_id: r.size_factor for r in diff.size_factors(df).collect()}
    assert got == pytest.approx({"a": 1.0, "b": 2.0, "c": 0.5})


@pytest.mark.parametrize("scale, shift", [(1e-8, 0.0), (1e8, 0.0), (1.0, 1e6)])
def test_screen_ignores_units(spark, scale, shift):
    rng = np.random.default_rng(2)
    cohort = spark.createDataFrame([(str(i), int(rng.integers(1, 40)), int(rng.integers(0, 2))) for i in range(80)],
                                   "sample_id string, time int, event int")
    x = rng.normal(size=80)
    rows = [("m", str(i), f, v) for i in range(80) for f, v in (("plain", x[i]), ("unit", x[i] * scale + shift), ("same", 7e5))]
    df = spark.createDataFrame([(m, s, f, float(v)) for m, s, f, v in rows], "modality string, sample_id string, feature_id string, value double")
    got = {r.feature_id: r.chi2 for r in survival.cox_screen(df, cohort).collect()}
    assert set(got) == {"plain", "unit"} and got["unit"] == pytest.approx(got["plain"], rel=1e-6)


@pytest.mark.parametrize("n, p", [(400, 300), (60, 500), (50, 8)])
def test_components_of_a_flat_spectrum(spark, n, p):
    x = np.random.default_rng(p).normal(size=(n, p))
    df = spark.createDataFrame([("g", str(i), [float(v) for v in r]) for i, r in enumerate(x)], "grp string, sample_id string, features array<double>")
    fit = reduce.pca_fit(df, 5)["g"]
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert fit["var"] == pytest.approx(s[:5] ** 2 / (n - 1), rel=1e-7)
    assert np.abs((fit["load"] * vt[:5].T).sum(0)) == pytest.approx(np.ones(5), abs=1e-6)


def test_components_of_few_directions(spark):
    rng = np.random.default_rng(5)
    x = np.outer(rng.normal(size=40), rng.normal(size=30))
    df = spark.createDataFrame([("g", str(i), [float(v) for v in r]) for i, r in enumerate(x)], "grp string, sample_id string, features array<double>")
    var = reduce.pca_fit(df, 4)["g"]["var"]
    assert var[0] == pytest.approx(np.trace(np.cov(x.T)), rel=1e-9) and (var[1:] < 1e-9 * var[0]).all()


def test_elastic_net_ignores_units(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4))
    time = rng.exponential(1, 120) * np.exp(-x[:, 0])
    for scale, shift, unit in ((1.0, 0.0, 1.0), (1e-8, 0.0, 1000.0), (1.0, 1e6, 1.0)):
        rows = [("g", str(i), float(np.ceil(time[i] * 50) * unit), 1, [float(v) for v in x[i] * scale + shift]) for i in range(120)]
        df = spark.createDataFrame(rows, "grp string, sample_id string, time double, event int, features array<double>")
        coefs, cv = coxnet.cox_elastic_net(df, nlambda=12, nfolds=3)
        got = coefs.where("lambda_at = 'min'").orderBy("pos").toPandas().coef.to_numpy() * scale
        curve = cv.orderBy("idx").toPandas()
        if scale == 1.0 and not shift:
            first, scores = got, curve.cvm
        assert got == pytest.approx(first, rel=1e-3, abs=1e-4) and got[0] > 0.3
        assert curve.cvm.to_numpy() == pytest.approx(scores.to_numpy(), abs=2e-3) and curve.converged.all()


@pytest.mark.parametrize("modality, label", [("Meth", "Methylation"), ("LNC", "LNC RNAs"), ("Gene", "mRNA"), ("miRNA", "miRNA")])
def test_rows_that_contain_a_modality(spark, modality, label):
    names = ["Clinical", "miRNA", "mRNA", "Methylation", "LNC RNAs"]
    df = spark.createDataFrame([(n, "x") for n in names] + [(f"{modality}-Clin", "One AE"), (f"{modality}-Clin", "x")], "data_types string, reduction string")
    got = rows_of(report.compare(df, "containing", modality=modality), "data_types", "reduction")
    assert got == {(label, "x"), (f"{modality}-Clin", "One AE")}


def test_a_modality_may_be_empty_in_one_fold(spark):
    df = spark.createDataFrame([(1, "x", "a", [1.0]), (1, "y", "a", [2.0]), (1, "x", "b", [5.0]), (2, "x", "a", [3.0]), (2, "x", "b", [4.0])],
                               "cv int, modality string, sample_id string, features array<double>")
    got = rows_of(layout.concat_vectors(df, ["y", "x"], ("cv", "sample_id"), ("cv",)).withColumn("v", F.col("features").cast("string")), "cv", "sample_id", "v")
    assert got == {(1, "a", "[2.0, 1.0]"), (2, "a", "[3.0]"), (2, "b", "[4.0]")}
