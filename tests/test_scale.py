"""What tasks hold and what is shuffled: plans and pieces, on small rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazardlake.operators import cluster as K
from hazardlake.operators import coxpath
from hazardlake.operators import layout as L
from hazardlake.operators import quality as Q
from hazardlake.operators import reduce as R
from hazardlake.plans import cohort as M
from hazardlake.plans import experiment as P


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def matrix(spark, n=12, modality="m"):
    rows = [(modality, f"s{i:02d}", f"f{j}", None if (i + j) % 5 == 0 else float(i * j % 7)) for i in range(n) for j in range(3)]
    return spark.createDataFrame(rows, "modality string, sample_id string, feature_id string, value double")


def test_statistics_go_to_the_rows(spark):
    """Scaling, imputing and assembling do not shuffle rows to join them with statistics."""
    rows = matrix(spark)
    imputed = Q.impute_median(rows)
    assert "Exchange hashpartitioning" not in plan(imputed)
    assert "Exchange hashpartitioning" not in plan(Q.zscore(rows))
    assert plan(L.assemble(rows, L.feature_dictionary(rows))).count("Exchange hashpartitioning") == 1
    want = rows.toPandas()
    want["value"] = want.value.fillna(want.groupby("feature_id").value.transform("median"))
    by = ["sample_id", "feature_id"]
    pd.testing.assert_frame_equal(imputed.toPandas().sort_values(by, ignore_index=True), want.sort_values(by, ignore_index=True))


def test_distances_come_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(f"s{i:03d}", rng.normal(size=3).tolist()) for i in range(90)]
    v = spark.createDataFrame(rows, "sample_id string, features array<double>")
    whole = K.kmeans(v, [2, 3], 4, 5)
    monkeypatch.setattr(K, "BLOCK", 70)
    assert max(len(x) for x in K._blocks(np.zeros((90, 3)), 20)) == 3
    blocks = K.kmeans(v, [2, 3], 4, 5)
    for k in (2, 3):
        assert blocks[k]["cost"] == pytest.approx(whole[k]["cost"])
        np.testing.assert_allclose(blocks[k]["centers"], whole[k]["centers"])


def test_risk_sets_from_pieces(monkeypatch):
    """Rows that come in pieces and another order, curvature and scores taken up piece by piece."""
    rng = np.random.default_rng(3)
    x, t, e = rng.normal(size=(60, 4)), rng.integers(1, 9, 60).astype(float), rng.integers(0, 2, 60)
    one = coxpath.Risk(x, t, e)
    keep, beta, use = np.ones((60, 1)), np.full((4, 1), 0.1), np.array([0, 2, 3])
    parts = one.evaluate(beta, keep, one.deaths(keep))[2]
    curve = one.hessian(use, *(p[:, 0] for p in parts))
    scores = rng.integers(0, 9, (60, 5)).astype(float)
    ranked = coxpath.concordance_columns(t, e, scores)
    monkeypatch.setattr(coxpath, "PIECE", 7)
    monkeypatch.setattr(coxpath, "SCORED", 130)
    row = rng.permutation(60)
    many = coxpath.Risk((x[row][lo:lo + 25] for lo in range(0, 60, 25)), t, e, row)
    np.testing.assert_allclose(many.z, one.z, atol=1e-12)
    np.testing.assert_allclose(many.hessian(use, *(p[:, 0] for p in parts)), curve, rtol=1e-9)
    np.testing.assert_allclose(coxpath.concordance_columns(t, e, scores), ranked)


def test_rounds_leave_the_shards_in_place(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [("m", f"s{i:03d}", x.tolist(), x.tolist()) for i, x in enumerate(rng.normal(size=(80, 4)))]
    pairs = spark.createDataFrame(rows, "grp string, sample_id string, features array<double>, target array<double>")
    monkeypatch.setattr(R, "SHARD_BYTES", 2000)
    plans, cut = [], R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda df: plans.append(plan(df)) or cut(df))
    assert R.dae_fit(pairs, 2, epochs=3, patience=9).count() == 1
    rounds = [p.split("FlatMapCoGroupsInArrow")[1] for p in plans if "FlatMapCoGroupsInArrow" in p]
    assert len(rounds) == 2
    assert all("Exchange" not in p[:p.index("InMemoryTableScan")] for p in rounds)


def test_first_specimens_are_found_once(spark, monkeypatch):
    names = [f"{'x' * 17}{s:02d}-{o:02d}" for s in range(6) for o in range(4)]
    rows = [(n, f, float(i)) for i, n in enumerate(names) for f in ("a", "b") if (i + len(f)) % 3 or f == "b"]
    raw = spark.createDataFrame(rows, "sample_id string, feature_id string, value double")
    some = spark.createDataFrame([(f"{'x' * 17}{s:02d}",) for s in range(4)], "sample_id string")
    monkeypatch.setattr(M, "TASK_ROWS", 4, raising=False)
    got = M.one_specimen_per_sample(raw, some)
    assert "Exchange" not in plan(got)
    want = {}
    for n, f, v in sorted(rows):
        if n[:19] in {r.sample_id for r in some.collect()}:
            want.setdefault((n[:19], f), v)
    assert {(r.sample_id, r.feature_id): r.value for r in got.collect()} == want


def test_a_study_carries_its_own_samples_only(spark, monkeypatch):
    """Rows of samples that lack a modality or are not in the cohort are not screened, scaled or copied."""
    a, b, clin = matrix(spark, 12, "a"), matrix(spark, 9, "b"), matrix(spark, 12, "c")
    cohort = spark.createDataFrame([(f"s{i:02d}", 10 + i, i % 2, "LUSC") for i in range(2, 12)],
                                   "sample_id string, time int, event int, subtype string")

    class Found(Exception):
        pass

    def seen(long, *rest):
        raise Found(sorted(r.sample_id for r in long.select("sample_id").distinct().collect()))

    monkeypatch.setattr(P, "screened", seen)
    with pytest.raises(Found) as found:
        P.run_experiment(a.unionByName(b), clin, cohort, {"a": "Gene", "b": "Meth", "c": "Clin"}, method="screen", k=2)
    assert found.value.args[0] == [f"s{i:02d}" for i in range(2, 9)]


def test_curvature_is_kept_along_the_path(monkeypatch):
    """A Hessian serves many penalties; the gradient of every accepted point is its own, so the optimum is the same."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 9))
    t, e = np.ceil(rng.exponential(np.exp(-x[:, :3].sum(1) / 3)) * 300), rng.integers(0, 2, 900)
    risk, made, hessian = coxpath.Risk(x, t, e), [], coxpath.Risk.hessian
    monkeypatch.setattr(coxpath.Risk, "hessian", lambda self, *args: (made.append(1), hessian(self, *args))[1])
    keep = np.ones((900, 3))
    keep[rng.random(900) < 0.1, 1] = 0
    uses = [np.arange(9), np.arange(9), np.array([1, 4, 7, 8])]
    lambdas = np.tile(0.3 * np.logspace(0, -4, 60), (3, 1))
    beta, ok = coxpath.solve_path(risk, uses, keep, lambdas, 0.5)
    assert ok.all() and 0 < len(made) < 3 * 60 / 4
    n, deaths = keep.sum(0), risk.deaths(keep)
    for l in (0, 20, 59):
        grad = risk.evaluate(beta[:, l].T, keep, deaths)[1]
        for c, use in enumerate(uses):
            g, b = grad[use, c] / n[c] - lambdas[c, l] * 0.5 * beta[c, l, use], beta[c, l, use]
            off = np.where(b != 0, np.abs(g - 0.5 * lambdas[c, l] * np.sign(b)), np.maximum(np.abs(g) - 0.5 * lambdas[c, l], 0))
            assert off.max() < 1e-7 * 0.3 * 1.01


def test_combinations_are_views_of_one_vector(spark, monkeypatch):
    """Models of some positions each are those of their own vectors, and share the rows of the group."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 6)) * np.arange(1, 7)
    df = spark.createDataFrame([("1", f"s{i:02d}", r.tolist()) for i, r in enumerate(x)], "grp string, sample_id string, features array<double>")
    views = {"1|a": ("1", [0, 2, 5]), "1|b": ("1", list(range(6)))}
    fit = R.pca_fit(df, {"1|a": 2, "1|b": 3}, views=views)
    got = R.pca_project(df, fit, views=views).toPandas()
    assert sorted(got.grp) == ["1|a"] * 60 + ["1|b"] * 60
    for name, (_, ix) in views.items():
        z = x[:, ix] - x[:, ix].mean(0)
        u, s, _ = np.linalg.svd(z, full_matrices=False)
        scores = np.stack(got[got.grp == name].sort_values("sample_id").features)
        k = scores.shape[1]
        np.testing.assert_allclose(np.abs(scores), np.abs(u * s)[:, :k], atol=1e-6)
    scaled = Q.zscore_vectors(df.withColumn("features", F.concat("features", F.array(F.lit(3.0)))), ["grp"]).orderBy("sample_id").toPandas()
    want = np.c_[(x - x.mean(0)) / x.std(0, ddof=1), np.zeros(60)]
    np.testing.assert_allclose(np.stack(scaled.features), want, atol=1e-9)


def test_principal_components_of_combinations_copy_no_rows(spark, monkeypatch):
    """The study by components writes no feature once per combination."""
    a, b, clin = matrix(spark, 40, "a"), matrix(spark, 40, "b"), matrix(spark, 40, "c")
    cohort = spark.createDataFrame([(f"s{i:02d}", 10 + 7 * i % 23, i % 2, ("LUSC", "LUAD")[i // 3 % 2]) for i in range(40)],
                                   "sample_id string, time int, event int, subtype string")
    noise = F.hash("modality", "sample_id", "feature_id") % 1000 / 100
    a, b, clin = (df.withColumn("value", noise.cast("double")) for df in (a, b, clin))

    def copied(*_):
        raise AssertionError("rows are copied for each combination")

    monkeypatch.setattr(P.E, "expand_combos", copied)
    out = P.run_experiment(a.unionByName(b), clin, cohort, {"a": "Gene", "b": "Meth", "c": "Clin"}, method="pca", k=2, nlambda=3,
                           inner_folds=2, screen_sizes={"a": 3, "b": 2}, reduced_sizes={"a": 2, "b": 2}, early_size=2)["results"].toPandas()
    early = out[out.integration == "early"]
    assert sorted(early.data_types.unique()) == ["Gene-Clin", "Meth-Clin", "Meth-Gene", "Multimodal (Early)"] and len(early) == 8


def test_filled_modalities_of_some_samples(spark, tmp_path):
    """Brands and discounts of listed samples are the rows that all samples have, with the features of all."""
    from hazardlake.sources import fixtures as X
    tables = {
        "customer": ([(i, "BUILDING") for i in range(6)], "c_custkey long, c_mktsegment string"),
        "orders": ([(i, i % 6, "F", f"{i % 3}-P", f"1995-01-{1 + i:02d}") for i in range(18)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate string"),
        "lineitem": ([(i % 18, i % 7, "AR"[i % 2], float(i), i / 100) for i in range(40)],
                     "l_orderkey long, l_partkey long, l_returnflag string, l_quantity double, l_discount double"),
        "part": ([(i, f"B{i}") for i in range(7)], "p_partkey long, p_brand string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    some = X.cohort(spark, str(tmp_path)).where("sample_id in ('1', '4')")
    for source in (X.brand, X.discount):
        whole = {tuple(r) for r in source(spark, str(tmp_path)).where("sample_id in ('1', '4')").collect()}
        assert {tuple(r) for r in source(spark, str(tmp_path), some).collect()} == whole and len(whole) > 10


def test_screened_combinations_copy_no_rows(spark, monkeypatch):
    """The study by screening deals tests of features to combinations, never the values of samples."""
    a, b, clin = matrix(spark, 40, "a"), matrix(spark, 40, "b"), matrix(spark, 40, "c")
    cohort = spark.createDataFrame([(f"s{i:02d}", 10 + 7 * i % 23, i % 2, ("LUSC", "LUAD")[i // 3 % 2]) for i in range(40)],
                                   "sample_id string, time int, event int, subtype string")
    noise = F.hash("modality", "sample_id", "feature_id") % 1000 / 100
    a, b, clin = (df.withColumn("value", noise.cast("double")) for df in (a, b, clin))
    dealt, expand = [], P.E.expand_combos
    monkeypatch.setattr(P.E, "expand_combos", lambda long, combos: (dealt.append(long.columns), expand(long, combos))[1])
    out = P.run_experiment(a.unionByName(b), clin, cohort, {"a": "Gene", "b": "Meth", "c": "Clin"}, method="screen", k=2, nlambda=3,
                           inner_folds=2, screen_sizes={"a": 3, "b": 3}, reduced_sizes={"a": 2, "b": 2}, early_size=2)["results"].toPandas()
    assert dealt and not any("sample_id" in columns for columns in dealt)
    early = out[out.integration == "early"]
    assert sorted(early.data_types.unique()) == ["Gene-Clin", "Meth-Clin", "Meth-Gene", "Multimodal (Early)"] and len(early) == 8


def test_a_model_is_scored_in_parts(spark, monkeypatch):
    """Rows that a task encodes are few whatever a task trains on, and parts change nothing."""
    rng = np.random.default_rng(4)
    rows = [("m", f"s{i:03d}", x.tolist(), x.tolist()) for i, x in enumerate(rng.normal(size=(90, 4)))]
    pairs = spark.createDataFrame(rows, "grp string, sample_id string, features array<double>, target array<double>")
    fit = R.cut_lineage(R.dae_fit(pairs, 2, epochs=2))
    whole = R.dae_loss(pairs, fit).first().mse
    monkeypatch.setattr(R, "PART_BYTES", 2000, raising=False)
    dealt, shards = [], R._shards
    monkeypatch.setattr(R, "_shards", lambda *args: dealt.append(shards(*args)) or dealt[-1])
    assert R.dae_loss(pairs, fit).first().mse == pytest.approx(whole, rel=1e-12)
    assert dealt[0][1] == {"m": 3}
