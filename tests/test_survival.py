import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazardlake.operators import coxnet, coxpath
from hazardlake.operators import survival as V
from hazardlake.operators.diff import bh_adjust
from hazardlake.operators.blocks import ModelRows


def cohort(spark, n=120, seed=0, days=40, strata=2):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({
        "sample_id": [f"s{i:04d}" for i in range(n)], "time": rng.integers(2, days, n),
        "event": rng.integers(0, 2, n), "subtype": rng.choice(["LUSC", "LUAD"][:strata], n)})


def test_km_ties(spark):
    """Tied event and censoring at one time."""
    df = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, 1)], "time int, event int")
    rows = V.kaplan_meier(df).orderBy("time").collect()
    assert [r.n_risk for r in rows] == [4, 3, 1]
    assert [round(r.survival, 6) for r in rows] == [0.75, 0.5, 0.0]


def test_km_all_censored(spark):
    df = spark.createDataFrame([(1, 0), (5, 0)], "time int, event int")
    assert [r.survival for r in V.kaplan_meier(df).collect()] == [1.0, 1.0]


def test_logrank_without_events_is_null(spark):
    df = spark.createDataFrame([(1, 0, "a"), (5, 0, "b")], "time int, event int, g string")
    assert V.logrank(df, "g").first().chi2 is None


@pytest.mark.parametrize("levels", [3, 500])
def test_concordance_brute_force(spark, levels):
    pdf = cohort(spark, 300, 1)
    pdf["score"] = np.random.default_rng(2).integers(0, levels, len(pdf)) / 7 - 3.0
    got = V.concordance(spark.createDataFrame(pdf), ["subtype"]).toPandas().set_index("subtype")
    for name, g in pdf.groupby("subtype"):
        t, e, s = g.time.values, g.event.values, g.score.values
        ok = (e[:, None] == 1) & ((t[:, None] < t) | ((t[:, None] == t) & (e == 0)))
        assert got.loc[name, "comparable"] == ok.sum()
        assert got.loc[name, "concordant"] == (ok & (s[:, None] > s)).sum()
        assert got.loc[name, "tied"] == (ok & (s[:, None] == s)).sum()


def test_concordance_reversed_score(spark):
    pdf = cohort(spark, 100, 4)
    pdf["score"] = np.random.default_rng(5).permutation(100) - 50.0
    df = spark.createDataFrame(pdf)
    a = V.concordance(df).first().cindex
    b = V.concordance(df.withColumn("score", -F.col("score"))).first().cindex
    assert a + b == pytest.approx(1.0)


def brute_score(t, e, x):
    u = v = 0.0
    for i in np.flatnonzero(e == 1):
        r = t >= t[i]
        u += x[i] - x[r].mean()
        v += x[r].var()
    return u, v


def long_frame(spark, pdf, x):
    rows = [("m", s, f"f{j:02d}", float(x[i, j])) for i, s in enumerate(pdf.sample_id) for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "modality string, sample_id string, feature_id string, value double")


def test_cox_screen(spark):
    pdf = cohort(spark)
    x = np.random.default_rng(3).normal(size=(len(pdf), 4))
    x[:, 3] = 2.5  # constant: no test
    got = V.cox_screen(long_frame(spark, pdf, x), spark.createDataFrame(pdf)).toPandas().set_index("feature_id")
    assert sorted(got.index) == ["f00", "f01", "f02"]
    for j in range(3):
        u, v = brute_score(pdf.time.values, pdf.event.values, x[:, j])
        assert got.loc[f"f{j:02d}", "chi2"] == pytest.approx(u * u / v)
        assert got.loc[f"f{j:02d}", "p"] == pytest.approx(math.erfc(math.sqrt(u * u / v / 2)))


def test_cox_screen_ignores_scale(spark):
    pdf = cohort(spark)
    x = np.random.default_rng(3).normal(size=(len(pdf), 2))
    c = spark.createDataFrame(pdf)
    a, b = (V.cox_screen(long_frame(spark, pdf, y), c).orderBy("feature_id").toPandas().chi2
            for y in (x, 1e6 + 250 * x))
    np.testing.assert_allclose(a, b, rtol=1e-6)


def test_cox_screen_cv_equals_separate_screens(spark):
    pdf = cohort(spark)
    pdf["fold"] = np.arange(len(pdf)) % 3 + 1
    x = np.random.default_rng(8).normal(size=(len(pdf), 2))
    long = long_frame(spark, pdf, x)
    got = V.cox_screen_cv(long, spark.createDataFrame(pdf), 3).toPandas().set_index(["cv", "feature_id"])
    for cv in (1, 2, 3):
        keep = (pdf.fold != cv).values
        u, v = brute_score(pdf.time.values[keep], pdf.event.values[keep], x[keep, 0])
        assert got.loc[(cv, "f00"), "chi2"] == pytest.approx(u * u / v)


def vectors(spark, n=150, p=8, seed=11):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    risk = x[:, 0] - 0.8 * x[:, 1]
    t = np.ceil(rng.exponential(np.exp(-risk)) * 60).astype(int) + 1
    e = rng.integers(0, 4, n) > 0
    pdf = pd.DataFrame({"grp": "a", "sample_id": [f"s{i}" for i in range(n)], "time": t,
                        "event": e.astype(int), "features": x.tolist()})
    return pdf, spark.createDataFrame(pdf)


def kkt(x, t, e, beta, lam, alpha):
    """Largest violation of the optimality conditions on the standardised scale."""
    z = (x - x.mean(0)) / x.std(0)
    eta = np.exp(z @ beta)
    g = np.zeros(x.shape[1])
    for i in np.flatnonzero(e == 1):
        r = t >= t[i]
        g += z[i] - (z[r] * eta[r, None]).sum(0) / eta[r].sum()
    g = g / len(t) - lam * (1 - alpha) * beta
    active = beta != 0
    return max(np.abs(g[active] - lam * alpha * np.sign(beta[active])).max(initial=0),
               (np.abs(g[~active]) - lam * alpha).max(initial=0))


def test_elastic_net_is_optimal(spark):
    pdf, df = vectors(spark)
    x, t, e = np.stack(pdf.features), pdf.time.values, pdf.event.values
    rows = df.select("grp", "sample_id", F.col("time").cast("double"), F.col("event").cast("double"),
                     F.lit(0).alias("inner"), "features")
    with ModelRows(rows, ["time", "event", "inner"]) as r:
        path = coxnet._Path(r, {"all": range(8), "some": [0, 3, 4]}, 0)
        fit = coxnet._fit_path(path, 0.5, 12, 0.01, 6, 1e-9, 50)[0]
    for l in (0, 3, 11):
        assert kkt(x, t, e, fit["all"]["beta"][:, 0, l], fit["all"]["lambda"][l], 0.5) < 1e-5
    some = fit["some"]["beta"][:, 0, 11]
    assert set(np.flatnonzero(some)) <= {0, 3, 4}
    assert kkt(x[:, [0, 3, 4]], t, e, some[[0, 3, 4]], fit["some"]["lambda"][11], 0.5) < 1e-5


def test_paths_in_tasks_are_optimal_at_the_size_of_the_study():
    """Optimality at 732 rows and 171 features, for the whole data and for a fold with its own weights."""
    rng = np.random.default_rng(4)
    n, p = 732, 171
    x = rng.normal(size=(n, p))
    t = np.ceil(rng.exponential(np.exp(-x[:, :5].sum(1) / 2)) * 300)
    e = (rng.random(n) < 0.4).astype(int)
    risk = coxpath.Risk(x, t, e)
    keep = np.ones((n, 2))
    keep[rng.random(n) < 0.1, 1] = 0
    lambdas = np.tile(0.2 * np.logspace(0, -2, 25), (2, 1))
    uses = [np.arange(p), np.arange(0, p, 3)]
    beta, ok = coxpath.solve_path(risk, uses, keep, lambdas, 0.5)
    assert ok.all() and not beta[1][:, 1::3].any()
    for l in (0, 8, 24):
        assert kkt(x, t, e, beta[0, l], lambdas[0, l], 0.5) < 1e-6
        inside = keep[:, 1] > 0
        z, tt, ee, b = risk.z[inside][:, uses[1]], risk.time[inside], risk.event[inside], beta[1, l][uses[1]]
        w = np.exp(z @ b)
        g = sum(z[i] - (z[tt >= tt[i]] * w[tt >= tt[i], None]).sum(0) / w[tt >= tt[i]].sum() for i in np.flatnonzero(ee == 1))
        g = g / inside.sum() - lambdas[1, l] * 0.5 * b
        cut = lambdas[1, l] * 0.5
        assert max(np.abs(g[b != 0] - cut * np.sign(b[b != 0])).max(initial=0), (np.abs(g[b == 0]) - cut).max(initial=0)) < 1e-6


def test_both_routes_end_at_the_same_optimum(spark, monkeypatch):
    _, df = vectors(spark)
    found = []
    for limit in (coxnet.TASK_BYTES, 10):
        monkeypatch.setattr(coxnet, "TASK_BYTES", limit)
        coefs, cv = coxnet.cox_elastic_net(df, {"all": range(8), "some": [0, 3, 4]}, nlambda=10, nfolds=3)
        found.append((coefs.where("lambda_at = 'min'").orderBy("mask", "pos").toPandas(), cv.orderBy("mask", "idx").toPandas()))
    (a, b), (c, d) = found
    np.testing.assert_allclose(b["lambda"], d["lambda"], rtol=1e-9)
    np.testing.assert_allclose(b.cvm, d.cvm, atol=5e-3)
    if (b.loc[b.groupby("mask").cvm.idxmax()].idx.values == d.loc[d.groupby("mask").cvm.idxmax()].idx.values).all():
        np.testing.assert_allclose(a.coef, c.coef, atol=2e-3)


def test_concordance_of_columns_counts_all_pairs():
    rng = np.random.default_rng(0)
    for m in (1, 2, 17, 90):
        t, e, s = rng.integers(1, 9, m), rng.integers(0, 2, m), rng.integers(0, 6, (m, 4)).astype(float)
        i, j = np.nonzero((e[:, None] == 1) & ((t[:, None] < t) | ((t[:, None] == t) & (e == 0))))
        got = coxpath.concordance_columns(t, e, s)
        for c in range(4):
            want = np.mean((s[i, c] > s[j, c]) + 0.5 * (s[i, c] == s[j, c])) if len(i) else np.nan
            assert got[c] == pytest.approx(want, nan_ok=True)


def test_elastic_net_finds_the_signal(spark):
    pdf, df = vectors(spark)
    coefs, cv = coxnet.cox_elastic_net(df, nlambda=15, nfolds=4)
    c = coefs.where("lambda_at = 'min'").toPandas().set_index("pos").coef
    assert c[1] > 0.3 and c[2] < -0.3
    curve = cv.toPandas().sort_values("idx")
    assert curve.cvm.max() > 0.7 and curve.nonzero.iloc[0] == 0
    sparse = coefs.where("lambda_at = '1se' and coef != 0").count()
    assert sparse <= (c != 0).sum()
    scored = coxnet.predict_vectors(df, coefs, "min").toPandas().set_index("sample_id").score
    direct = np.stack(pdf.features) @ c.sort_index().values
    np.testing.assert_allclose(scored.loc[pdf.sample_id].values, direct, atol=1e-9)


def test_elastic_net_does_not_depend_on_partitions(spark):
    _, df = vectors(spark, 60, 4)
    out = []
    for parts in ("3", "40"):  # 40 partitions use the summing tree
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        coefs, _ = coxnet.cox_elastic_net(df, nlambda=6, nfolds=3)
        out.append(coefs.orderBy("lambda_at", "pos").toPandas().coef.values)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    np.testing.assert_allclose(out[0], out[1], atol=1e-8)


@pytest.fixture
def many_ranges(spark):
    """More ranges than any fixed number of buckets, not joined again by adaptive execution."""
    settings = {"spark.sql.shuffle.partitions": "150", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_ranks_over_many_ranges(spark, many_ranges):
    rng = np.random.default_rng(8)
    n = 900
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.8, "hot", "cold"), "score": np.round(rng.standard_normal(n), 2),
                        "time": rng.integers(1, 40, n), "event": rng.integers(0, 2, n), "p": rng.integers(1, 500, n) / 500.0})
    df = spark.createDataFrame(pdf)
    got = {r.g: r for r in V.concordance(df, ["g"]).collect()}
    adjusted = {(r.g, r.p): r.padj for r in bh_adjust(df.select("g", "p"), "p", ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        t, e, s = (part[c].to_numpy() for c in ("time", "event", "score"))
        pair = (e[:, None] == 1) & ((t[None] > t[:, None]) | ((t[None] == t[:, None]) & (e[None] == 0)))
        assert got[g].comparable == pair.sum() and got[g].tied == (pair & (s[:, None] == s[None])).sum()
        assert got[g].concordant == (pair & (s[:, None] > s[None])).sum()
        p = np.sort(part.p.to_numpy())
        raw = np.minimum.accumulate((p * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
        for value, want in zip(p, np.minimum(raw, 1)):
            assert adjusted[g, value] == pytest.approx(want, rel=1e-12)


def test_size_does_not_decide_what_is_found(spark, monkeypatch):
    """A model whose rows are spread ends where a task ends, and its curvature may take several scans."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 6))
    t = np.ceil(rng.exponential(np.exp(-3 * x[:, 0] - x[:, 1])) * 60)  # strong effects: most of the deviance is explained
    rows = [("g", f"s{i:03d}", float(t[i]), int(i % 5 > 0), [float(v) for v in x[i]]) for i in range(90)]
    df = spark.createDataFrame(rows, "grp string, sample_id string, time double, event int, features array<double>")
    found = []
    for limit in (coxnet.TASK_BYTES, 10):
        monkeypatch.setattr(coxnet, "TASK_BYTES", limit)
        monkeypatch.setattr(coxnet, "HESSIAN_BUDGET", 1000)
        coefs, cv = coxnet.cox_elastic_net(df, {"all": range(6), "some": [1, 2, 5]}, nlambda=4, lambda_min_ratio=1e-2, nfolds=2)
        found.append((coefs.orderBy("lambda_at", "mask", "pos").toPandas(), cv.orderBy("mask", "idx").toPandas()))
    (a, b), (c, d) = found
    assert b.converged.all() and d.converged.all()
    for x, y in ((b, d), (a, c)):
        assert (x.dtypes == y.dtypes).all()
        for name in x.columns:
            if x[name].dtype == float:
                np.testing.assert_allclose(x[name], y[name], atol=2e-5)
            else:
                assert (x[name] == y[name]).all()
