import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazardlake.operators import cluster as K
from hazardlake.operators import layout as L
from hazardlake.operators import nbwald as W
from hazardlake.operators import reduce as R
from hazardlake.operators import sampling as E
from hazardlake.plans import experiment as P
from hazardlake.plans import subtypes as B


def frame(spark, x, grp="a", **more):
    pdf = pd.DataFrame({"grp": grp, "sample_id": [f"s{i:03d}" for i in range(len(x))], "features": x.tolist(), **more})
    return spark.createDataFrame(pdf)


def block(n=60, p=6, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, p)) * np.geomspace(8, 0.5, p) + 3


def test_pca(spark):
    """The same as an SVD of the centred block; wide and flat blocks are in test_edge_cases."""
    x, y = block(), block(40, 9, 1)
    both = frame(spark, x).unionByName(frame(spark, y, "b"))
    fit = R.pca_fit(both, {"a": 3, "b": 2})
    for name, z, k in (("a", x, 3), ("b", y, 2)):
        z = z - z.mean(0)
        _, s, vt = np.linalg.svd(z, full_matrices=False)
        np.testing.assert_allclose(fit[name]["var"], (s ** 2 / (len(z) - 1))[:k], rtol=1e-6)
        np.testing.assert_allclose(np.abs(fit[name]["load"].T @ vt[:k].T), np.eye(k), atol=1e-5)
    got = R.pca_project(both, fit).where("grp = 'a'").toPandas().set_index("sample_id").sort_index()
    want = (x - x.mean(0)) @ fit["a"]["load"]
    np.testing.assert_allclose(np.stack(got.features), want, atol=1e-9)


@pytest.mark.parametrize("activation", ["sigmoid", "tanh", "relu"])
def test_autoencoder_gradient(activation):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(7, 5)), rng.normal(size=(7, 5))
    w = {"w1": rng.normal(size=(5, 3)), "b1": rng.normal(size=3), "w2": rng.normal(size=(3, 5)), "b2": rng.normal(size=5)}
    _, grad = R.dae_loss_gradient(w, x, y, activation)
    for name in w:
        for at in np.ndindex(w[name].shape):
            old, h = w[name][at], 1e-6
            w[name][at] = old + h
            up, _ = R.dae_loss_gradient(w, x, y, activation)
            w[name][at] = old - h
            down, _ = R.dae_loss_gradient(w, x, y, activation)
            w[name][at] = old
            assert grad[name][at] == pytest.approx((up - down) / (2 * h), rel=1e-4, abs=1e-5)


def test_autoencoder_learns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 2)) @ rng.normal(size=(2, 6))
    df = frame(spark, x, target=x.tolist())
    few, many = R.dae_fit(df, 3, "tanh", epochs=2), R.dae_fit(df, 3, "tanh", epochs=60, learning_rate=0.05)
    assert R.dae_weights(many, "a")["loss"][1] < 0.6 * R.dae_weights(few, "a")["loss"][1]
    code = R.dae_encode(df, many).first().features
    assert len(code) == 3 and max(map(abs, code)) <= 1
    mse = R.dae_loss(df, many).first().mse
    m = R.dae_weights(many, "a")
    rebuilt = np.tanh(x @ m["w1"] + m["b1"]) @ m["w2"] + m["b2"]
    assert mse == pytest.approx(((rebuilt - x) ** 2).mean())


def test_autoencoder_in_shards(spark, monkeypatch):
    """Averaged shards reach the held-out loss of one task within 5 %; weights in several segments."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 3)) @ rng.normal(size=(3, 12)) + 0.1 * rng.normal(size=(600, 12))
    df = frame(spark, x + 0.3 * rng.normal(size=x.shape), target=x.tolist())
    options = dict(k=5, activation="tanh", epochs=25, learning_rate=0.01, min_delta=0.0)
    one = R.dae_weights(R.dae_fit(df, **options), "a")["loss"][1]
    monkeypatch.setattr(R, "SHARD_BYTES", 600 * 12 * 16 // 3)
    monkeypatch.setattr(R, "SEGMENT", 50)
    monkeypatch.setattr(R, "FAN", 2)
    fit = R.dae_fit(df, **options)
    assert fit.count() > 1
    assert R.dae_weights(fit, "a")["loss"][1] < 1.05 * one
    code = R.dae_encode(df, fit).toPandas()
    m = R.dae_weights(fit, "a")
    got = {s: c for s, c in zip(code.sample_id, code.features)}
    rows = df.toPandas()
    for s, f in zip(rows.sample_id[:20], rows.features[:20]):
        np.testing.assert_allclose(got[s], np.tanh(np.array(f) @ m["w1"] + m["b1"]), atol=1e-9)


def test_autoencoder_equals_a_plain_loop(spark):
    """One shard is mini-batch Adam as a plain loop over the same batches has it."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 4))
    df = frame(spark, x, target=x.tolist())
    got = R.dae_weights(R.dae_fit(df, 2, "tanh", epochs=3, validation=0.0, min_delta=-1e9, batch=8), "a")
    order = df.toPandas().sort_values("sample_id")
    x = np.stack(order.features)
    t = R._Trainer("a", 4, 2, "tanh", 0.001, 8, 5)
    w = {k: v.copy() for k, v in R._unpack(t.start(), 4, 2).items()}
    m, v, step = {k: 0 * a for k, a in w.items()}, {k: 0 * a for k, a in w.items()}, 0
    for number in range(3):
        perm = R._seed("batches", 5, "a", 0, number).permutation(50)
        for i in range(0, 50, 8):
            _, g = R.dae_loss_gradient(w, x[perm[i:i + 8]], x[perm[i:i + 8]], "tanh")
            step += 1
            for k in w:
                d = g[k] / (len(perm[i:i + 8]) * 4)
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                w[k] = w[k] - 0.001 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-7)
    for k in w:
        np.testing.assert_allclose(got[k], w[k], atol=1e-10)


def test_kmeans_and_best_k(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(30, 3)) * 0.2 + c for c in ([0, 0, 0], [5, 5, 0])])
    df = frame(spark, x)
    fits = K.kmeans(df, range(1, 5), restarts=4)
    np.testing.assert_allclose(fits[1]["centers"][0], x.mean(0), atol=1e-9)
    assert fits[1]["cost"] == pytest.approx(((x - x.mean(0)) ** 2).sum())
    assert [fits[k]["cost"] for k in (1, 2, 3, 4)] == sorted((fits[k]["cost"] for k in (1, 2, 3, 4)), reverse=True)
    best = K.best_k(df, fits).where("best = 1").collect()
    assert [r.k for r in best] == [2]
    lab = K.assign(df, {2: fits[2]}).toPandas().sort_values("sample_id").cluster.values
    assert len(set(lab[:30])) == len(set(lab[30:])) == 1 and lab[0] != lab[-1]


def test_silhouette(spark):
    x, lab = block(25, 3), np.arange(25) % 3
    lab[0] = 7  # a cluster of one row
    got = K.silhouette(frame(spark, x, cluster=lab.tolist())).toPandas().sort_values("sample_id").silhouette.values
    d = ((x[:, None] - x) ** 2).sum(-1)
    for i in range(25):
        same = (lab == lab[i]) & (np.arange(25) != i)
        if not same.any():
            assert got[i] == 0
            continue
        a = d[i, same].mean()
        b = min(d[i, lab == c].mean() for c in set(lab) - {lab[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b))


def nb_loglik(k, mu, a):
    r = 1 / a
    lg = np.vectorize(math.lgamma)
    return (lg(k + r) - lg(r) - (k + r) * np.log1p(a * mu) + k * np.log(a * mu)).sum()


def nb_counts(spark, genes=12, n=40, seed=5):
    rng = np.random.default_rng(seed)
    bad = np.arange(n) % 2
    rows, raw = [], {}
    for g in range(genes):
        mean = 40 * (g + 1) * np.where((bad == 1) & (g == 0), 4.0, 1.0)
        k = rng.negative_binomial(5, 5 / (5 + mean))
        raw[f"g{g:02d}"] = k
        rows += [(f"s{i:02d}", f"g{g:02d}", int(v)) for i, v in enumerate(k)]
    counts = spark.createDataFrame(rows, "sample_id string, feature_id string, value long")
    groups = spark.createDataFrame([(f"s{i:02d}", "BadPrognosis" if b else "GoodPrognosis") for i, b in enumerate(bad)],
                                   "sample_id string, grp string")
    return counts, groups, raw, bad


def test_nb_dispersion_maximises_the_likelihood(spark):
    """Gene-wise dispersions against a fine direct grid of the adjusted likelihood."""
    counts, groups, raw, bad = nb_counts(spark, 3)
    ones = counts.select("sample_id").distinct().withColumn("size_factor", F.lit(1.0))
    base = counts.join(groups, "sample_id").join(ones, "sample_id").select(
        "feature_id", (F.col("grp") == "BadPrognosis").cast("int").alias("bad"),
        F.col("value").cast("double").alias("k"), F.col("size_factor").alias("s"))
    q = base.groupBy("feature_id", "bad").agg(F.avg("k").alias("q")).withColumn("lo", F.lit(-5.0)).withColumn("hi", F.lit(2.0))
    got = W._peak(W._profile(base, q, "lo", "hi"), "x").toPandas().set_index("feature_id").x
    for g, k in raw.items():
        mu = np.where(bad == 1, k[bad == 1].mean(), k[bad == 0].mean())
        grid = np.linspace(-5, 2, 2001)
        adj = [nb_loglik(k, mu, math.exp(a)) - 0.5 * sum(
            math.log((mu[bad == b] / (1 + math.exp(a) * mu[bad == b])).sum()) for b in (0, 1)) for a in grid]
        assert got[g] == pytest.approx(grid[int(np.argmax(adj))], abs=0.05)


def test_nb_wald(spark):
    counts, groups, _, _ = nb_counts(spark)
    out = B.differential_expression(counts, groups).toPandas().set_index("feature_id")
    assert len(out) == 12 and out.loc["g00", "diffexpressed"] == "UP" and out.loc["g00", "delabel"] == "g00"
    assert out.loc["g00", "log2_fold_change"] == pytest.approx(2.0, abs=0.7)
    assert (out.drop("g00").padj > 0.01).all()
    assert 0.05 < out.dispersion.median() < 0.6
    np.testing.assert_allclose(out.p, [math.erfc(abs(s) / math.sqrt(2)) for s in out.stat], rtol=1e-9)


def study(spark, n=90):
    rng = np.random.default_rng(6)
    a = rng.normal(size=n)
    rows = []
    for m, p in (("o1", 6), ("o2", 4)):
        x = rng.normal(size=(n, p))
        x[:, 0] += a
        rows += [(m, f"s{i:03d}", f"{m}f{j}", float(x[i, j])) for i in range(n) for j in range(p)]
    clin = [("cl", f"s{i:03d}", f, None if i % 7 == 0 and f == "age" else float(v))
            for i in range(n) for f, v in (("age", 50 + i % 13), ("sex", i % 2))]
    t = np.ceil(rng.exponential(np.exp(-a)) * 100).astype(int) + 1
    cohort = [(f"s{i:03d}", int(t[i]), int(i % 4 > 0), "LUSC" if i % 2 else "LUAD") for i in range(n)]
    long = "modality string, sample_id string, feature_id string, value double"
    return (spark.createDataFrame(rows, long), spark.createDataFrame(clin, long),
            spark.createDataFrame(cohort, "sample_id string, time int, event int, subtype string"))


@pytest.mark.parametrize("method", ["screen", "pca", "screen+dae", "dae"])
def test_experiment(spark, method):
    long, clin, cohort = study(spark)
    names = {"o1": "Gene", "o2": "LNC", "cl": "Clin"}
    out = P.run_experiment(long, clin, cohort, names, method=method, k=2, screen_sizes={"o1": 4, "o2": 3},
                           reduced_sizes={"o1": 2, "o2": 2}, early_size=3, nlambda=6, inner_folds=3, epochs=3,
                           combos=False)
    r = out["results"].toPandas()
    assert set(r.fold) == {1, 2} and len(r) == 2 * 5
    assert set(r.integration) == {"single", "late", "early"}
    assert set(r.data_types) == {"Gene Expression", "LNC RNAs", "Clinical", "Multimodal (Late)", "Multimodal (Early)"}
    assert r.cindex.between(0, 1).all()
    if method == "screen":
        assert r[r.integration == "late"].cindex.mean() > 0.55
    assert (out["loss"] is not None) == method.endswith("dae")


def test_late_masks():
    width = {(1, m): w for m, w in (("l", 3), ("i", 2), ("g", 4), ("m", 5), ("c", 2))}
    names = {"l": "LNC", "i": "miRNA", "g": "Gene", "m": "Meth", "c": "Clin"}
    masks = P._late_masks(width, names, 1, True)
    assert len(masks) == 5 + 1 + 21
    assert sorted(masks["Meth-Clin-LNC"] if "Meth-Clin-LNC" in masks else masks["Meth-LNC-Clin"]) == [
        0, 1, 2, 9, 10, 11, 12, 13, 14, 15]


def test_pca_plot_table(spark):
    long, _, cohort = study(spark)
    late = cohort.withColumn("time", F.col("time") * 20)
    out = P.pca_plot_table(long, late).toPandas()
    assert set(out.modality) == {"o1", "o2"} and out.group_label.str.contains(" - ").all()
    assert out.groupby("modality").pc1.mean().abs().max() < 1e-9


def test_survival_subtypes(spark):
    long, _, cohort = study(spark)
    rows = long.where("modality = 'o1'")
    v = L.assemble(rows, L.feature_dictionary(rows))
    out = B.survival_subtypes(v, cohort, ks=range(1, 4), choose_restarts=2, restarts=2)
    labels = out["labels"].toPandas()
    assert len(labels) == 90 and set(labels.prognosis) == {"GoodPrognosis", "BadPrognosis"}
    assert out["crosstab"].agg(F.sum("n")).first()[0] == 90 and out["logrank"].first().chi2 >= 0


def test_clustering_matrix(spark):
    df = frame(spark, block(5, 3))
    coefs = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 0.5), ("a", 3, -1.0)], "grp string, pos int, coef double")
    row = K.clustering_matrix(df, coefs).orderBy("sample_id").first()
    np.testing.assert_allclose(row.features, block(5, 3)[0, 1:])


def test_results_independent_of_partitions(spark):
    """Folds, corruption and clustering are the same under another shuffle width."""
    long, _, cohort = study(spark)
    seen = []
    for parts in ("2", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        folds = E.stratified_folds(cohort, ["subtype"], 3).orderBy("sample_id").toPandas().fold.tolist()
        noise = E.corrupt_zeros(long).orderBy("feature_id", "sample_id").toPandas().value.tolist()
        cost = K.kmeans(frame(spark, block()), [3], restarts=3)[3]["cost"]
        seen.append((folds, noise, round(cost, 6)))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1]


def test_experiment_with_few_screened_features(spark):
    """A strict screen leaves other numbers of features in every fold."""
    long, clin, cohort = study(spark)
    names = {"o1": "Gene", "o2": "LNC", "cl": "Clin"}
    out = P.run_experiment(long, clin, cohort, names, method="screen", k=3, screen_sizes={"o1": 6, "o2": 4},
                           reduced_sizes={"o1": 6, "o2": 4}, early_size=9, nlambda=4, inner_folds=2, combos=False)
    widths = out["vectors"].groupBy("cv").agg(F.max(F.size("features")).alias("p")).toPandas().p
    assert widths.max() <= 12 and len(out["results"].collect()) == 3 * 5


STUDIES = {"late_integration", "early_integration", "variant_screen_only", "variant_pca", "variant_autoencoder",
           "autoencoder_loss", "train_one_subtype", "feature_importance", "subtypes_on_selected"}


def test_registered_studies_are_whole(spark, monkeypatch):
    """All penalties and inner folds, all combinations that the query returns, all numbers of clusters."""
    import inspect

    from hazardlake.plans import queries, subtypes
    study, clusters = inspect.signature(P.run_experiment), inspect.signature(subtypes.survival_subtypes)
    seen = {}

    class Called(Exception):
        pass

    def run(*args, **options):
        bound = study.bind(*args, **options)
        bound.apply_defaults()
        seen[name] = bound.arguments
        if name != "subtypes_on_selected":
            raise Called
        rows = spark.createDataFrame([], "grp string, sample_id string, features array<double>, mask string, lambda_at string")
        return {"vectors": rows, "coefs": rows}

    def cluster(*args, **options):
        bound = clusters.bind(*args, **options)
        bound.apply_defaults()
        seen["ks"] = list(bound.arguments["ks"])
        raise Called

    monkeypatch.setattr(queries.P, "run_experiment", run)
    monkeypatch.setattr(queries.B, "survival_subtypes", cluster)
    monkeypatch.setattr(queries, "cut_lineage", lambda df: df)
    for name in STUDIES:
        with pytest.raises(Called):
            queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert {(x["nlambda"], x["inner_folds"], x["k"], x["epochs"]) for n, x in seen.items() if n != "ks"} == {(100, 10, 5, 100)}
    one = {"autoencoder_loss", "feature_importance", "subtypes_on_selected"}  # tables without other combinations
    assert {n for n, x in seen.items() if n != "ks" and not x["combos"]} == one
    assert seen["ks"] == list(range(1, 11))


def test_nb_wald_gathers_no_samples(spark, monkeypatch):
    """Samples stay spread, absent cells count 0, and the numbers are those of the whole matrix."""
    counts, groups, _, _ = nb_counts(spark)
    plans, cut = [], W.cut_lineage
    monkeypatch.setattr(W, "cut_lineage", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df))[1])
    zeros = counts.withColumn("value", F.when(F.hash("sample_id", "feature_id") % 3 == 0, 0).otherwise(F.col("value")))
    zeros = zeros.withColumn("value", F.when(F.col("feature_id") == "g01", F.col("value") + 1).otherwise(F.col("value")))  # in all samples
    factors = groups.select("sample_id", (1 + F.pmod(F.hash("sample_id"), F.lit(5)) / 10).alias("size_factor"))
    whole, sparse = (W.nb_wald(df, groups, factors).toPandas().set_index("feature_id").sort_index()
                     for df in (zeros, zeros.where("value > 0")))
    assert len(whole) == 12
    pd.testing.assert_frame_equal(whole, sparse, rtol=1e-9)
    assert not any("size_factor" in line and "collect_list" in line for p in plans for line in p.splitlines())
    assert not any("scalar-subquery" in p for p in plans)
