import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazardlake import schema
from hazardlake.functions import pvalues
from hazardlake.functions import scalar as S
from hazardlake.operators import clean as C
from hazardlake.operators import diff as D
from hazardlake.operators import layout as L
from hazardlake.operators import quality as Q
from hazardlake.operators import report as T
from hazardlake.operators import sampling as E
from hazardlake.plans import cohort as P
from hazardlake.sources import tables


def long(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, feature_id string, value double")


def test_sentinels_and_rare(spark):
    df = spark.createDataFrame([("NX",), ("N0",), ("N0",), ("N3",), (None,)], "n string")
    out = C.null_rare(C.null_sentinels(df, {"n": ["NX"]}), "n", 2)
    assert sorted((r.n or "") for r in out.collect()) == ["", "", "", "N0", "N0"]


def test_label_encode(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("B",)], "x string")
    assert [r.x for r in C.label_encode(df, ["x"]).collect()] == [3, 2, None, 3, 1]


def test_five_year_rule(spark):
    rows = [("a", 1824, 1), ("b", 1825, 1), ("c", 1825, 0), ("d", 1826, 1), ("e", 1000, 0)]
    df = spark.createDataFrame([(*r, "LUSC") for r in rows], "sample_id string, time int, event int, subtype string")
    assert {r.sample_id: r.group_label for r in C.five_year_groups(df).collect()} == {
        "a": "LUSC - Dead", "d": "LUSC - Alive"}


def test_zero_filter_threshold(spark):
    rows = [(f"s{i}", "two", 0.0 if i < 2 else 1.0) for i in range(10)]
    rows += [(f"s{i}", "one", 0.0 if i < 1 else 1.0) for i in range(10)]
    rows += [(f"s{i}", "gap", None if i < 1 else 1.0) for i in range(10)]
    out = Q.filter_zero_fraction(long(spark, rows), 10, 0.2, by=())
    assert {r.feature_id for r in out.collect()} == {"one"}


def test_missing_sample_filter(spark):
    rows = [("a", f"f{i}", None if i < 1 else 1.0) for i in range(5)]
    rows += [("b", f"f{i}", 1.0) for i in range(5)]
    assert {r.sample_id for r in Q.filter_missing_samples(long(spark, rows)).collect()} == {"b"}


def test_constant_feature_has_null_zscore(spark):
    out = Q.zscore(long(spark, [("a", "f", 2.0), ("b", "f", 2.0)]), by=())
    assert [r.value for r in out.collect()] == [None, None]


def test_beta_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "value double")
    assert [r.m for r in df.select(S.beta_to_m().alias("m")).collect()] == [None, 0.0, None, None]


def test_split_and_strip(spark):
    df = spark.createDataFrame([("a_b_c_d_e_f_g", "A;B;C"), ("a_b", "A")], "x string, y string")
    got = df.select(S.nth_part("x", "_", 6).alias("p"), S.first_of_list("y").alias("g")).collect()
    assert [(r.p, r.g) for r in got] == [("f_g", "A"), ("", "A")]


@pytest.mark.parametrize("probes", [Q.PROBES, (0.0, 1.0), (0.9, 0.99)])
def test_quantiles_in_rounds_do_not_depend_on_the_sketch(spark, probes):
    """Cuts that never help, ties, one value, a NULL group: brackets of at most 40 rows, several rounds."""
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=700), "b": rng.integers(0, 4, 500) * 1.0, "c": np.zeros(90), None: np.append(np.full(300, 2.0), 5.0),
              "e": np.array([1.0, 9.0]), "f": np.exp(rng.normal(size=400) * 9)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("z", None)], "g string, v double")
    for q in (0.73,):
        got = {r.g: r.x for r in Q.group_quantile(df, ["g"], "v", q, "x", probes, 40).collect()}
        assert got == {g: pytest.approx(np.quantile(vs, q), rel=1e-12) for g, vs in groups.items()}


@pytest.mark.parametrize("q,n", [(0.5, 7), (0.5, 10_001), (0.25, 4000), (0.9, 333)])
def test_group_quantile_is_exact(spark, q, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, n), "v": np.round(rng.normal(size=n), 2)})
    got = Q.group_quantile(spark.createDataFrame(pdf), ["g"], "v", q, "x").toPandas().set_index("g").x
    for g, want in pdf.groupby("g").v.quantile(q).items():
        assert got[g] == pytest.approx(want, abs=1e-12)


def test_median_imputation(spark):
    rows = [("a", "f", 1.0), ("b", "f", 2.0), ("c", "f", None), ("d", "f", 4.0), ("e", "f", 9.0)]
    out = {r.sample_id: r.value for r in Q.impute_median(long(spark, rows), by=()).collect()}
    assert out["c"] == 3.0 and out["a"] == 1.0


@pytest.mark.parametrize("parts", ["1", "8"])
def test_fold_sizes(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rows = [(f"a{i}", "LUAD") for i in range(408)] + [(f"b{i}", "LUSC") for i in range(324)]
    df = spark.createDataFrame(rows, "sample_id string, subtype string")
    folds = E.stratified_folds(df, ["subtype"], 5).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    sizes = folds.groupby(["subtype", "fold"]).size()
    assert set(sizes["LUAD"]) == {81, 82} and set(sizes["LUSC"]) == {64, 65}
    assert len(sizes) == 10 and folds.sample_id.nunique() == 732


def test_folds_with_few_samples(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "sample_id string, subtype string")
    assert sorted(r.fold for r in E.stratified_folds(df, ["subtype"], 5).collect()) == [1, 2, 3]


def test_roles(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "sample_id string, fold int, subtype string")
    rows = {(r.sample_id, r.cv, r.role) for r in E.with_roles(df, 2, F.col("subtype") == "x").collect()}
    assert rows == {("a", 1, "test"), ("a", 2, "train"), ("b", 2, "test")}


def test_corruption_count(spark):
    rows = [(f"s{i}", f, i + 1.0) for i in range(37) for f in ("x", "y")]
    out = E.corrupt_zeros(long(spark, rows), 0.3, 5, by=()).toPandas()
    assert (out[out.value == 0].groupby("feature_id").size() == 11).all()
    kept = out[out.value != 0]
    assert (kept.value == kept.sample_id.str[1:].astype(int) + 1).all()


def test_gaussian_corruption(spark):
    df = long(spark, [(f"s{i}", "f", 0.0) for i in range(4000)])
    v = E.corrupt_gaussian(df, 0.5, by=()).toPandas().value
    assert abs(v.mean()) < 0.03 and v.std() == pytest.approx(0.5, abs=0.03)


def test_combination_grids():
    late, early = E.late_combos(), E.early_combos()
    assert len(late) == 21 and len(early) == 26
    assert ["Meth", "Clin"] in early and ["Meth", "Clin"] not in late and ["Meth"] not in early


def test_first_per_key_ties_are_fixed(spark):
    rows = [("k", 1, "b"), ("k", 1, "a"), ("k", 2, "0"), ("l", 5, None)]
    out = C.first_per_key(spark.createDataFrame(rows, "k string, o int, v string"), ["k"], ["o"])
    assert {(r.k, r.o, r.v) for r in out.collect()} == {("k", 1, "a"), ("l", 5, None)}


def test_assemble_fills_gaps(spark):
    rows = spark.createDataFrame([("m", "a", "f1", 1.0), ("m", "a", "f2", 2.0), ("m", "b", "f2", 3.0)],
                                 "modality string, sample_id string, feature_id string, value double")
    out = L.assemble(rows, L.feature_dictionary(rows)).collect()
    assert {r.sample_id: r.features for r in out} == {"a": [1.0, 2.0], "b": [None, 3.0]}


def test_concat_vectors_is_inner(spark):
    rows = [("x", "a", [1.0]), ("y", "a", [2.0, 3.0]), ("x", "b", [9.0])]
    df = spark.createDataFrame(rows, "modality string, sample_id string, features array<double>")
    assert [tuple(r) for r in L.concat_vectors(df, ["y", "x"]).collect()] == [("a", [2.0, 3.0, 1.0])]


def bh(p):
    p = np.asarray(p)
    order = np.argsort(-p)
    adj = np.minimum.accumulate(p[order] * len(p) / np.arange(len(p), 0, -1))
    out = np.empty(len(p))
    out[order] = np.minimum(adj, 1)
    return out


@pytest.mark.parametrize("n", [1, 5, 3000])
def test_bh(spark, n):
    p = np.round(np.random.default_rng(n).uniform(size=n) ** 2, 3)
    df = spark.createDataFrame(pd.DataFrame({"i": range(n), "p": p})).unionByName(
        spark.createDataFrame([(-1, None)], "i long, p double"))
    got = D.bh_adjust(df, "p").toPandas().sort_values("i").padj.values
    assert np.isnan(got[0])
    np.testing.assert_allclose(got[1:], bh(p), atol=1e-12)


def test_size_factors(spark):
    counts = {"a": [10, 20, 30], "b": [20, 40, 60], "c": [5, 10, 15]}
    rows = [(s, f"g{i}", float(v)) for s, vs in counts.items() for i, v in enumerate(vs)]
    rows += [("a", "zero", 0.0), ("b", "zero", 9.0), ("c", "zero", 9.0)]
    got = {r.sample_id: r.size_factor for r in D.size_factors(long(spark, rows)).collect()}
    assert got["b"] / got["a"] == pytest.approx(2) and got["c"] / got["a"] == pytest.approx(0.5)


def _exact_beta(a, b, x):
    """Incomplete beta of whole a and b: a binomial tail in fractions."""
    n = a + b - 1
    return float(sum(math.comb(n, j) * x ** j * (1 - x) ** (n - j) for j in range(a, n + 1)))


def test_normal_and_chi2_tails(spark):
    zs = [0.0, 1e-9, 0.1, 1.0, 1.999, 2.0, 2.5, 5.0, 15.0, 26.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(
        "z", pvalues.normal_two_sided(-F.col("z")).alias("n"), pvalues.chi2_sf("z").alias("c"), pvalues.chi2_sf("z", F.lit(4)).alias("four"),
        pvalues.chi2_sf("z", F.lit(5)).alias("five"))
    for r in got.collect():
        y = r.z / 2
        one = math.erfc(math.sqrt(y))
        assert r.n == pytest.approx(math.erfc(r.z / math.sqrt(2)), rel=1e-12) and r.c == pytest.approx(one, rel=1e-12)
        assert r.four == pytest.approx(math.exp(-y) * (1 + y), rel=1e-12)
        assert r.five == pytest.approx(one + math.exp(-y) * math.sqrt(y / math.pi) * (2 + 4 * y / 3), rel=1e-12)
    odd = spark.createDataFrame([(None, 1), (1.0, None), (1.0, 0), (-1.0, 3)], "x double, k int")
    assert [r.p for r in odd.select(pvalues.chi2_sf("x", "k").alias("p")).collect()] == [None, None, None, 1.0]


def test_f_tails(spark):
    rows = [(f, d1, d2) for f in (0.25, 1.0, 1.5, 4.0, 20.0) for d1 in (2, 4, 10, 60) for d2 in (2, 10, 100, 600)]
    for r in spark.createDataFrame(rows, "f double, a long, b long").select("*", pvalues.f_sf("f", "a", "b").alias("p")).collect():
        want = _exact_beta(r.b // 2, r.a // 2, Fraction(r.b) / (r.b + r.a * Fraction(r.f)))
        assert r.p == pytest.approx(want, rel=1e-11)
    # Two degrees above many: (1 + 2 f / d)^(-d / 2); one above one: an arc tangent.
    rows = [(f, d) for f in (0.01, 1.0, 5.0, 50.0) for d in (10 ** 3, 10 ** 5, 10 ** 7)]
    for r in spark.createDataFrame(rows, "f double, d long").select(
            "*", pvalues.f_sf("f", F.lit(2), "d").alias("p"), pvalues.f_sf("f", F.lit(1), F.lit(1)).alias("q")).collect():
        assert r.p == pytest.approx(math.exp(-r.d / 2 * math.log1p(2 * r.f / r.d)), rel=1e-9)
        assert r.q == pytest.approx(2 / math.pi * math.atan(1 / math.sqrt(r.f)), rel=1e-12)
    odd = spark.createDataFrame([(None, 1, 1), (1.0, 1, 0), (0.0, 2, 5)], "f double, a long, b long")
    assert [r.p for r in odd.select(pvalues.f_sf("f", "a", "b").alias("p")).collect()] == [None, None, 1.0]


def test_screens_start_no_python_worker(spark):
    df = spark.createDataFrame([(1.0, 2, 9)], "f double, a long, b long").select(
        pvalues.f_sf("f", "a", "b"), pvalues.chi2_sf("f", "a"), pvalues.normal_two_sided("f"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_ln_gamma(spark):
    import math
    xs = [0.01, 0.5, 1.0, 3.3, 50.0, 1e4, 1e8]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(F.expr(S.ln_gamma("x")).alias("g")).collect()
    for x, r in zip(xs, got):
        assert r.g == pytest.approx(math.lgamma(x), rel=1e-9, abs=1e-8)


def test_canonical_names(spark):
    names = ["Meth-Clin-LNC", "Gene-LNC-Clin-miRNA", "Clinical", "Multimodal", "LNC RNAs"]
    df = spark.createDataFrame([(n,) for n in names], "data_types string")
    assert [r[0] for r in df.select(T.canonical_combo()).collect()] == [
        "Meth-LNC-Clin", "Gene-LNC-miRNA-Clin", "Clinical", "Meth-Gene-LNC-miRNA-Clin", "LNC RNAs"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a;b", 1.5), ("c,d", None)], "k string, v double")
    tables.write_results(df, str(tmp_path / "out"))
    back = tables.read_csv(spark, str(tmp_path / "out"), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with open(tmp_path / "x.tsv", "w") as f:
        f.write("id\tvalue\nx\t1.0\ny\tNaN\n")
    got = tables.read_tsv(spark, str(tmp_path / "x.tsv"), "id string, value double").collect()
    assert [(r.id, r.value) for r in got] == [("x", 1.0), ("y", None)]


def test_stage(spark, tmp_path):
    df = spark.createDataFrame([("a", "m1", 1.0), ("b", "m2", 2.0)], "sample_id string, modality string, value double")
    back = tables.stage(df, str(tmp_path / "t"), ["modality"])
    assert back.columns == df.columns and back.where("modality = 'm1'").count() == 1


def test_build_cohort(spark):
    base = dict(patient="p", sample_type="TP", subtype="Lung", stage="I", t="T1", n="N0", m="M0",
                prior_malignancy="no", synchronous_malignancy="No", gender="f", age_at_index=60,
                pack_years_smoked=1.0, dim_short=1.0, dim_mid=2.0, dim_long=3.0, days_to_death=None,
                days_to_last_follow_up=100, vital_status="Alive")
    rows = [dict(base, sample_id="S-000000000000000-A-02", days_to_death=50, vital_status="Dead", gender="m"),
            dict(base, sample_id="S-000000000000000-A-01", days_to_death=40, vital_status="Dead", t="TX"),
            dict(base, sample_id="S-111111111111111-A-01", days_to_last_follow_up=1),
            dict(base, sample_id="S-222222222222222-A-01", sample_type="NT"),
            dict(base, sample_id="S-333333333333333-A-01", dim_mid=None)]
    clinical = spark.createDataFrame([[r[f.name] for f in schema.CLINICAL] for r in rows], schema.CLINICAL)
    ids = sorted({r["sample_id"][:19] for r in rows})
    eligible = spark.createDataFrame([(i, "LUSC") for i in ids], "sample_id string, subtype string")
    out = {r.sample_id: r for r in C.build_cohort(clinical, eligible).collect()}
    assert set(out) == {ids[0], ids[3]}
    first = out[ids[0]]
    assert (first.time, first.event, first.t, first.volume, first.gender) == (40, 1, None, 6.0, 1)
    assert out[ids[3]].volume is None and out[ids[3]].time == 100


def test_methylation_plan(spark):
    rows = [(f"s{i}-{sp}", f, 0.1 * i + (0.3 if sp == "B" else 0.0) + k) for i in range(6) for sp in "AB"
            for k, f in enumerate(("cg1", "cg2", "rs1", "cg3"))]
    rows = [(s, f, None if f == "cg2" and s < "s3" else v) for s, f, v in rows]
    ids = spark.createDataFrame([(f"s{i}",) for i in range(6)], "sample_id string")
    annot = spark.createDataFrame([("cg1", "Island"), ("cg2", "Island"), ("cg3", "Shore")],
                                  "probe_id string, island_relation string")
    raw = long(spark, rows).withColumn("sample_id", F.concat("sample_id", F.lit("x")))
    raw = raw.withColumn("sample_id", F.regexp_replace("sample_id", "x$", ""))
    out = P.methylation(raw.withColumn("sample_id", F.rpad("sample_id", 20, "0")),
                        ids.withColumn("sample_id", F.rpad(F.concat("sample_id", F.lit("-A")), 19, "0")),
                        ids.withColumn("sample_id", F.rpad(F.concat("sample_id", F.lit("-A")), 19, "0")), annot)
    assert {r.feature_id for r in out.collect()} == {"cg1"} and out.count() == 6


def test_expression_plan(spark):
    rows = [(f"s{i}", f, 0.0 if f == "E2" and i < 4 else 1.0 + i) for i in range(5) for f in ("E1", "E2", "L1")]
    ids = spark.createDataFrame([(f"s{i}",) for i in range(5)], "sample_id string")
    lnc = spark.createDataFrame([("L1",), ("L1",), ("L9",)], "feature_id string")
    raw = long(spark, rows)
    assert {r.feature_id for r in P.expression(raw, ids, ids, "lncRNA", lnc).collect()} == {"L1"}
    assert {r.feature_id for r in P.expression(raw, ids, ids, "mRNA", lnc, keep_list=False).collect()} == {"E1"}


def test_finished_stage(spark, tmp_path):
    """Read again while inputs and settings stay; made anew if either changes or the write was cut off."""
    source, folder, made = tmp_path / "in.parquet", tmp_path / "stages", []
    spark.range(5).write.parquet(str(source))

    def run(k):
        def build():
            made.append(k)
            return spark.read.parquet(str(source)).withColumn("k", F.lit(k))
        return {tuple(r) for r in tables.finished_stage(spark, str(folder), "s", [str(source)], {"k": k}, build).collect()}

    assert run(1) == run(1) == {(i, 1) for i in range(5)} and made == [1]
    assert run(2) == {(i, 2) for i in range(5)} and made == [1, 2]
    left, = (folder / "s").iterdir()  # the version of other settings is gone
    (left / "_SUCCESS").unlink()
    assert run(2) == {(i, 2) for i in range(5)} and made == [1, 2, 2]
    spark.range(7).write.mode("overwrite").parquet(str(source))
    assert len(run(2)) == 7 and made == [1, 2, 2, 2]


def test_text_keeps_nulls_and_quotes(spark, tmp_path):
    rows = [("a,b", 1.5, None), ('say "x"', None, "t\tu"), (None, -2.0, "")]
    df = spark.createDataFrame(rows, "a string, x double, b string")
    for fmt, read in (("csv", tables.read_csv), ("tsv", tables.read_tsv)):
        tables.write_results(df, str(tmp_path / fmt), fmt)
        assert {tuple(r) for r in read(spark, str(tmp_path / fmt), df.schema).collect()} == set(rows)
