"""Negative-binomial Wald test per feature between two groups.

Every step is an aggregation over (feature, group) of column expressions, so counts of a feature
are summed where they lie and never gathered. Steps: group means; dispersion by maximising the
adjusted profile likelihood on a grid, refined once; a trend a0 + a1 / mean over features; shrinkage
towards the trend; final means and test. Replacement of outlying counts and independent filtering
are left out.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.functions.pvalues import normal_two_sided
from hazardlake.functions.scalar import ln_gamma
from hazardlake.operators.diff import bh_adjust, size_factors
from hazardlake.operators.quality import group_quantile
from hazardlake.sources.tables import cut_lineage

MIN_DISPERSION = 1e-8
GRID = 21


def _trigamma(x: float) -> float:
    total = 0.0
    while x < 10:
        total += 1 / (x * x)
        x += 1
    i = 1 / (x * x)
    return total + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i / 42))


def _group_means(base, genes, alpha, rounds):
    """Weighted means q_g of k / s under the given dispersion, by fixed-point rounds."""
    for _ in range(rounds):
        w = 1 / (1 + F.col(alpha) * F.col("s") * F.col("q"))
        q = (base.join(genes.select("feature_id", "bad", "q", alpha), ["feature_id", "bad"])
             .groupBy("feature_id", "bad").agg((F.sum(F.col("k") * w) / F.sum(F.col("s") * w)).alias("q")))
        genes = cut_lineage(genes.drop("q").join(q, ["feature_id", "bad"]))
    return genes


def _profile(base, genes, lo: str, hi: str):
    """Adjusted profile log likelihood of ln dispersion on an even grid from ``lo`` to ``hi``."""
    step = (F.col(hi) - F.col(lo)) / (GRID - 1)
    rows = base.join(genes.select("feature_id", "bad", "q", lo, hi), ["feature_id", "bad"])
    mu = F.col("s") * F.col("q")
    rows = rows.withColumn("mu", F.greatest(mu, F.lit(1e-10))).withColumn("_step", step)
    points = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))))
    points = points.withColumn("a", F.exp(F.col(lo) + F.col("i") * F.col("_step"))).withColumn(
        "r", 1 / F.col("a"))
    ll = f"{ln_gamma('(k + r)')} - {ln_gamma('r')} - (k + r) * log1p(a * mu) + k * ln(a * mu)"
    keys = ["feature_id", F.col(lo).alias("lo"), F.col("_step").alias("step"), "i"]
    sides = points.groupBy("bad", *keys).agg(F.expr(f"sum({ll})").alias("l"),
                                             F.expr("sum(mu / (1 + a * mu))").alias("w"))
    value = F.sum("l") - 0.5 * F.sum(F.ln("w"))
    return (sides.groupBy("feature_id", "lo", "step", "i").agg(value.alias("v"))
            .groupBy("feature_id", "lo", "step")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("ll")))


def _peak(profile, alias, prior=None):
    """Grid maximum with a parabola through its neighbours."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(GRID - 1)),
                       lambda i: F.col("lo") + i * F.col("step"))
    p = profile.withColumn("x", grid)
    if prior is not None:
        centre, var = prior
        p = p.withColumn("ll", F.zip_with("ll", "x", lambda v, x: v - F.pow(
            x - F.col(centre), F.lit(2.0)) / (2 * var)))
    p = p.withColumn("i", F.array_position("ll", F.array_max("ll")).cast("int") - 1)
    at = lambda d: F.get("ll", F.col("i") + d)
    bend = at(-1) - 2 * at(0) + at(1)
    shift = F.when(bend < 0, 0.5 * (at(-1) - at(1)) / bend).otherwise(0.0)
    inner = (F.col("i") > 0) & (F.col("i") < GRID - 1)
    return p.withColumn(alias, F.get("x", F.col("i")) + F.when(inner, shift).otherwise(0.0) * F.col("step"))


def _trend(genes):
    """a0 + a1 / mean through the feature dispersions (gamma errors), by weighted least squares."""
    use = genes.where(F.col("log_gene") > math.log(100 * MIN_DISPERSION)).select(
        F.exp("log_gene").alias("a"), (1 / F.col("base_mean")).alias("x"))
    a0, a1 = 0.1, 1.0
    for _ in range(20):
        fit = F.lit(a0) + F.lit(a1) * F.col("x")
        near = use.where((F.col("a") / fit > 1e-4) & (F.col("a") / fit < 15)).withColumn("w", 1 / (fit * fit))
        t = near.agg(*[F.sum(F.col("w") * e).alias(n) for n, e in (
            ("w", F.lit(1.0)), ("x", F.col("x")), ("xx", F.col("x") ** 2),
            ("y", F.col("a")), ("xy", F.col("x") * F.col("a")))], F.avg("a").alias("m")).first()
        if t["w"] is None:
            return None
        det = t["w"] * t["xx"] - t["x"] ** 2
        if det <= 1e-12 * t["w"] * t["xx"]:
            return (t["m"], 0.0)
        new0 = (t["xx"] * t["y"] - t["x"] * t["xy"]) / det
        new1 = (t["w"] * t["xy"] - t["x"] * t["y"]) / det
        if new0 <= 0 or new1 <= 0:
            return (t["m"], 0.0)
        if abs(math.log(new0 / a0)) + abs(math.log(new1 / a1)) < 1e-6:
            return (new0, new1)
        a0, a1 = new0, new1
    return (a0, a1)


def nb_wald(counts: DataFrame, groups: DataFrame, factors: DataFrame = None,
            bad: str = "BadPrognosis") -> DataFrame:
    """Test every feature of ``counts(sample_id, feature_id, value)`` between two groups.

    ``groups(sample_id, grp)``. Returns base_mean, dispersion, log2_fold_change (bad over good),
    lfc_se, stat, p and adjusted p. Features without any count drop out; an absent row counts 0.
    """
    factors = size_factors(counts) if factors is None else factors
    samples = cut_lineage(groups.select("sample_id", (F.col("grp") == bad).cast("int").alias("bad"))
                          .join(factors, "sample_id"))
    # A gene without a row for a sample counts 0 there; the matrix has genes x samples cells.
    # Samples stay where they are, and each meets the few features.
    cells = samples.crossJoin(counts.select("feature_id").distinct())
    base = cut_lineage(cells.join(counts, ["feature_id", "sample_id"], "left").select(
        "feature_id", "bad", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("k"),
        F.col("size_factor").alias("s")))
    m = samples.count()
    norm = F.col("k") / F.col("s")
    cells = base.groupBy("feature_id", "bad").agg(
        F.count("*").cast("double").alias("n"), F.avg(norm).alias("q"), F.sum(norm).alias("total"),
        (F.count("*") * F.var_pop(norm)).alias("ss"), F.sum(1 / F.col("s")).alias("inv"))
    whole = cells.groupBy("feature_id").agg(
        (F.sum("total") / F.sum("n")).alias("base_mean"), (F.sum("ss") / (F.sum("n") - 2)).alias("var"),
        (F.sum("inv") / F.sum("n")).alias("xi"), F.min("q").alias("low")).where(F.col("base_mean") > 0)
    rough = (F.col("var") - F.col("xi") * F.col("base_mean")) / F.pow("base_mean", F.lit(2.0))
    top = math.log(max(10.0, float(m)))
    whole = whole.withColumn("a0", F.greatest(F.lit(MIN_DISPERSION), F.least(rough, F.lit(10.0))))
    genes = cut_lineage(cells.select("feature_id", "bad", F.greatest("q", F.lit(1e-8)).alias("q"))
                        .join(whole.drop("var", "xi", "low"), "feature_id")
                        .withColumn("lo", F.lit(math.log(MIN_DISPERSION))).withColumn("hi", F.lit(top)))
    genes = _group_means(base, genes, "a0", 2)

    coarse = _peak(_profile(base, genes, "lo", "hi"), "peak").select("feature_id", "peak")
    width = (top - math.log(MIN_DISPERSION)) / (GRID - 1)
    genes = cut_lineage(genes.drop("lo", "hi").join(coarse, "feature_id")
                        .withColumn("lo", F.col("peak") - width).withColumn("hi", F.col("peak") + width))
    fine = _peak(_profile(base, genes, "lo", "hi"), "log_gene").select("feature_id", "log_gene")
    per_gene = cut_lineage(genes.select("feature_id", "base_mean").distinct().join(fine, "feature_id"))

    a = _trend(per_gene) or (0.1, 0.0)
    per_gene = per_gene.withColumn("log_fit", F.ln(F.lit(a[0]) + F.lit(a[1]) / F.col("base_mean")))
    resid = (per_gene.where(F.col("log_gene") > math.log(100 * MIN_DISPERSION))
             .select(F.lit(1).alias("one"), (F.col("log_gene") - F.col("log_fit")).alias("r")))
    mid = group_quantile(resid, ["one"], "r").select("median")
    spread = group_quantile(resid.withColumn("r", F.abs(F.col("r") - mid.scalar())), ["one"], "r").first()
    var = (1.4826 * spread["median"]) ** 2 if spread else 1.0
    prior = max(var - _trigamma(max(m - 2, 1) / 2), 0.25)

    lo, hi = F.least("log_gene", "log_fit") - 0.5, F.greatest("log_gene", "log_fit") + 0.5
    genes = cut_lineage(genes.drop("lo", "hi", "peak", "base_mean").join(per_gene, "feature_id")
                        .withColumn("lo", lo).withColumn("hi", hi))
    post = _profile(base, genes, "lo", "hi").join(per_gene.select("feature_id", "log_fit"), "feature_id")
    shrunk = _peak(post, "log_map", ("log_fit", prior)).select("feature_id", "log_map")
    outlier = F.col("log_gene") > F.col("log_fit") + 2 * math.sqrt(max(var, 1e-12))
    alpha = F.exp(F.when(outlier, F.col("log_gene")).otherwise(F.col("log_map")))
    genes = genes.drop("lo", "hi").join(shrunk, "feature_id").withColumn("dispersion", alpha)
    genes = _group_means(base, cut_lineage(genes), "dispersion", 3)

    mu = F.greatest(F.col("s") * F.col("q"), F.lit(1e-10))
    info = (base.join(genes.select("feature_id", "bad", "q", "dispersion"), ["feature_id", "bad"])
            .groupBy("feature_id", "bad", "q").agg(
                F.sum(mu / (1 + F.col("dispersion") * mu)).alias("w")))
    side = lambda c, g: F.max(F.when(F.col("bad") == g, F.col(c)))
    ln2 = math.log(2)
    test = info.groupBy("feature_id").agg(
        (F.log2(side("q", 1)) - F.log2(side("q", 0))).alias("log2_fold_change"),
        (F.sqrt(1 / side("w", 1) + 1 / side("w", 0)) / ln2).alias("lfc_se"))
    test = (test.join(genes.select("feature_id", "base_mean", "dispersion").distinct(), "feature_id")
            .withColumn("stat", F.col("log2_fold_change") / F.col("lfc_se"))
            .withColumn("p", normal_two_sided("stat")))
    return bh_adjust(test, "p").select("feature_id", "base_mean", "dispersion", "log2_fold_change",
                                       "lfc_se", "stat", "p", "padj")
