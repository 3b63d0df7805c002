"""Differential analysis between two groups, multiple-testing adjustment."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.functions.pvalues import f_sf
from hazardlake.functions.scalar import beta_to_m
from hazardlake.operators.layout import complete_features, map_probes_to_genes, null_safe_join
from hazardlake.operators.ranks import in_ranges, with_totals_before
from hazardlake.sources.tables import cut_lineage


def two_groups(cohort: DataFrame, bad: DataFrame) -> DataFrame:
    """Adds ``grp``: 'BadPrognosis' for the listed samples, else the reference 'GoodPrognosis'."""
    marked = cohort.join(bad.select("sample_id", F.lit(1).alias("_bad")).distinct(),
                         "sample_id", "left")
    label = F.when(F.col("_bad") == 1, "BadPrognosis").otherwise("GoodPrognosis")
    return marked.withColumn("grp", label).drop("_bad")


def methylation_by_gene(long: DataFrame, annot: DataFrame, n_samples) -> DataFrame:
    """Beta values to complete finite M-values, averaged per gene and sample."""
    m = long.withColumn("value", beta_to_m("value"))
    whole = complete_features(m, n_samples, by=())
    return map_probes_to_genes(whole, annot)


def anova_by_feature(long: DataFrame, groups: DataFrame, group="grp", by=()) -> DataFrame:
    """One-way analysis of variance per feature from group moments, so groups may be any size."""
    keys = [*by, "feature_id"]
    n = F.count("value").cast("double")
    cells = (long.where(F.col("value").isNotNull()).join(groups.select("sample_id", group), "sample_id")
             .groupBy(*keys, group).agg(n.alias("n"), F.avg("value").alias("mean"),
                                        (n * F.var_pop("value")).alias("within")))
    grand = F.sum(F.col("n") * F.col("mean")).over(Window.partitionBy(*keys)) / F.sum("n").over(
        Window.partitionBy(*keys))
    out = (cells.withColumn("dev", F.col("mean") - grand).groupBy(*keys)
           .agg((F.count("*") - 1).cast("bigint").alias("df"),
                (F.sum("n") - F.count("*")).cast("bigint").alias("df_resid"),
                F.sum(F.col("n") * F.col("dev") * F.col("dev")).alias("sum_sq"),
                F.sum("within").alias("_ssw"))
           .where((F.col("df") > 0) & (F.col("df_resid") > 0)))
    mean_sq = F.col("sum_sq") / F.col("df")
    f = mean_sq / F.nullif(F.col("_ssw") / F.col("df_resid"), F.lit(0.0))
    return (out.withColumn("mean_sq", mean_sq).withColumn("f_value", f).drop("_ssw")
            .withColumn("p", f_sf("f_value", "df", "df_resid")))


def mean_difference(long: DataFrame, groups: DataFrame, group="grp",
                    labels=("GoodPrognosis", "BadPrognosis"), by=()) -> DataFrame:
    """Mean of the second label minus mean of the first, and its size, per feature."""
    a, b = [F.avg(F.when(F.col(group) == v, F.col("value"))) for v in labels]
    return (long.join(groups.select("sample_id", group), "sample_id")
            .groupBy(*by, "feature_id").agg((b - a).alias("mean_difference"))
            .withColumn("abs_difference", F.abs("mean_difference")))


def differential_methylation(gene_values: DataFrame, groups: DataFrame, adjust=False) -> DataFrame:
    out = (mean_difference(gene_values, groups).drop("abs_difference")
           .join(anova_by_feature(gene_values, groups), "feature_id"))
    return bh_adjust(out, "p") if adjust else out


def bh_adjust(df: DataFrame, p="p", partition_by=(), alias="padj") -> DataFrame:
    """Benjamini-Hochberg adjusted p per partition, without sorting a partition in one task.

    Distinct p-values are parted by range; ranks and running minima are formed inside the ranges and
    completed by totals over the ranges. NULL stays NULL.
    The input, one row per test, is checkpointed: it is read several times.
    """
    by = list(partition_by)
    df = cut_lineage(df)
    distinct = (df.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("_p"))
                .agg(F.count("*").alias("_n")))
    over, inner = Window.partitionBy(*by), Window.partitionBy(*by, "_b")
    ranked = in_ranges(distinct, by, "_p").withColumn("_in", F.sum("_n").over(
        inner.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)))
    raw = with_totals_before(ranked, by, F.sum("_n")).withColumn(
        "_raw", F.col("_p") * F.col("_m") / (F.col("_before") + F.col("_in")))
    lows = raw.groupBy(*by, "_b").agg(F.min("_raw").alias("_low"))
    lows = lows.select(*by, "_b", F.min("_low").over(
        over.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_next"))
    here = F.min("_raw").over(inner.orderBy(F.col("_p").desc())
                              .rowsBetween(Window.unboundedPreceding, 0))
    adjusted = (null_safe_join(raw.withColumn("_here", here), lows, [*by, "_b"])
                .select(*by, F.col("_p").alias(p),
                        F.least(F.lit(1.0), "_here", "_next").alias(alias)))
    return null_safe_join(df, adjusted, [*by, p], "left").select(*by, p, *[c for c in df.columns if c not in (*by, p)], alias)


def size_factors(counts: DataFrame) -> DataFrame:
    """Median-of-ratios library size per sample, over genes counted in every sample.

    A gene without a row for a sample counts 0 there, as one with a row of 0 does. The median runs
    over the genes of one sample, whose number the study bounds.
    """
    samples = counts.agg(F.count_distinct("sample_id")).scalar()
    log_mean = (counts.where(F.col("value") > 0).groupBy("feature_id")
                .agg(F.avg(F.ln("value")).alias("_g"), F.count_distinct("sample_id").alias("_n"))
                .where(F.col("_n") == samples).select("feature_id", "_g"))
    ratio = F.ln("value") - F.col("_g")
    return (counts.where(F.col("value") > 0).join(log_mean, "feature_id")
            .groupBy("sample_id").agg(F.exp(F.median(ratio)).alias("size_factor")))
