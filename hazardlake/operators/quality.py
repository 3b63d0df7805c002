"""Per-feature quality control, scaling and imputation on long tables.

Statistics are aggregated first and joined back. The statistics table has one row per feature
and group; adaptive execution broadcasts it when its measured size allows, and otherwise splits
skewed join partitions. A window would move every value of a feature into one task.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.operators.clean import top_n
from hazardlake.operators.layout import null_safe_join, select_features
from hazardlake.sources.tables import beside, cut_lineage, stored


def filter_zero_fraction(long: DataFrame, n_samples, cut: float = 0.2,
                         by=("modality",)) -> DataFrame:
    """Keep features with fewer than ``cut`` zeros; one missing value also drops a feature."""
    keep = (long.groupBy(*by, "feature_id")
            .agg(F.count_if(F.col("value") == 0).alias("z"), F.count("value").alias("n"))
            .where((F.col("z") < n_samples * F.lit(cut)) & (F.col("n") == n_samples)))
    return select_features(long, keep.select(*by, "feature_id"))


def filter_missing_features(long: DataFrame, n_samples, cut: float = 0.2,
                            by=("modality",)) -> DataFrame:
    keep = (long.groupBy(*by, "feature_id").agg(F.count("value").alias("n"))
            .where(n_samples - F.col("n") < n_samples * F.lit(cut)))
    return select_features(long, keep.select(*by, "feature_id"))


def filter_missing_samples(long: DataFrame, cut: float = 0.2) -> DataFrame:
    """Drop samples that miss ``cut`` or more of the features present in ``long``."""
    features = long.select("feature_id").distinct().agg(F.count("*").alias("p")).scalar()
    keep = (long.groupBy("sample_id").agg(F.count("value").alias("n"))
            .where(features - F.col("n") < features * F.lit(cut)).select("sample_id"))
    return long.join(keep, "sample_id", "left_semi")


def filter_annotation(long: DataFrame, annot: DataFrame, relation: str = "Island") -> DataFrame:
    ids = annot.where(F.col("island_relation") == relation).select(
        F.col("probe_id").alias("feature_id")).distinct()
    return select_features(long, ids)


def top_variance(long: DataFrame, k: int, by=()) -> DataFrame:
    var = long.groupBy(*by, "feature_id").agg(F.var_samp("value").alias("var"))
    best = top_n(var, [F.col("var").desc(), "feature_id"], k, by)
    return select_features(long, best.select(*by, "feature_id"))


def split_features(long: DataFrame, id_list: DataFrame):
    """(features in the list, features not in it)."""
    ids = id_list.select("feature_id").distinct()
    return select_features(long, ids), select_features(long, ids, exclude=True)


def zscore(long: DataFrame, by=("modality",), reference=None) -> DataFrame:
    """(value - mean) / sample sd per feature and group, skipping NULLs; sd 0 gives NULL.

    ``by`` normally holds the fold role, so train and test rows are scaled apart. With
    ``reference`` (a condition on rows) mean and sd come from those rows only and apply to all.
    """
    keys = [*by, "feature_id"]
    rows = long = stored(long)
    if reference is not None:
        rows = long.where(reference)
        keys = [c for c in keys if c != "role"]
    stats = rows.groupBy(*keys).agg(
        F.avg("value").alias("_mean"), F.nullif(F.stddev_samp("value"), F.lit(0.0)).alias("_sd"))
    return (long.join(beside(stats), keys)
            .withColumn("value", (F.col("value") - F.col("_mean")) / F.col("_sd"))
            .select(*long.columns))


def zscore_vectors(vectors: DataFrame, by) -> DataFrame:
    """``zscore`` of every position of ``features`` in its group ``by``; sd 0 gives 0. ``vectors`` should be stored."""
    x = F.col("value")
    flat = vectors.select(*by, F.posexplode("features").alias("pos", "value"))
    stats = flat.groupBy(*by, "pos").agg(F.avg(x).alias("mean"), F.nullif(F.stddev_samp(x), F.lit(0.0)).alias("sd"))
    stats = stats.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "sd"))).alias("_stats"))
    scaled = F.zip_with("features", "_stats", lambda v, s: F.coalesce((v - s["mean"]) / s["sd"], F.lit(0.0)))
    return null_safe_join(vectors, beside(stats), by).withColumn("features", scaled).drop("_stats")


PROBES = tuple(i / 64 for i in range(1, 64))   # cuts that a round lays into every bracket
FITS = 100_000                                # rows of a bracket that are ranked


def group_quantile(df: DataFrame, keys, value: str, q: float = 0.5, alias: str = "median",
                   probes=PROBES, fits: int = FITS) -> DataFrame:
    """Exact interpolated quantile per group without gathering any group.

    All groups keep a bracket (lo, hi] of values that holds the wanted ranks. In a round a mergeable
    sketch proposes cuts inside the bracket, the rows between cuts are counted exactly, and the
    bracket shrinks to the parts with the wanted ranks. Rounds end when every bracket has at most
    ``fits`` rows or one value, or when a round takes less than a tenth off; the distinct values inside are
    then counted and ranked. Cuts only decide how fast that is, not what is found.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    at = (F.col("_n") - 1) * F.lit(float(q))
    bracket = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_hi")).select(
        *keys, "_n", (F.floor(at) + 1).alias("_a"), (F.ceil(at) + 1).alias("_z"), F.lit(None).cast("double").alias("_lo"), "_hi",
        F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_inside"), (F.col("_least") < F.col("_hi")).alias("_open")))
    inner = F.coalesce(F.col("_v") > F.col("_lo"), F.lit(True)) & (F.col("_v") <= F.col("_hi"))
    while True:
        wide = beside(bracket.where(F.col("_open") & (F.col("_inside") > fits)))
        if wide.isEmpty():
            break
        inside = null_safe_join(rows, wide, keys).where(inner)
        cuts = beside(inside.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_v", list(probes), 1000)).alias("_cuts")))
        part = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
        counts = null_safe_join(inside, cuts, keys).groupBy(*keys, part.alias("_part")).agg(
            F.count("*").alias("_c"), F.max("_v").alias("_top"), F.min("_v").alias("_bottom"))
        known = null_safe_join(counts, wide, keys)
        order = Window.partitionBy(*keys).orderBy("_part")
        upto = F.col("_below") + F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))
        known = known.withColumn("_upto", upto).withColumn("_before", F.lag("_top").over(order))
        wanted = known.where((F.col("_upto") >= F.col("_a")) & (F.col("_upto") - F.col("_c") < F.col("_z")))
        first = F.min(F.struct("_part", F.coalesce("_before", "_lo").alias("lo"), (F.col("_upto") - F.col("_c")).alias("below")))
        found = wanted.groupBy(*keys).agg(first.alias("_f"), F.max("_top").alias("_t"), F.min("_bottom").alias("_s"), F.sum("_c").alias("_m"))
        shrunk = null_safe_join(wide, found, keys).select(
            *keys, "_n", "_a", "_z", F.col("_f.lo").alias("_lo"), F.col("_t").alias("_hi"), F.col("_f.below").alias("_below"),
            F.col("_m").alias("_inside"), ((F.col("_s") < F.col("_t")) & (F.col("_m") < 0.9 * F.col("_inside"))).alias("_open"))
        bracket = cut_lineage(bracket.where(~(F.col("_open") & (F.col("_inside") > fits))).unionByName(shrunk))
    counted = null_safe_join(rows, beside(bracket), keys).where(inner).groupBy(*keys, "_n", "_a", "_z", "_below", "_v").agg(F.count("*").alias("_c"))
    running = F.col("_below") + F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    picked = counted.withColumn("_cum", running).groupBy(*keys).agg(
        F.min(F.when(F.col("_cum") >= F.col("_a"), F.col("_v"))).alias("_low"),
        F.min(F.when(F.col("_cum") >= F.col("_z"), F.col("_v"))).alias("_high"), F.max(at - F.floor(at)).alias("_f"))
    return picked.select(*keys, (F.col("_low") + F.col("_f") * (F.col("_high") - F.col("_low"))).alias(alias))


def impute_median(long: DataFrame, by=("modality",)) -> DataFrame:
    """NULL becomes the exact median of its feature and group."""
    keys = [*by, "feature_id"]
    long = stored(long)
    gaps = long.where(F.col("value").isNull()).select(*keys).distinct()
    med = group_quantile(null_safe_join(long, beside(gaps), keys), keys, "value", alias="_med")
    return (long.join(beside(med), keys, "left")
            .withColumn("value", F.coalesce("value", "_med")).select(*long.columns))
