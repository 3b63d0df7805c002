"""Hash-ordered sampling: stratified folds, roles, corruption, modality combinations.

Every random choice is a hash of keys and a seed, so results do not depend on partitioning or
on lost executors. Ranks in hash order are found from bucket counts; no group is sorted whole.
"""

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.functions import scalar as S
from hazardlake.operators.layout import null_safe_join

BUCKET_DIGITS = 3  # leading hex digits of the hash: 4096 buckets per group


def hash_thresholds(df: DataFrame, keys, ranks) -> DataFrame:
    """Per group the hashes at the wanted ranks, as a sorted array ``thresholds``.

    ``df`` has the keys and ``_h``; ``ranks`` turns the column ``_n`` (group size) into an array
    of ranks. Only the rows of the buckets that hold a wanted rank are sorted.
    """
    keys = list(keys)
    bucket = F.substring("_h", 1, BUCKET_DIGITS).alias("_b")
    counts = df.groupBy(*keys, bucket).agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*keys)
    cum = F.sum("_c").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    sized = counts.withColumn("_cum", cum).withColumn("_n", F.sum("_c").over(group))
    wanted = (sized.select(*keys, "_b", "_c", "_cum", F.explode(ranks).alias("_r"))
              .where((F.col("_r") <= F.col("_cum")) & (F.col("_r") > F.col("_cum") - F.col("_c")))
              .groupBy(*keys, "_b")
              .agg(F.collect_list((F.col("_r") - (F.col("_cum") - F.col("_c"))).cast("int"))
                   .alias("_in")))
    near = null_safe_join(df.select(*keys, "_h", bucket), wanted, [*keys, "_b"])
    rn = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h"))
    return (near.withColumn("_rn", rn).where(F.array_contains("_in", F.col("_rn")))
            .groupBy(*keys).agg(F.array_sort(F.collect_list("_h")).alias("thresholds")))


def stratified_folds(cohort: DataFrame, by, k: int = 5, seed: int = 3) -> DataFrame:
    """Adds ``fold`` 1..k: in each stratum the hash order is cut into k runs of near-equal size."""
    by = list(by)
    hashed = cohort.withColumn("_h", S.hash_order(["sample_id"], seed))
    size = lambda j: (F.floor(F.col("_n") / F.lit(k)) * j
                      + F.least(F.col("_n") % k, F.lit(j))).cast("long")
    ends = F.array(*[size(j) for j in range(1, k)])
    cuts = hash_thresholds(hashed, by, ends)  # NULL is a stratum of its own
    fold = F.size(F.filter(F.coalesce("thresholds", F.array().cast("array<string>")),
                           lambda t: t < F.col("_h"))) + 1
    return null_safe_join(hashed, cuts, by, "left").withColumn("fold", fold).select(*cohort.columns, "fold")


def with_roles(folded: DataFrame, k: int = 5, train_filter=None) -> DataFrame:
    """One row per sample and experiment ``cv``; ``role`` is 'test' in the sample's own fold.

    ``train_filter`` (a condition) restricts training rows, e.g. to one subtype; test rows stay.
    """
    out = (folded.withColumn("cv", F.explode(F.sequence(F.lit(1), F.lit(k))))
           .withColumn("role", F.when(F.col("cv") == F.col("fold"), "test").otherwise("train")))
    return out if train_filter is None else out.where((F.col("role") == "test") | train_filter)


def corrupt_zeros(long: DataFrame, p: float = 0.3, seed: int = 5, by=("modality",)) -> DataFrame:
    """Sets exactly floor(p n) pseudo-random rows of every feature to 0."""
    keys = [*by, "feature_id"]
    hashed = long.withColumn("_h", S.hash_order([*keys, "sample_id"], seed))
    last = F.array(F.floor(F.col("_n") * F.lit(p)).cast("long"))
    cut = hash_thresholds(hashed, keys, last)
    hit = F.col("_h") <= F.get("thresholds", F.lit(0))
    return (null_safe_join(hashed, cut, keys, "left")
            .withColumn("value", F.when(hit, 0.0).otherwise(F.col("value"))).select(*long.columns))


def corrupt_gaussian(long: DataFrame, sd: float, seed: int = 5, by=("modality",)) -> DataFrame:
    noise = S.hash_normal([*by, "feature_id", "sample_id"], seed) * F.lit(float(sd))
    return long.withColumn("value", F.col("value") + noise)


# Short modality names, in the order used in combination names.
COMBO_ORDER = ["Meth", "Gene", "LNC", "miRNA", "Clin"]


def late_combos(names=COMBO_ORDER, clinical: str = "Clin"):
    """Every choice of 2 to n-1 modalities, but for one omics modality plus clinical data."""
    return [list(c) for size in range(2, len(names)) for c in combinations(names, size)
            if not (size == 2 and clinical in c)]


def early_combos(names=COMBO_ORDER, clinical: str = "Clin"):
    """Every omics choice, without and with clinical data; one alone only with clinical data."""
    omics = [n for n in names if n != clinical]
    out = []
    for size in range(1, len(omics) + 1):
        for c in combinations(omics, size):
            out += [[*c]] if size > 1 else []
            out += [[*c, clinical]]
    return out


def combo_table(spark, combos) -> DataFrame:
    """(combo, modality), one row per member."""
    rows = [("-".join(c), m) for c in combos for m in c]
    return spark.createDataFrame(rows, "combo string, modality string")


def expand_combos(long: DataFrame, combos: DataFrame) -> DataFrame:
    """Long features once per combination that uses their modality.

    Only the combinations are listed against each modality, so this is a map-side lookup.
    """
    members = combos.groupBy("modality").agg(F.collect_list("combo").alias("combos"))
    return (long.join(members, "modality")
            .select(F.explode("combos").alias("combo"), *long.columns))
