"""Cleaning of clinical tables, key handling and cohort building."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.functions import scalar as S


def cast_numeric(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: S.to_number(c) for c in cols})


def null_sentinels(df: DataFrame, rules: dict) -> DataFrame:
    """``rules`` maps a column to the texts that mean missing."""
    return df.withColumns({c: S.null_if_in(c, v) for c, v in rules.items()})


def null_rare(df: DataFrame, col: str, min_count: int = 2) -> DataFrame:
    """Categories seen fewer than ``min_count`` times become NULL."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n"))
    kept = counts.where(F.col("_n") >= min_count).select(col, F.lit(True).alias("_keep"))
    return (df.join(kept, col, "left").withColumn(col, F.when(F.col("_keep"), F.col(col)))
            .select(*df.columns))


def label_encode(df: DataFrame, cols) -> DataFrame:
    """Code from 1 by rank among the sorted distinct values; NULL stays NULL.

    The sorted category lists come from one partially aggregated row, so nothing is shuffled
    but the categories themselves.
    """
    lists = F.struct(*[F.array_sort(F.collect_set(c)).alias(c) for c in cols])
    cats = df.agg(lists.alias("cats")).scalar()
    return df.withColumns(
        {c: F.array_position(cats.getField(c), F.col(c)).cast("int") for c in cols})


def first_per_key(df: DataFrame, keys, order_by) -> DataFrame:
    """The whole first row of every key.

    A minimum over a struct is combined before the shuffle, so a key with very many rows
    never lands in one task. Ties on ``order_by`` are broken by the other columns.
    """
    keys = list(keys)
    rest = [*order_by, *[c for c in df.columns if c not in keys and c not in order_by]]
    return (df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r"))
            .select(*keys, "_r.*").select(*df.columns))


def first_match_lookup(df: DataFrame, lookup: DataFrame, key: str, order_by) -> DataFrame:
    """Left join to the first lookup row per key; rows without a match stay."""
    return df.join(first_per_key(lookup, [key], order_by), key, "left")


def symmetric_difference(a: DataFrame, b: DataFrame, key) -> DataFrame:
    """Keys found in exactly one of two tables."""
    keys = [key] if isinstance(key, str) else list(key)
    tagged = (a.select(*keys, F.lit(1).alias("s")).unionByName(b.select(*keys, F.lit(2).alias("s"))))
    return (tagged.groupBy(*keys).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
            .where(F.col("lo") == F.col("hi")).select(*keys))


def top_n(df: DataFrame, by, n: int, partition_by=()) -> DataFrame:
    """First n rows in the given order, per partition if one is named."""
    if not partition_by:
        return df.orderBy(*by).limit(n)
    w = Window.partitionBy(*partition_by).orderBy(*by)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def mean_se(df: DataFrame, keys, cols) -> DataFrame:
    """Mean and standard error sd / sqrt(n) of every listed column."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(c),
                 (F.stddev_samp(c) / F.sqrt(F.count(c).cast("double"))).alias(f"se_{c}")]
    return df.groupBy(*keys).agg(*aggs)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def build_cohort(clinical: DataFrame, eligible: DataFrame, tumour: str = "TP",
                 min_time: int = 1) -> DataFrame:
    """Clinical table to one analysed row per sample.

    Categories are coded over all specimens, before the tumour filter. ``eligible(sample_id,
    subtype)`` lists the samples of the study and names their subtype.
    """
    from hazardlake.schema import CLINICAL_CATEGORIES, CLINICAL_SENTINELS

    rules = {c: v for c, v in CLINICAL_SENTINELS.items() if c in clinical.columns}
    cats = [c for c in CLINICAL_CATEGORIES if c in clinical.columns]
    df = label_encode(null_sentinels(clinical, rules), cats).withColumnRenamed(
        "subtype", "subtype_code")
    if {"dim_short", "dim_mid", "dim_long"} <= set(df.columns):
        df = df.withColumn("volume", S.volume("dim_short", "dim_mid", "dim_long")).drop(
            "dim_short", "dim_mid", "dim_long")
    df = (df.where(F.col("sample_type") == tumour)
          .withColumn("specimen", F.col("sample_id"))
          .withColumn("sample_id", S.barcode("sample_id"))
          .join(eligible, "sample_id")
          .withColumn("time", S.survival_time()).withColumn("event", S.event_flag())
          .where(F.col("time").isNotNull() & (F.col("time") > min_time)))
    return first_per_key(df, ["sample_id"], ["specimen"]).drop(
        "sample_type", "days_to_death", "days_to_last_follow_up", "vital_status")


def five_year_groups(cohort: DataFrame, horizon: int = S.FIVE_YEARS) -> DataFrame:
    """Died before the horizon or known alive after it, labelled 'subtype - status'.

    Whoever died after the horizon counts as alive; exactly the horizon and earlier censoring
    drop out.
    """
    late = F.col("time") > horizon
    early_death = (F.col("event") == 1) & (F.col("time") < horizon)
    status = F.when(late, "Alive").otherwise("Dead")
    return (cohort.where(late | early_death).withColumn("status", status)
            .withColumn("group_label", F.concat_ws(" - ", "subtype", "status")))
