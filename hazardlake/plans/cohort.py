"""Raw tables to analysed modality tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.functions import scalar as S
from hazardlake.operators import layout as L
from hazardlake.operators import quality as Q
from hazardlake.operators.clean import first_per_key
from hazardlake.sources.tables import stored

TASK_ROWS = 1_000_000  # rows among which one task looks for the first specimens


def one_specimen_per_sample(raw: DataFrame, eligible: DataFrame, length: int = 19,
                            tumour: str = None) -> DataFrame:
    """Specimen rows to eligible samples; of several specimens the first barcode is kept."""
    rows = raw if tumour is None else raw.where(F.col("sample_type") == tumour)
    rows = rows.withColumn("specimen", F.col("sample_id")).withColumn(
        "sample_id", S.barcode("sample_id", length))
    rows = rows.join(eligible.select("sample_id").hint("shuffle_hash"), "sample_id", "left_semi")
    # A minimum of texts is found by sorting, so the rows are dealt to as many tasks as their number asks for.
    rows = stored(rows.select("sample_id", "feature_id", "specimen", "value"))
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(max(least, rows.count() // TASK_ROWS), "sample_id")
    return stored(first_per_key(rows, ["sample_id", "feature_id"], ["specimen"]).drop("specimen"))


def expression(raw: DataFrame, eligible: DataFrame, cohort: DataFrame, modality: str,
               lnc_list: DataFrame = None, keep_list: bool = True, cut: float = 0.2) -> DataFrame:
    """mRNA, lncRNA or miRNA: eligible specimens, id-list split, zero filter, cohort rows.

    With ``lnc_list`` the features in the list (or, with ``keep_list=False``, all others) stay.
    """
    rows = one_specimen_per_sample(raw, eligible)
    if lnc_list is not None:
        rows = L.select_features(rows, lnc_list.select("feature_id").distinct(), exclude=not keep_list)
    n = rows.agg(F.count_distinct("sample_id")).scalar()
    kept = Q.filter_zero_fraction(rows, n, cut, by=())
    return (kept.join(cohort.select("sample_id"), "sample_id", "left_semi")
            .select(F.lit(modality).alias("modality"), "sample_id", "feature_id", "value"))


def methylation(raw: DataFrame, eligible: DataFrame, cohort: DataFrame, annot: DataFrame,
                cut: float = 0.2, relation: str = "Island", k: int = 25_000) -> DataFrame:
    """Methylation: drop SNP probes, sparse probes and samples; keep islands; top variance."""
    rows = L.select_features(one_specimen_per_sample(raw, eligible), prefix="rs", exclude=True)
    n = rows.agg(F.count_distinct("sample_id")).scalar()
    rows = Q.filter_missing_samples(Q.filter_missing_features(rows, n, cut, by=()), cut)
    rows = Q.top_variance(Q.filter_annotation(rows, annot, relation), k)
    return (rows.join(cohort.select("sample_id"), "sample_id", "left_semi")
            .select(F.lit("methylation").alias("modality"), "sample_id", "feature_id", "value"))
