"""Ranks over a whole group without sorting the group in one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.operators.layout import null_safe_join
from hazardlake.sources.tables import cut_lineage


def in_ranges(df: DataFrame, by, value) -> DataFrame:
    """Adds ``_b``, the range of (by, value) that a row falls in; ranges ascend with both.

    Rows alike in ``by`` and ``value`` share a range. There are as many ranges as the session has
    shuffle partitions, less those that adaptive execution joins, so they grow with the data. Their
    bounds are sampled, so the rows are checkpointed: all that follows sees the same ranges.
    """
    return cut_lineage(df.repartitionByRange(*by, value).withColumn("_b", F.spark_partition_id()))


def with_totals_before(rows: DataFrame, by, size) -> DataFrame:
    """Adds ``_before`` and ``_m``: the sum of ``size`` (an aggregate) in all earlier ranges, and in all, of the group."""
    over = Window.partitionBy(*by)
    sizes = rows.groupBy(*by, "_b").agg(size.alias("_size"))
    before = F.sum("_size").over(over.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*by, "_b", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(over).alias("_m"))
    return null_safe_join(rows, sizes, [*by, "_b"])
