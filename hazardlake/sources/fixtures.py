"""The study's tables derived from the generic star-schema tables by Spark jobs.

sample = customer, time = days between first and last order, event = last order has status 'F',
subtype = market segment group. Modalities: ``dense`` (embedding dimensions), ``brand`` (quantity
per brand, many zeros), ``discount`` (mean discount per priority and flag, with gaps) and
``activity`` (mean event value per type).
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlake.sources.tables import read_table

# Segments that form the first subtype, and the last-order status that is an event.
FIRST_SUBTYPE = ["BUILDING", "MACHINERY"]
EVENT_STATUS = "F"
SUBTYPES = ["LUSC", "LUAD"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def sample_id(col: str):
    return F.col(col).cast("string").alias("sample_id")


def follow_up(spark, sf_dir) -> DataFrame:
    days = F.datediff(F.max(F.to_date("o_orderdate")), F.min(F.to_date("o_orderdate")))
    return (table(spark, sf_dir, "orders").groupBy("o_custkey")
            .agg(days.alias("time"), F.max_by("o_orderstatus", "o_orderkey").alias("status"),
                 F.max_by("o_orderpriority", "o_orderkey").alias("priority")))


def cohort(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    first = F.col("c_mktsegment").isin(FIRST_SUBTYPE)
    return (c.join(follow_up(spark, sf_dir), c.c_custkey == F.col("o_custkey"))
            .where(F.col("time") > 1)
            .select(sample_id("c_custkey"), "time",
                    F.when(F.col("status") == EVENT_STATUS, 1).otherwise(0).alias("event"),
                    F.when(first, SUBTYPES[0]).otherwise(SUBTYPES[1]).alias("subtype")))


def clinical(spark, sf_dir) -> DataFrame:
    """Clinical stand-in: numbers, categories and one sentinel category per customer."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .join(follow_up(spark, sf_dir), c.c_custkey == F.col("o_custkey"))
            .select(sample_id("c_custkey"), F.col("c_acctbal").alias("acctbal"),
                    F.col("n_name").alias("nation"), F.col("r_name").alias("region"),
                    F.col("c_mktsegment").alias("segment"), F.col("priority").alias("stage")))


def dense(spark, sf_dir) -> DataFrame:
    """64 signed features per sample from the embedding vectors."""
    e, c = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "customer")
    known = e.join(c.select(F.col("c_custkey").alias("vec_id")), "vec_id", "left_semi")
    flat = known.select(sample_id("vec_id"), F.posexplode("embedding").alias("i", "x"))
    return flat.select(F.lit("dense").alias("modality"), "sample_id",
                       F.format_string("E%02d", "i").alias("feature_id"),
                       F.col("x").cast("double").alias("value"))


def _orders_of_customers(spark, sf_dir) -> DataFrame:
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return (l.join(o.select("o_orderkey", "o_custkey", "o_orderpriority"),
                   F.col("l_orderkey") == F.col("o_orderkey"))
            .withColumn("sample_id", F.col("o_custkey").cast("string")))


def _fill(long: DataFrame, samples: DataFrame, modality: str, zero=None, names: DataFrame = None) -> DataFrame:
    """Every sample gets every feature; the feature list, of all rows or of ``names``, comes from one aggregated row."""
    features = (long if names is None else names).agg(F.array_sort(F.collect_set("feature_id"))).scalar()
    grid = samples.select("sample_id", F.explode(features).alias("feature_id"))
    out = grid.join(long, ["sample_id", "feature_id"], "left")
    value = F.col("value") if zero is None else F.coalesce("value", F.lit(zero))
    return out.select(F.lit(modality).alias("modality"), "sample_id", "feature_id",
                      value.alias("value"))


def brand(spark, sf_dir, samples: DataFrame = None) -> DataFrame:
    """Total quantity per customer and brand; brands never bought count 0. ``samples`` are rows of the cohort, if not all."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    bought = _orders_of_customers(spark, sf_dir).join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        "sample_id", F.col("p_brand").alias("feature_id"), "l_quantity")
    total = _of(bought, samples).groupBy("sample_id", "feature_id").agg(F.sum("l_quantity").alias("value"))
    return _fill(total, cohort(spark, sf_dir) if samples is None else samples, "brand", 0.0, bought)


def discount(spark, sf_dir, samples: DataFrame = None) -> DataFrame:
    """Mean discount per customer, order priority and return flag; gaps are NULL. ``samples`` are rows of the cohort, if not all."""
    feature = F.concat("o_orderpriority", F.lit("|"), "l_returnflag")
    lines = _orders_of_customers(spark, sf_dir).select("sample_id", feature.alias("feature_id"), "l_discount")
    mean = _of(lines, samples).groupBy("sample_id", "feature_id").agg(F.avg("l_discount").alias("value"))
    return _fill(mean, cohort(spark, sf_dir) if samples is None else samples, "discount", names=lines)


def _of(rows: DataFrame, samples: DataFrame = None) -> DataFrame:
    return rows if samples is None else rows.join(samples, "sample_id", "left_semi")


def activity(spark, sf_dir) -> DataFrame:
    """Mean event value per user and event type."""
    return (table(spark, sf_dir, "events").groupBy(sample_id("user_id"), F.col("event_type").alias("feature_id"))
            .agg(F.avg("value").alias("value"))
            .select(F.lit("activity").alias("modality"), "sample_id", "feature_id", "value"))


def counts(spark, sf_dir) -> DataFrame:
    """Count matrix: line items per supplier (sample) and part brand (feature)."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return (l.join(p.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(sample_id("l_suppkey"), F.col("p_brand").alias("feature_id"))
            .agg(F.count("*").alias("value")))


def count_groups(spark, sf_dir) -> DataFrame:
    """Supplier groups by the region of their nation."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return (s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(sample_id("s_suppkey"), F.when(F.col("n_regionkey") < 2, "BadPrognosis")
                    .otherwise("GoodPrognosis").alias("grp")))


def barcode(custkey):
    """19 characters that name a customer, as the first part of a specimen's barcode."""
    return F.format_string("CUST-%014d", custkey)


def specimens(spark, sf_dir) -> DataFrame:
    """Raw clinical table: a specimen per order, named by customer and order, categories with sentinels.

    The order's status is the vital status; days run from the order to the first day of 1999.
    """
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    o = table(spark, sf_dir, "orders")
    days = F.datediff(F.lit("1999-01-01").cast("date"), F.to_date("o_orderdate"))
    pick = lambda k, *names: F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % k + 1).cast("int"))
    number = lambda k: F.nullif(F.col("o_orderkey") % k, F.lit(0)).cast("double")
    return (o.join(c, F.col("o_custkey") == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(
        F.concat_ws("-", barcode("c_custkey"), F.format_string("%010d", "o_orderkey")).alias("sample_id"), F.col("c_name").alias("patient"),
        F.when(F.col("o_orderpriority") == "5-LOW", "NT").otherwise("TP").alias("sample_type"), F.col("c_mktsegment").alias("subtype"),
        F.col("n_name").alias("stage"), pick(5, "TX", "T1", "T2", "T3", "T4").alias("t"), pick(3, "NX", "N0", "N1").alias("n"),
        pick(4, "M0", "MX", "M1", "M0").alias("m"), pick(7, "not reported", "yes", "no", "no", "no", "yes", "no").alias("prior_malignancy"),
        pick(2, "Not Reported", "No").alias("synchronous_malignancy"), pick(6, "male", "female", "male", "male", "female", "female").alias("gender"),
        (F.col("c_custkey") % 60 + 30).cast("int").alias("age_at_index"), number(11).alias("pack_years_smoked"),
        number(9).alias("dim_short"), number(10).alias("dim_mid"), number(13).alias("dim_long"),
        F.when(F.col("o_orderstatus") == "F", days).cast("int").alias("days_to_death"),
        F.when(F.col("o_orderkey") % 8 != 3, days + 1).cast("int").alias("days_to_last_follow_up"),
        F.when(F.col("o_orderstatus") == "F", "Dead").when(F.col("o_orderstatus") == "O", "Alive").alias("vital_status")))


def eligible(spark, sf_dir) -> DataFrame:
    """Samples of the study with their subtype: customers that are not in debt."""
    first = F.col("c_mktsegment").isin(FIRST_SUBTYPE)
    return (table(spark, sf_dir, "customer").where("c_acctbal >= 0")
            .select(barcode("c_custkey").alias("sample_id"), F.when(first, SUBTYPES[0]).otherwise(SUBTYPES[1]).alias("subtype")))


def _probe_name():
    return F.concat_ws("-", F.when(F.col("l_returnflag") == "R", "rs").otherwise("cg"), F.col("l_linenumber").cast("string"), "l_returnflag")


def probes(spark, sf_dir) -> DataFrame:
    """Raw probe values per specimen: mean discount and tax by line number and flag, some missing, some SNP probes ('rs')."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    name = _probe_name()
    value = F.avg(F.col("l_discount") * 5 + F.col("l_tax"))
    return (l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("o_custkey", "o_orderkey", name.alias("feature_id")).agg(value.alias("v"))
            .select(F.concat_ws("-", barcode("o_custkey"), F.format_string("%010d", "o_orderkey")).alias("sample_id"), "feature_id",
                    F.when(F.col("o_orderkey") % 9 != 4, F.col("v")).alias("value")))


def probe_annotation(spark, sf_dir) -> DataFrame:
    """Where each probe lies: all line numbers but 2 are islands."""
    names = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_returnflag").distinct()
    name = _probe_name()
    return names.select(name.alias("probe_id"), F.when(F.col("l_linenumber") != 2, "Island").otherwise("OpenSea").alias("island_relation"))
