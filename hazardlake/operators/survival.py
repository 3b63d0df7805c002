"""Survival statistics on day-resolution times.

Rows are aggregated per (group, day) before any ordered window, so a window holds at most one
row per distinct day whatever the number of samples, and the aggregation combines map-side.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from hazardlake.functions.pvalues import chi2_sf
from hazardlake.operators.clean import top_n
from hazardlake.operators.ranks import in_ranges, with_totals_before

Z95 = 1.959963984540054


def kaplan_meier(df: DataFrame, by=(), time="time", event="event") -> DataFrame:
    """Survival curve per group: at-risk, events, survival and the log-scale 95 % band."""
    by = list(by)
    days = df.groupBy(*by, time).agg(F.count("*").alias("n_obs"),
                                     F.sum(event).cast("bigint").alias("n_event"))
    later = Window.partitionBy(*by).orderBy(F.col(time).desc())
    days = days.withColumn("n_risk", F.sum("n_obs").over(later))
    d, n = F.col("n_event").cast("double"), F.col("n_risk").cast("double")
    so_far = Window.partitionBy(*by).orderBy(time)
    log_surv = F.sum(F.when(d < n, F.ln(1 - d / n)).otherwise(0.0)).over(so_far)
    green = F.sum(F.when(d < n, d / (n * (n - d))).otherwise(0.0)).over(so_far)
    dead = F.max(F.when(d >= n, 1).otherwise(0)).over(so_far) == 1
    surv = F.when(dead, 0.0).otherwise(F.exp(log_surv))
    se = F.sqrt(green)
    return (days.withColumn("survival", surv)
            .withColumn("lower", F.when(~dead, surv * F.exp(-Z95 * se)))
            .withColumn("upper", F.when(~dead, F.least(F.lit(1.0), surv * F.exp(Z95 * se))))
            .select(*by, time, "n_risk", "n_event", "survival", "lower", "upper"))


def _risk_table(df: DataFrame, group: str, time: str, event: str) -> DataFrame:
    """Per event day: n, d and the arrays of n_g, d_g over the sorted groups (few by nature)."""
    days = df.groupBy(time, group).agg(F.count("*").alias("c"), F.sum(event).alias("d"))
    groups = days.agg(F.array_sort(F.collect_set(group))).scalar()
    filled = (days.groupBy(time).agg(F.map_from_entries(F.collect_list(
        F.struct(F.col(group), F.struct("c", "d")))).alias("m"))
        .select(time, F.explode(groups).alias("g"), "m")
        .select(time, "g", F.coalesce(F.try_element_at("m", F.col("g"))["c"], F.lit(0)).alias("c"),
                F.coalesce(F.try_element_at("m", F.col("g"))["d"], F.lit(0)).alias("d")))
    risk = F.sum("c").over(Window.partitionBy("g").orderBy(F.col(time).desc()))
    return (filled.withColumn("r", risk.cast("double"))
            .groupBy(time).agg(F.sum("d").cast("double").alias("d"), F.sum("r").alias("n"),
                               F.collect_list(F.struct("g", "r", "d")).alias("gs"))
            .where(F.col("d") > 0))


def logrank_components(df: DataFrame, group: str, time="time", event="event") -> DataFrame:
    """Per pair of groups: observed minus expected events of ``g`` and covariance ``v``."""
    t = _risk_table(df, group, time, event)
    hyper = F.when(F.col("n") > 1, F.col("d") * (F.col("n") - F.col("d")) / (F.col("n") - 1)
                   ).otherwise(0.0)
    pairs = (t.withColumn("w", hyper).select("d", "n", "w", "gs", F.explode("gs").alias("a"))
             .select("d", "n", "w", "a", F.explode("gs").alias("b")))
    same = F.when(F.col("a.g") == F.col("b.g"), 1.0).otherwise(0.0)
    return pairs.groupBy(F.col("a.g").alias("g"), F.col("b.g").alias("h")).agg(
        F.sum("a.d").cast("bigint").alias("observed"),
        F.sum(F.col("d") * F.col("a.r") / F.col("n")).alias("expected"),
        F.sum(F.col("w") * F.col("a.r") / F.col("n") * (same - F.col("b.r") / F.col("n"))).alias("v"))


@F.pandas_udf(DoubleType())
def _quadratic_form(cells: pd.Series) -> pd.Series:
    out = []
    for rows in cells:
        names = sorted({r["g"] for r in rows})
        at = {g: i for i, g in enumerate(names)}
        u, v = np.zeros(len(names)), np.zeros((len(names), len(names)))
        for r in rows:
            u[at[r["g"]]] = r["o"] - r["e"]
            v[at[r["g"]], at[r["h"]]] = r["v"]
        u, v = u[1:], v[1:, 1:]
        ok = len(u) > 0 and np.linalg.matrix_rank(v) == len(u)
        out.append(float(u @ np.linalg.solve(v, u)) if ok else None)
    return pd.Series(out, dtype="float64")


def logrank(df: DataFrame, group: str, time="time", event="event") -> DataFrame:
    """One row: chi-square, degrees of freedom and p between the groups."""
    cells = F.collect_list(F.struct(F.col("g").cast("string").alias("g"),
                                    F.col("h").cast("string").alias("h"),
                                    F.col("observed").cast("double").alias("o"),
                                    F.col("expected").alias("e"), "v"))
    out = (logrank_components(df, group, time, event)
           .agg(cells.alias("cells"), F.count_distinct("g").cast("int").alias("k"))
           .select(_quadratic_form("cells").alias("chi2"), (F.col("k") - 1).alias("df")))
    return out.select("chi2", "df", chi2_sf("chi2", "df").alias("p"))


def _score_from_cells(cells: DataFrame, keys, time: str) -> DataFrame:
    """Score test from per-day cells (n, mean, m2, d, dx), centred on the feature mean."""
    whole = Window.partitionBy(*keys)
    centre = (F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole))
    c = cells.withColumn("centre", centre).withColumn("dm", F.col("mean") - F.col("centre"))
    c = (c.withColumn("sx", F.col("n") * F.col("dm"))
         .withColumn("sxx", F.col("m2") + F.col("n") * F.col("dm") * F.col("dm"))
         .withColumn("dxc", F.col("dx") - F.col("d") * (F.col("mean") - F.col("dm"))))
    later = whole.orderBy(F.col(time).desc())
    c = (c.withColumn("n_risk", F.sum("n").over(later))
         .withColumn("s1", F.sum("sx").over(later) / F.col("n_risk"))
         .withColumn("s2", F.sum("sxx").over(later) / F.col("n_risk")))
    u = F.sum(F.when(F.col("d") > 0, F.col("dxc") - F.col("d") * F.col("s1")))
    v = F.sum(F.when(F.col("d") > 0, F.col("d") * (F.col("s2") - F.col("s1") * F.col("s1"))))
    # A feature is constant if its variance is rounding error by its own size, whatever its unit.
    noise = F.sum(F.when(F.col("d") > 0, F.col("d") * (1e-12 * F.col("s2") + 1e-24 * F.col("centre") * F.col("centre"))))
    return (c.groupBy(*keys).agg(u.alias("u"), v.alias("v"), noise.alias("noise"))
            .withColumn("chi2", F.when(F.col("v") > F.col("noise"), F.col("u") * F.col("u") / F.col("v")))
            .where(F.col("chi2").isNotNull()).drop("noise"))


def _cells(rows: DataFrame, keys, time, event) -> DataFrame:
    n = F.count("value").cast("double")
    return rows.groupBy(*keys, time).agg(
        n.alias("n"), F.avg("value").alias("mean"),
        (n * F.var_pop("value")).alias("m2"), F.sum(event).cast("double").alias("d"),
        F.sum(F.when(F.col(event) == 1, F.col("value")).otherwise(0.0)).alias("dx"))


def cox_screen(long: DataFrame, cohort: DataFrame, by=("modality",), time="time",
               event="event") -> DataFrame:
    """Univariate Cox score test at beta = 0 for every feature: u, v, chi2 (1 df) and p.

    The statistic does not change when a feature is shifted or scaled, so it needs no z-scores.
    Constant features have no test and drop out.
    """
    keys = [*by, "feature_id"]
    rows = long.where(F.col("value").isNotNull()).join(cohort, "sample_id")
    out = _score_from_cells(_cells(rows, keys, time, event), keys, time)
    return out.withColumn("p", chi2_sf("chi2"))


def cox_screen_cv(long: DataFrame, folded: DataFrame, k: int = 5, by=("modality",), time="time",
                  event="event", train_filter=None) -> DataFrame:
    """``cox_screen`` on the training part of all k experiments in one scan.

    Rows are reduced to cells per (feature, own fold, day) once; only those cells are then
    replicated to the k - 1 experiments that train on them and merged by exact moments.
    """
    keys = ["cv", *by, "feature_id"]
    train = folded if train_filter is None else folded.where(train_filter)
    rows = long.where(F.col("value").isNotNull()).join(train, "sample_id")
    own = _cells(rows, [*by, "feature_id", "fold"], time, event)
    cv = F.explode(F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: i != F.col("fold")))
    n, mean = F.col("n"), F.col("mean")
    merged = (own.withColumn("cv", cv).groupBy(*keys, time)
              .agg(F.sum("n").alias("n"), (F.sum(n * mean) / F.sum(n)).alias("mean"),
                   F.sum("m2").alias("within"), F.collect_list(F.struct("n", "mean")).alias("parts"),
                   F.sum("d").alias("d"), F.sum("dx").alias("dx")))
    between = F.aggregate("parts", F.lit(0.0), lambda acc, x: acc + x["n"] * F.pow(
        x["mean"] - F.col("mean"), F.lit(2.0)))
    cells = merged.withColumn("m2", F.col("within") + between).drop("within", "parts")
    out = _score_from_cells(cells, keys, time)
    return out.withColumn("p", chi2_sf("chi2"))


def screen_select(screen: DataFrame, n, by=("modality",), p_max: float = 0.8) -> DataFrame:
    """Per group the n features with the smallest p (largest chi2); fewer if fewer pass.

    ``n`` is a number or a map from modality to a number.
    """
    ok = screen.where(F.col("p") <= p_max)
    if not isinstance(n, dict):
        return top_n(ok, [F.col("chi2").desc(), "feature_id"], n, by)
    sizes = F.create_map(*[F.lit(x) for kv in n.items() for x in kv])
    best = top_n(ok.withColumn("_rank", F.row_number().over(
        Window.partitionBy(*by).orderBy(F.col("chi2").desc(), "feature_id"))),
        [F.col("chi2").desc(), "feature_id"], max(n.values()), by)
    return best.where(F.col("_rank") <= F.try_element_at(sizes, F.col("modality"))).drop("_rank")


def cox_predict(long: DataFrame, coefs: DataFrame, ids=("sample_id",), by=()) -> DataFrame:
    """Linear predictor: sum of value times coefficient over the features in ``coefs``."""
    used = coefs.where(F.col("coef") != 0)
    return (long.join(used, [*by, "feature_id"]).groupBy(*by, *ids)
            .agg(F.sum(F.col("value") * F.col("coef")).alias("score")))


def _score_ranks(rows: DataFrame, by) -> DataFrame:
    """Adds the rank ``r`` of the score ``s`` in its group, from 0, equal scores alike, and how many octal digits ranks have."""
    ranked = in_ranges(rows, by, "s").withColumn(
        "_in", (F.dense_rank().over(Window.partitionBy(*by, "_b").orderBy("s")) - 1).cast("bigint"))
    placed = with_totals_before(ranked, by, F.max("_in") + 1)
    top = F.col("_m") - 1
    digits = F.when(top > 0, F.floor(F.log2(top.cast("double")) / 3) + 1).otherwise(0).cast("int")
    return placed.withColumn("r", F.col("_before") + F.col("_in")).withColumn("digits", digits).drop("_b", "_in", "_before", "_m")


def concordance(df: DataFrame, by=(), score="score", time="time", event="event") -> DataFrame:
    """Harrell's concordance per group, exact, without forming pairs of rows.

    A pair is comparable if the earlier time is an event, or if both times are equal and exactly
    one is an event; higher scores should fail earlier; equal scores count one half.

    Scores become octal numbers, their ranks in the group. Two different scores differ first in one
    digit; for each digit position rows are counted by (leading digits, digit, day), and a running
    total over days counts, for every event, the later rows with a smaller digit. Each pair is found
    at exactly one position. Windows hold one row per distinct day, so a group with most of the data
    is spread like any other.
    """
    by = list(by)
    rows = (df.where(F.col(score).isNotNull())
            .groupBy(*by, F.col(score).cast("double").alias("s"), F.col(time).alias("t"))
            .agg(F.count("*").alias("n"), F.sum(event).cast("bigint").alias("e")))
    ranked = _score_ranks(rows, by)
    # One entry per digit position: level, leading digits, digit. Level 0 takes every pair of the
    # group, level 1 the pairs of equal score; their rows all get digit 7 and count as smaller.
    entry = lambda lv, lead, d: F.struct(
        F.lit(lv).cast("int").alias("lv") if isinstance(lv, int) else lv.cast("int").alias("lv"),
        lead.cast("bigint").alias("lead"), d.cast("int").alias("d"))
    zero = F.lit(0)
    fixed = F.array(entry(0, zero, F.lit(7)), entry(1, F.col("r"), F.lit(7)))
    ranks = F.expr("transform(sequence(1, digits), i -> named_struct('lv', cast(1 + i as int), "
                   "'lead', shiftright(r, 3 * i), 'd', cast(shiftright(r, 3 * (i - 1)) & 7 as int)))")
    positions = F.concat(fixed, F.when(F.col("digits") > 0, ranks).otherwise(F.slice(fixed, 1, 0)))
    cells = (ranked.select(*by, "t", "n", "e", F.explode(positions).alias("x"))
             .select(*by, "t", "n", "e", "x.*")
             .groupBy(*by, "lv", "lead", "t", "d").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
             .repartition(*by, "lv", "lead"))
    whole = F.col("lv") < 2
    per_day = []
    for d in range(1, 8):
        below = (F.col("d") < d) | whole
        per_day += [F.sum(F.when(F.col("d") == d, F.col("e")).otherwise(0)).alias(f"e{d}"),
                    F.sum(F.when(below, F.col("n")).otherwise(0)).alias(f"n{d}"),
                    F.sum(F.when(below, F.col("n") - F.col("e")).otherwise(0)).alias(f"c{d}")]
    days = cells.groupBy(*by, "lv", "lead", "t").agg(*per_day)
    later = (Window.partitionBy(*by, "lv", "lead").orderBy(F.col("t").desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    found = sum(
        F.col(f"e{d}") * (F.coalesce(F.sum(f"n{d}").over(later), F.lit(0)) + F.col(f"c{d}"))
        for d in range(1, 8))
    counts = days.select(*by, "lv", found.alias("pairs"))
    out = counts.groupBy(*by).agg(
        F.sum(F.when(F.col("lv") > 1, F.col("pairs")).otherwise(0)).alias("concordant"),
        F.sum(F.when(F.col("lv") == 1, F.col("pairs")).otherwise(0)).alias("tied"),
        F.sum(F.when(F.col("lv") == 0, F.col("pairs")).otherwise(0)).alias("comparable"))
    value = (F.col("concordant") + 0.5 * F.col("tied")) / F.nullif(F.col("comparable"), F.lit(0))
    return out.withColumn("cindex", value.cast("double"))
