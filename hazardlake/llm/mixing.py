"""Mixing sources to target weights by subset-sum budget fitting on length histograms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored, table, word_count

WEIGHTS = (5, 2, 1)
REPEAT = 3
BUCKETS = 4096
#: Words of a budget that the dynamic programming may be left with; its table has a number for each.
TABLE = 1 << 26


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their lengths sum to ``budget``, or come nearest below.

    Every length first gives its share of most of the budget; bounded-knapsack dynamic programming
    over the documents left meets the rest. While it misses the rest, four times as much of the
    budget is left to it, in the end all: so the sum is the best of all choices of counts. Lengths
    are divided by their greatest common divisor, so a miss by parity alone costs nothing. Where
    nothing meets ``TABLE`` words left to it, which takes a source with hardly any lengths, the
    nearest sum within these stands.
    """
    lengths, counts = [int(x) for x in lengths], [int(x) for x in counts]
    unit = math.gcd(*lengths) or 1
    lengths, budget = [x // unit for x in lengths], max(0, budget) // unit
    total = sum(x * n for x, n in zip(lengths, counts))
    if budget >= total:
        return np.array([n if x else 0 for x, n in zip(lengths, counts)], np.int64)
    spare = 2 * max(lengths, default=0)
    while True:
        take = [n * max(0, budget - spare) // total if x else 0 for x, n in zip(lengths, counts)]
        rest = budget - sum(x * n for x, n in zip(lengths, take))
        order = sorted((i for i, x in enumerate(lengths) if x), key=lambda i: -lengths[i])
        for i in order:
            n = min(counts[i] - take[i], max(0, rest - spare) // lengths[i])
            take[i], rest = take[i] + n, rest - n * lengths[i]
        free = not any(take)
        missed = _fill(lengths, counts, take, order, rest)
        if not missed or free or 4 * spare > TABLE:
            return np.array(take, np.int64)
        spare *= 4


def _fill(lengths: list[int], counts: list[int], take: list[int], order: list[int], rest: int) -> int:
    """Add to ``take`` the documents left whose lengths come nearest below ``rest``; what is missed."""
    mask, reach = (1 << (rest + 1)) - 1, 1
    first = np.full(rest + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for i in order:
        left, part = counts[i] - take[i], 1
        while left and not reach >> rest & 1 and lengths[i] <= rest:
            n = min(part, left, rest // lengths[i])
            new = reach << n * lengths[i] & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(rest // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(items)
                items.append((i, n))
                reach |= new
            left, part = (0 if n < min(part, left) else left - n), part * 2
    at = best = reach.bit_length() - 1
    while at:
        i, n = items[first[at]]
        take[i], at = take[i] + n, at - n * lengths[i]
    return rest - best


def source_targets(totals: DataFrame, weights=WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """(source, source_size) with ``target``: shares by weight, at most ``repeat`` times the size.

    The level at which all shares meet the total is found from the order in which sources fill:
    a source stops once the level reaches its limit divided by its weight. One row per source,
    so the windows over all sources are small.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("limit", F.lit(repeat) * F.col("source_size"))
    after = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    level = ranked.select(
        "*", F.sum("source_size").over(whole).alias("total"),
        F.coalesce(F.sum("limit").over(after.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("filled"),
        F.sum("weight").over(after.rowsBetween(0, Window.unboundedFollowing)).alias("open"))
    full = F.col("limit") * F.col("open") <= (F.col("total") - F.col("filled")) * F.col("weight")
    marked = level.withColumn("full", full)
    share = marked.withColumns({
        "spent": F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0)).over(whole),
        "sharing": F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole)})
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(
        (F.col("total") - F.col("spent")).cast("double") * F.col("weight") / F.col("sharing"))
    return share.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, repeat: int = REPEAT, seed: int = 8) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and times of every row.

    A source takes all its documents as often as its target holds its size, and of the rest of
    the target a set of documents whose lengths fit it. ``times`` counts a document's copies;
    documents without words cost nothing and stay once. NULL is a source of its own, the last;
    NULL texts have no words. Rows that repeat are chosen one by one. Equal lengths are chosen
    by a seeded hash of doc_id. Only (doc_id, source, size) is shuffled; the histogram of one
    source has a row per length. A length with very many documents is ranked in hash buckets.
    """
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                               F.xxhash64(F.lit(seed), "doc_id").alias("h"))
                   .withColumn("bucket", F.pmod(F.col("h"), F.lit(BUCKETS)).cast("int")))
    cells = stored(sizes.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")))
    hist = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    totals = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = stored(source_targets(totals, weights, repeat))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        whole = int(target // size) if size else 0
        budget = min(size, round(target - whole * size)) if size else 0
        some = fit_budget(pdf["size"].to_numpy(), pdf["n"].to_numpy(), budget)
        return pdf.assign(whole=whole, some=some)[["source", "size", "whole", "some"]]

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    known = hist.join(targets, same(hist, targets)).select(hist["source"], "size", "n", "source_size", "target")
    plans = stored(known.groupBy("source").applyInPandas(plan, "source string, size long, whole long, some long"))
    # Buckets of a length are taken in order until its number is reached; one is cut inside.
    up_to = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.withColumn("before", F.coalesce(F.sum("n").over(up_to), F.lit(0)))
    cut = (before.join(plans, same(before, plans) & (before["size"] == plans["size"]))
           .select(before["source"], before["size"], "bucket", "whole",
                   (F.col("some") - F.col("before")).alias("quota")))
    rows = sizes.join(cut, same(sizes, cut) & (sizes["size"] == cut["size"]) & (sizes["bucket"] == cut["bucket"])).select(
        "doc_id", sizes["source"], sizes["size"], sizes["bucket"], "h", "whole", "quota")
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id"))
    times = (F.col("whole") + F.when(rank <= F.col("quota"), 1).otherwise(0)).cast("long")
    chosen = rows.select("doc_id", "source", "size", F.when(F.col("size") == 0, F.lit(1)).otherwise(times).alias("times"))
    return (chosen.join(targets, same(chosen, targets))
            .select("doc_id", chosen["source"], "size", "source_size", "target",
                    (F.col("size") * F.col("times")).alias("taken"), "times"))


def mixed(docs: DataFrame, weights=WEIGHTS, repeat: int = REPEAT, seed: int = 8) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns as they are.

    Rows that agree in doc_id, source and size share their copies evenly.
    """
    *key, words, each_time, alike, n, copy = fresh(docs, "_doc_id", "_source", "_size", "_words", "_times", "_rows", "_n", "_copy")
    times = (mix(docs, weights, repeat, seed).groupBy("doc_id", "source", "size")
             .agg(F.sum("times").alias(each_time), F.count(F.lit(1)).alias(alike)).withColumnsRenamed(dict(zip(("doc_id", "source", "size"), key))))
    sized = docs.withColumn(words, word_count(F.col("text")))
    same = sized["doc_id"].eqNullSafe(times[key[0]]) & sized["source"].eqNullSafe(times[key[1]]) & (sized[words] == times[key[2]])
    place = F.row_number().over(Window.partitionBy(*key).orderBy("text"))
    each = F.floor(F.col(each_time) / F.col(alike)) + (place <= F.col(each_time) % F.col(alike)).cast("int")
    rows = sized.join(times, same).withColumn(n, each.cast("int")).where(F.col(n) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def op8_mixing(spark, sf_dir) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
