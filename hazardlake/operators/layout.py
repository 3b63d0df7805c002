"""Long and vector layouts of feature matrices, feature selection, modality joins.

Long form ``(modality, sample_id, feature_id, value)`` is canonical: a transpose is a no-op and
"for every column" is a ``groupBy(feature_id)``. Vector form ``(.., sample_id, features)`` serves
the model steps; a feature dictionary fixes the position of every feature.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlake.sources.tables import beside


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on equally named keys where NULL matches NULL; the keys come from the left side."""
    keys = list(keys)
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(renamed[f"_right_{k}"])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def to_long(df: DataFrame, ids, features, name="feature_id", value="value") -> DataFrame:
    return df.unpivot(list(ids), list(features), name, value)


def to_wide(long: DataFrame, ids, features, name="feature_id", value="value") -> DataFrame:
    """One column per listed feature. The list is given, so no extra job looks for it."""
    return long.groupBy(*ids).pivot(name, list(features)).agg(F.max(value))


def select_features(long: DataFrame, ids: DataFrame = None, prefix: str = None,
                    contains: str = None, exclude: bool = False) -> DataFrame:
    """Keep (or with ``exclude`` drop) features by id table, name prefix or substring.

    Name matching ignores case. ``ids`` has a ``feature_id`` column and may carry more columns
    shared with ``long`` (such as ``modality``), which then take part in the match.
    """
    out = long
    if ids is not None:
        on = [c for c in ids.columns if c in long.columns]
        out = out.join(beside(ids.select(*on)), on, "left_anti" if exclude else "left_semi")
    for pattern, test in ((prefix, "startswith"), (contains, "contains")):
        if pattern is not None:
            hit = getattr(F.lower("feature_id"), test)(F.lit(pattern.lower()))
            out = out.where(~hit if exclude else hit)
    return out


def feature_dictionary(long: DataFrame, by=("modality",), prefix: dict = None) -> DataFrame:
    """Position (from 1), size and short name of every feature, ordered by feature id."""
    w = Window.partitionBy(*by)
    dic = (long.select(*by, "feature_id").distinct()
           .withColumn("pos", F.row_number().over(w.orderBy("feature_id")))
           .withColumn("p", F.count("*").over(w)))
    if prefix is not None:
        names = F.create_map(*[F.lit(x) for kv in prefix.items() for x in kv])
        dic = dic.withColumn("short_name", F.concat(F.try_element_at(names, F.col("modality")), "pos"))
    return dic


def assemble(long: DataFrame, dictionary: DataFrame, ids=("sample_id",),
             by=("modality",)) -> DataFrame:
    """Long to vector; a feature that a sample lacks becomes NULL at its position.

    A sample with two rows for one feature is an error.
    """
    on = [*by, "feature_id"]
    pairs = F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "value"))
    grouped = (long.join(beside(dictionary.select(*on, "pos", "p")), on)
               .groupBy(*by, *ids).agg(pairs.alias("pairs"), F.max("p").cast("int").alias("p")))
    value = grouped.schema["pairs"].dataType.elementType["value"].dataType
    have = F.transform("pairs", lambda x: x["pos"])
    gaps = F.transform(F.array_except(F.sequence(F.lit(1), F.col("p")), have),
                       lambda i: F.struct(i.alias("pos"), F.lit(None).cast(value).alias("value")))
    # Positions, not counts, decide what is missing: a repeated feature must not hide a missing one.
    whole = F.transform(F.array_sort(F.concat("pairs", gaps)), lambda x: x["value"])
    repeated = F.raise_error(F.lit("a sample has two rows for one feature")).cast(T.ArrayType(value))
    return grouped.select(*by, *ids, F.when(F.size(F.array_distinct(have)) < F.size("pairs"), repeated)
                          .otherwise(whole).alias("features"))


def explode_vec(vectors: DataFrame, dictionary: DataFrame, ids=("sample_id",),
                by=("modality",)) -> DataFrame:
    flat = vectors.select(*by, *ids, F.posexplode("features").alias("pos0", "value"))
    return (flat.withColumn("pos", F.col("pos0") + 1)
            .join(dictionary.select(*by, "feature_id", "pos"), [*by, "pos"])
            .select(*by, *ids, "feature_id", "value"))


def complete_features(long: DataFrame, n_samples, by=("modality",)) -> DataFrame:
    """Keep features that have a finite value for every sample."""
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    keep = (long.groupBy(*by, "feature_id").agg(F.count_if(finite).alias("n"))
            .where(F.col("n") == n_samples).select(*by, "feature_id"))
    return select_features(long, keep)


def join_modalities(long: DataFrame, modalities, ids=("sample_id",)) -> DataFrame:
    """Rows of the samples that have every listed modality (inner join in long form)."""
    long = long.where(F.col("modality").isin(list(modalities)))
    whole = (long.groupBy(*ids).agg(F.collect_set("modality").alias("m"))
             .where(F.size("m") == len(modalities)).select(*ids))
    return long.join(whole, list(ids), "left_semi")


def common_features(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stack two sample blocks over the features both have."""
    shared = a.select("feature_id").distinct().join(
        b.select("feature_id").distinct(), "feature_id", "left_semi")
    return select_features(a.unionByName(b), shared)


def concat_vectors(vectors: DataFrame, modalities, ids=("sample_id",), within=()) -> DataFrame:
    """Concatenate the modality vectors of a sample in the listed order (inner join).

    ``within`` names those of ``ids`` that make an experiment: a modality without any vector in one
    (none of its features was kept) is an empty vector there, so the experiment does not vanish.
    """
    order = F.array_position(F.array(*[F.lit(m) for m in modalities]), F.col("modality"))
    parts = F.array_sort(F.collect_list(F.struct(order.alias("o"), "features")))
    listed = vectors.where(F.col("modality").isin(list(modalities)))
    whole = listed.groupBy(*ids).agg(parts.alias("parts"))
    if within:
        present = listed.select(*within, "modality").distinct().groupBy(*within).agg(F.count("*").alias("_need"))
        whole = null_safe_join(whole, present, within)
    else:
        whole = whole.withColumn("_need", F.lit(len(modalities)))
    return (whole.where(F.size("parts") == F.col("_need"))
            .select(*ids, F.flatten(F.transform("parts", lambda x: x["features"])).alias("features")))


def attach_outcome(df: DataFrame, cohort: DataFrame, clinical: DataFrame = None) -> DataFrame:
    out = df.join(cohort, "sample_id")
    return out if clinical is None else out.join(clinical, "sample_id")


def map_probes_to_genes(long: DataFrame, annot: DataFrame, by=("sample_id",)) -> DataFrame:
    """Mean value per first-listed gene and sample; probes without a gene drop out.

    ``annot(feature_id, genes)`` holds lists such as 'A;B;C'.
    """
    gene = annot.select("feature_id", F.regexp_replace("genes", ";.*$", "").alias("gene"))
    return (long.join(gene.where(F.col("gene") != ""), "feature_id")
            .groupBy(*by, F.col("gene").alias("feature_id")).agg(F.avg("value").alias("value")))
