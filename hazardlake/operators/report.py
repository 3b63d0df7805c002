"""Report tables over fold results ``(fold, model, reduction, integration, data_types, cindex..)``."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.functions import scalar as S
from hazardlake.operators.clean import mean_se, top_n
from hazardlake.operators.sampling import COMBO_ORDER

# Labels used in result tables.
MULTIMODAL_LATE = "Multimodal (Late)"
MULTIMODAL_EARLY = "Multimodal (Early)"
SINGLES = ["Clinical", "miRNA", "mRNA", "Methylation", "LNC RNAs"]
SINGLE_NAMES = {"Clin": "Clinical", "miRNA": "miRNA", "Gene": "mRNA", "Meth": "Methylation", "LNC": "LNC RNAs"}
RELABEL = {
    "Gene Expression": "mRNA",
    "Multimodal": MULTIMODAL_LATE,
    "FullAE": MULTIMODAL_EARLY,
    "Full AE": MULTIMODAL_EARLY,
    "Full_LFS": MULTIMODAL_EARLY,
    "Full_PCA": MULTIMODAL_EARLY,
    "Meth-Gene-LNC-miRNA-Full": MULTIMODAL_EARLY,
}
ALL_MODALITIES = {
    "Multimodal": "Meth-Gene-LNC-miRNA-Clin",
    "Multi (No Clin)": "Meth-Gene-LNC-miRNA",
}


def canonical_combo(col="data_types"):
    """Combination name with its members in the fixed order; other labels stay as they are."""
    parts = F.split(S.recode(col, ALL_MODALITIES), "-")
    order = F.array(*[F.lit(m) for m in COMBO_ORDER])
    sorted_name = F.array_join(F.filter(order, lambda m: F.array_contains(parts, m)), "-")
    known = F.size(F.array_except(parts, order)) == 0
    return F.when(known, sorted_name).otherwise(F.col(col))


def summarise_results(results: DataFrame, subtypes=("LUSC", "LUAD"), digits: int = 2) -> DataFrame:
    """Mean and standard error over folds, one row per data type, reduction and subtype."""
    named = results.withColumn("data_types", S.recode("data_types", {"Gene Expression": "mRNA"}))
    keys = ["data_types", "reduction"]
    m = mean_se(named, keys, ["cindex_a", "cindex_b"])
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("subtype"), F.col(f"cindex_{x}").alias("cindex"),
                 F.col(f"se_cindex_{x}").alias("se")) for name, x in zip(subtypes, "ab")]))
    return m.select(*keys, rows.alias("r")).select(
        *keys, "r.subtype", F.bround("r.cindex", digits).alias("cindex"), "r.se")


def ordered(summary: DataFrame) -> DataFrame:
    """Adds the place of every bar inside its subtype facet, by concordance."""
    w = Window.partitionBy("subtype").orderBy("cindex", "data_types", "reduction")
    return summary.withColumn("place", F.row_number().over(w))


def compare(summary: DataFrame, kind: str, early_reduction="One AE", modality="LNC", k=5) -> DataFrame:
    """Row sets behind the comparison figures.

    'individual': single modalities and early multimodal; 'two_omics': singles and early pairs;
    'best': the k best combinations per subtype; 'containing': singles and early combinations that
    contain ``modality``; 'integration': early against late multimodal.
    """
    name, early = F.col("data_types"), F.col("reduction") == early_reduction
    combo = F.array_contains(F.split("data_types", "-"), F.lit(modality))
    if kind == "individual":
        out = summary.where(name.isin(SINGLES + [MULTIMODAL_EARLY]))
        return out.withColumn("data_types", S.recode("data_types", {MULTIMODAL_EARLY: "Multimodal"}))
    if kind == "two_omics":
        return summary.where(name.isin(SINGLES) | (early & (F.size(F.split("data_types", "-")) == 2)))
    if kind == "best":
        multi = summary.where(name.contains("-") | name.startswith("Multimodal"))
        return top_n(multi, [F.col("cindex").desc(), "data_types", "reduction"], k, ["subtype"])
    if kind == "containing":
        single = SINGLE_NAMES[modality]
        return summary.where((name == single) | (name == MULTIMODAL_LATE) | (early & combo))
    if kind == "integration":
        return summary.where(name.isin(MULTIMODAL_EARLY, MULTIMODAL_LATE))
    raise ValueError(kind)


def compare_reductions(runs: dict, digits: int = 2) -> DataFrame:
    """Early and late multimodal rows of several runs, tagged by their reduction method."""
    out = None
    for label, results in runs.items():
        part = summarise_results(results, digits=digits).withColumn("dimensionality_reduction", F.lit(label))
        out = part if out is None else out.unionByName(part)
    renamed = out.withColumn("data_types", S.recode("data_types", RELABEL))
    order = F.array(*[F.lit(x) for x in runs])
    return (renamed.where(F.col("data_types").isin(MULTIMODAL_EARLY, MULTIMODAL_LATE))
            .withColumn("method_order", F.array_position(order, F.col("dimensionality_reduction")).cast("int")))


def all_combinations(results: DataFrame) -> DataFrame:
    return summarise_results(results.withColumn("data_types", canonical_combo()))


def feature_importance(coefs: DataFrame, fold: int, names: dict = None) -> DataFrame:
    """Non-zero coefficients of one fold with display names, largest first."""
    out = coefs.where((F.col("coef") != 0) & (F.col("fold") == fold))
    return out.withColumn("variable", S.recode("feature_id", names or {})).orderBy(F.col("coef").desc(), "feature_id")


def pca_run(coordinates: DataFrame, fold: int, drop=()) -> DataFrame:
    return coordinates.where((F.col("fold") == fold) & ~F.col("modality").isin(list(drop)))
