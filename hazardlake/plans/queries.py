"""The registered queries: every operator run over the given tables."""

from pyspark.sql import functions as F

from hazardlake.functions import scalar as S
from hazardlake.operators import clean as C
from hazardlake.operators import cluster as K
from hazardlake.operators import coxnet
from hazardlake.operators import diff as D
from hazardlake.operators import layout as L
from hazardlake.operators import quality as Q
from hazardlake.operators import reduce as R
from hazardlake.operators import report as T
from hazardlake.operators import sampling as E
from hazardlake.operators import survival as V
from hazardlake.operators.nbwald import nb_wald
from hazardlake.plans import cohort as M
from hazardlake.plans import experiment as P
from hazardlake.plans import subtypes as B
from hazardlake.sources import fixtures as X
from hazardlake.sources.tables import cut_lineage, finished_stage, read_csv, read_tsv, scratch_folder, stored, write_results

QUERIES = {}
DIGITS = 6


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df, *cols, digits=DIGITS):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def whole(df, *cols):
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


def size_of(df):
    return df.agg(F.count("*")).scalar()


# Survival ---------------------------------------------------------------------------------------

@query
def cohort(spark, sf):
    return whole(X.cohort(spark, sf), "time", "event")


@query
def km_by_group(spark, sf):
    out = V.kaplan_meier(X.cohort(spark, sf), ["subtype"])
    return whole(rounded(out, "survival", "lower", "upper"), "time", "n_risk", "n_event")


@query
def logrank_by_group(spark, sf):
    return rounded(V.logrank(X.cohort(spark, sf), "subtype"), "chi2").select("chi2")


@query
def logrank_components(spark, sf):
    c = X.cohort(spark, sf).join(X.clinical(spark, sf).select("sample_id", "segment"), "sample_id")
    return rounded(V.logrank_components(c, "segment"), "expected", "v")


@query
def logrank_p_value(spark, sf):
    c = X.cohort(spark, sf).join(X.clinical(spark, sf).select("sample_id", "segment"), "sample_id")
    return rounded(rounded(V.logrank(c, "segment"), "chi2"), "p", digits=9)


@query
def cox_screen(spark, sf):
    out = V.cox_screen(X.dense(spark, sf), X.cohort(spark, sf))
    return rounded(out, "u", "v", "chi2").select("feature_id", "u", "v", "chi2")


@query
def cox_screen_p(spark, sf):
    out = V.cox_screen(X.dense(spark, sf), X.cohort(spark, sf))
    return rounded(out, "p", digits=9).select("feature_id", "p")


@query
def cox_screen_topn_per_fold(spark, sf):
    folds = E.stratified_folds(X.cohort(spark, sf), ["subtype"], 5)
    screen = V.cox_screen_cv(X.dense(spark, sf), folds, 5)
    top = V.screen_select(screen, 10, ["cv", "modality"])
    return whole(rounded(top, "chi2"), "cv").select("cv", "feature_id", "chi2")


@query
def cox_screen_one_subtype(spark, sf):
    """Training rows from the first subtype only."""
    folds = E.stratified_folds(X.cohort(spark, sf), ["subtype"], 5)
    out = V.cox_screen_cv(X.dense(spark, sf), folds, 5, train_filter=F.col("subtype") == X.SUBTYPES[0])
    return whole(rounded(out, "chi2"), "cv").select("cv", "feature_id", "chi2")


def _fixed_coefs(long):
    """Coefficients known in advance: a function of the feature number."""
    i = F.substring("feature_id", 2, 2).cast("double")
    return long.select("feature_id").distinct().withColumn("coef", (i - 31.5) / 100.0)


@query
def linear_predictor(spark, sf):
    x = X.dense(spark, sf)
    return rounded(V.cox_predict(x, _fixed_coefs(x)), "score")


@query
def concordance_by_subtype(spark, sf):
    x = X.dense(spark, sf)
    df = V.cox_predict(x, _fixed_coefs(x)).withColumn("score", F.round("score", 9))
    return rounded(V.concordance(df.join(X.cohort(spark, sf), "sample_id"), ["subtype"]), "cindex")


@query
def concordance_all(spark, sf):
    """Whole cohort in one group, with many equal scores."""
    c = X.cohort(spark, sf).join(X.clinical(spark, sf), "sample_id")
    return rounded(V.concordance(c.withColumn("score", F.floor(F.col("acctbal") / 500))), "cindex")


# Cleaning, cohort and keys ----------------------------------------------------------------------

@query
def null_sentinels(spark, sf):
    c = C.null_sentinels(X.clinical(spark, sf), {"stage": ["4-NOT SPECIFIED"]})
    return c.groupBy("stage").agg(F.count("*").alias("n"))


@query
def null_rare(spark, sf):
    p = X.table(spark, sf, "part").select("p_partkey", "p_name")
    out = C.null_rare(p, "p_name", 30)
    return out.groupBy("p_name").agg(F.count("*").alias("n"))


@query
def label_encode(spark, sf):
    c = C.null_sentinels(X.clinical(spark, sf), {"stage": ["4-NOT SPECIFIED"]})
    return whole(C.label_encode(c, ["nation", "region", "stage"]), "nation", "region", "stage").select(
        "sample_id", "nation", "region", "stage")


@query
def recode_groups(spark, sf):
    o = X.table(spark, sf, "orders")
    names = {"F": "Dead", "O": "Alive"}
    return (o.select(S.recode("o_orderstatus", names).alias("status"),
                     F.concat(F.lit("run-"), "o_orderpriority").alias("label"))
            .groupBy("status", "label").agg(F.count("*").alias("n")))


@query
def survival_time(spark, sf):
    """Death day if the last order is final, else last follow-up; status text to event flag."""
    f = X.follow_up(spark, sf).select(
        X.sample_id("o_custkey"),
        F.when(F.col("status") == "F", F.col("time")).alias("days_to_death"),
        F.when(F.col("status") != "F", F.col("time") + 1).alias("days_to_last_follow_up"),
        F.when(F.col("status") == "F", "Dead").when(F.col("status") == "O", "Alive").alias("vital_status"))
    return f.select("sample_id", S.survival_time().cast("bigint").alias("time"),
                    S.event_flag().cast("bigint").alias("event"))


@query
def build_cohort(spark, sf):
    """Raw specimens to one analysed row per eligible sample."""
    out = C.build_cohort(X.specimens(spark, sf), X.eligible(spark, sf))
    return whole(out, "stage", "prior_malignancy", "n", "m", "t", "gender", "synchronous_malignancy", "subtype_code", "age_at_index", "time", "event")


@query
def methylation_flow(spark, sf):
    """Raw probes to the methylation table of the cohort."""
    cohort = X.cohort(spark, sf).withColumn("sample_id", X.barcode(F.col("sample_id").cast("bigint")))
    out = M.methylation(X.probes(spark, sf), X.eligible(spark, sf), cohort, X.probe_annotation(spark, sf), cut=0.6, k=8)
    return rounded(out, "value")


@query
def text_round_trip(spark, sf):
    """Clinical rows written as CSV and TSV and as a finished stage, read back by a fixed schema."""
    folder = scratch_folder(spark)
    rows = X.specimens(spark, sf)
    schema = rows.schema
    write_results(rows, f"{folder}/csv")
    write_results(read_csv(spark, f"{folder}/csv", schema), f"{folder}/tsv", "tsv")
    inputs = [f"{sf}/{t}.parquet" for t in ("customer", "orders", "nation")]
    out = finished_stage(spark, folder, "clinical", inputs, {"format": "tsv"}, lambda: read_tsv(spark, f"{folder}/tsv", schema))
    return whole(out, "age_at_index", "days_to_death", "days_to_last_follow_up")


@query
def five_year_groups(spark, sf):
    g = C.five_year_groups(X.cohort(spark, sf), 1825)
    return whole(g.select("sample_id", "time", "group_label"), "time")


@query
def volume_product(spark, sf):
    p = X.table(spark, sf, "part")
    dims = p.select("p_partkey", F.col("p_size").cast("double").alias("a"), "p_retailprice",
                    F.nullif(F.col("p_size") % 7, F.lit(0)).cast("double").alias("b"))
    return rounded(dims.select("p_partkey", S.volume("a", "b", "p_retailprice").alias("volume")), "volume")


@query
def barcode_substring(spark, sf):
    c = X.table(spark, sf, "customer").select(S.barcode("c_name", 15).alias("barcode"))
    return c.groupBy("barcode").agg(F.count("*").alias("n"))


@query
def split_nth(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", S.nth_part("url", "/", 4).alias("part"))


@query
def regex_strip(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", S.first_of_list("url", "[?#]").alias("first"))


@query
def cast_numeric(spark, sf):
    o = X.table(spark, sf, "orders").select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("a"), F.col("o_orderstatus").alias("b"))
    return C.cast_numeric(o, ["a", "b"])


@query
def round_half_even(spark, sf):
    l = X.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    return l.select("l_suppkey", F.bround(F.col("q") / 8.0, 2).alias("v"),
                    F.round(F.sqrt(F.abs(F.col("n") - 100).cast("double")), 6).alias("root"))


@query
def first_per_key(spark, sf):
    l = X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    out = C.first_per_key(l, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
    return whole(out, "l_linenumber")


@query
def first_column_per_name(spark, sf):
    """First of several specimens per (sample, feature)."""
    l, o = X.table(spark, sf, "lineitem"), X.table(spark, sf, "orders")
    rows = (l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(X.sample_id("o_custkey"), F.col("l_returnflag").alias("feature_id"),
                    "l_orderkey", "l_linenumber", F.col("l_quantity").alias("value")))
    return C.first_per_key(rows, ["sample_id", "feature_id"], ["l_orderkey", "l_linenumber"]).select(
        "sample_id", "feature_id", "value")


@query
def symmetric_difference(spark, sf):
    o = X.table(spark, sf, "orders")
    a = o.where(F.col("o_orderstatus") == "F").select("o_custkey")
    b = o.where(F.col("o_orderpriority") == "1-URGENT").select("o_custkey")
    return C.symmetric_difference(a, b, "o_custkey")


@query
def first_match_lookup(spark, sf):
    p = X.table(spark, sf, "part")
    brands = p.select("p_brand").distinct()
    symbols = p.select("p_brand", "p_partkey", "p_name")
    return C.first_match_lookup(brands, symbols, "p_brand", ["p_partkey"])


@query
def subtype_crosstab(spark, sf):
    c = X.cohort(spark, sf).join(X.clinical(spark, sf), "sample_id")
    return C.crosstab(c, "subtype", "region")


@query
def set_operations(spark, sf):
    """Intersection and difference of two sample lists."""
    o, e = X.table(spark, sf, "orders"), X.table(spark, sf, "events")
    a, b = o.select(X.sample_id("o_custkey")).distinct(), e.select(X.sample_id("user_id")).distinct()
    both = a.join(b, "sample_id", "left_semi").withColumn("side", F.lit("both"))
    return both.unionByName(a.join(b, "sample_id", "left_anti").withColumn("side", F.lit("first")))


@query
def union_fill(spark, sf):
    """Union by name; columns one side lacks are NULL."""
    s = X.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = X.table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query
def stratified_folds(spark, sf):
    return whole(E.stratified_folds(X.cohort(spark, sf), ["subtype"], 5), "fold").select(
        "sample_id", "subtype", "fold")


@query
def fold_roles(spark, sf):
    folds = E.stratified_folds(X.cohort(spark, sf), ["subtype"], 5)
    roles = E.with_roles(folds, 5, F.col("subtype") == X.SUBTYPES[1])
    return whole(roles.groupBy("cv", "role", "subtype").agg(
        F.count("*").alias("n"), F.sum("event").alias("events")), "cv", "events")


# Quality control --------------------------------------------------------------------------------

@query
def zero_filter(spark, sf):
    out = Q.filter_zero_fraction(X.brand(spark, sf), size_of(X.cohort(spark, sf)), 0.2)
    return rounded(out.groupBy("feature_id").agg(F.sum("value").alias("total")), "total")


@query
def missing_feature_filter(spark, sf):
    out = Q.filter_missing_features(X.discount(spark, sf), size_of(X.cohort(spark, sf)), 0.23)
    return out.groupBy("feature_id").agg(F.count("value").alias("n"))


@query
def missing_sample_filter(spark, sf):
    out = Q.filter_missing_samples(X.discount(spark, sf), 0.2)
    return out.groupBy("sample_id").agg(F.count("value").alias("n"))


@query
def top_variance(spark, sf):
    out = Q.top_variance(X.brand(spark, sf), 10)
    return rounded(out.groupBy("feature_id").agg(F.var_samp("value").alias("var")), "var")


def _brand_types(spark, sf):
    return C.first_per_key(X.table(spark, sf, "part").select(
        F.col("p_brand").alias("probe_id"), "p_partkey", F.col("p_type").alias("island_relation")),
        ["probe_id"], ["p_partkey"])


@query
def annotation_filter(spark, sf):
    out = Q.filter_annotation(X.brand(spark, sf), _brand_types(spark, sf), "PROMO")
    return rounded(out.groupBy("feature_id").agg(F.avg("value").alias("mean")), "mean")


@query
def feature_split(spark, sf):
    ids = (X.table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature_id"))
           .agg(F.avg("p_size").alias("size")).where(F.col("size") > 25).select("feature_id"))
    listed, other = Q.split_features(X.brand(spark, sf), ids)
    both = listed.withColumn("side", F.lit("listed")).unionByName(other.withColumn("side", F.lit("other")))
    return rounded(both.groupBy("side", "feature_id").agg(F.sum("value").alias("total")), "total")


@query
def prefix_select(spark, sf):
    """Name selection ignores case; exclusion by substring."""
    out = L.select_features(X.brand(spark, sf), prefix="brand#1")
    out = L.select_features(out, contains="9", exclude=True)
    return rounded(out.groupBy("feature_id").agg(F.sum("value").alias("total")), "total")


@query
def zscore_by_role(spark, sf):
    folds = E.stratified_folds(X.cohort(spark, sf), ["subtype"], 5)
    rows = X.dense(spark, sf).join(E.with_roles(folds, 5).select("cv", "role", "sample_id"), "sample_id")
    out = rounded(Q.zscore(rows, ["cv", "role", "modality"]), "value")
    return whole(out, "cv").select("cv", "role", "sample_id", "feature_id", "value")


@query
def zscore_train_reference(spark, sf):
    """Mean and sd from training rows, applied to all rows of the experiment."""
    folds = E.stratified_folds(X.cohort(spark, sf), ["subtype"], 5)
    rows = X.brand(spark, sf).join(E.with_roles(folds, 5).select("cv", "role", "sample_id"), "sample_id")
    out = Q.zscore(rows, ["cv", "role", "modality"], F.col("role") == "train")
    return whole(rounded(out.groupBy("cv", "role", "feature_id").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")), "mean", "sd"), "cv")


@query
def median_impute_by_role(spark, sf):
    folds = E.stratified_folds(X.cohort(spark, sf), ["subtype"], 5).select("sample_id", "fold")
    rows = X.discount(spark, sf).join(folds, "sample_id")
    out = rounded(Q.impute_median(rows, ["fold", "modality"]), "value")
    return whole(out, "fold").select("fold", "sample_id", "feature_id", "value")


@query
def complete_features(spark, sf):
    out = L.complete_features(X.dense(spark, sf).unionByName(X.activity(spark, sf)),
                              size_of(X.dense(spark, sf).select("sample_id").distinct()))
    return out.groupBy("modality", "feature_id").agg(F.count("*").alias("n"))


# Corruption -------------------------------------------------------------------------------------

@query
def corrupt_zeros(spark, sf):
    return rounded(E.corrupt_zeros(X.dense(spark, sf), 0.3, 5), "value").select(
        "sample_id", "feature_id", "value")


@query
def corrupt_gaussian(spark, sf):
    return rounded(E.corrupt_gaussian(X.dense(spark, sf), 0.5, 5), "value").select(
        "sample_id", "feature_id", "value")


# Layout and joins -------------------------------------------------------------------------------

@query
def unpivot_modality(spark, sf):
    l = X.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("sample_id")).agg(
        F.avg("l_tax").alias("tax"), F.avg("l_discount").alias("discount"))
    return rounded(L.to_long(l, ["sample_id"], ["tax", "discount"]), "value")


@query
def pivot_modality(spark, sf):
    kinds = ["click", "error", "purchase", "signup", "view"]
    return rounded(L.to_wide(X.activity(spark, sf), ["sample_id"], kinds), *kinds)


@query
def feature_dictionary(spark, sf):
    rows = X.brand(spark, sf).unionByName(X.activity(spark, sf))
    dic = L.feature_dictionary(rows, prefix={"brand": "Gene Expression", "activity": "miRNA"})
    return whole(dic, "pos", "p")


@query
def assemble_explode(spark, sf):
    """Long to vectors and back."""
    rows = X.discount(spark, sf)
    dic = L.feature_dictionary(rows)
    back = L.explode_vec(L.assemble(rows, dic), dic)
    return rounded(back, "value").select("sample_id", "feature_id", "value")


@query
def join_modalities(spark, sf):
    rows = X.brand(spark, sf).unionByName(X.activity(spark, sf)).unionByName(X.dense(spark, sf))
    out = L.join_modalities(rows, ["brand", "activity", "dense"])
    return rounded(out.groupBy("sample_id", "modality").agg(
        F.count("value").alias("n"), F.sum("value").alias("total")), "total")


@query
def common_features(spark, sf):
    """Two sample blocks stacked over the features both have."""
    x = X.activity(spark, sf).join(X.cohort(spark, sf).select("sample_id", "subtype"), "sample_id")
    a = x.where((F.col("subtype") == X.SUBTYPES[0]) & (F.col("feature_id") != "view"))
    b = x.where((F.col("subtype") == X.SUBTYPES[1]) & (F.col("feature_id") != "click"))
    return rounded(L.common_features(a, b), "value").select("sample_id", "subtype", "feature_id", "value")


@query
def attach_outcome(spark, sf):
    out = L.attach_outcome(X.activity(spark, sf), X.cohort(spark, sf),
                           X.clinical(spark, sf).select("sample_id", "region"))
    return whole(rounded(out, "value"), "time", "event").select(
        "sample_id", "feature_id", "value", "time", "event", "region")


@query
def combo_grid(spark, sf):
    """Features of every late and early combination."""
    short = {"LNC": X.discount, "miRNA": X.activity, "Gene": X.brand, "Meth": X.dense}
    rows = None
    for name, source in short.items():
        part = source(spark, sf).withColumn("modality", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    clin = X.clinical(spark, sf).select(F.lit("Clin").alias("modality"), "sample_id",
                                        F.lit("acctbal").alias("feature_id"), F.col("acctbal").alias("value"))
    rows = rows.unionByName(clin)
    out = None
    for kind, combos in (("late", E.late_combos()), ("early", E.early_combos())):
        part = E.expand_combos(rows, E.combo_table(spark, combos)).groupBy("combo").agg(
            F.count("value").alias("n"), F.count_distinct("modality", "feature_id").alias("features"))
        part = part.withColumn("integration", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


# Differential analysis --------------------------------------------------------------------------

def _beta(spark, sf):
    """Mean discounts scaled into (0, 1); the ends give no finite M-value."""
    return X.discount(spark, sf).withColumn("value", F.col("value") * 10.0)


@query
def beta_to_m(spark, sf):
    return rounded(_beta(spark, sf).withColumn("value", S.beta_to_m("value")), "value").select(
        "sample_id", "feature_id", "value")


def _gene_annot(spark, sf):
    """Probe to gene list: brand to 'type;name' of its first part, some without a gene."""
    p = C.first_per_key(X.table(spark, sf, "part").select("p_brand", "p_partkey", "p_type", "p_name", "p_size"),
                        ["p_brand"], ["p_partkey"])
    genes = F.when(F.col("p_size") < 10, "").otherwise(F.concat("p_type", F.lit(";"), "p_name"))
    return p.select(F.col("p_brand").alias("feature_id"), genes.alias("genes"))


@query
def collapse_to_gene(spark, sf):
    out = L.map_probes_to_genes(X.brand(spark, sf), _gene_annot(spark, sf))
    return rounded(out, "value")


@query
def methylation_by_gene(spark, sf):
    """Beta values from quantities; probes with a non-finite M-value in any sample drop out."""
    beta = X.brand(spark, sf).withColumn("value", (F.col("value") + 1.0) / 400.0)
    out = D.methylation_by_gene(beta, _gene_annot(spark, sf), size_of(X.cohort(spark, sf)))
    return rounded(out, "value")


def _groups(spark, sf):
    bad = X.cohort(spark, sf).where(F.col("subtype") == X.SUBTYPES[0])
    return D.two_groups(X.cohort(spark, sf), bad)


@query
def two_groups(spark, sf):
    return _groups(spark, sf).groupBy("grp").agg(F.count("*").alias("n"), F.sum("event").cast("bigint").alias("events"))


@query
def anova_by_feature(spark, sf):
    out = D.anova_by_feature(X.dense(spark, sf), _groups(spark, sf))
    return rounded(out.drop("p"), "sum_sq", "mean_sq", "f_value")


@query
def anova_many_groups(spark, sf):
    g = X.clinical(spark, sf).select("sample_id", F.col("region").alias("grp"))
    return rounded(D.anova_by_feature(X.brand(spark, sf), g).drop("p"), "sum_sq", "mean_sq", "f_value", digits=4)


@query
def anova_p_values(spark, sf):
    """Five groups, so four degrees of freedom."""
    g = X.clinical(spark, sf).select("sample_id", F.col("region").alias("grp"))
    return rounded(D.anova_by_feature(X.brand(spark, sf), g), "p", digits=9).select("feature_id", "df", "df_resid", "p")


@query
def mean_difference(spark, sf):
    return rounded(D.mean_difference(X.dense(spark, sf), _groups(spark, sf)), "mean_difference", "abs_difference")


@query
def differential_methylation(spark, sf):
    out = D.differential_methylation(X.dense(spark, sf), _groups(spark, sf), adjust=True)
    return rounded(rounded(out, "mean_difference", "sum_sq", "mean_sq", "f_value"), "p", "padj", digits=9)


def _p_values(spark, sf):
    """One p-like number in (0, 1) per part and type, with ties."""
    p = X.table(spark, sf, "part")
    return p.select("p_partkey", "p_type", (F.col("p_size") / 51.0 * ((F.col("p_partkey") % 97) + 1) / 98.0).alias("p"))


@query
def bh_adjust(spark, sf):
    return rounded(D.bh_adjust(_p_values(spark, sf), "p"), "padj", digits=9).select("p_partkey", "padj")


@query
def bh_adjust_by_type(spark, sf):
    out = D.bh_adjust(_p_values(spark, sf), "p", ["p_type"])
    return rounded(out, "padj", digits=9).select("p_partkey", "p_type", "padj")


@query
def volcano_label(spark, sf):
    c = X.table(spark, sf, "customer").select(
        "c_custkey", (F.col("c_acctbal") / 5000.0 - 1).alias("log2_fold_change"),
        F.nullif((F.col("c_custkey") % 20) / 100.0, F.lit(0.1)).alias("padj"))
    out = c.withColumn("diffexpressed", S.volcano_label())
    return out.select("c_custkey", "diffexpressed",
                      F.round(S.neg_log10(F.col("padj") + 0.001), 6).alias("neg_log10_p"))


@query
def size_factors(spark, sf):
    return rounded(D.size_factors(X.counts(spark, sf)), "size_factor")


@query
def nb_wald_test(spark, sf):
    return nb_wald(X.counts(spark, sf), X.count_groups(spark, sf))


@query
def differential_expression(spark, sf):
    symbols = X.table(spark, sf, "part").select(F.col("p_brand").alias("feature_id"), F.col("p_name").alias("symbol"))
    return B.differential_expression(X.counts(spark, sf), X.count_groups(spark, sf), symbols)


# Reports ----------------------------------------------------------------------------------------

def _mock_results(spark, sf):
    """Fold results derived from orders: one row per priority, status and year."""
    o = X.table(spark, sf, "orders")
    fold = (F.year("o_orderdate") % 5 + 1).cast("int")
    names = {"1-URGENT": "Meth-Clin-LNC", "2-HIGH": "Gene-LNC-Clin-miRNA", "3-MEDIUM": "Gene Expression",
             "4-NOT SPECIFIED": "Multimodal (Early)", "5-LOW": "LNC RNAs"}
    kinds = {"F": "One AE", "O": "Feature Selection", "P": "PCA"}
    score = lambda c: F.avg(F.col("o_totalprice") % c) / c
    return (o.groupBy(fold.alias("fold"), S.recode("o_orderpriority", names).alias("data_types"),
                      S.recode("o_orderstatus", kinds).alias("reduction"))
            .agg(score(1000.0).alias("cindex"), score(700.0).alias("cindex_a"), score(300.0).alias("cindex_b")))


@query
def results_mean_se(spark, sf):
    out = C.mean_se(_mock_results(spark, sf), ["data_types", "reduction"], ["cindex", "cindex_a", "cindex_b"])
    num = [c for c in out.columns if "cindex" in c]
    return rounded(out, *num)


@query
def results_unpivot(spark, sf):
    return rounded(T.summarise_results(_mock_results(spark, sf), digits=6), "se")


@query
def canonical_combo(spark, sf):
    return rounded(T.all_combinations(_mock_results(spark, sf)).withColumn("cindex", F.round("cindex", 2)), "se")


@query
def report_comparisons(spark, sf):
    s = T.ordered(T.summarise_results(_mock_results(spark, sf), digits=6))
    out = None
    for kind in ("individual", "two_omics", "best", "containing", "integration"):
        part = T.compare(s, kind, k=3).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return whole(rounded(out, "se"), "place")


@query
def report_reductions(spark, sf):
    r = _mock_results(spark, sf)
    runs = {k: r.where(F.col("reduction") == k) for k in ("PCA", "Feature Selection", "One AE")}
    return whole(rounded(T.compare_reductions(runs, digits=6), "se"), "method_order")


# Models -----------------------------------------------------------------------------------------

def dense_vectors(spark, sf):
    rows = X.dense(spark, sf)
    return L.assemble(rows, L.feature_dictionary(rows))


@query
def silhouette(spark, sf):
    """Rows clustered by the label that the embeddings carry."""
    lab = X.table(spark, sf, "embeddings").select(X.sample_id("vec_id"), F.col("label").cast("int").alias("cluster"))
    out = K.silhouette(dense_vectors(spark, sf).join(lab, "sample_id"))
    return rounded(whole(out, "cluster"), "silhouette").select("sample_id", "cluster", "silhouette")


@query
def kmeans_best_k(spark, sf):
    v = cut_lineage(dense_vectors(spark, sf).select("sample_id", "features"))
    return K.best_k(v, K.kmeans(v, range(1, 11), 25, 10))


@query
def survival_subtypes(spark, sf):
    """Clusters of the samples with the survival curve of each."""
    return B.survival_subtypes(dense_vectors(spark, sf), X.cohort(spark, sf))["curves"]


@query
def subtype_labels(spark, sf):
    out = B.survival_subtypes(dense_vectors(spark, sf), X.cohort(spark, sf), choose_restarts=25)
    return out["labels"].select("sample_id", "subtype", "cluster", "prognosis")


@query
def pca_project(spark, sf):
    v = dense_vectors(spark, sf).withColumn("grp", F.col("modality"))
    return R.pca_project(v, R.pca_fit(v, 10)).select("sample_id", F.posexplode("features").alias("pc", "score"))


@query
def pca_plot_table(spark, sf):
    rows = X.dense(spark, sf).unionByName(X.brand(spark, sf)).unionByName(X.discount(spark, sf))
    return P.pca_plot_table(rows, X.cohort(spark, sf))


@query
def dae_encode(spark, sf):
    rows = Q.zscore(X.dense(spark, sf))
    dic = L.feature_dictionary(rows)
    noisy = L.assemble(E.corrupt_zeros(rows), dic).withColumn("grp", F.col("modality"))
    clean = L.assemble(rows, dic).select("sample_id", F.col("features").alias("target"))
    pairs = cut_lineage(noisy.join(clean, "sample_id"))
    fit = R.dae_fit(pairs, 16)
    return R.dae_encode(pairs, fit).select("sample_id", F.posexplode("features").alias("unit", "value"))


@query
def cox_elastic_net(spark, sf):
    train = dense_vectors(spark, sf).join(X.cohort(spark, sf), "sample_id").withColumn("grp", F.col("modality"))
    return coxnet.cox_elastic_net(train, nlambda=100, nfolds=10)[0]


@query
def cox_elastic_net_cv(spark, sf):
    train = dense_vectors(spark, sf).join(X.cohort(spark, sf), "sample_id").withColumn("grp", F.col("subtype"))
    return coxnet.cox_elastic_net(train, nlambda=100, nfolds=10)[1]


# Short names of the fixture modalities, in vector order, and sizes in proportion to their features.
NAMES = {"discount": "LNC", "activity": "miRNA", "brand": "Gene", "dense": "Meth", "clinical": "Clin"}
SCREENED = {"dense": 20, "brand": 20, "discount": 10, "activity": 5}
REDUCED = {"dense": 6, "brand": 6, "discount": 4, "activity": 2}


def clinical_features(spark, sf):
    cols = ["acctbal", "nation", "region", "segment", "stage"]
    c = C.null_sentinels(X.clinical(spark, sf), {"stage": ["4-NOT SPECIFIED"]})
    c = C.label_encode(c, cols[1:]).select("sample_id", *[F.col(x).cast("double").alias(x) for x in cols])
    return L.to_long(c, ["sample_id"], cols).select(
        F.lit("clinical").alias("modality"), "sample_id", "feature_id", "value")


def experiment(spark, sf, method, **options):
    cohort, dense, activity = cut_lineage(X.cohort(spark, sf)), X.dense(spark, sf), X.activity(spark, sf)
    # The study is of samples with every modality; brands and discounts are filled in for no others.
    samples = cut_lineage(cohort.join(dense, "sample_id", "left_semi").join(activity, "sample_id", "left_semi"))
    rows = dense.unionByName(X.brand(spark, sf, samples)).unionByName(X.discount(spark, sf, samples)).unionByName(activity)
    settings = dict(screen_sizes=SCREENED, reduced_sizes=REDUCED, early_size=10)
    return P.run_experiment(stored(rows), cut_lineage(clinical_features(spark, sf)), cohort, NAMES, method=method, **{**settings, **options})


@query
def clinical_modality(spark, sf):
    """Clinical variables encoded, scaled and imputed per experiment and role."""
    roles = E.with_roles(E.stratified_folds(X.cohort(spark, sf), ["subtype"], 5), 5)
    out = P.scaled_features(cut_lineage(clinical_features(spark, sf)), roles)
    return whole(rounded(out, "value"), "cv").select("cv", "role", "sample_id", "feature_id", "value")


@query
def late_integration(spark, sf):
    """Screen, autoencode, concatenate: singles, all modalities and every late combination."""
    return experiment(spark, sf, "screen+dae", early=False)["results"]


@query
def early_integration(spark, sf):
    """Concatenate screened features, reduce once, add clinical variables: every early combination."""
    out = experiment(spark, sf, "screen")["results"]
    return out.where(F.col("integration") == "early")


@query
def variant_screen_only(spark, sf):
    return experiment(spark, sf, "screen")["results"]


@query
def variant_pca(spark, sf):
    return experiment(spark, sf, "pca")["results"]


@query
def variant_autoencoder(spark, sf):
    return experiment(spark, sf, "dae")["results"]


@query
def autoencoder_loss(spark, sf):
    """Reconstruction error of train and test rows per fold and modality, Gaussian noise.

    No late combination is fitted: autoencoders are per modality, so they have no part in this table.
    """
    return experiment(spark, sf, "screen+dae", combos=False, early=False, noise="gaussian", level=0.5,
                      activation="tanh")["loss"]


@query
def train_one_subtype(spark, sf):
    """Training rows of one subtype, scores on both."""
    return experiment(spark, sf, "screen", early=False,
                      train_filter=F.col("subtype") == X.SUBTYPES[1])["results"]


@query
def feature_importance(spark, sf):
    # Models of other combinations have no part in the coefficients of the whole one.
    out = experiment(spark, sf, "screen", combos=False, early=False)["coefs"]
    named = out.where((F.col("lambda_at") == "min") & (F.col("mask") == "Multimodal (Late)")).select(
        F.col("grp").cast("int").alias("fold"), F.col("pos").cast("string").alias("feature_id"), "coef")
    return T.feature_importance(named, 5)


@query
def autoencoder_grid(spark, sf):
    """Reconstruction error of every activation, kind of noise and level, on all samples."""
    return P.autoencoder_grid(X.dense(spark, sf).unionByName(X.brand(spark, sf)), 16)


@query
def pca_run_coordinates(spark, sf):
    """First two components of one fold's training rows, without one modality."""
    rows = X.dense(spark, sf).unionByName(X.brand(spark, sf)).unionByName(X.discount(spark, sf))
    folded = E.stratified_folds(X.cohort(spark, sf), ["subtype"], 5)
    return T.pca_run(P.pca_coordinates(rows, X.cohort(spark, sf), E.with_roles(folded, 5)), 2, ["discount"])


@query
def subtypes_on_selected(spark, sf):
    """Clusters of the features that the elastic net keeps in one fold, against the disease."""
    out = experiment(spark, sf, "screen", combos=False, early=False)
    vectors = out["vectors"].where(F.col("grp") == "1").select("grp", "sample_id", "features")
    used = out["coefs"].where((F.col("grp") == "1") & (F.col("mask") == "Multimodal (Late)") & (F.col("lambda_at") == "min"))
    return B.survival_subtypes(vectors, X.cohort(spark, sf), used)["crosstab"]


# Raw matrices -----------------------------------------------------------------------------------

def specimens(spark, sf):
    """Raw matrix of orders (specimens of their customer, whose number fills 19 characters) and brands."""
    o, l, p = X.table(spark, sf, "orders"), X.table(spark, sf, "lineitem"), X.table(spark, sf, "part")
    person = F.lpad(F.col("o_custkey").cast("string"), 19, "0")
    name = F.concat(person, F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    bought = (l.join(p, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
              .select(person.alias("person"), name.alias("sample_id"), F.col("p_brand").alias("feature_id"), "l_quantity"))
    # One row per specimen, those of a sample in one file; zeros are filled in where the rows are read.
    long = bought.repartition("person").groupBy("person", "sample_id", "feature_id").agg(F.sum("l_quantity").alias("value"))
    entry = F.when(F.col("sample_id").isNotNull() & F.col("feature_id").isNotNull(), F.struct("feature_id", "value"))
    found = stored(long.groupBy("person", "sample_id").agg(
        F.map_from_entries(F.collect_list(entry)).alias("found"), F.collect_set("feature_id").alias("names")))
    brands = found.select(F.explode("names").alias("name")).agg(F.array_sort(F.collect_set("name"))).scalar()
    return (found.select("sample_id", "found", F.explode(brands).alias("feature_id"))
            .select("sample_id", "feature_id", F.coalesce(F.try_element_at("found", F.col("feature_id")), F.lit(0.0)).alias("value")))


@query
def raw_expression(spark, sf):
    """Specimens to samples, listed features out, features of many zeros out, cohort rows."""
    cohort = X.cohort(spark, sf).withColumn("sample_id", F.lpad("sample_id", 19, "0"))
    listed = (X.table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature_id"))
              .agg(F.avg("p_size").alias("size")).where(F.col("size") > 26))
    return M.expression(specimens(spark, sf), cohort.where(F.col("subtype") == "LUSC"), cohort.where(F.col("event") == 0), "mRNA",
                        listed, keep_list=False, cut=0.85)
