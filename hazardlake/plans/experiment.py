"""The cross-validated experiment: select, reduce, integrate, fit, score.

Folds, modalities and combinations are columns, so each step is one job for all of them. Steps
that several later jobs read are cut to reliable storage.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake import schema
from hazardlake.operators import coxnet, reduce
from hazardlake.operators import layout as L
from hazardlake.operators import quality as Q
from hazardlake.operators import sampling as E
from hazardlake.operators import survival as V
from hazardlake.sources.tables import beside, cut_lineage, stored

# Label of a run's reduction, and of its early integration.
REDUCTIONS = {
    "screen+dae": ("Feature Selection+AE", "One AE"),
    "screen": ("Feature Selection", "Full_LFS"),
    "pca": ("PCA", "Full_PCA"),
    "dae": ("Autoencoder", "FullAE"),
}
IDS = ("role", "sample_id")


def scaled_features(long: DataFrame, roles: DataFrame) -> DataFrame:
    """Features per experiment, scaled and imputed apart for train and test rows."""
    keys = ["cv", "role", "modality"]
    if "cv" in long.columns:
        joined = long.join(roles.select("cv", "role", "sample_id"), ["cv", "sample_id"])
    else:  # a row per sample goes to the values, which stay in their partitions and are multiplied there
        lists = roles.groupBy("sample_id").agg(F.collect_list(F.struct("cv", "role")).alias("_in"))
        joined = long.join(beside(lists), "sample_id").select("*", F.inline("_in"))
    joined = joined.select(*keys, "sample_id", "feature_id", "value")
    return Q.impute_median(Q.zscore(joined, keys), keys).withColumn(
        "value", F.coalesce("value", F.lit(0.0)))


def screened(long: DataFrame, folded: DataFrame, k: int, sizes, train_filter=None):
    """(rows of the screened features per experiment, the screen with its rank)."""
    screen = cut_lineage(V.cox_screen_cv(long, folded, k, train_filter=train_filter))
    chosen = V.screen_select(screen, sizes, ["cv", "modality"]).select("cv", "modality", "feature_id")
    return long.join(chosen, ["modality", "feature_id"]), screen


def vectors_of(scaled: DataFrame) -> DataFrame:
    by = ("cv", "modality")
    return L.assemble(scaled, L.feature_dictionary(scaled, by), IDS, by)


def reduce_vectors(vectors: DataFrame, scaled: DataFrame, method: str, sizes: dict, ids,
                   activation="sigmoid", noise="zeros", level=0.3, epochs=100, seed=5):
    """Reduce the vectors of every ``grp``; returns (vectors, autoencoder loss table or None).

    ``scaled`` is the long form of the same vectors with ``grp``; it is corrupted for training.
    The encoder sees the corrupted rows in training and clean rows in testing.
    """
    train = vectors.where(F.col("role") == "train")
    if method == "pca":
        return reduce.pca_project(vectors, reduce.pca_fit(train, sizes), ids), None
    rows = scaled.where(F.col("role") == "train").select("grp", "sample_id", "feature_id", "value")
    noisy = (E.corrupt_zeros(rows, level, seed, ["grp"]) if noise == "zeros"
             else E.corrupt_gaussian(rows, level, seed, ["grp"]))
    corrupted = L.assemble(noisy, L.feature_dictionary(scaled, ("grp",)), ("sample_id",), ("grp",))
    pairs = cut_lineage(corrupted.join(
        train.select("grp", "sample_id", *[c for c in ids if c != "sample_id"],
                     F.col("features").alias("target")), ["grp", "sample_id"]))
    fit = reduce.dae_fit(pairs, sizes, activation, epochs=epochs, seed=seed)
    test = vectors.where(F.col("role") == "test")
    cols = list(dict.fromkeys(["grp", *ids, "features"]))
    coded = reduce.dae_encode(pairs.select(*cols).unionByName(test.select(*cols)), fit, ids)
    loss = (reduce.dae_loss(pairs, fit).withColumnRenamed("mse", "train_mse").join(
        reduce.dae_loss(test.withColumn("target", F.col("features")), fit)
        .withColumnRenamed("mse", "test_mse"), "grp"))
    return coded, loss


def _score(vectors, coefs, cohort, cohort_cols, by) -> DataFrame:
    """Concordance of test rows per model and mask, whole and per subtype."""
    test = vectors.where(F.col("role") == "test")
    scored = coxnet.predict_vectors(test, coefs).join(cohort, "sample_id").select(
        *by, "mask", "subtype", "time", "event", "score")
    a, b = cohort_cols
    levels = F.array(F.lit("all"), F.col("subtype"))
    parts = V.concordance(scored.withColumn("part", F.explode(levels)), [*by, "mask", "part"])
    pick = lambda v: F.max(F.when(F.col("part") == v, F.col("cindex")))
    return parts.groupBy(*by, "mask").agg(
        pick("all").alias("cindex"), pick(a).alias("cindex_a"), pick(b).alias("cindex_b"))


def run_experiment(long: DataFrame, clinical: DataFrame, cohort: DataFrame, names: dict,
                   method="screen+dae", k=5, screen_sizes=None, reduced_sizes=None,
                   early_size=schema.EARLY_SIZE, early=True, combos=True, subtypes=("LUSC", "LUAD"),
                   train_filter=None, alpha=0.5, nlambda=100, inner_folds=10, epochs=100,
                   activation="sigmoid", noise="zeros", level=0.3, seed=3) -> dict:
    """One run of the study.

    ``long`` holds the omics rows, ``clinical`` the encoded clinical rows, both as (modality,
    sample_id, feature_id, value); ``cohort(sample_id, time, event, subtype)``. ``names`` maps
    each modality (the clinical one too, as 'Clin') to its short name in combinations, in
    vector order. Returns the tables 'results', 'coefs', 'cv', 'loss', 'vectors'.
    """
    omics = [m for m, s in names.items() if s != "Clin"]
    clin = [m for m, s in names.items() if s == "Clin"]
    screen_sizes = screen_sizes or schema.SCREEN_SIZES
    reduced_sizes = reduced_sizes or schema.REDUCED_SIZES
    every = L.join_modalities(long.unionByName(clinical), omics + clin).select("sample_id").distinct()
    folded = cut_lineage(E.stratified_folds(
        cohort.join(every, "sample_id", "left_semi"), ["subtype"], k, seed))
    roles = E.with_roles(folded, k, train_filter)
    # Only samples of the study take part in what follows.
    long = stored(long.where(F.col("modality").isin(omics)).join(folded, "sample_id", "left_semi"))

    screen = None
    if method.startswith("screen"):
        rows, screen = screened(long, folded, k, screen_sizes, train_filter)
    else:
        rows = long
    scaled = scaled_features(rows, roles).withColumn("grp", F.concat_ws("|", "cv", "modality"))
    if method != "pca":  # which reads it once, for its vectors
        scaled = stored(scaled)
    clin_rows = scaled_features(clinical, roles)
    varying = clin_rows.where(F.col("role") == "train").groupBy("cv", "modality", "feature_id").agg(
        F.max(F.abs("value")).alias("m")).where(F.col("m") > 0).drop("m")
    clin_vectors = vectors_of(clin_rows.join(varying, ["cv", "modality", "feature_id"], "left_semi"))

    ids = ("cv", "modality", *IDS)
    sizes = {f"{cv}|{m}": reduced_sizes[m] for cv in range(1, k + 1) for m in omics}
    base = loss = None
    if method == "screen":
        best = V.screen_select(screen, reduced_sizes, ["cv", "modality"])
        reduced = vectors_of(scaled.join(best.select("cv", "modality", "feature_id"),
                                         ["cv", "modality", "feature_id"], "left_semi"))
    else:
        base = cut_lineage(vectors_of(scaled).withColumn("grp", F.concat_ws("|", "cv", "modality")))
        reduced, loss = reduce_vectors(base, scaled, "pca" if method == "pca" else "dae", sizes, ids,
                                       activation, noise, level, epochs)
    label, early_label = REDUCTIONS[method]

    # Late integration: one vector per sample, one feature mask per combination.
    parts = cut_lineage(reduced.select(*ids, "features").unionByName(
        clin_vectors.select(*ids, "features")))
    late = L.concat_vectors(parts, omics + clin, ("cv", *IDS), ("cv",)).withColumn("grp", F.col("cv").cast("string"))
    late = cut_lineage(late)
    width = {(r["cv"], r["modality"]): r["p"] for r in parts.groupBy("cv", "modality").agg(
        F.max(F.size("features")).alias("p")).collect()}
    late_train = late.where(F.col("role") == "train").join(cohort, "sample_id")
    coefs, cv = coxnet.cox_elastic_net(
        late_train, lambda grp: _late_masks(width, names, int(grp), combos), alpha, nlambda,
        nfolds=inner_folds)
    table = _score(late, coefs, cohort, subtypes, ["grp"])
    results = table.select(F.col("grp").cast("int").alias("fold"), F.lit("elastic net").alias("model"),
                           F.lit(label).alias("reduction"),
                           F.when(F.col("mask").isin(list(SINGLE_LABELS.values())), "single")
                           .otherwise("late").alias("integration"),
                           F.col("mask").alias("data_types"), "cindex", "cindex_a", "cindex_b")
    if early:
        e_results, e_loss = _early(scaled, base, clin_vectors, cohort, names, method, early_size, k, subtypes,
                                   combos, alpha, nlambda, inner_folds, epochs, activation, noise,
                                   level, screen_sizes, early_label)
        results = results.unionByName(e_results)
        if loss is not None and e_loss is not None:
            loss = loss.unionByName(e_loss)
    return {"results": results, "coefs": coefs, "cv": cv, "loss": loss, "vectors": late, "folds": folded}


# Data-type label of a single modality in the result table.
SINGLE_LABELS = {"Meth": "Methylation", "Gene": "Gene Expression", "LNC": "LNC RNAs",
                 "miRNA": "miRNA", "Clin": "Clinical"}


def _late_masks(width, names, cv, combos):
    """Feature positions of every combination in one fold, where blocks may have any width."""
    spans, at = {}, 0
    for m, short in names.items():
        n = width.get((cv, m), 0)  # no feature of it was kept in this fold
        spans[short] = range(at, at + n)
        at += n
    masks = {SINGLE_LABELS[s]: list(r) for s, r in spans.items()}
    masks["Multimodal (Late)"] = list(range(at))
    order = [s for s in E.COMBO_ORDER if s in spans]
    for c in E.late_combos(order) if combos else []:
        masks["-".join(c)] = [i for s in c for i in spans[s]]
    return masks


def _early(scaled, base, clin_vectors, cohort, names, method, size, k, subtypes, combos, alpha, nlambda,
           inner_folds, epochs, activation, noise, level, screen_sizes, label):
    """Concatenate features of a combination, scale again, reduce once, add clinical data, fit."""
    short = {s: m for m, s in names.items()}
    order = [s for s in E.COMBO_ORDER if s in short]
    wanted = E.early_combos(order) if combos else []
    whole = [s for s in order]
    listed = [("-".join(c), c) for c in wanted if c != whole] + [("Multimodal (Early)", whole)]
    if method in ("pca", "dae"):
        # These variants first reduce every modality to the screen size, then everything at once.
        ids = ("cv", "modality", *IDS)
        first = {f"{cv}|{m}": screen_sizes[m] for cv in range(1, k + 1) for m in screen_sizes}
        wide, _ = reduce_vectors(base, scaled, method, first, ids, activation, noise, level, epochs)
        flat = wide.select(*ids, F.posexplode("features").alias("pos", "value"))
        source = flat.select(*ids, F.col("pos").cast("string").alias("feature_id"), "value")
    else:
        source = scaled
    if method == "screen":
        return _early_screened(scaled, clin_vectors, cohort, listed, short, size, subtypes, alpha, nlambda, inner_folds, label), None
    sizes = {f"{cv}|{name}": size for cv in range(1, k + 1) for name, _ in listed}
    ids = ("grp", "cv", "combo", *IDS)
    loss = None
    if method == "pca":
        coded = _pca_of_combinations(stored(wide), {name: [short[s] for s in c if s != "Clin"] for name, c in listed}, sizes)
    else:
        coded, loss = _coded_rows(source, listed, short, sizes, ids, activation, noise, level, epochs)
    clin = [name for name, c in listed if "Clin" in c]
    with_clin = (coded.where(F.col("combo").isin(clin))
                 .join(clin_vectors.select("cv", *IDS, F.col("features").alias("extra")), ["cv", *IDS])
                 .select(*ids, F.concat("features", "extra").alias("features")))
    whole_set = stored(coded.where(~F.col("combo").isin(clin)).select(*ids, "features")
                       .unionByName(with_clin))
    train = whole_set.where(F.col("role") == "train").join(cohort, "sample_id")
    coefs, _ = coxnet.cox_elastic_net(train, None, alpha, nlambda, nfolds=inner_folds)
    table = _score(whole_set, coefs, cohort, subtypes, ["grp"])
    parts = F.split("grp", "\\|")
    return table.select(parts[0].cast("int").alias("fold"), F.lit("elastic net").alias("model"),
                        F.lit(label).alias("reduction"), F.lit("early").alias("integration"),
                        parts[1].alias("data_types"), "cindex", "cindex_a", "cindex_b"), loss


def _pca_of_combinations(wide, members, sizes):
    """Components of every combination, from vectors per modality that are scaled again and stored once per sample.

    A combination is a view of some positions of the concatenated vector; only its scores are written out.
    """
    order = sorted({m for c in members.values() for m in c})
    whole = L.concat_vectors(Q.zscore_vectors(wide, ["cv", "modality", "role"]), order, ("cv", *IDS), ("cv",))
    whole = stored(whole.withColumn("grp", F.col("cv").cast("string")))
    width = {(r["cv"], r["modality"]): r["p"] for r in wide.groupBy("cv", "modality").agg(F.max(F.size("features")).alias("p")).collect()}
    views = {}
    for name in sizes:
        cv, combo = name.split("|")
        spans, at = {}, 0
        for m in order:
            spans[m], at = range(at, at + width.get((int(cv), m), 0)), at + width.get((int(cv), m), 0)
        views[name] = (cv, [i for m in order if m in members[combo] for i in spans[m]])
    fit = reduce.pca_fit(whole.where(F.col("role") == "train"), sizes, views=views)
    coded = reduce.pca_project(whole, fit, ("cv", *IDS), views)
    return coded.withColumn("combo", F.split("grp", "\\|")[1])


def _early_screened(scaled, clin_vectors, cohort, listed, short, size, subtypes, alpha, nlambda, inner_folds, label):
    """Fits of the best features of every combination, which is a mask of vectors that all combinations of a fold share.

    A feature's test does not depend on the combination, so the rows are screened once and the tests are dealt to
    the combinations. Those with clinical data have vectors of their own: not every sample need have clinical features.
    """
    source = _scaled_again(scaled)
    screen = V.cox_screen(source.where(F.col("role") == "train"), cohort, ["cv", "modality"])
    named = screen.withColumn("feature_id", F.concat_ws(":", "modality", "feature_id"))
    tests = E.expand_combos(named, _members(source.sparkSession, listed, short)).withColumn("grp", F.concat_ws("|", "cv", "combo"))
    best = cut_lineage(V.screen_select(tests, size, ["grp"]).select("cv", "combo", "feature_id"))
    rows = source.withColumn("feature_id", F.concat_ws(":", "modality", "feature_id"))
    rows = rows.join(F.broadcast(best.select("cv", "feature_id").distinct()), ["cv", "feature_id"], "left_semi")
    dictionary = cut_lineage(L.feature_dictionary(rows, ("cv",)))
    omics = stored(L.assemble(rows, dictionary, IDS, ("cv",)))
    wide = omics.join(clin_vectors.select("cv", *IDS, F.col("features").alias("extra")), ["cv", *IDS]).withColumn(
        "features", F.concat("features", "extra"))
    extra = {r["cv"]: r["p"] for r in clin_vectors.groupBy("cv").agg(F.max(F.size("features")).alias("p")).collect()}
    clin, masks = {name for name, c in listed if "Clin" in c}, {}
    for r in best.join(dictionary, ["cv", "feature_id"]).select("cv", "combo", "pos", "p").collect():
        if r["combo"] not in clin or r["cv"] in extra:
            grp = f"{r['cv']}|{'with' if r['combo'] in clin else 'without'} Clin"
            more = range(r["p"], r["p"] + extra[r["cv"]]) if r["combo"] in clin else []
            masks.setdefault(grp, {}).setdefault(r["combo"], [*more]).append(r["pos"] - 1)
    vectors = (omics.withColumn("grp", F.concat("cv", F.lit("|without Clin")))
               .unionByName(wide.withColumn("grp", F.concat("cv", F.lit("|with Clin"))).drop("extra")))
    vectors = stored(vectors.where(F.col("grp").isin(list(masks))).select("grp", *IDS, "features"))
    coefs, _ = coxnet.cox_elastic_net(vectors.where(F.col("role") == "train").join(cohort, "sample_id"), masks.get, alpha, nlambda, nfolds=inner_folds)
    table = _score(vectors, coefs, cohort, subtypes, ["grp"])
    return table.select(F.split("grp", "\\|")[0].cast("int").alias("fold"), F.lit("elastic net").alias("model"),
                        F.lit(label).alias("reduction"), F.lit("early").alias("integration"),
                        F.col("mask").alias("data_types"), "cindex", "cindex_a", "cindex_b")


def _members(spark, listed, short) -> DataFrame:
    return spark.createDataFrame([(name, short[s]) for name, c in listed for s in c if s != "Clin"], "combo string, modality string")


def _scaled_again(source) -> DataFrame:
    """Features scaled once more; a combination has all of a modality, so that is the same in all of them."""
    return stored(Q.zscore(source.select("cv", "role", "modality", "sample_id", "feature_id", "value"), ["cv", "role", "modality"])
                  .withColumn("value", F.coalesce("value", F.lit(0.0))))


def _coded_rows(source, listed, short, sizes, ids, activation, noise, level, epochs):
    """Features of every combination, scaled again, and reduced."""
    source = _scaled_again(source)
    rows = stored(E.expand_combos(source, _members(source.sparkSession, listed, short)).select(
        F.concat_ws("|", "cv", "combo").alias("grp"), "cv", "combo", "role", "sample_id",
        F.concat_ws(":", "modality", "feature_id").alias("feature_id"), "value"))
    base = cut_lineage(L.assemble(rows, L.feature_dictionary(rows, ("grp",)), ids[1:], ("grp",)))
    return reduce_vectors(base, rows, "dae", sizes, ids, activation, noise, level, epochs)


def pca_plot_table(long: DataFrame, cohort: DataFrame, fold: int = None) -> DataFrame:
    """First two components per modality of samples with a five-year outcome, with group labels."""
    from hazardlake.operators.clean import five_year_groups
    groups = five_year_groups(cohort).select("sample_id", "group_label")
    rows = Q.zscore(long.join(groups.select("sample_id"), "sample_id", "left_semi"))
    rows = Q.impute_median(rows).withColumn("value", F.coalesce("value", F.lit(0.0)))
    v = L.assemble(rows, L.feature_dictionary(rows)).withColumn("grp", F.col("modality"))
    v = cut_lineage(v)
    out = reduce.pca_project(v, reduce.pca_fit(v, 2), ("modality", "sample_id"))
    out = out.select("modality", "sample_id", F.col("features")[0].alias("pc1"),
                     F.get("features", F.lit(1)).alias("pc2")).join(groups, "sample_id")
    return out if fold is None else out.withColumn("fold", F.lit(fold))


def pca_coordinates(long: DataFrame, cohort: DataFrame, roles: DataFrame) -> DataFrame:
    """First two components of every fold's training rows per modality, fitted apart, with group labels."""
    from hazardlake.operators.clean import five_year_groups
    groups = five_year_groups(cohort).select("sample_id", "group_label")
    train = roles.where(F.col("role") == "train").join(groups.select("sample_id"), "sample_id", "left_semi")
    rows = scaled_features(long, train.select("cv", "role", "sample_id"))
    v = cut_lineage(vectors_of(rows).withColumn("grp", F.concat_ws("|", "cv", "modality")))
    out = reduce.pca_project(v, reduce.pca_fit(v, 2), ("cv", "modality", "sample_id"))
    return out.select(F.col("cv").alias("fold"), "modality", "sample_id", F.col("features")[0].alias("pc1"),
                      F.get("features", F.lit(1)).alias("pc2")).join(groups, "sample_id")


# The hyper-parameter grid of the autoencoder.
ACTIVATIONS = ["sigmoid", "tanh", "relu"]
NOISES = [("zeros", 0.1), ("zeros", 0.3), ("gaussian", 0.1), ("gaussian", 0.5)]


def autoencoder_grid(long: DataFrame, size: int, activations=ACTIVATIONS, noises=NOISES, epochs=100, seed=5) -> DataFrame:
    """(modality, activation, noise, level, mse): the encoder's error under every setting.

    All settings are models of one fit, so an epoch of the whole grid is one scan.
    """
    rows = Q.impute_median(Q.zscore(long)).withColumn("value", F.coalesce("value", F.lit(0.0)))
    rows = cut_lineage(rows)
    dic = L.feature_dictionary(rows)
    clean = L.assemble(rows, dic).select("modality", "sample_id", F.col("features").alias("target"))
    noisy = None
    for kind, level in noises:
        part = E.corrupt_zeros(rows, level, seed) if kind == "zeros" else E.corrupt_gaussian(rows, level, seed)
        part = L.assemble(part, dic).withColumn("setting", F.lit(f"{kind}|{level}"))
        noisy = part if noisy is None else noisy.unionByName(part)
    every = F.explode(F.array(*map(F.lit, activations)))
    # Activations share the rows of their setting, which are stored once.
    pairs = cut_lineage(noisy.join(clean, ["modality", "sample_id"])).withColumn("activation", every).withColumn(
        "grp", F.concat_ws("|", "modality", "activation", "setting"))
    models = [r["grp"] for r in pairs.select("grp").distinct().collect()]
    fit = reduce.dae_fit(pairs, size, {g: g.split("|")[1] for g in models}, epochs=epochs, seed=seed)
    part = F.split("grp", "[|]")
    return reduce.dae_loss(pairs, fit).select(part[0].alias("modality"), part[1].alias("activation"), part[2].alias("noise"),
                                              part[3].cast("double").alias("level"), "mse")
