"""The end-to-end analyses, composed from the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from firmlens.functions import bands, ratios
from firmlens.functions.clean import coerce_numeric, combine_text, filter_valid, finite, is_valid, parse_range, scrub_non_finite
from firmlens.functions.resolve import Roles, resolve_roles, standardise
from firmlens.operators import consensus as cs
from firmlens.operators import density as ds
from firmlens.operators import density_tree as dt
from firmlens.operators import features as ft
from firmlens.operators import kmeans as km
from firmlens.operators import mixture as mx
from firmlens.operators import models as md
from firmlens.operators import profile_stats as ps
from firmlens.operators import ranking as rk
from firmlens.operators import segments as sg
from firmlens.operators import significance as sig
from firmlens.operators import validate as va
from firmlens.operators import vectors as ve
from firmlens.operators.text import TfIdf, fit_tfidf
from firmlens.plans.explore import explore
from firmlens.session import bounded_collect, cut_lineage, local_rows
from firmlens.sources.files import write_processed, write_segments

REPORT = "section string, subject string, metric string, value double"


def report_rows(df: DataFrame, section: str, subject: str, metrics: list[str]) -> DataFrame:
    """Turn result columns into tidy report rows."""
    values = df.select(F.col(subject).cast("string").alias("subject"), *[F.col(m).cast("double").alias(m) for m in metrics])
    return values.unpivot("subject", metrics, "metric", "value").select(F.lit(section).alias("section"), "subject", "metric", "value")


def report_values(spark, section: str, values: dict[str, float]) -> DataFrame:
    return local_rows(spark, [(section, "all", m, float(v)) for m, v in values.items()], REPORT)


def report_table(frames: list[DataFrame]) -> DataFrame:
    """One tidy table (section, subject, metric, value) of all metric frames."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


# --- processing -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Processed:
    table: DataFrame
    summary: DataFrame
    counts: dict[str, int] | None = None  # rows read, copies, not valid and kept, if the table was written


NUMERIC = ["revenue", "market_value", "it_spend", "employees", "sites", "servers", "storage", "year_founded"]


def process(df: DataFrame, as_of_year: int, keep: tuple[str, ...] = (), path: str | None = None) -> Processed:
    """Dedupe, recognise columns, coerce, keep valid companies, derive the seven measures.

    With ``path`` the table is written, and the write itself counts what was read, removed and kept.
    """
    if path is None:
        clean = coerce_numeric(standardise(ps.dedupe(df), keep), NUMERIC)
        table, counts = ft.derived_metrics(filter_valid(clean), as_of_year), None
    else:
        counts = _write_counted(df, as_of_year, keep, path)
        table = df.sparkSession.read.parquet(path)
    return Processed(table, ps.metric_summary(table, [m for m in ft.DERIVED_METRICS if m in table.columns]), counts)


def _write_counted(df: DataFrame, as_of_year: int, keep: tuple[str, ...], path: str) -> dict[str, int]:
    """Write the processed table and count on the way.

    Copies travel as a number beside each distinct row, so everything is counted in the writing tasks, behind the
    shuffle: a repeated task of an earlier stage adds nothing.
    """
    seen = Observation()
    merged = df.groupBy(*[f"`{c}`" for c in df.columns]).agg(F.count("*").alias("__copies"))
    clean = coerce_numeric(standardise(merged, (*keep, "__copies")), NUMERIC)
    counted = clean.observe(
        seen, F.coalesce(F.sum("__copies"), F.lit(0)).alias("rows_read"), F.count("*").alias("distinct_rows"),
        F.count_if(is_valid(clean.columns)).alias("kept"))
    write_processed(ft.derived_metrics(filter_valid(counted).drop("__copies"), as_of_year), path)
    found = seen.get
    return {"rows_read": found["rows_read"], "copies": found["rows_read"] - found["distinct_rows"],
            "not_valid": found["distinct_rows"] - found["kept"], "kept": found["kept"]}


# --- preprocessing for segmentation ------------------------------------------------------------------

@dataclass(frozen=True)
class Prepared:
    """Rows with unscaled feature columns and the scaled array ``features``."""

    frame: DataFrame
    numeric: list[str]
    roles: Roles
    fences: dict
    medians: dict
    scaler: ve.Scaler
    tfidf: TfIdf | None
    ages: tuple[float, float] | None

    @property
    def names(self) -> list[str]:
        return self.numeric + (self.tfidf.vocabulary if self.tfidf else [])

    def score(self, df: DataFrame, as_of_year: int) -> DataFrame:
        """Prepare new rows with the fitted medians, fences, scaler and vocabulary."""
        return _apply(_numbers(df, self.roles, as_of_year, self.ages)[0], self)


def _numbers(df: DataFrame, roles: Roles, as_of_year: int, ages: tuple[float, float] | None):
    """Numeric roles as doubles, text ranges parsed, age from the founding year."""
    kinds = dict(df.dtypes)
    out = df.withColumns({
        name: parse_range(F.col(f"`{c}`")) if kinds[c] == "string" else ps.dbl(f"`{c}`") for name, c in roles.numeric.items()
    })
    numeric = [n for n in roles.numeric if n != "year_founded"]
    if "year_founded" in roles.numeric:
        out = ft.repaired_age(out, as_of_year, fitted=ages)
        numeric.append("company_age")
    # Two roles may share one source column; keep the first.
    seen: dict = {}
    for n in numeric:
        seen.setdefault(roles.numeric.get(n, n), n)
    return out, list(seen.values())


def _apply(df: DataFrame, p: Prepared) -> DataFrame:
    filled = df.withColumns({c: F.coalesce(ps.dbl(c), F.lit(v)) for c, v in p.medians.items() if c in df.columns})
    capped = filled.withColumns({
        c: F.greatest(F.least(F.col(c), F.lit(f["upper"])), F.lit(f["lower"])) for c, f in p.fences.items()})
    made = _intensities(capped)
    made = made.withColumns({c: F.coalesce(c, F.lit(p.medians[c])) for c in INTENSITIES if c in p.medians and c in made.columns})
    out = p.scaler.vector(made, "features")
    if p.tfidf:
        staged = p.tfidf.transform(out, combine_text(list(p.roles.text.values())))
        out = staged.withColumn("features", F.concat("features", vector_to_array("tfidf"))).drop("tfidf")
    return out


INTENSITIES = ("market_value_to_revenue_ratio", "it_investment_intensity")


def _intensities(df: DataFrame) -> DataFrame:
    has = set(df.columns)
    if {"revenue", "market_value"} <= has:
        df = df.withColumn(INTENSITIES[0], ratios.market_value_to_revenue_ratio())
    if "revenue" in has and has & {"it_budget", "it_spend"}:
        df = ft.it_intensity(df, "zero")
    return df


def preprocess(df: DataFrame, as_of_year: int, use_text: bool = True, max_terms: int = 100) -> Prepared:
    """Resolve roles, repair, impute, cap, derive two intensities, scale, add text features."""
    roles = resolve_roles(df.columns)
    ages = ft.age_medians(df, as_of_year, roles.numeric["year_founded"]) if "year_founded" in roles.numeric else None
    numbers, numeric = _numbers(df, roles, as_of_year, ages)
    middle = {c: v or 0.0 for c, v in ps.medians(numbers, numeric).items()}
    filled = numbers.withColumns({c: F.coalesce(ps.dbl(c), F.lit(v)) for c, v in middle.items()})
    fences = ps.iqr_fences(filled, numeric)
    capped = filled.withColumns({
        c: F.greatest(F.least(F.col(c), F.lit(f["upper"])), F.lit(f["lower"])) for c, f in fences.items()})
    made = _intensities(capped)
    extra = [c for c in INTENSITIES if c in made.columns]
    middle |= {c: v or 0.0 for c, v in ps.medians(made, extra).items()} if extra else {}
    made = made.withColumns({c: F.coalesce(c, F.lit(middle[c])) for c in extra})
    kept = ps.varying_columns(made, numeric + extra)
    if not kept:
        raise ValueError("no numeric feature with variance")
    tfidf = fit_tfidf(df, combine_text(list(roles.text.values())), max_terms) if use_text and roles.text else None
    fitted = Prepared(made, kept, roles, fences, middle, ve.standard_scaler(made, kept), tfidf, ages)
    frame = _apply(numbers, fitted)
    # The indicators leave gaps where revenue is not positive; the features keep their filled values.
    frame = ft.calculate_indicators(frame).withColumns({c: F.coalesce(c, F.lit(middle[c])) for c in extra})
    return Prepared(frame, kept, roles, fences, middle, fitted.scaler, tfidf, ages)


# --- choosing K ------------------------------------------------------------------------------------------

def k_sweep(
    data: DataFrame, max_k: int = 10, n_init: int = 10, seed: int = 42, key: str = "company_id", anchors: int | None = None
) -> tuple[DataFrame, dict[int, km.Fit]]:
    """Inertia, silhouette, Davies-Bouldin and Calinski-Harabasz for K = 2 .. max_k + 1."""
    n = data.count()
    ks = list(range(2, min(max_k + 1, n // 2, n - 1) + 1))
    if not ks:
        raise ValueError("too few rows to choose K")
    fits = km.kmeans_by_k(data, ks, n_init, seed, key)
    scores = va.silhouettes(km.predict_all(data, fits), [f"k{k}" for k in ks], key=key, anchors=anchors)
    rows = []
    for k, s in zip(ks, scores):
        quality = fits[k].quality()
        rows.append((k, fits[k].inertia, s.score, s.stderr, s.rows, quality.davies_bouldin(), quality.calinski_harabasz()))
    return local_rows(data.sparkSession, rows, "k int, inertia double, silhouette double, silhouette_stderr double, "
                      "silhouette_rows long, davies_bouldin double, calinski_harabasz double"), fits


def kmeans_grid(
    data: DataFrame, n_init: int = 10, seed: int = 42, key: str = "company_id", anchors: int | None = None
) -> tuple[DataFrame, dict[int, km.Fit]]:
    """K = 2 .. max(3, min(15, n // 100)) - 1, scored 0.6 silhouette + 0.4 Calinski-Harabasz / 1000."""
    ks = grid_ks(data.count())
    fits = km.kmeans_by_k(data, ks, n_init, seed, key)
    scores = va.silhouettes(km.predict_all(data, fits), [f"k{k}" for k in ks], key=key, anchors=anchors)
    rows = []
    for k, s in zip(ks, scores):
        ch = fits[k].quality().calinski_harabasz()
        rows.append((k, s.score, ch, 0.6 * s.score + 0.4 * ch / 1000))
    return local_rows(data.sparkSession, rows, "k int, silhouette double, calinski_harabasz double, score double"), fits


def grid_ks(n: int) -> list[int]:
    return list(range(2, max(3, min(15, n // 100))))


# --- the full analysis ---------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Segmentation:
    labelled: DataFrame
    report: DataFrame
    parts: dict = field(default_factory=dict)


def numbered_by_size(df: DataFrame, label: str = "cluster") -> DataFrame:
    """``label`` renumbered 0, 1, ... by descending size (ties: the smaller label); -1 and null stay."""
    kind = df.schema[label].dataType.simpleString()
    found = sorted((r for r in bounded_collect(sg.cluster_sizes(df, label), sg.MAX_CLUSTERS, "clusters") if r[label] not in (None, -1)),
                   key=lambda r: (-r["n"], r[label]))
    numbers = local_rows(df.sparkSession, [(r[label], i) for i, r in enumerate(found)], f"{label} {kind}, __number int")
    return df.join(F.broadcast(numbers), label, "left").withColumn(
        label, F.when(F.col(label) == -1, -1).otherwise(F.col("__number"))).drop("__number")


def segment_report(labelled: DataFrame, numeric: list[str], categorical: list[str] = ()) -> list[DataFrame]:
    """Report sections that follow from the labels: sizes, statistics, shares and modes, profiles, correlations, differences."""
    pair = F.concat_ws("/", "cluster", "feature").alias("subject")
    found = sg.analyze_clusters(labelled, numeric, list(categorical)).where(F.col("feature") != "size")
    shares = found.where(F.col("stat") == "share")
    # The most frequent value of each cluster with its share; ties go to the smallest, as in ``modes``.
    top = shares.groupBy("cluster", "feature").agg(F.min(F.struct((-F.col("value")).alias("rank"), "text", "value")).alias("top"))
    return [
        report_rows(sg.cluster_sizes(labelled), "sizes", "cluster", ["n", "pct"]),
        report_rows(sg.small_cluster_warning(labelled), "small_clusters", "cluster", ["n", "pct"]),
        found.where(~F.col("stat").isin("share", "mode")).select(F.lit("statistics").alias("section"), pair, F.col("stat").alias("metric"), "value"),
        shares.select(F.lit("shares").alias("section"), pair, F.col("text").alias("metric"), "value"),
        top.select(F.lit("modes").alias("section"), pair, F.col("top.text").alias("metric"), F.col("top.value").alias("value")),
        report_rows(sg.compare_clusters(labelled, numeric).withColumn("s", F.concat_ws("/", "cluster", "feature")), "profile", "s", ["mean", "std"]),
        report_rows(ps.correlation_matrix(labelled, numeric).withColumn("s", F.concat_ws("/", "feature_a", "feature_b")), "correlation", "s", ["corr"]),
        report_rows(sg.cluster_vs_rest(labelled, numeric).withColumn("s", F.concat_ws("/", "cluster", "feature")), "differences", "s", ["difference_pct"]),
    ]


def membership_report(labelled: DataFrame, numeric: list[str], key: str = "company_id") -> tuple[list[DataFrame], md.Logistic]:
    """How well the features tell the segments: accuracies, cross-validation, confusion, precision and recall, drivers."""
    spark = labelled.sparkSession
    train, test = md.parts(md.split(labelled, stratify="cluster", key=key))
    logistic = md.fit_logistic(train, numeric)
    guessed = logistic.predict(test).select("cluster", "predicted").persist()
    folds = md.kfold_accuracy(train, numeric, key=key)
    spread = {f"fold_{k}": v for k, v in folds.agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std")).first().asDict().items()
              if v is not None}
    return [
        report_values(spark, "logistic", {"train_accuracy": md.accuracy(logistic.predict(train)), "test_accuracy": md.accuracy(guessed), **spread}),
        report_rows(folds, "cross_validation", "fold", ["accuracy"]),
        report_rows(md.confusion(guessed, "cluster", "predicted").withColumn("s", F.concat_ws("/", "label", "prediction")), "confusion", "s", ["n"]),
        report_rows(md.class_report(guessed, "cluster", "predicted"), "classes", "class", ["precision", "recall", "f1", "support"]),
        report_rows(rk.top_drivers(logistic.coefficients(spark), 5).withColumn("s", F.concat_ws("/", "cluster", "feature")), "drivers", "s", ["coefficient"]),
    ], logistic


def run_full(
    df: DataFrame, as_of_year: int, n_clusters: int | None = None, n_init: int = 10, key: str = "company_id",
    path: str | None = None, method: str = "kmeans", eps: float = 0.5, min_samples: int = 5,
) -> Segmentation:
    """Explore, preprocess, choose K, cluster, test, profile, reduce, model, report, export.

    ``method="dbscan"`` takes dense segments in place of K-Means; they are numbered by size and rows outside all of them are
    -1, a group of their own in the report.  With fewer than two groups there is nothing to tell apart, and the sections
    on membership are left out.
    """
    if method not in ("kmeans", "dbscan"):
        raise ValueError(f"unknown method {method}")
    spark = df.sparkSession
    prepared = preprocess(df, as_of_year)
    # The density method reads the rows several times, also as the side of a join.
    data = km.spread_out(cut_lineage(prepared.frame) if method == "dbscan" else prepared.frame).persist()
    numeric = prepared.numeric
    if method == "dbscan":
        fit = None
        labelled = numbered_by_size(ds.dbscan(data, eps, min_samples, key=key)).persist()
        groups = [r["cluster"] for r in bounded_collect(sg.cluster_sizes(labelled), sg.MAX_CLUSTERS, "clusters")]
        dense = labelled.where(F.col("cluster") >= 0)
        segments = sum(g >= 0 for g in groups)
        choice = {"k": segments, "noise": labelled.count() - dense.count()}
        if segments > 1:
            choice["silhouette"] = va.silhouette(dense, key=key).score
        sweep = report_values(spark, "density", {"eps": eps, "min_samples": min_samples})
    else:
        if n_clusters is None:
            metrics, fits = k_sweep(data, n_init=n_init, key=key)
            best = rk.select_k(metrics).first()
            silhouette, fit = best["silhouette"], fits[best["k"]]
            sweep = report_rows(metrics, "k_selection", "k", ["inertia", "silhouette", "davies_bouldin", "calinski_harabasz"])
        else:
            fit = km.kmeans(data, n_clusters, n_init, key=key)
            silhouette = va.silhouette(km.predict(data, fit), key=key).score
            sweep = report_values(spark, "k_selection", {"k": n_clusters})
        labelled = km.predict(data, fit).persist()
        groups = list(range(fit.k))
        choice = {"k": fit.k, "silhouette": silhouette, "inertia": fit.inertia}
    categorical = list(prepared.roles.category.values())
    projection = ve.pca(labelled, numeric, min(3, len(numeric)))
    membership, logistic = membership_report(labelled, numeric, key) if len(groups) > 1 else ([], None)
    tests = [report_rows(sig.chi_square_all(labelled, categorical), "chi_square", "feature", ["chi2", "p", "p_adjusted", "significant"])] if len(groups) > 1 else []
    linear, fit_quality = md.linear_analysis(labelled, numeric, key=key)
    uncapped = _numbers(df, prepared.roles, as_of_year, prepared.ages)[0]  # outliers are counted before capping
    outlier_cols = [c for c in numeric if c in uncapped.columns]
    insights = sg.rule_insights(labelled, numeric)
    report = report_table([
        explore(df, prepared.roles), sweep,
        report_values(spark, "choice", choice),
        *segment_report(labelled, numeric, categorical),
        *tests,
        report_rows(ps.iqr_outlier_report(uncapped, outlier_cols), "outliers", "feature", ["n_out", "pct_out"]),
        report_rows(ve.vif_report(labelled, numeric), "collinearity", "feature", ["vif", "high"]),
        report_rows(projection.spectrum(spark), "pca", "component", ["explained"]),
        *membership,
        report_rows(fit_quality, "linear", "part", ["mse", "r2"]),
        report_rows(rk.top_coefficients(linear.coefficients(spark)), "linear_coefficients", "feature", ["coefficient"]),
        insights.select(F.concat(F.lit("insight_"), "insight").alias("section"), "subject", "metric", "value"),
    ])
    if path is not None:
        write_segments(labelled.drop("features"), path)
    return Segmentation(labelled, report, {"prepared": prepared, "fit": fit, "logistic": logistic, "linear": linear, "projection": projection})


def assign_segment(new_rows: DataFrame, prepared: Prepared, fit: km.Fit, as_of_year: int) -> DataFrame:
    """Segment membership of new companies, with everything fitted earlier."""
    return km.predict(prepared.score(new_rows, as_of_year), fit)


# --- the standard pipeline ----------------------------------------------------------------------------------------

STANDARD_COLUMNS = [
    "revenue", "market_value", "it_spend", "employees", "sites", "servers", "storage", "revenue_per_employee",
    "market_value_per_employee", "it_spend_ratio", "employees_per_site", "technology_density_index", "company_age",
    "geographic_dispersion",
]


def run_standard(
    df: DataFrame, categorical: tuple[str, ...] = ("country", "region"), n_init: int = 10, key: str = "company_id",
    strict: bool = False,
) -> Segmentation:
    """Context, filtering and encoding, clustering loop, interpretation on a processed table."""
    spark = df.sparkSession
    numeric = ps.select_available_numeric(df, wanted=STANDARD_COLUMNS)
    categorical = [c for c in categorical if c in df.columns]
    work = df.select(key, *numeric, *categorical)
    report_sparse = ps.sparse_columns(work, numeric + categorical)
    work = ps.drop_sparse_columns(work, numeric + categorical)
    numeric, categorical = ([c for c in cols if c in work.columns] for cols in (numeric, categorical))
    work = ps.drop_null_rows(ps.impute(work, numeric, categorical), numeric)
    metric = ve.choose_metric(len(numeric), len(categorical))
    numeric = ve.prune_correlated(work, ps.varying_columns(work, numeric))
    categorical = [c for c in categorical if c in ps.drop_single_category(work, categorical).columns]
    sections = [
        report_rows(report_sparse, "sparsity", "feature", ["missing_pct"]),
        report_rows(ps.cardinality(work, categorical), "cardinality", "feature", ["n_distinct"]) if categorical else None,
        report_values(spark, f"metric_{metric}", {"numeric": len(numeric), "categorical": len(categorical)}),
    ]
    if metric == "gower":
        coded, weights = cs.coded_features(work, numeric, categorical)
        data = km.spread_out(coded).persist()
        k, medoids, scores = cs.best_medoids(data, weights, grid_ks(data.count()), key)
        labelled = cs.predict_medoids(data, medoids, weights).persist()
        runs = labelled
        fitted = cs.kmedoids_by_seed(data, weights, [k], [42 + i for i in range(5)], key)
        for i in range(5):
            runs = cs.predict_medoids(runs, fitted[k, 42 + i][0], weights, f"run{i}")
        stability = cs.stability_ari(runs, [f"run{i}" for i in range(5)], "cluster")
        silhouette = scores[k].score
        reduced = numeric
    else:
        if metric == "mixed" and categorical:
            encoded, projection = ve.famd(work, numeric, categorical)
        else:
            scaler = ve.auto_scaler(work, numeric)
            encoded = scaler.transform(work)
            projection = ve.pca(encoded, numeric).keep(0.85)
        reduced = [f"pc{i + 1}" for i in range(projection.components.shape[1])]
        projected = projection.transform(encoded).withColumn("features", F.array(*reduced))
        data = km.spread_out(projected.select(key, "features", *reduced)).persist()
        grid, fits = kmeans_grid(data, n_init, key=key)
        best = grid.orderBy(F.desc("score"), "k").first()
        k, silhouette = best["k"], best["silhouette"]
        stability = km.stability_centres(data, fits[k], n_init=n_init, key=key)
        labels = km.predict(data, fits[k])
        # The reduced columns and the original ones come from the same rows; join on the key.
        labelled = work.join(labels, key).persist()
        sections += [report_rows(grid, "grid", "k", ["silhouette", "calinski_harabasz", "score"]),
                     report_rows(projection.spectrum(spark), "reduction", "component", ["explained"])]
    passed = va.validation_gate(silhouette, strict)
    importance = rk.feature_importance_rank(md.forest_importance(labelled, reduced))
    sections += [
        report_values(spark, "choice", {"k": k, "silhouette": silhouette, "stability": stability[0], "stable": stability[1], "gate_passed": passed}),
        report_rows(importance, "importance", "feature", ["importance"]),
        report_rows(sg.cluster_sizes(labelled), "sizes", "cluster", ["n", "pct"]),
        report_rows(sg.cluster_profiles(labelled, numeric[:5], categorical).withColumn("s", F.concat_ws("/", "cluster", "feature")), "profile", "s", ["mean", "median"]),
    ]
    return Segmentation(labelled, report_table([s for s in sections if s is not None]), {"k": k})


# --- the enhanced pipeline ----------------------------------------------------------------------------------------------

EXCLUDED = ["company_id", "cluster", "sub", "confidence"]


def density_sub_segments(
    staged: DataFrame, group: str = "grp", min_size: int = 100, min_samples: int = 10, epsilon: float = 0.5, key: str = "company_id"
) -> DataFrame:
    """Every group of at least ``min_size`` rows split by its density tree: ``sub``, and ``cluster`` numbers the pairs (group, sub).

    A dense segment has at least 5 % of its group's rows and 50; rows outside all of them are the group's last segment.
    """
    sizes = {r[group]: r["n"] for r in sg.cluster_sizes(staged, group).collect()}
    wanted = {g: max(50, int(0.05 * n)) for g, n in sizes.items() if n >= min_size}
    large = staged.where(F.col(group).isin(list(wanted)))
    small = staged.where(~F.col(group).isin(list(wanted))).withColumn("sub", F.lit(0))
    split = dt.density_segments(large, wanted, min_samples, epsilon, group, key=key) if wanted else large.withColumn("sub", F.lit(0))
    found = cut_lineage(split.unionByName(small))
    # Noise comes last in its group; a group of noise alone is one segment.
    last = found.groupBy(group).agg(F.max("sub").alias("most"))
    found = found.join(F.broadcast(last), group).withColumn("sub", F.when(F.col("sub") < 0, F.col("most") + 1).otherwise(F.col("sub")).cast("int")).drop("most")
    pairs = sorted((r[0], r[1]) for r in found.select(group, "sub").distinct().collect())
    code = F.array_position(F.array(*[F.concat_ws("/", F.lit(g), F.lit(s)) for g, s in pairs]), F.concat_ws("/", group, "sub")).cast("int") - 1
    return found.withColumn("cluster", code)


def hierarchical_segments(
    data: DataFrame, ks=(5, 6, 7), min_size: int = 100, n_init: int = 10, seed: int = 42, key: str = "company_id", sub: str = "kmeans"
) -> DataFrame:
    """Mixture macro segments, each larger one split by K-Means or (``sub="density"``) by its density tree; ``cluster`` numbers the pairs (macro, sub)."""
    macro, _ = mx.gmm_bic(data, list(ks), n_init=n_init, seed=seed, key=key)
    staged = mx.predict_mixture(data, macro, "grp").drop("confidence").persist()
    if sub == "density":
        return density_sub_segments(staged, "grp", min_size, key=key).withColumnRenamed("grp", "macro")
    sizes = {r["grp"]: r["n"] for r in sg.cluster_sizes(staged, "grp").collect()}
    wanted = {g: max(2, min(5, n // min_size)) for g, n in sorted(sizes.items()) if n >= min_size}
    fits = km.kmeans_in_groups(staged, wanted, n_init, seed, key) if wanted else {}
    pairs = [(g, s) for g in sorted(sizes) for s in range(fits[g].k if g in fits else 1)]
    code = F.array_position(F.array(*[F.lit(g * 100 + s) for g, s in pairs]), F.col("grp") * 100 + F.col("sub")).cast("int") - 1
    return km.predict_in_groups(staged, fits).withColumn("cluster", code).withColumnRenamed("grp", "macro")


@dataclass(frozen=True)
class TwoTier:
    labelled: DataFrame  # tier-1 label in ``cluster``
    silhouette: va.Silhouette
    mega: int | None
    refined: DataFrame | None  # members of the dominant cluster with ``sub``
    sub_silhouette: va.Silhouette | None
    anomalies: DataFrame | None
    gaps: DataFrame | None


def recluster_mega(
    labelled: DataFrame, mega: int, n_init: int = 10, seed: int = 42, key: str = "company_id"
) -> tuple[DataFrame, va.Silhouette | None]:
    """Split one dominant cluster on refined features: ``sub``, ``sub_confidence``, ``sub_name``."""
    members = sg.rows_in_clusters(labelled, [mega]).drop("features")
    refined = ft.refined_features(members)
    cols = [c for c in [*ft.REFINED_FEATURES, "geographic_dispersion", "company_age", "sites"] if c in refined.columns]
    filled = scrub_non_finite(refined, cols, to=0.0)
    cols = ps.varying_columns(filled, cols)
    data = km.spread_out(ve.robust_scaler(filled, cols).vector(filled)).persist()
    n = data.count()
    ks = list(range(3, min(10, n // 100))) or [min(3, n)]
    model, _ = mx.gmm_bic(data, ks, n_init=n_init, seed=seed, key=key, max_iter=200)
    out = mx.predict_mixture(data, model, "sub", "sub_confidence").withColumn(
        "sub_name", bands.tier_name(F.lit(mega), F.col("sub"))).persist()
    several = out.select("sub").distinct().limit(2).count() > 1
    return out, va.silhouette(out, "sub", key=key) if several else None


def two_tier(
    data: DataFrame, ks=(5, 6, 7, 8, 9), n_init: int = 10, seed: int = 42, key: str = "company_id", threshold: float = 40.0
) -> TwoTier:
    """Mixture segments; a dominant one is split again, small ones become anomalies, sub-segments get gaps."""
    model, _ = mx.gmm_bic(data, list(ks), n_init=n_init, seed=seed, key=key)
    labelled = mx.predict_mixture(data.drop("cluster", "confidence", "sub"), model).persist()
    score = va.silhouette(labelled, key=key)
    dominant = sg.mega_cluster_ids(labelled, threshold)
    if not dominant:
        return TwoTier(labelled, score, None, None, None, None, None)
    refined, sub_score = recluster_mega(labelled, dominant[0], n_init, seed, key)
    _, small = sg.split_small_clusters(labelled)
    anomalies = sg.classify_anomalies(sg.anomaly_rows(labelled, small), labelled)
    return TwoTier(labelled, score, dominant[0], refined, sub_score, anomalies, sg.gap_analysis(refined, "sub", dominant[0]))


def run_enhanced(df: DataFrame, n_init: int = 10, seed: int = 42, key: str = "company_id") -> Segmentation:
    """Engineered features, collinearity check, two-tier mixtures, personas, validation, report."""
    spark = df.sparkSession
    engineered = ft.engineer_features(df)
    cols = ps.select_available_numeric(engineered, exclude=[*EXCLUDED, key])
    numbers = scrub_non_finite(engineered, cols, to=0.0)
    kept = ve.vif_prune(numbers, cols)
    scaled = ve.robust_scaler(numbers, kept)
    vectors = engineered.withColumn("features", F.array(*[
        (F.coalesce(finite(F.col(c)), F.lit(0.0)) - F.lit(scaled.centre[i])) / F.lit(scaled.scale[i]) for i, c in enumerate(kept)]))
    # The feature table is read by every scan of the fits below: written once, then reused.
    data = km.spread_out(cut_lineage(vectors)).persist()
    segments = hierarchical_segments(data, n_init=n_init, seed=seed, key=key)
    tiers = two_tier(data, n_init=n_init, seed=seed, key=key)
    main, _ = sg.split_small_clusters(tiers.labelled)
    personas = sg.build_personas(sg.rows_in_clusters(tiers.labelled, main), ["employees", "revenue", "it_spend_ratio"])
    personas = cut_lineage(personas)
    labelled = sg.attach_personas(tiers.labelled, personas)
    quality = va.centroid_stats(tiers.labelled)
    sections = [
        report_values(spark, "features", {"initial": len(cols), "kept": len(kept), "removed": len(set(cols) - set(kept))}),
        report_values(spark, "quality", {"silhouette": tiers.silhouette.score, "davies_bouldin": quality.davies_bouldin(),
                                         "calinski_harabasz": quality.calinski_harabasz()}),
        report_rows(sg.balance_report(tiers.labelled).withColumn("s", F.lit("all")), "balance", "s", ["k", "largest_pct", "smallest", "largest"]),
        report_rows(sg.cluster_sizes(segments), "hierarchical", "cluster", ["n", "pct"]),
        report_rows(sg.cluster_sizes(tiers.labelled), "tier1", "cluster", ["n", "pct"]),
        report_rows(personas, "personas", "persona", ["n", "pct", "mean_z"]),
        report_rows(sg.persona_summary(labelled), "persona_summary", "persona", ["employees_count", "employees_median", "revenue_median"]),
    ]
    if tiers.refined is not None:
        sections.append(report_rows(sg.subcluster_summary(tiers.refined, tiers.mega), "tier2", "name", ["n", "pct", "median_revenue", "median_it_spend", "median_employees"]))
        sections.append(report_rows(tiers.gaps.withColumn("s", F.concat_ws("/", "segment", "gap")), "gaps", "s", ["deviation_pct", "opportunity_value"]))
        counts = tiers.anomalies.groupBy("category").agg(F.count("*").alias("n"))
        sections.append(report_rows(counts, "anomalies", "category", ["n"]))
    return Segmentation(labelled, report_table(sections), {"tiers": tiers, "personas": personas, "features": kept, "hierarchical": segments})
