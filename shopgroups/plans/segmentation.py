"""Segmentation flows: feature table -> fits -> metric rows.

The scaled feature table feeds many fits, so it is written once to the shared
folder (``spark.checkpoint.dir``); every later job reads that copy instead of
re-running the customer joins, and a lost executor only costs a re-read (see
``sources.kept``). Fits are not kept.
"""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster as C
from ..operators import dbscan as DB
from ..operators import features as FE
from ..operators import metrics as M
from ..operators import prep as P
from ..operators import ward as WD
from ..operators.components import stored
from ..session import checkpoint_dir
from ..sources import views as V
from ..sources.kept import kept

METRIC_SCHEMA = ("k long, random_state long, n_features long, inertia double, silhouette_score double, "
                 "calinski_harabasz_score double, davies_bouldin_score double, min_cluster_size long, "
                 "max_cluster_size long, min_cluster_percentage double, max_cluster_percentage double")


def model_columns(features: DataFrame) -> list[str]:
    shares = [c for c in features.columns if c.startswith(FE.SHARE_PREFIX)]
    return [c for c in P.FINAL_MODEL_COLUMNS if not c.startswith(FE.SHARE_PREFIX)] + shares


def selected_features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Clean model columns, from the written customer view."""
    clean = P.clean_feature_values(FE.add_customer_info_features(V.customer_info(spark, sf_dir)))
    cols = model_columns(clean)
    return P.select_model_features(clean, cols), cols


def scaled_features(spark: SparkSession, sf_dir: str, method: str = "robust",
                    use_log: bool = False) -> tuple[DataFrame, list[str]]:
    """(id + scaled model columns, the columns)."""
    def build():
        sel, cols = selected_features(spark, sf_dir)
        return P.scale_features(sel, cols, method, use_log)[0], cols

    return kept(spark, sf_dir, V.CUSTOMER_SOURCES, ("scaled", method, use_log), build)


def dummy_features(clean: DataFrame, genders=("female", "male"), degrees=("Bsc", "Msc", "Phd")) -> tuple[DataFrame, list[str]]:
    """(id + fixed gender and degree dummies (F17), the dummies)."""
    wide = FE.one_hot(FE.one_hot(clean, "customer_gender", list(genders), "gender"), "degree_level", list(degrees), "degree")
    names = [f"gender_{g}" for g in genders] + [f"degree_{x}" for x in degrees]
    return wide.select("customer_id", *names), names


#: Scalings of the compared feature sets: (method, log).
SCALINGS = {"robust": ("robust", False), "standard": ("standard", False), "log_robust": ("robust", True), "log_standard": ("standard", True)}


def feature_variants(spark: SparkSession, sf_dir: str, names) -> tuple[DataFrame, dict]:
    """(id + the columns of all variants side by side, {variant: its columns}).

    A variant is a scaling of the model columns, or ``standard_with_dummies``: the standard one and the
    gender and degree dummies (F17, F18), scaled too.
    """
    names = tuple(names)

    def build():
        checkpoint_dir(spark)
        clean = P.clean_feature_values(FE.add_customer_info_features(V.customer_info(spark, sf_dir)))
        cols = model_columns(clean)
        dummies, dummy_names = dummy_features(clean)
        wide = FE.concat_feature_sets(P.select_model_features(clean, cols), dummies).checkpoint()
        sets, out = {}, []

        def add(variant, columns, scaling):
            model = P.fit_scaler(wide, columns, *scaling)
            scaled = model.transform(wide)
            out.append(scaled.select("customer_id", *[F.col(c).alias(f"{variant}__{c}") for c in columns]))
            return [f"{variant}__{c}" for c in columns]

        plain = [n for n in names if n in SCALINGS]
        for n in plain + (["standard"] if "standard_with_dummies" in names and "standard" not in names else []):
            sets[n] = add(n, cols, SCALINGS[n])
        if "standard_with_dummies" in names:
            sets["standard_with_dummies"] = sets["standard"] + add("dummies", dummy_names, SCALINGS["standard"])
        table = out[0]
        for other in out[1:]:
            table = table.join(other, "customer_id")
        return table, {n: sets[n] for n in names}

    return kept(spark, sf_dir, V.CUSTOMER_SOURCES, ("variants", names), build)


def kmeans_model(df: DataFrame, cols, k: int, seed: int = 42, n_init: int = 10) -> C.KMeansResult:
    return C.fit_kmeans(df, cols, k, seed, n_init)


def gmm_model(df: DataFrame, cols, k: int, seed: int = 42) -> C.GMMResult:
    return C.fit_gmm_diag(df, cols, k, seed)


def _metric_values(df: DataFrame, cols, label: str) -> dict:
    return M.clustering_metrics(df, cols, label).first().asDict()


def evaluate_kmeans(df: DataFrame, cols, k: int, seed: int = 42, n_init: int = 10):
    """C4: fit + metrics. Returns (metrics dict, model, labelled DataFrame)."""
    metrics, models = k_sweep(df, cols, [k], seed, n_init)
    return metrics[0], models[0], models[0].assign(df)


def k_sweep(df: DataFrame, cols, k_values, seed: int = 42, n_init: int = 10, models=None) -> tuple[list[dict], list[C.KMeansResult]]:
    """(metrics per k, models): all k are fitted in the same passes, unless ``models`` gives the fits; their metrics are computed together."""
    k_values = list(k_values)
    models = models or C.fit_kmeans_many(df, cols, [(k, seed) for k in k_values], n_init)
    found = M.clustering_metrics_for_centers(df, cols, {str(k): m.centers for k, m in zip(k_values, models)})
    return [{**found[str(k)], "k": k, "random_state": seed, "n_features": len(cols), "inertia": m.inertia}
            for k, m in zip(k_values, models)], models


def _rows(spark: SparkSession, metrics: list[dict], schema: str) -> DataFrame:
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    return spark.createDataFrame([tuple(m.get(n) for n in names) for m in metrics], schema)


def metric_rows(spark: SparkSession, metrics: list[dict]) -> DataFrame:
    return _rows(spark, metrics, METRIC_SCHEMA)


def compare_k_values(df: DataFrame, cols, k_values, seed: int = 42, n_init: int = 10) -> DataFrame:
    """One metrics row per k."""
    return metric_rows(df.sparkSession, k_sweep(df, cols, k_values, seed, n_init)[0])


def compare_feature_sets(df: DataFrame, sets: dict, k: int = 5, seed: int = 42, n_init: int = 10) -> DataFrame:
    """One metrics row per set of columns of ``df`` ({variant: columns}), fitted and scored in shared passes."""
    models = C.fit_kmeans_sets(df, sets, k, seed, n_init)
    found = M.clustering_metrics_for_centers(df, None, {n: m.centers for n, m in models.items()}, sets)
    rows = [{**found[n], "k": k, "random_state": seed, "n_features": len(sets[n]), "inertia": m.inertia, "feature_set_variant": n}
            for n, m in models.items()]
    return _rows(df.sparkSession, rows, METRIC_SCHEMA + ", feature_set_variant string")


def seed_stability(df: DataFrame, cols, k: int, seeds, n_init: int = 10, id_col: str = "customer_id", models=None) -> DataFrame:
    """ARI between the labels of every pair of seeds.

    All label columns are expressions over the same rows (no join needed).
    """
    labelled = df.select(id_col, *cols)
    models = models or C.fit_kmeans_many(df, cols, [(k, s) for s in seeds], n_init)
    for s, model in zip(seeds, models):
        labelled = labelled.withColumn(f"l{s}", C.nearest_center(cols, model.centers))
    # one pass: at most k ** len(seeds) rows, in practice a few more than k
    names = [f"l{s}" for s in seeds]
    table = labelled.groupBy(*names).agg(F.count("*").alias("n")).toPandas()
    rows = [(k, a, b, M.ari_of_counts(table.groupby([f"l{a}", f"l{b}"])["n"].sum())) for a, b in combinations(seeds, 2)]
    return df.sparkSession.createDataFrame(rows, "k long, seed_a long, seed_b long, adjusted_rand_index double")


def gmm_comparison(df: DataFrame, cols, k_values, seed: int = 42) -> DataFrame:
    """C8 + C15: diagonal GMM per k with AIC, BIC and average max probability."""
    out = []
    for k, model in zip(k_values, C.fit_gmm_diag_many(df, cols, [(k, seed) for k in k_values])):
        labelled = model.assign(df)
        m = _metric_values(labelled, cols, "cluster")
        avg_max = labelled.agg(F.avg("max_probability")).first()[0]
        m.update({"model": f"gmm_diag_k{k}", "algorithm": "gaussian_mixture_diag", "n_clusters": k,
                  "aic": model.aic(), "bic": model.bic(), "avg_max_probability": float(avg_max),
                  "n_iter": model.n_iter})
        out.append(m)
    schema = ("model string, algorithm string, n_clusters long, silhouette_score double, "
              "calinski_harabasz_score double, davies_bouldin_score double, min_cluster_size long, "
              "max_cluster_size long, min_cluster_percentage double, max_cluster_percentage double, "
              "aic double, bic double, avg_max_probability double, n_iter long")
    return _rows(df.sparkSession, out, schema)


BALANCE_SCHEMA = "model string, algorithm string, cluster long, count long, percentage double, is_noise boolean"


def _balance(labelled: DataFrame, model: str, algorithm: str) -> DataFrame:
    """C14 with the model's names; cluster -1 is noise."""
    rows = M.cluster_summary(labelled.select("cluster"), "cluster")
    return rows.select(F.lit(model).alias("model"), F.lit(algorithm).alias("algorithm"), F.col("cluster").cast("long").alias("cluster"),
                       "count", "percentage", (F.col("cluster") == -1).alias("is_noise"))


DBSCAN_SCHEMA = ("model string, algorithm string, eps double, min_samples long, row_count long, number_of_clusters_excluding_noise long, "
                 "noise_count long, noise_percentage double, largest_non_noise_cluster_percentage double, silhouette_score double, "
                 "calinski_harabasz_score double, davies_bouldin_score double, min_cluster_size long, max_cluster_size long, "
                 "min_cluster_percentage double, max_cluster_percentage double")


def dbscan_study(df: DataFrame, cols, eps_values, min_samples_values, id_col: str = "customer_id") -> tuple[list[dict], list[DataFrame]]:
    """(a row per (eps, min_samples), its cluster balance with the noise).

    Sizes and shares (of all rows, noise included) are those of clusters without noise; separation
    metrics are over rows that are no noise, where there are at least 2 clusters and more rows than clusters.
    """
    out, balances = [], []
    feats = df.select(id_col, *cols)
    for eps in eps_values:
        boxes = DB.Boxes(feats, cols, eps, id_col, DB.dbscan_folder(df.sparkSession))
        for ms in min_samples_values:
            name = f"DBSCAN_eps{eps:g}_min{ms}"
            labels = stored(boxes.labels(ms, id_col), boxes.folder, f"labels-{ms}")
            sizes = labels.groupBy("cluster").count()
            own = F.when(F.col("cluster") >= 0, F.col("count"))
            stats = sizes.agg(F.sum("count").alias("n"), F.sum(F.when(F.col("cluster") < 0, F.col("count"))).alias("noise"),
                              F.count(own).alias("k"), F.min(own).alias("low"), F.max(own).alias("high")).first()
            n, noise, k = stats["n"] or 0, stats["noise"] or 0, stats["k"]
            row = {"model": name, "algorithm": "DBSCAN", "eps": float(eps), "min_samples": ms, "row_count": n,
                   "number_of_clusters_excluding_noise": k, "noise_count": noise, "noise_percentage": noise * 100.0 / n if n else None}
            if k:
                row.update({"min_cluster_size": stats["low"], "max_cluster_size": stats["high"], "min_cluster_percentage": stats["low"] * 100.0 / n,
                            "max_cluster_percentage": stats["high"] * 100.0 / n, "largest_non_noise_cluster_percentage": stats["high"] * 100.0 / n})
            if k >= 2 and n - noise > k:
                clustered = feats.join(labels.where("cluster >= 0").select(id_col, "cluster"), id_col)
                m = _metric_values(clustered, cols, "cluster")
                row.update({x: m[x] for x in ("silhouette_score", "calinski_harabasz_score", "davies_bouldin_score")})
            out.append(row)
            balances.append(_balance(labels, name, "DBSCAN"))
    return out, balances


def dbscan_diagnostics(df: DataFrame, cols, eps_values, min_samples_values, id_col: str = "customer_id") -> DataFrame:
    return _rows(df.sparkSession, dbscan_study(df, cols, eps_values, min_samples_values, id_col)[0], DBSCAN_SCHEMA)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def ward_study(df: DataFrame, cols, ks=(4, 5, 6), id_col: str = "customer_id") -> tuple[DataFrame, DataFrame, WD.WardModel]:
    """(a metrics row per k, its cluster balance, the tree), over all rows."""
    model = WD.fit_ward(df, cols, id_col)
    labels = stored(model.assign(df, id_col, ks), f"{checkpoint_dir(df.sparkSession).rstrip('/')}/ward-{uuid.uuid4().hex}", "labels")
    rows, balances = [], []
    for k in ks:
        labelled = df.join(labels.select(id_col, F.col(f"cluster_{k}").alias("cluster")), id_col)
        rows.append(M.evaluation_row(M.clustering_metrics(labelled, cols, "cluster"), f"ward_k{k}", "agglomerative_ward", k,
                                     {"micro_clusters": len(model.sizes), "micro_inertia_share": model.micro_inertia / max(model.total_inertia, 1e-300)}))
        balances.append(_balance(labelled, f"ward_k{k}", "agglomerative_ward"))
    return union_all(rows), union_all(balances), model


def model_comparison(df: DataFrame, cols, id_col: str = "customer_id", k: int = 5, gmm_k=(4, 5, 6), ward_k=(4, 5, 6),
                     seed: int = 42, n_init: int = 50):
    """C14 + C15: one metrics row per model (K-Means, diagonal GMMs, Ward, bisecting K-Means) with the
    model-specific extras (inertia; AIC, BIC, average max probability; micro-clusters) and NULL where a model has
    none, plus the per-model cluster balance table. Returns (metrics, balance)."""
    rows, balances = [], []

    def add(model_name, algorithm, n_clusters, labelled, extra):
        rows.append(M.evaluation_row(M.clustering_metrics(labelled, cols, "cluster"), model_name, algorithm, n_clusters, extra))
        balances.append(_balance(labelled, model_name, algorithm))

    km = kmeans_model(df, cols, k, seed, n_init)
    add(f"kmeans_k{k}", "kmeans", k, km.assign(df), {"inertia": km.inertia})
    for g, model in zip(gmm_k, C.fit_gmm_diag_many(df, cols, [(g, seed) for g in gmm_k])):
        labelled = model.assign(df)
        avg_max = labelled.agg(F.avg("max_probability")).first()[0]
        add(f"gmm_diag_k{g}", "gaussian_mixture_diag", g, labelled,
            {"aic": model.aic(), "bic": model.bic(), "avg_max_probability": float(avg_max)})
    ward_rows, ward_balances, _ = ward_study(df, cols, ward_k, id_col)
    rows.append(ward_rows)
    balances.append(ward_balances)
    add(f"bisecting_k{k}", "bisecting_kmeans", k, df.join(C.bisecting_labels(df, cols, k, id_col, seed), id_col), None)
    return union_all(rows), union_all(balances)
