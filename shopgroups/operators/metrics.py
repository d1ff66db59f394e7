"""Clustering metrics (C9-C15), over all rows.

* One aggregation gives every cluster's size, centroid and variance (the sum of
  its features' variances): a model of k rows, like any fitted estimator.
* A second pass (Arrow batches in NumPy) has each row's distance to every
  centroid. The mean squared distance of a row to a cluster's members is its
  squared distance to the centroid plus the cluster's variance, so the
  silhouette over squared Euclidean distances (as MLlib's evaluator) needs no
  pairs of rows: O(rows * k) for all rows. The same pass sums the distances to
  the own centroid for Davies-Bouldin; Calinski-Harabasz needs only the k rows.
* Adjusted Rand index: a contingency ``groupBy(a, b)`` and sums over it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .blocks import PackedRows

MAX_CLUSTERS = 2_000  # bound on k: the model is k x d numbers, Davies-Bouldin k x k
METRIC_TYPES = ("silhouette_score double, calinski_harabasz_score double, davies_bouldin_score double, "
                "min_cluster_size long, max_cluster_size long, min_cluster_percentage double, "
                "max_cluster_percentage double")


def deterministic_sample(df: DataFrame, id_col: str, sample_size: int, seed: int = 42) -> DataFrame:
    """The ``sample_size`` rows with the smallest keys, or all if there are fewer.

    The key is the MD5 of ``seed:id`` (null: empty), which other engines compute alike, so that the sample
    depends on the ids only. Every partition keeps its own smallest keys, then those are merged.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return df.orderBy(key, F.col(id_col)).limit(sample_size)


def cluster_summary(labels: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """C14: cluster, count, percentage of all rows."""
    counts = labels.groupBy(cluster_col).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy())  # over k aggregated rows
    return counts.withColumn("percentage", F.col("count") * 100.0 / total)


def cluster_stats(df: DataFrame, cols, label: str):
    """(labels, sizes, centroids, variances) of the clusters, in label order. More than
    ``MAX_CLUSTERS`` clusters are an error."""
    rows = df.groupBy(label).agg(
        F.count("*").alias("__n"), *[F.avg(c).alias(f"__c{i}") for i, c in enumerate(cols)],
        sum((F.var_pop(c) for c in cols), F.lit(0.0)).alias("__v")).limit(MAX_CLUSTERS + 1).collect()
    if len(rows) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    rows.sort(key=lambda r: (r[label] is None, r[label]))
    return ([r[label] for r in rows], np.array([r["__n"] for r in rows], dtype=float),
            np.array([[r[f"__c{i}"] for i in range(len(cols))] for r in rows], dtype=float).reshape(len(rows), len(cols)),
            np.array([r["__v"] for r in rows], dtype=float))


def _score_rows(x: np.ndarray, own: np.ndarray, sizes: np.ndarray, cents: np.ndarray,
                variances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(silhouette, distance to the own centroid) of every row. Members of single-row clusters
    and rows without another cluster score 0."""
    mid = cents.mean(axis=0)  # smaller numbers, less cancellation
    x, cents = x - mid, cents - mid
    d2 = np.maximum((x ** 2).sum(axis=1)[:, None] + (cents ** 2).sum(axis=1) - 2.0 * x @ cents.T, 0.0)
    every = np.arange(len(x))
    to_own = np.sqrt(((x - cents[own]) ** 2).sum(axis=1))
    mean = d2 + variances
    mean[:, sizes == 0] = np.inf
    n = sizes[own]
    a = mean[every, own] * n / np.maximum(n - 1.0, 1.0)
    mean[every, own] = np.inf
    b = mean.min(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        s = (b - a) / np.maximum(a, b)
    return np.where((n > 1) & np.isfinite(b), np.nan_to_num(s, nan=0.0), 0.0), to_own


def _ch_db(counts, cents, variances, mean_dist):
    k, n = len(counts), counts.sum()
    overall = (cents * counts[:, None]).sum(axis=0) / n
    between = float((counts * ((cents - overall) ** 2).sum(axis=1)).sum())
    within = float((counts * variances).sum())
    if k < 2:
        return None, None
    ch = 1.0 if within == 0.0 else between * (n - k) / (within * (k - 1.0))
    dist = np.sqrt(((cents[:, None, :] - cents[None, :, :]) ** 2).sum(axis=2)) if k * k * cents.shape[1] < 10_000_000 \
        else np.array([np.sqrt(((cents - c) ** 2).sum(axis=1)) for c in cents])
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = (mean_dist[:, None] + mean_dist[None, :]) / dist
    ratio[~np.isfinite(ratio)] = 0.0  # coincident centroids, as scikit-learn
    np.fill_diagonal(ratio, 0.0)
    return float(ch), float(ratio.max(axis=1).mean())


def _metric_values(counts, cents, variances, dist_sum, sil_sum) -> dict:
    ch, db = _ch_db(counts, cents, variances, dist_sum / counts)
    n = counts.sum()
    return {"silhouette_score": float(sil_sum.sum() / n), "calinski_harabasz_score": ch, "davies_bouldin_score": db,
            "min_cluster_size": int(counts.min()), "max_cluster_size": int(counts.max()),
            "min_cluster_percentage": float(counts.min() * 100.0 / n),
            "max_cluster_percentage": float(counts.max() * 100.0 / n)}


def silhouette_samples(df: DataFrame, cols, label: str, id_col: str) -> DataFrame:
    """(id, label, silhouette) of every row."""
    cols = list(cols)
    ship_package(df.sparkSession)
    labels, sizes, cents, variances = cluster_stats(df, cols, label)
    place = {v: i for i, v in enumerate(labels)}
    kinds = {c: df.schema[c].dataType.simpleString() for c in (id_col, label)}

    def score(batches):
        for b in batches:
            own = np.array([place[v] for v in b[label].tolist()], dtype=int)
            if len(own):
                s, _ = _score_rows(b[cols].to_numpy(dtype=float), own, sizes, cents, variances)
                yield pd.DataFrame({id_col: b[id_col], label: b[label], "silhouette": s})

    return df.select(id_col, label, *cols).mapInPandas(
        score, f"`{id_col}` {kinds[id_col]}, `{label}` {kinds[label]}, silhouette double")


def silhouette(df: DataFrame, cols, label: str, id_col: str) -> DataFrame:
    """Mean silhouette over all rows."""
    return silhouette_samples(df, cols, label, id_col).agg(F.avg("silhouette").alias("silhouette_score"))


def _label_metrics(df: DataFrame, cols, label: str) -> dict:
    cols = list(cols)
    ship_package(df.sparkSession)
    labels, sizes, cents, variances = cluster_stats(df, cols, label)
    place = {v: i for i, v in enumerate(labels)}

    def sums(batches):
        dist, sil = np.zeros(len(sizes)), np.zeros(len(sizes))
        for b in batches:
            own = np.array([place[v] for v in b[label].tolist()], dtype=int)
            if len(own):
                s, d = _score_rows(b[cols].to_numpy(dtype=float), own, sizes, cents, variances)
                sil += np.bincount(own, weights=s, minlength=len(sizes))
                dist += np.bincount(own, weights=d, minlength=len(sizes))
        yield pd.DataFrame({"j": np.arange(len(sizes)), "dist": dist, "sil": sil})

    got = df.select(label, *cols).mapInPandas(sums, "j long, dist double, sil double") \
        .groupBy("j").agg(F.sum("dist").alias("dist"), F.sum("sil").alias("sil")).collect()
    by = {r["j"]: r for r in got}
    return _metric_values(sizes, cents, variances, np.array([by[j]["dist"] for j in range(len(sizes))]),
                          np.array([by[j]["sil"] for j in range(len(sizes))]))


def calinski_harabasz(df: DataFrame, cols, label: str) -> DataFrame:
    """C11: (B / (k - 1)) / (W / (n - k)), from the clusters' sizes, centroids and variances alone."""
    _, sizes, cents, variances = cluster_stats(df, list(cols), label)
    ch, _ = _ch_db(sizes, cents, variances, np.zeros(len(sizes)))
    return df.sparkSession.createDataFrame([(ch,)], "calinski_harabasz_score double")


def davies_bouldin(df: DataFrame, cols, label: str) -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / d(c_i, c_j)."""
    return df.sparkSession.createDataFrame([(_label_metrics(df, cols, label)["davies_bouldin_score"],)],
                                           "davies_bouldin_score double")


def adjusted_rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """ARI from the contingency table of two label columns (one row)."""
    cont = df.groupBy(a, b).agg(F.count("*").alias("n"))

    def c2(x):
        return x * (x - 1) / 2.0
    row_sum = F.sum("n").over(Window.partitionBy(a))
    col_sum = F.sum("n").over(Window.partitionBy(b))
    first_a = F.row_number().over(Window.partitionBy(a).orderBy(b)) == 1
    first_b = F.row_number().over(Window.partitionBy(b).orderBy(a)) == 1
    t = cont.select("n", row_sum.alias("ra"), col_sum.alias("cb"), first_a.alias("fa"), first_b.alias("fb"))
    s = t.agg(F.sum(c2(F.col("n").cast("double"))).alias("idx"),
              F.sum(F.when(F.col("fa"), c2(F.col("ra").cast("double")))).alias("sa"),
              F.sum(F.when(F.col("fb"), c2(F.col("cb").cast("double")))).alias("sb"),
              F.sum("n").cast("double").alias("N"))
    expected = F.col("sa") * F.col("sb") / c2(F.col("N"))
    max_idx = (F.col("sa") + F.col("sb")) / 2.0
    ari = F.when(max_idx == expected, F.lit(1.0)).otherwise((F.col("idx") - expected) / (max_idx - expected))
    return s.select(ari.alias("adjusted_rand_index"))


def ari_of_counts(counts: pd.Series) -> float:
    """ARI of a contingency table: counts indexed by the two labels."""
    def pairs(n):
        return float((n * (n - 1) / 2.0).sum())

    index, a, b = pairs(counts), pairs(counts.groupby(level=0).sum()), pairs(counts.groupby(level=1).sum())
    n = float(counts.sum())
    expected, most = a * b / max(n * (n - 1) / 2.0, 1.0), (a + b) / 2.0
    return 1.0 if most == expected else (index - expected) / (most - expected)


def clustering_metrics(df: DataFrame, cols, label: str) -> DataFrame:
    """Silhouette, CH, DB and cluster size range, one row."""
    m = _label_metrics(df, cols, label)
    names = [t.split()[0] for t in METRIC_TYPES.split(", ")]
    return df.sparkSession.createDataFrame([tuple(m[n] for n in names)], METRIC_TYPES)


def evaluation_row(metrics: DataFrame, model: str, algorithm: str, n_clusters: int, extra: dict | None = None) -> DataFrame:
    """Metrics row with model names and optional extra metrics (absent -> NULL when unioned)."""
    out = metrics.select(F.lit(model).alias("model"), F.lit(algorithm).alias("algorithm"),
                         F.lit(n_clusters).alias("n_clusters"), "*")
    for k, v in (extra or {}).items():
        out = out.withColumn(k, F.lit(v))
    return out


def clustering_metrics_for_centers(df: DataFrame, cols, centers: dict, columns: dict | None = None) -> dict:
    """C9 for several fitted centre sets (nearest-centre labels, ties to the lowest index) in two
    shared passes. A set may have ``columns`` of its own. Returns name -> metrics dict."""
    names = list(centers)
    models = [np.asarray(centers[nm], dtype=float) for nm in names]
    own_columns = [list(columns[nm]) if columns else list(cols) for nm in names]
    every = list(dict.fromkeys(c for cs in own_columns for c in cs))
    use = [np.array([every.index(c) for c in cs]) for cs in own_columns]
    X = PackedRows(df, every)
    try:
        def sizes(blocks):
            out = [(np.zeros(len(C)), np.zeros(C.shape), np.zeros(len(C))) for C in models]
            for x, _ in blocks:
                for C, u, (n, s, q) in zip(models, use, out):
                    own = _nearest(x[:, u], C)
                    off = x[:, u] - C[own]
                    n += np.bincount(own, minlength=len(C))
                    np.add.at(s, own, off)
                    q += np.bincount(own, weights=(off ** 2).sum(axis=1), minlength=len(C))
            return tuple(a for part in out for a in part)

        flat, stats = X.fold(sizes), []
        for i, C in enumerate(models):
            n, s, q = flat[3 * i: 3 * i + 3]
            off = s / np.maximum(n, 1.0)[:, None]
            stats.append((n, C + off, np.maximum(q / np.maximum(n, 1.0) - (off ** 2).sum(axis=1), 0.0)))

        def scores(blocks):
            out = [(np.zeros(len(C)), np.zeros(len(C))) for C in models]
            for x, _ in blocks:
                for C, u, st, (dist, sil) in zip(models, use, stats, out):
                    own = _nearest(x[:, u], C)
                    s, d = _score_rows(x[:, u], own, *st)
                    dist += np.bincount(own, weights=d, minlength=len(C))
                    sil += np.bincount(own, weights=s, minlength=len(C))
            return tuple(a for part in out for a in part)

        sums = X.fold(scores)
    finally:
        X.unpersist()
    found = {}
    for i, nm in enumerate(names):
        n, cents, variances = stats[i]
        has = np.flatnonzero(n)
        found[nm] = _metric_values(n[has], cents[has], variances[has], sums[2 * i][has], sums[2 * i + 1][has])
    return found


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
