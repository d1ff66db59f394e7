"""Single steps of the iterative fits, from given parameters.

A fit is a start and a number of these steps; a step has a closed form, so that
it can be checked value by value.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .blocks import PackedRows
from .cluster import _lloyd_pass, em_sums, m_step


def _long_rows(spark, names, cols, tables: dict, per_label: dict) -> DataFrame:
    """(cluster, column, ``tables`` values, ``per_label`` values): one row per label and column."""
    rows = [(names[j], c, *[float(t[j, i]) for t in tables.values()], *[v[j] for v in per_label.values()])
            for j in range(len(names)) for i, c in enumerate(cols)]
    kinds = {"long": int, "double": float}
    schema = ["cluster long", "column string", *[f"{n} double" for n in tables]]
    schema += [f"{n} {next(k for k, t in kinds.items() if isinstance(v[0], t))}" for n, v in per_label.items()]
    return spark.createDataFrame(rows, ", ".join(schema))


def kmeans_step(df: DataFrame, cols, labels, centers: np.ndarray) -> DataFrame:
    """One Lloyd step: rows per centre, their summed squared distances, and the new centres
    (a centre without rows stays). One row per label and column."""
    cols = list(cols)
    X = PackedRows(df, cols)
    try:
        (n, cost, sums), = _lloyd_pass(X, [(np.arange(len(cols)), centers[None], np.ones((1, len(centers)), bool))])
    finally:
        X.unpersist()
    new = np.where(n[0][:, None] > 0, sums[0] / np.maximum(n[0], 1.0)[:, None], centers)
    return _long_rows(df.sparkSession, labels, cols, {"center": new},
                      {"row_count": [int(v) for v in n[0]], "cost": [float(v) for v in cost[0]]})


def gmm_step(df: DataFrame, cols, labels, weights, means, variances, reg_covar: float = 1e-6) -> DataFrame:
    """One EM step of a diagonal mixture: new weights, means and variances, and the mean log-likelihood
    under the given ones. One row per component and column."""
    cols = list(cols)
    X = PackedRows(df, cols)
    try:
        sums, = em_sums(X, [(np.asarray(weights), np.asarray(means), np.asarray(variances))])
    finally:
        X.unpersist()
    w, m, v = m_step(sums, reg_covar)
    score = float(sums[3] / sums[4])
    return _long_rows(df.sparkSession, labels, cols, {"mean": m, "variance": v},
                      {"weight": [float(x) for x in w], "mean_log_likelihood": [score] * len(w)})


def variance_along(df: DataFrame, cols, names, axes: np.ndarray) -> DataFrame:
    """(axis, variance, explained_variance_ratio): population variance of the rows along given directions.

    Axes are scaled to length 1. The ratio is to the total variance of all columns, as a PCA's
    explained variance is; for its own axes both agree.
    """
    axes = np.asarray(axes, dtype=float)
    axes = axes / np.linalg.norm(axes, axis=1, keepdims=True)
    X = PackedRows(df, list(cols))
    width = len(list(cols))
    try:
        def total(blocks):
            n, s = 0.0, np.zeros(width)
            for x, _ in blocks:
                n, s = n + len(x), s + x.sum(axis=0)
            return n, s

        n, s = X.fold(total)
        middle = s / max(n, 1.0)

        def squares(blocks):
            along, every = np.zeros(len(axes)), 0.0
            for x, _ in blocks:
                off = x - middle
                along += ((off @ axes.T) ** 2).sum(axis=0)
                every += float((off ** 2).sum())
            return along, every

        along, every = X.fold(squares)
    finally:
        X.unpersist()
    rows = [(int(a), float(v / max(n, 1.0)), float(v / every) if every else 0.0) for a, v in zip(names, along)]
    return df.sparkSession.createDataFrame(rows, "axis long, variance double, explained_variance_ratio double")
