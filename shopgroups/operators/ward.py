"""Ward linkage over all rows (C16), on clustering features of micro-clusters.

Ward's cost of a merge depends on sizes and centroids only, so rows that are
close together can be stood for by one clustering feature (count, mean, sum of
squared deviations) without a look at them again:

1. Every task reduces its blocks to at most ``max_micro`` features around points
   drawn by their distance from those drawn before, and tasks combine theirs in
   the same way until one list is left. Rows that are equal always share a
   feature; with at most ``max_micro`` different rows each is one of its own.
2. One more pass gives every row to its nearest centre and adds up the exact
   features of these micro-clusters (a second one before it, where rows had to
   be drawn, moves the centres to the means of their rows).
3. Nearest-neighbour chains merge the features by Ward's cost; the tree is cut
   where ``k`` clusters are left.
4. A row's label is its micro-cluster's.

The model held at once is ``max_micro`` x columns, whatever the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .blocks import PackedRows, added

#: Micro-clusters at most. The sum of squares within them, which no later merge can undo, is reported.
MAX_MICRO = 2_048
#: Draws of a reduction, each of an equal part of the centres; and features per centre that a task collects before it reduces them.
DRAWS, HELD = 8, 8


def distinct_features(n: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features with an equal mean as one."""
    centres, own = np.unique(mean, axis=0, return_inverse=True)
    return np.bincount(own.ravel(), weights=n, minlength=len(centres)), centres


def drawn(n: np.ndarray, points: np.ndarray, most: int) -> np.ndarray:
    """Places of ``most`` points, drawn without repeats in proportion to their rows and squared distances to those drawn before."""
    rng = np.random.default_rng(len(n))
    chosen = [int(n.argmax())]
    far = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    for draw in range(DRAWS):
        far[chosen] = 0.0
        weight = n * far
        share = min(-(-(most - len(chosen)) // (DRAWS - draw)), int((weight > 0).sum()))
        if share <= 0:
            break
        # the largest keys are a weighted draw without replacement
        with np.errstate(divide="ignore"):
            key = np.where(weight > 0, np.log(rng.random(len(n))) / np.where(weight > 0, weight, 1.0), -np.inf)
        new = np.argpartition(-key, share - 1)[:share]
        chosen += new.tolist()
        to = (points[new] ** 2).sum(axis=1) - 2.0 * points @ points[new].T + (points ** 2).sum(axis=1)[:, None]
        far = np.minimum(far, np.maximum(to, 0.0).min(axis=1))
    return np.array(chosen)


def reduced(n: np.ndarray, mean: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` features that stand for the given ones."""
    n, mean = distinct_features(n, mean)
    if len(n) <= most:
        return n, mean
    centres = mean[drawn(n, mean, most)]
    own = nearest(mean, centres)
    size = np.bincount(own, weights=n, minlength=len(centres))
    sums = np.zeros(centres.shape)
    np.add.at(sums, own, mean * n[:, None])
    return size, sums / size[:, None]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of every row, of equally near ones the first; a centre equal to the row always wins."""
    out = np.empty(len(x), np.int64)
    step = max(1, 2_000_000 // max(len(centres), 1))
    square = (centres ** 2).sum(axis=1)
    for a in range(0, len(x), step):
        part = x[a: a + step]
        far = square - 2.0 * part @ centres.T
        # what rounding could turn is computed from the differences
        bound = far.min(axis=1) + 1e-12 * ((part ** 2).sum(axis=1) + square.max())
        row, col = np.nonzero(far <= bound[:, None])
        exact = ((part[row] - centres[col]) ** 2).sum(axis=1)
        order = np.lexsort((col, exact, row))
        row, col = row[order], col[order]
        out[a: a + step] = col[np.searchsorted(row, np.arange(len(part)))]
    return out


def ward_merges(n: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Rows (a, b, height, size) of all merges in order of their heights, as a linkage matrix: numbers from
    len(n) on are merged clusters. Height is the square root of twice the growth of the sum of squares."""
    m = len(n)
    size, centre = n.astype(float).copy(), mean.astype(float).copy()
    alive = np.ones(m, bool)
    found, chain = [], []
    for _ in range(m - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            cost = size * size[a] / (size + size[a]) * ((centre - centre[a]) ** 2).sum(axis=1)
            cost[~alive] = np.inf
            cost[a] = np.inf
            b = int(cost.argmin())
            # of equally near ones the one before in the chain, so that chains end
            if len(chain) > 1 and cost[chain[-2]] <= cost[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        a, b = min(a, b), max(a, b)
        found.append((a, b, float(np.sqrt(2.0 * size[a] * size[b] / (size[a] + size[b]) * ((centre[a] - centre[b]) ** 2).sum()))))
        centre[a] = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        alive[b] = False
    # chains find merges out of order; sorted by height, then renamed to the clusters they merge
    order = sorted(range(len(found)), key=lambda i: (found[i][2], i))
    name, total = np.arange(m), n.astype(float).copy()
    out = np.zeros((len(found), 4))
    for step, i in enumerate(order):
        a, b, height = found[i]
        total[a] += total[b]
        out[step] = (min(name[a], name[b]), max(name[a], name[b]), height, total[a])
        name[a] = m + step
    return out


def cut_tree(merges: np.ndarray, m: int, k: int) -> np.ndarray:
    """The cluster of each of ``m`` leaves once ``k`` clusters are left, numbered by their smallest leaf."""
    parent = np.arange(m + len(merges))
    for step in range(max(0, m - k)):
        a, b = int(merges[step, 0]), int(merges[step, 1])
        parent[a] = parent[b] = m + step
    root = np.arange(m)
    while (parent[root] != root).any():
        root = parent[root]
    _, first, own = np.unique(root, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[own]


@dataclass
class WardModel:
    columns: list
    centres: np.ndarray     # micro-clusters x columns
    sizes: np.ndarray
    merges: np.ndarray      # as of ``ward_merges``
    micro_inertia: float    # sum of squares within the micro-clusters: 0 if each is one point
    total_inertia: float    # sum of squares around the mean of all rows

    def micro_labels(self, k: int) -> np.ndarray:
        """The label of each micro-cluster among ``k`` clusters, numbered by size, then by the smallest centre."""
        own = cut_tree(self.merges, len(self.sizes), k)
        rows = np.bincount(own, weights=self.sizes)
        first = [tuple(self.centres[own == c][np.lexsort(self.centres[own == c].T[::-1])[0]]) for c in range(len(rows))]
        rank = {c: i for i, c in enumerate(sorted(range(len(rows)), key=lambda c: (-rows[c], first[c])))}
        return np.array([rank[c] for c in own], dtype=np.int64)

    def assign(self, df: DataFrame, id_col: str, ks) -> DataFrame:
        """(id, cluster_k for every k of ``ks``) of every row, in one pass."""
        ship_package(df.sparkSession)
        ks = list(ks)
        centres, cols = self.centres, self.columns
        tables = [self.micro_labels(k) for k in ks]
        names = [f"cluster_{k}" for k in ks]

        def label(batches):
            for pdf in batches:
                micro = nearest(pdf[[f"x{i}" for i in range(len(cols))]].to_numpy(dtype=float), centres)
                yield pd.DataFrame({"id": pdf["id"], **{name: t[micro] for name, t in zip(names, tables)}})

        kind = df.schema[id_col].dataType.simpleString()
        rows = df.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
        return rows.mapInPandas(label, f"id {kind}, " + ", ".join(f"{n} long" for n in names)).withColumnRenamed("id", id_col)


def fit_ward(df: DataFrame, cols, id_col: str | None = None, max_micro: int = MAX_MICRO) -> WardModel:
    """Ward's tree over all rows; features must not be null. No rows: an error, as no tree has none.

    Exact, ties apart, while the rows have at most ``max_micro`` different values. Beyond that, rows of a
    micro-cluster stay together: ``micro_inertia`` against ``total_inertia`` tells how much that can matter.
    """
    cols = list(cols)
    X = PackedRows(df, cols, id_col)
    width = len(cols)
    try:
        def summarise(blocks):
            n, mean, exact = np.zeros(0), np.zeros((0, width)), True
            for x, _ in blocks:
                n, mean = distinct_features(np.concatenate([n, np.ones(len(x))]), np.concatenate([mean, x]))
                if len(n) > HELD * max_micro:
                    exact, (n, mean) = False, reduced(n, mean, max_micro)
            return closed(n, mean, exact)

        def closed(n, mean, exact):
            fits = len(n) <= max_micro
            n, mean = reduced(n, mean, max_micro)
            return n, mean, exact and fits

        def combine(a, b):
            return closed(*distinct_features(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])), a[2] and b[2])

        _, centres, exact = X.fold(summarise, combine)
        if not len(centres):
            raise ValueError("no rows to cluster")
        grand = centres.mean(axis=0)

        def features(centres):
            def add_up(blocks):
                n, s, q = np.zeros(len(centres)), np.zeros(centres.shape), np.zeros(len(centres))
                t = np.zeros(width + 1)
                for x, _ in blocks:
                    own = nearest(x, centres)
                    off = x - centres[own]
                    n += np.bincount(own, minlength=len(centres))
                    np.add.at(s, own, off)
                    q += np.bincount(own, weights=(off ** 2).sum(axis=1), minlength=len(centres))
                    t += np.append((x - grand).sum(axis=0), ((x - grand) ** 2).sum())
                return n, s, q, t

            return X.fold(add_up, added)

        if not exact:
            n, s, _, _ = features(centres)
            centres = centres[n > 0] + s[n > 0] / n[n > 0, None]
        n, s, q, t = features(centres)
        held = n > 0
        n, s, q, centres = n[held], s[held], q[held], centres[held]
        off = s / n[:, None]
        within = float((q - n * (off ** 2).sum(axis=1)).clip(0).sum())
        total = float(t[-1] - (t[:-1] ** 2).sum() / n.sum())
        return WardModel(cols, centres, n, ward_merges(n, centres + off), within, total)
    finally:
        X.unpersist()


def ward_merge_table(spark, model: WardModel, last: int) -> DataFrame:
    """The last ``last`` merges: how many clusters are left after each, its height and size."""
    rows = [(len(model.merges) - i, float(h), int(s)) for i, (_, _, h, s) in enumerate(model.merges)][-last:]
    return spark.createDataFrame(rows, "clusters_left long, height double, merged_rows long")
