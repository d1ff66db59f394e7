"""Cluster profiles, k-to-k+1 split analysis and assignment checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.stats import quantiles

# Default labels and sentences of the two recommendation rows
# (the source project's wording, generalised where it names k; callers may pass their own).
ROBUST_CANDIDATE = "KMeans_k5_compact_robust"
ROBUST_DECISION = ("Keep the smaller k as the metric-supported segmentation level, "
                   "and document the larger-k split as a business tradeoff.")
FEATURE_SET_DROPPED = "customer_gender and degree-level dummy columns"
FEATURE_SET_BASKET_POLICY = "Basket features remain excluded from clustering."
FEATURE_SET_DECISION = "Use the compact business feature set for the final model."


def _numeric(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def _medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Exact medians per key group as a small DataFrame (``{col}_median``)."""
    res = quantiles(df, columns, [0.5], keys)
    table: dict = {}
    for o in res:
        table.setdefault(tuple(o[k] for k in keys), {})[o["column"]] = o["value"]
    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
                       + [f"`{c}_median` double" for c in columns])
    rows = [(*key, *[vals.get(c) for c in columns]) for key, vals in table.items()]
    return df.sparkSession.createDataFrame(rows, schema)


def create_cluster_profile(df: DataFrame, cluster_col: str = "cluster", columns=None) -> DataFrame:
    """C20: ``{col}_mean`` and ``{col}_median`` per cluster (NULLs skipped).

    Columns: all numeric ones, or the listed ones that exist and are numeric.
    Means are one aggregation; medians use the exact two-pass quantiles and
    come back as k rows that are joined on the cluster key.
    """
    if columns is None:
        cols = _numeric(df, exclude=(cluster_col,))
    else:
        cols = [c for c in columns if c in df.columns and isinstance(df.schema[c].dataType, NumericType)]
    means = df.groupBy(cluster_col).agg(*[F.avg(c).alias(f"{c}_mean") for c in cols])
    meds = _medians(df, [cluster_col], cols)
    out = means.join(meds, cluster_col, "left")
    return out.select(cluster_col, *[x for c in cols for x in (f"{c}_mean", f"{c}_median")])


def mean_profile(df: DataFrame, cluster_col: str, columns, suffix: str = "") -> DataFrame:
    """Mean per cluster (e.g. spending shares; NULL skipped, rows need not sum to 1)."""
    return df.groupBy(cluster_col).agg(*[F.avg(c).alias(f"{c}{suffix}") for c in columns])


def metric_means(df: DataFrame, cluster_col: str, spend: str = "total_lifetime_spend",
                 promo: str = "percentage_of_products_bought_promotion",
                 loyalty: str = "has_loyalty_card") -> DataFrame:
    """Mean spend, mean promotion share and loyalty-card percentage per cluster."""
    return df.groupBy(cluster_col).agg(
        F.avg(spend).alias("mean_total_lifetime_spend"), F.avg(promo).alias("mean_promotion_share"),
        (F.avg(loyalty) * 100.0).alias("loyalty_card_percentage"))


def split_counts(labels: DataFrame, a: str = "k5_cluster", b: str = "k6_cluster",
                 threshold: float = 0.05) -> DataFrame:
    """How the largest ``a`` cluster spreads over ``b`` clusters.

    Largest = most rows (ties: smallest label), picked lazily with a window
    over the k per-cluster counts and joined back on the label.
    """
    sizes = labels.groupBy(a).agg(F.count("*").alias("__n"))
    largest = sizes.withColumn("__r", F.row_number().over(Window.orderBy(F.desc("__n"), F.asc(a)))) \
        .where("__r = 1").select(a)
    big = labels.join(largest, a)
    split = big.groupBy(a, b).agg(F.count("*").alias("customer_count"))
    totals = labels.groupBy(b).agg(F.count("*").alias("k6_cluster_total_count"))
    share = F.col("customer_count") / F.sum("customer_count").over(Window.partitionBy(a))
    out = split.join(totals, b, "left").select(
        a, b, "customer_count", share.alias("share_of_big_k5_cluster"), "k6_cluster_total_count",
        (F.col("customer_count") / F.col("k6_cluster_total_count")).alias("share_of_k6_cluster_from_big_k5_cluster"))
    return out.withColumn("main_split_part", F.col("share_of_big_k5_cluster") >= F.lit(threshold))


def split_profile(labels: DataFrame, features: DataFrame, profile_columns, share_columns,
                  a: str = "k5_cluster", b: str = "k6_cluster", id_col: str = "customer_id",
                  threshold: float = 0.05) -> DataFrame:
    """mean/median profile of each (a, b) part of the largest ``a`` cluster, joined to C24."""
    counts = split_counts(labels, a, b, threshold)
    big = labels.join(counts.select(a).distinct(), a).join(features, id_col, "left")
    agg = big.groupBy(a, b).agg(
        F.count_distinct(id_col).alias("customer_count"),
        *[F.avg(c).alias(f"{c}_mean") for c in profile_columns],
        *[F.avg(c).alias(f"{c}_mean") for c in share_columns])
    meds = _medians(big, [a, b], list(profile_columns))
    prof = agg.join(meds, [a, b], "left")
    front = [a, b, "customer_count", "share_of_big_k5_cluster", "k6_cluster_total_count",
             "share_of_k6_cluster_from_big_k5_cluster", "main_split_part"]
    out = prof.join(counts, [a, b, "customer_count"], "left")
    rest = [x for c in profile_columns for x in (f"{c}_mean", f"{c}_median")] + [f"{c}_mean" for c in share_columns]
    return out.select(*front, *rest)


def robustness_recommendation(k_metrics: DataFrame, stability: DataFrame, split: DataFrame,
                              k_a: int = 5, k_b: int = 6, candidate: str = ROBUST_CANDIDATE,
                              decision: str = ROBUST_DECISION) -> DataFrame:
    """One recommendation row whose text is built from metric values.

    The inputs are small result tables (one row per k, per seed pair, per
    split part); their few scalars are read back and formatted.
    """
    rows = {r["k"]: r for r in k_metrics.where(F.col("k").isin(k_a, k_b)).collect()}
    a, b = rows[k_a], rows[k_b]
    st = stability.agg(F.min("adjusted_rand_index").alias("lo"), F.avg("adjusted_rand_index").alias("mean"),
                       F.max("adjusted_rand_index").alias("hi")).first()
    sp = split.where("main_split_part").agg(F.count("*").alias("parts"),
                                            F.sum("share_of_big_k5_cluster").alias("covered")).first()
    out = (
        candidate,
        f"k={k_a} gives usable segments with silhouette {a['silhouette_score']:.3f}, Davies-Bouldin "
        f"{a['davies_bouldin_score']:.3f}, and minimum cluster share {a['min_cluster_percentage']:.2f}%.",
        f"The largest cluster is broad at {a['max_cluster_percentage']:.2f}% of customers; k={k_b} improves "
        f"balance to a largest cluster of {b['max_cluster_percentage']:.2f}% but its silhouette is "
        f"{b['silhouette_score']:.3f} and Davies-Bouldin {b['davies_bouldin_score']:.3f}.",
        f"ARI range {st['lo']:.3f} to {st['hi']:.3f}, mean {st['mean']:.3f}.",
        f"k={k_b} splits the largest k={k_a} cluster into {sp['parts']} main subgroups covering "
        f"{(sp['covered'] or 0.0) * 100:.2f}% of that cluster.",
        decision,
    )
    return k_metrics.sparkSession.createDataFrame(
        [out], "candidate string, evidence_for string, evidence_against string, seed_stability string, "
               "business_balance_check string, recommendation string")


def assignment_checks(base: DataFrame, labels: DataFrame, id_col: str = "customer_id",
                      cluster_col: str = "cluster") -> DataFrame:
    """Assignment rows equal input rows, no repeated id, no missing label ((check, value) rows)."""
    nb = base.count()
    lab = labels.agg(F.count(F.lit(1)).alias("nl"), F.count_distinct(id_col).alias("nd"),
                     F.count_if(F.col(cluster_col).isNull()).alias("nn")).first()
    checks = [("input rows", nb), ("assignment rows", lab["nl"]), ("row counts equal", str(nb == lab["nl"]).lower()),
              ("repeated ids", lab["nl"] - lab["nd"]), ("missing labels", lab["nn"])]
    return base.sparkSession.createDataFrame([(n, str(v)) for n, v in checks], "check string, value string")


def profile_input(labels: DataFrame, features: DataFrame, id_col: str = "customer_id") -> DataFrame:
    """Labels left-joined to features; the row count must not change.

    Repeated feature ids would multiply label rows; they fail the job lazily
    (a window count per id inside the same plan) instead of a separate pass.
    """
    from pyspark.sql import Window as W
    feats = features.withColumn("__dup", F.count(F.lit(1)).over(W.partitionBy(id_col)))
    joined = labels.join(feats, id_col, "left")
    guard = F.when(F.col("__dup") > 1, F.raise_error(F.concat(
        F.lit("features repeat id "), F.col(id_col).cast("string"), F.lit("; the profile join would add rows"))))
    return joined.where(F.coalesce(guard.cast("boolean"), F.lit(True))).drop("__dup")


def feature_set_recommendation(feature_metrics: DataFrame, chosen: str, alternative: str, k: int = 5,
                               dropped: str = FEATURE_SET_DROPPED, basket_policy: str = FEATURE_SET_BASKET_POLICY,
                               decision: str = FEATURE_SET_DECISION) -> DataFrame:
    """C26 (feature-set variant): one row comparing two rows of a feature-set metrics table."""
    rows = {r["feature_set_variant"]: r for r in
            feature_metrics.where(F.col("feature_set_variant").isin(chosen, alternative)).collect()}
    a, c = rows[alternative], rows[chosen]
    reason = (f"The {chosen} set changes silhouette from {a['silhouette_score']:.3f} to {c['silhouette_score']:.3f} "
              f"and Davies-Bouldin from {a['davies_bouldin_score']:.3f} to {c['davies_bouldin_score']:.3f}.")
    return feature_metrics.sparkSession.createDataFrame(
        [(chosen, k, reason, dropped, basket_policy, decision)],
        "recommended_feature_set string, recommended_k int, reason string, dropped_features string, "
        "basket_policy string, decision string")
