"""Registered queries: each callable takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver tables (or views Spark derives from them) in
full. Computed columns carry the same aliases as the DuckDB statements in
``oracle.py``; doubles are rounded on both sides so that engine-specific
summation order cannot change the value hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..operators import baskets as B
from ..operators import cluster as C
from ..operators import dbscan as DB
from ..operators import features as FE
from ..operators import metrics as M
from ..operators import offers as G
from ..operators import prep as P
from ..operators import profile as PR
from ..operators import quality as Q
from ..operators import steps as ST
from ..operators import ward as WD
from ..sources import io as IO
from ..sources import views as V
from . import segmentation as SEG

QUERIES: dict = {}

# Rule thresholds for the driver data (near-uniform brands): the source
# project's 0.01 / 0.15 / 1.2 leave no rule at sf0.1.
RULE_SUPPORT, RULE_CONFIDENCE, RULE_LIFT = 0.005, 0.05, 1.0
DIGITS = 6


def register(fn):
    """Add a query; it applies the session defaults (UTC, AQE) before building its plan."""
    from functools import wraps

    from ..session import configure

    @wraps(fn)
    def run(spark: SparkSession, d: str) -> DataFrame:
        configure(spark)
        return fn(spark, d)

    QUERIES[fn.__name__] = run
    return run


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


# ------------------------------------------------------------------ shared views
# ``labels`` is any table (customer_id, cluster); the market segment where none is given
def segment_lines(spark: SparkSession, d: str, labels: DataFrame | None = None) -> DataFrame:
    """(invoice_id, customer_id, cluster, product): item occurrences with the segment."""
    return B.join_baskets_to_clusters(V.basket_lines(spark, d), labels or V.customer_segments(spark, d), validate=False)


def segment_baskets(spark: SparkSession, d: str, validate: bool = False, labels: DataFrame | None = None) -> DataFrame:
    return B.join_baskets_to_clusters(V.baskets(spark, d), labels or V.customer_segments(spark, d), validate=validate)


def basket_items(spark: SparkSession, d: str, labels: DataFrame | None = None) -> DataFrame:
    """(cluster, customer_id, invoice_id, product, n), written: the one aggregate of the lines that sizes, profiles,
    item sets and top products derive from. Without ``labels`` there is no cluster."""
    import uuid

    from ..operators.components import stored
    from ..session import checkpoint_dir
    items = B.basket_items(V.invoice_lines(spark, d), V.invoices(spark, d), labels)
    return stored(items, f"{checkpoint_dir(spark).rstrip('/')}/baskets-{uuid.uuid4().hex}", "items")


# ------------------------------------------------------------------ B5 - B9
def segment_item_sets(spark: SparkSession, d: str, labels: DataFrame | None = None) -> DataFrame:
    """(invoice_id, cluster, items): sets are built from the lines first, then one row
    per basket is joined to its customer's segment."""
    sets = B.basket_item_sets(V.invoice_lines(spark, d))
    baskets = sets.join(V.invoices(spark, d), "invoice_id")
    return (B.join_baskets_to_clusters(baskets, labels or V.customer_segments(spark, d), validate=False)
             .select("invoice_id", "cluster", "items"))


def segment_rules(spark: SparkSession, d: str, labels: DataFrame | None = None, min_lift: float = RULE_LIFT) -> DataFrame:
    return B.cluster_association_rules_from_sets(segment_item_sets(spark, d, labels), "cluster", min_support=RULE_SUPPORT,
                                                 min_confidence=RULE_CONFIDENCE, min_lift=min_lift, top_n=20,
                                                 few=B.few_groups(labels or V.customer_segments(spark, d)))


@register
def segment_association_rules(spark: SparkSession, d: str) -> DataFrame:
    return rounded(segment_rules(spark, d))


@register
def global_association_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = B.mine_pair_rules(V.invoice_lines(spark, d), (), min_support=RULE_SUPPORT,
                              min_confidence=RULE_CONFIDENCE, min_lift=RULE_LIFT)
    return rounded(rules)


@register
def rules_above_all_lifts(spark: SparkSession, d: str) -> DataFrame:
    """A lift that no pair reaches leaves a table without rows, with all columns."""
    return rounded(segment_rules(spark, d, min_lift=1e9))


@register
def rule_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.rule_summary(segment_rules(spark, d)))


@register
def rule_top5(spark: SparkSession, d: str) -> DataFrame:
    return B.top_rules_with_label(segment_rules(spark, d), 5)


# ------------------------------------------------------------------ B1 - B4
@register
def cluster_contract(spark: SparkSession, d: str) -> DataFrame:
    return B.cluster_contract_counts(V.customer_segments(spark, d))


@register
def basket_segment_join(spark: SparkSession, d: str) -> DataFrame:
    return segment_baskets(spark, d, validate=True).select(
        "invoice_id", "customer_id", "cluster", "basket_size", "distinct_products_per_basket")


@register
def segment_basket_profile(spark: SparkSession, d: str) -> DataFrame:
    labels = V.customer_segments(spark, d)
    items = basket_items(spark, d, labels)
    return rounded(B.cluster_basket_profile(B.baskets_of(items), items, labels))


@register
def segment_top_products(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.cluster_top_products(segment_lines(spark, d), top_n=10))


# ------------------------------------------------------------------ F12 - F16
@register
def basket_parse(spark: SparkSession, d: str) -> DataFrame:
    parsed = B.parse_baskets(V.basket_list_text(spark, d))
    return parsed.select("invoice_id", "customer_id", "basket_size", "distinct_products_per_basket",
                         F.array_join("goods_list", ",").alias("goods_text"))


@register
def basket_sizes(spark: SparkSession, d: str) -> DataFrame:
    return V.baskets(spark, d)


@register
def customer_basket_features(spark: SparkSession, d: str) -> DataFrame:
    items = basket_items(spark, d)
    return rounded(B.customer_basket_features(B.baskets_of(items), items, count_col="n"))


def _customer_base(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.tables import read_table
    return read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"))


@register
def customer_with_basket_features(spark: SparkSession, d: str) -> DataFrame:
    items = basket_items(spark, d)
    feats = B.customer_basket_features(B.baskets_of(items), items, count_col="n")
    return rounded(B.attach_basket_features(_customer_base(spark, d), feats))


@register
def customer_basket_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.attach_basket_counts(_customer_base(spark, d), V.invoices(spark, d))


# ------------------------------------------------------------------ F1 - F11, F17 - F19


def model_columns(features: DataFrame) -> list[str]:
    """The source project's 20 model columns with this data's spend shares."""
    shares = [c for c in features.columns if c.startswith(FE.SHARE_PREFIX)]
    return [c for c in P.FINAL_MODEL_COLUMNS if not c.startswith(FE.SHARE_PREFIX)] + shares


def customer_features_frame(spark: SparkSession, d: str) -> DataFrame:
    return FE.add_customer_info_features(V.customer_info(spark, d))


def clean_features_frame(spark: SparkSession, d: str) -> DataFrame:
    return P.clean_feature_values(customer_features_frame(spark, d))


def selected_features_frame(spark: SparkSession, d: str) -> DataFrame:
    clean = clean_features_frame(spark, d)
    return P.select_model_features(clean, model_columns(clean))


@register
def customer_info_view(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.customer_info(spark, d))


@register
def customer_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(customer_features_frame(spark, d))


@register
def degree_levels(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import degree_level
    return V.customer_info(spark, d, ["customer_id", "customer_name"]).select("customer_id", "customer_name",
                                                                             degree_level("customer_name").alias("degree_level"))


@register
def segment_one_hot(spark: SparkSession, d: str) -> DataFrame:
    feats = customer_features_frame(spark, d)
    out = FE.one_hot(feats, "customer_gender", ["female", "male", "other"], "gender")
    out = FE.one_hot(out, "degree_level", ["Bsc", "Msc", "Phd"], "degree")
    return out.select("customer_id", "gender_female", "gender_male", "gender_other",
                      "degree_Bsc", "degree_Msc", "degree_Phd")


@register
def clean_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clean_features_frame(spark, d))


@register
def selected_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(selected_features_frame(spark, d))


@register
def robust_scaled(spark: SparkSession, d: str) -> DataFrame:
    sel = selected_features_frame(spark, d)
    scaled, _ = P.scale_features(sel, [c for c in sel.columns if c != "customer_id"], "robust")
    return rounded(scaled)


@register
def standard_scaled(spark: SparkSession, d: str) -> DataFrame:
    sel = selected_features_frame(spark, d)
    scaled, _ = P.scale_features(sel, [c for c in sel.columns if c != "customer_id"], "standard")
    return rounded(scaled)


@register
def log_robust_scaled(spark: SparkSession, d: str) -> DataFrame:
    sel = selected_features_frame(spark, d)
    scaled, _ = P.scale_features(sel, [c for c in sel.columns if c != "customer_id"], "robust", use_log=True)
    return rounded(scaled)


# ------------------------------------------------------------------ Q1 - Q23


def _spend_cols(df: DataFrame) -> list[str]:
    return FE.spend_columns(df)


@register
def customer_table_info(spark: SparkSession, d: str) -> DataFrame:
    return Q.table_info(V.customer_info(spark, d))


@register
def customer_describe(spark: SparkSession, d: str) -> DataFrame:
    ci = V.customer_info(spark, d)
    return rounded(Q.describe_numeric(ci, Q.numeric_columns(ci, exclude=("customer_id",))))


@register
def customer_describe_text(spark: SparkSession, d: str) -> DataFrame:
    return Q.describe_text(V.customer_info(spark, d, ["customer_name", "customer_gender", "customer_birthdate"]))


@register
def order_key_integrity(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.tables import read_table
    return Q.key_integrity(read_table(spark, d, "orders"), "o_orderkey")


@register
def customer_missing_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.missing_summary(V.customer_info(spark, d)))


@register
def gender_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return Q.value_counts(V.customer_info(spark, d, ["customer_gender"]), "customer_gender")


@register
def segment_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return Q.value_counts(V.customer_segments(spark, d), "cluster", n=3)


@register
def name_prefix_counts(spark: SparkSession, d: str) -> DataFrame:
    return Q.name_prefix_counts(V.customer_info(spark, d, ["customer_name"]))


@register
def card_presence(spark: SparkSession, d: str) -> DataFrame:
    return Q.presence_counts(V.customer_info(spark, d, ["loyalty_card_number"]), "loyalty_card_number")


RANGE_RULES = [
    ("promotion percentage outside [0, 1]", "percentage_of_products_bought_promotion < 0 OR percentage_of_products_bought_promotion > 1"),
    ("year_first_transaction after 2026", "year_first_transaction > 2026"),
    ("typical_hour outside [0, 23]", "typical_hour < 0 OR typical_hour > 23"),
    ("negative kids_home", "kids_home < 0"),
    ("negative teens_home", "teens_home < 0"),
    ("negative number_complaints", "number_complaints < 0"),
    ("negative distinct_stores_visited", "distinct_stores_visited < 0"),
]


@register
def range_rule_violations(spark: SparkSession, d: str) -> DataFrame:
    return Q.rule_violations(V.customer_info(spark, d), [(n, F.expr(e)) for n, e in RANGE_RULES])


@register
def negative_value_counts(spark: SparkSession, d: str) -> DataFrame:
    ci = V.customer_info(spark, d)
    return Q.negative_value_counts(ci, Q.numeric_columns(ci, exclude=("customer_id",)))


@register
def customer_event_id_relationship(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.tables import read_table
    return Q.id_relationship(read_table(spark, d, "customer"), read_table(spark, d, "events"),
                             "c_custkey", "user_id")


@register
def event_coverage(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.tables import read_table
    return rounded(Q.coverage(read_table(spark, d, "customer"), read_table(spark, d, "events"),
                              "c_custkey", "user_id", ("with events", "without events")))


@register
def reference_year_check(spark: SparkSession, d: str) -> DataFrame:
    ci = V.customer_info(spark, d)
    ry = FE.reference_year(ci)
    return rounded(Q.tenure_checks(FE.add_customer_info_features(ci, ry), ry))


@register
def spend_quantiles(spark: SparkSession, d: str) -> DataFrame:
    feats = customer_features_frame(spark, d)
    return rounded(Q.quantile_table(feats, ["total_lifetime_spend", "age", "customer_tenure",
                                            "typical_hour", "number_complaints"]))


@register
def spend_correlation(spark: SparkSession, d: str) -> DataFrame:
    ci = V.customer_info(spark, d)
    return rounded(Q.correlation_lower(ci, _spend_cols(ci)))


@register
def category_spend(spark: SparkSession, d: str) -> DataFrame:
    feats = customer_features_frame(spark, d)
    return rounded(Q.category_spend(feats, [c for c in feats.columns if c.startswith("share_")]))


@register
def segment_median_spend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.group_median(customer_features_frame(spark, d), "total_lifetime_spend", "has_loyalty_card"))


@register
def spend_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.histogram(customer_features_frame(spark, d), "total_lifetime_spend", 30))


@register
def spend_box_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.box_stats(customer_features_frame(spark, d), "total_lifetime_spend"))


@register
def spend_capped(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.capped(customer_features_frame(spark, d), "total_lifetime_spend", 0.99))


@register
def top_customers_by_baskets(spark: SparkSession, d: str) -> DataFrame:
    return Q.top_counts(V.invoices(spark, d), "customer_id", 10, "number_of_baskets")


@register
def product_frequency(spark: SparkSession, d: str) -> DataFrame:
    return Q.top_counts(V.invoice_lines(spark, d), "product", 20, "count")


@register
def feature_validation(spark: SparkSession, d: str) -> DataFrame:
    feats = customer_features_frame(spark, d)
    checks = [
        ("rows", F.count(F.lit(1))),
        ("distinct customer_id", F.count_distinct("customer_id")),
        ("missing age", F.count_if(F.col("age").isNull())),
        ("min age", F.min("age")),
        ("max age", F.max("age")),
        ("negative tenure", F.count_if(F.col("customer_tenure") < 0)),
        ("customers with loyalty card", F.sum("has_loyalty_card")),
        ("missing total_lifetime_spend", F.count_if(F.col("total_lifetime_spend").isNull())),
    ]
    return Q.checks_table(feats, checks)


# ------------------------------------------------------------------ C9 - C15 on embeddings (label = cluster)


def _emb(spark: SparkSession, d: str):
    emb = V.embeddings_wide(spark, d)
    return emb, [c for c in emb.columns if c not in ("vec_id", "label")]


@register
def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    emb, _ = _emb(spark, d)
    return rounded(M.cluster_summary(emb, "label"))


@register
def calinski_harabasz(spark: SparkSession, d: str) -> DataFrame:
    emb, cols = _emb(spark, d)
    return rounded(M.calinski_harabasz(emb, cols, "label"))


@register
def davies_bouldin(spark: SparkSession, d: str) -> DataFrame:
    emb, cols = _emb(spark, d)
    return rounded(M.davies_bouldin(emb, cols, "label"))


@register
def silhouette_score(spark: SparkSession, d: str) -> DataFrame:
    emb, cols = _emb(spark, d)
    return rounded(M.silhouette(emb, cols, "label", "vec_id"))


@register
def silhouette_by_label(spark: SparkSession, d: str) -> DataFrame:
    emb, cols = _emb(spark, d)
    s = M.silhouette_samples(emb, cols, "label", "vec_id")
    return rounded(s.groupBy("label").agg(F.avg("silhouette").alias("mean_silhouette"),
                                          F.count("*").alias("scored_rows")))


@register
def clustering_metrics(spark: SparkSession, d: str) -> DataFrame:
    emb, cols = _emb(spark, d)
    return rounded(M.clustering_metrics(emb, cols, "label"))


@register
def ari_labels(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.tables import read_table
    cust = read_table(spark, d, "customer").select("c_mktsegment", "c_nationkey")
    nation = read_table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    j = cust.join(nation, cust.c_nationkey == nation.n_nationkey)
    return rounded(M.adjusted_rand_index(j, "c_mktsegment", "n_regionkey"))


@register
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Assignment half of K-Means with fixed centres (the per-label means)."""
    emb, cols = _emb(spark, d)
    labels, _, cents, _ = M.cluster_stats(emb, cols, "label")
    out = emb.select("vec_id", "label", C.nearest_center(cols, cents).alias("j"))
    mapping = F.create_map(*[x for j, lab in enumerate(labels) for x in (F.lit(j), F.lit(lab))])
    return out.select("vec_id", "label", mapping[F.col("j")].alias("assigned_cluster"))


def _label_model(spark: SparkSession, d: str):
    """The embeddings and the (label, size, mean, variance) of their given labels: parameters of a single step."""
    emb, cols = _emb(spark, d)
    rows = emb.groupBy("label").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in cols],
                                    *[F.var_pop(c).alias(f"v_{c}") for c in cols]).orderBy("label").collect()  # one row per label
    return (emb, cols, [r["label"] for r in rows], np.array([float(r["n"]) for r in rows]),
            np.array([[r[f"m_{c}"] for c in cols] for r in rows]), np.array([[r[f"v_{c}"] for c in cols] for r in rows]))


@register
def kmeans_one_step(spark: SparkSession, d: str) -> DataFrame:
    """One Lloyd step from the labels' means."""
    emb, cols, labels, _, means, _ = _label_model(spark, d)
    return rounded(ST.kmeans_step(emb, cols, labels, means))


@register
def gmm_one_step(spark: SparkSession, d: str) -> DataFrame:
    """One EM step from the labels' shares, means and variances."""
    emb, cols, labels, n, means, variances = _label_model(spark, d)
    return rounded(ST.gmm_step(emb, cols, labels, n / n.sum(), means, variances + 1e-6))


@register
def variance_along_means(spark: SparkSession, d: str) -> DataFrame:
    """Variance of all embeddings along the directions of the labels' means."""
    emb, cols, labels, _, means, _ = _label_model(spark, d)
    return rounded(ST.variance_along(emb, cols, labels, means))


@register
def given_label_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The solution row of given labels, with an extra metric."""
    emb, cols = _emb(spark, d)
    clusters = emb.select("label").distinct().count()
    return rounded(M.evaluation_row(M.clustering_metrics(emb, cols, "label"), "given_labels", "given", clusters, {"n_features": len(cols)}))


@register
def given_label_recommendation(spark: SparkSession, d: str) -> DataFrame:
    """C26 on given labels: the remainders of ``label`` by 5 and by 6 stand for the two solutions."""
    emb, cols = _emb(spark, d)
    emb = emb.withColumns({"k5_cluster": F.col("label") % 5, "k6_cluster": F.col("label") % 6})
    rows = [{**M.clustering_metrics(emb, cols, f"k{k}_cluster").first().asDict(), "k": k} for k in (5, 6)]
    ari = M.adjusted_rand_index(emb, "k5_cluster", "k6_cluster")
    return PR.robustness_recommendation(SEG.metric_rows(spark, rows), ari, PR.split_counts(emb.select("k5_cluster", "k6_cluster")))


@register
def feature_set_concat(spark: SparkSession, d: str) -> DataFrame:
    """the model columns and the dummies side by side."""
    clean = clean_features_frame(spark, d)
    dummies, _ = SEG.dummy_features(clean)
    return rounded(FE.concat_feature_sets(P.select_model_features(clean, model_columns(clean)), dummies))


# ------------------------------------------------------------------ C1 - C8, C16 - C19 fits (rows-only checks)

N_INIT = 50  # restarts per fit, as in the source notebooks (all restarts share each pass over the data)


@register
def kmeans_segments(spark: SparkSession, d: str) -> DataFrame:
    feats, cols = SEG.scaled_features(spark, d)
    C.validate_clustering_input(feats)
    model = SEG.kmeans_model(feats, cols, 5, 42, N_INIT)
    return model.assign(feats).select("customer_id", "cluster")


@register
def kmeans_k_sweep(spark: SparkSession, d: str) -> DataFrame:
    feats, cols = SEG.scaled_features(spark, d)
    return rounded(SEG.compare_k_values(feats, cols, range(2, 11), n_init=N_INIT))


@register
def kmeans_feature_sets(spark: SparkSession, d: str) -> DataFrame:
    wide, sets = SEG.feature_variants(spark, d, [*SEG.SCALINGS, "standard_with_dummies"])
    return rounded(SEG.compare_feature_sets(wide, sets, 5, n_init=N_INIT))


@register
def kmeans_seed_stability(spark: SparkSession, d: str) -> DataFrame:
    feats, cols = SEG.scaled_features(spark, d)
    return rounded(SEG.seed_stability(feats, cols, 5, [0, 21, 42, 99, 123], n_init=N_INIT))


@register
def gmm_diag_segments(spark: SparkSession, d: str) -> DataFrame:
    feats, cols = SEG.scaled_features(spark, d)
    model = SEG.gmm_model(feats, cols, 5, 42)
    return rounded(model.assign(feats).select("customer_id", "cluster", "max_probability"))


@register
def gmm_model_comparison(spark: SparkSession, d: str) -> DataFrame:
    feats, cols = SEG.scaled_features(spark, d)
    return rounded(SEG.gmm_comparison(feats, cols, [4, 5, 6]))


@register
def ward_segments(spark: SparkSession, d: str) -> DataFrame:
    """Ward's labels of all customers for 4, 5 and 6 clusters."""
    feats, cols = SEG.scaled_features(spark, d)
    return WD.fit_ward(feats, cols, "customer_id").assign(feats, "customer_id", (4, 5, 6))


@register
def ward_merges(spark: SparkSession, d: str) -> DataFrame:
    """The last 20 merges of Ward's tree over all customers (a report)."""
    feats, cols = SEG.scaled_features(spark, d)
    return rounded(WD.ward_merge_table(spark, WD.fit_ward(feats, cols, "customer_id"), 20))


@register
def ward_comparison(spark: SparkSession, d: str) -> DataFrame:
    feats, cols = SEG.scaled_features(spark, d)
    return rounded(SEG.ward_study(feats, cols)[0])


@register
def bisecting_segments(spark: SparkSession, d: str) -> DataFrame:
    feats, cols = SEG.scaled_features(spark, d)
    return C.bisecting_labels(feats, cols, 5)


@register
def pca_projection(spark: SparkSession, d: str) -> DataFrame:
    feats, cols = SEG.scaled_features(spark, d)
    proj, _ = C.pca_projection(feats, cols)
    return rounded(proj)


@register
def dbscan_segments(spark: SparkSession, d: str) -> DataFrame:
    feats, cols = SEG.scaled_features(spark, d)
    return DB.dbscan(feats, cols, eps=3.0, min_samples=10)


@register
def dbscan_cluster_balance(spark: SparkSession, d: str) -> DataFrame:
    feats, cols = SEG.scaled_features(spark, d)
    return rounded(SEG.union_all(SEG.dbscan_study(feats, cols, [2.0, 3.0, 4.0, 5.0], [10, 20])[1]))


@register
def dbscan_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    feats, cols = SEG.scaled_features(spark, d)
    return rounded(SEG.dbscan_diagnostics(feats, cols, [2.0, 3.0, 4.0, 5.0], [10, 20]))


# ------------------------------------------------------------------ C20 - C27 on market segments

PROFILE_COLUMNS = ["age", "customer_tenure", "total_lifetime_spend", "lifetime_total_distinct_products",
                   "percentage_of_products_bought_promotion", "number_complaints", "distinct_stores_visited",
                   "has_loyalty_card", "total_children_home", "typical_hour"]


def segment_features(spark: SparkSession, d: str, labels: DataFrame | None = None) -> DataFrame:
    return PR.profile_input(labels or V.customer_segments(spark, d), customer_features_frame(spark, d))


def split_labels(spark: SparkSession, d: str) -> DataFrame:
    """Two labelings of the same customers: market segment (k5) and region (k6)."""
    from ..sources.tables import read_table
    cust = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    nation = read_table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    return cust.join(nation, cust.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("k5_cluster"),
        F.col("n_regionkey").alias("k6_cluster"))


@register
def segment_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(PR.create_cluster_profile(segment_features(spark, d), "cluster", PROFILE_COLUMNS))


@register
def segment_spend_shares(spark: SparkSession, d: str) -> DataFrame:
    f = segment_features(spark, d)
    return rounded(PR.mean_profile(f, "cluster", [c for c in f.columns if c.startswith("share_")]))


@register
def segment_metric_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(PR.metric_means(segment_features(spark, d), "cluster"))


@register
def segment_split(spark: SparkSession, d: str) -> DataFrame:
    return rounded(PR.split_counts(split_labels(spark, d)))


@register
def segment_split_profile(spark: SparkSession, d: str) -> DataFrame:
    feats = customer_features_frame(spark, d)
    shares = [c for c in feats.columns if c.startswith("share_")]
    cols = [c for c in PROFILE_COLUMNS if c != "typical_hour"]
    return rounded(PR.split_profile(split_labels(spark, d), feats, cols, shares))


@register
def assignment_checks(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.tables import read_table
    return PR.assignment_checks(read_table(spark, d, "customer").select(F.col("c_custkey").alias("customer_id")),
                                V.customer_segments(spark, d))


@register
def metric_recommendation(spark: SparkSession, d: str) -> DataFrame:
    feats, cols = SEG.scaled_features(spark, d)
    seeds = [0, 21, 42, 99, 123]
    # the sweep's and the seeds' fits share their passes, and the one that both have
    configs = [(5, s) for s in seeds] + [(6, 42)]
    fitted = dict(zip(configs, C.fit_kmeans_many(feats, cols, configs, N_INIT)))
    metrics, (m5, m6) = SEG.k_sweep(feats, cols, [5, 6], n_init=N_INIT, models=[fitted[(5, 42)], fitted[(6, 42)]])
    k_metrics = SEG.metric_rows(spark, metrics)
    stability = SEG.seed_stability(feats, cols, 5, seeds, n_init=N_INIT, models=[fitted[(5, s)] for s in seeds])
    labels = feats.select("customer_id", C.nearest_center(cols, m5.centers).alias("k5_cluster"),
                          C.nearest_center(cols, m6.centers).alias("k6_cluster"))
    return PR.robustness_recommendation(k_metrics, stability, PR.split_counts(labels))


# ------------------------------------------------------------------ G1 - G12

OFFER_SHARES = [("economy", "share_economy"), ("large", "share_large"), ("medium", "share_medium"),
                ("promo", "share_promo")]


def offer_plan(spark: SparkSession, d: str, labels: DataFrame | None = None) -> DataFrame:
    """Analyst plan, one row per segment (derived from the segment list of the data)."""
    seg = (labels or V.customer_segments(spark, d)).select("cluster").distinct()
    return seg.select(
        "cluster",
        F.concat(F.initcap(F.lower("cluster")), F.lit(" shoppers")).alias("persona_name"),
        F.concat(F.lit("Customers of the "), F.lower("cluster"), F.lit(" segment")).alias("persona_summary"),
        F.lit("Bundle discount on the strongest pair").alias("recommended_promotion"),
        F.lit("bundle").alias("promotion_type"),
        F.lit("Top two brands").alias("products_to_promote"),
        F.lit("Check margins before discounting").alias("risk_or_caveat"),
        F.when(F.col("cluster").isin("BUILDING", "MACHINERY"), F.lit("brand#1, Brand#2,,")).alias("product_terms"),
        F.when(F.col("cluster") == "HOUSEHOLD", F.array(F.lit("BRAND#2"))).alias("rule_terms"))


def _offer_inputs(spark: SparkSession, d: str, labels: DataFrame | None = None):
    f = segment_features(spark, d, labels)
    prof = PR.create_cluster_profile(f, "cluster", ["age", "total_lifetime_spend", "has_loyalty_card",
                                                   "total_children_home"])
    shares = PR.mean_profile(f, "cluster", [c for c in f.columns if c.startswith("share_")])
    labels = labels or V.customer_segments(spark, d)
    items = basket_items(spark, d, labels)
    basket = B.cluster_basket_profile(B.baskets_of(items), items, labels)
    top = B.cluster_top_products(items, top_n=10, count_col="n")
    rules = B.cluster_association_rules_from_sets(B.item_sets_of(items), "cluster", min_support=RULE_SUPPORT, min_confidence=RULE_CONFIDENCE,
                                                  min_lift=RULE_LIFT, top_n=20, few=B.few_groups(labels))
    return prof, shares, basket, top, rules


def label_offers(spark: SparkSession, d: str, labels: DataFrame) -> DataFrame:
    """B1 to G9 from any label table: the contract is checked, then profiles, products, rules and offers follow."""
    B.validate_customer_clusters(labels)
    prof, shares, basket, top, rules = _offer_inputs(spark, d, labels)
    return G.create_cluster_promotion_recommendations(offer_plan(spark, d, labels), prof, shares, basket, top, rules, OFFER_SHARES)


@register
def given_label_offers(spark: SparkSession, d: str) -> DataFrame:
    """Offers for groups that a label table gives: here four, by the remainder of the id."""
    labels = V.customer_segments(spark, d).select("customer_id", F.concat(F.lit("g"), (F.col("customer_id") % 4).cast("string")).alias("cluster"))
    return label_offers(spark, d, labels)


def fitted_labels(spark: SparkSession, d: str) -> DataFrame:
    """(customer_id, cluster) of the final K-Means model, written like the source project's label file (S3) and read back."""
    import uuid

    from ..session import checkpoint_dir
    feats, cols = SEG.scaled_features(spark, d)
    C.validate_clustering_input(feats)
    labels = SEG.kmeans_model(feats, cols, 5, 42, N_INIT).assign(feats)
    path = f"{checkpoint_dir(spark).rstrip('/')}/assignments-{uuid.uuid4().hex}"
    out = IO.save_cluster_assignments(labels.withColumn("cluster", F.concat(F.lit("k"), F.col("cluster").cast("string"))), path)
    return IO.read_back(spark, path, out.schema)


@register
def fitted_label_offers(spark: SparkSession, d: str) -> DataFrame:
    """The source project's main path: fitted labels into baskets, rules and offers."""
    return label_offers(spark, d, fitted_labels(spark, d))


@register
def fitted_basket_profile(spark: SparkSession, d: str) -> DataFrame:
    labels = fitted_labels(spark, d)
    B.validate_customer_clusters(labels)
    items = basket_items(spark, d, labels)
    return rounded(B.cluster_basket_profile(B.baskets_of(items), items, labels))


@register
def offer_products(spark: SparkSession, d: str) -> DataFrame:
    top = B.cluster_top_products(segment_lines(spark, d), top_n=10)
    return G.list_top_products(top, offer_plan(spark, d), 5)


@register
def offer_rules(spark: SparkSession, d: str) -> DataFrame:
    return G.list_top_rules(segment_rules(spark, d), offer_plan(spark, d), 2)


@register
def offer_evidence(spark: SparkSession, d: str) -> DataFrame:
    prof, shares, basket, _, _ = _offer_inputs(spark, d)
    return G.cluster_evidence(offer_plan(spark, d).select("cluster"), prof, shares, basket, OFFER_SHARES)


@register
def offer_recommendations(spark: SparkSession, d: str) -> DataFrame:
    prof, shares, basket, top, rules = _offer_inputs(spark, d)
    return G.create_cluster_promotion_recommendations(offer_plan(spark, d), prof, shares, basket, top, rules,
                                                      OFFER_SHARES)


@register
def offer_value_context(spark: SparkSession, d: str) -> DataFrame:
    prof, _, _, _, _ = _offer_inputs(spark, d)
    return rounded(G.value_context(prof, offer_plan(spark, d)))


@register
def offer_completeness(spark: SparkSession, d: str) -> DataFrame:
    prof, shares, basket, top, rules = _offer_inputs(spark, d)
    return G.cluster_completeness(V.customer_segments(spark, d), {
        "cluster_profile": prof, "spending_shares": shares, "basket_profile": basket,
        "top_products": top, "association_rules": rules})


# ------------------------------------------------------------------ S1 - S4


@register
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Write (customer_id, cluster) as header CSV under the shared checkpoint folder, read it back."""
    import uuid

    from ..session import checkpoint_dir
    path = f"{checkpoint_dir(spark).rstrip('/')}/assignments-{uuid.uuid4().hex}"
    labels = V.customer_segments(spark, d)
    IO.save_cluster_assignments(labels, path, fmt="csv")
    IO.round_trip_check(spark, labels, path + "-check", fmt="csv")
    return IO.read_back(spark, path, labels.schema, fmt="csv")


@register
def sampled_customers(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic sample of at most 5,000 scaled customers (a sampling operator)."""
    feats, _ = SEG.scaled_features(spark, d)
    return rounded(M.deterministic_sample(feats, "customer_id", 5000, seed=42))


@register
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    feats, cols = SEG.scaled_features(spark, d)
    return rounded(SEG.model_comparison(feats, cols, n_init=N_INIT)[0])


@register
def model_cluster_balance(spark: SparkSession, d: str) -> DataFrame:
    feats, cols = SEG.scaled_features(spark, d)
    return rounded(SEG.model_comparison(feats, cols, n_init=N_INIT)[1])


@register
def complaints_histogram(spark: SparkSession, d: str) -> DataFrame:
    return Q.integer_histogram(V.customer_info(spark, d, ["number_complaints"]), "number_complaints")


@register
def segment_spend_box_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.box_stats(segment_features(spark, d), "total_lifetime_spend", "cluster"))


@register
def pca_explained_variance(spark: SparkSession, d: str) -> DataFrame:
    feats, cols = SEG.scaled_features(spark, d)
    _, ratios = C.pca_projection(feats, cols)
    return rounded(spark.createDataFrame([(i + 1, float(r)) for i, r in enumerate(ratios)],
                                         "component int, explained_variance_ratio double"))


@register
def dbscan_core_points(spark: SparkSession, d: str) -> DataFrame:
    feats, cols = SEG.scaled_features(spark, d)
    return DB.dbscan(feats, cols, eps=3.0, min_samples=10, neighbours_only=True)


@register
def feature_set_recommendation(spark: SparkSession, d: str) -> DataFrame:
    wide, sets = SEG.feature_variants(spark, d, ["standard", "standard_with_dummies"])
    sets = {"compact_business_set": sets["standard"], "previous_with_categorical_dummies": sets["standard_with_dummies"]}
    metrics = SEG.compare_feature_sets(wide, sets, 5, n_init=N_INIT)
    return PR.feature_set_recommendation(metrics, "compact_business_set", "previous_with_categorical_dummies")
