"""Promotion recommendation tables.

The source builds one row per plan row in a Python loop with three lookups.
Here every input is a DataFrame keyed by ``cluster`` and the whole table is
one plan of joins; a missing cluster fails the job through ``raise_error``.
The plan itself (personas, offers, search terms) is analyst input passed in
as a DataFrame, never constants of the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import contains_any, format_count, format_percentage, normalize_terms_array, normalize_terms_text

# The plan's required columns, the output columns, and the
# text used when a cluster has no saved rule.
PLAN_COLUMNS = ["cluster", "persona_name", "persona_summary", "recommended_promotion", "promotion_type",
                "products_to_promote", "risk_or_caveat"]
OUTPUT_COLUMNS = ["cluster", "persona_name", "persona_summary", "main_evidence", "recommended_promotion",
                  "promotion_type", "products_to_promote", "supporting_products", "supporting_association_rules",
                  "risk_or_caveat"]
NO_RULES_TEXT = "No strong pairwise rules saved."
# Source project's evidence sentence: share columns and their display names.
DEFAULT_SHARES = [("groceries", "share_groceries"), ("electronics", "share_electronics"),
                  ("vegetables", "share_vegetables"), ("meat", "share_meat")]


def validate_promotion_plan(plan: DataFrame) -> None:
    """Missing plan columns raise, naming them (schema only, no job)."""
    missing = [c for c in PLAN_COLUMNS if c not in plan.columns]
    if missing:
        raise ValueError(f"Missing promotion plan columns: {missing}")


def plan_terms(plan: DataFrame, column: str) -> Column:
    """G3 + G8: optional search terms as a lower-case array; absent column or NULL -> none."""
    if column not in plan.columns:
        return F.lit(None).cast("array<string>")
    dtype = plan.schema[column].dataType
    if isinstance(dtype, ArrayType):
        return F.when(F.col(column).isNull(), F.lit(None).cast("array<string>")).otherwise(normalize_terms_array(column))
    if isinstance(dtype, StringType):
        return F.when(F.col(column).isNull(), F.lit(None).cast("array<string>")).otherwise(normalize_terms_text(column))
    raise ValueError(f"{column} must be text or an array of text")


def _preferred_first(items: DataFrame, terms: DataFrame, text: Column, rank_col: str, top_n: int) -> DataFrame:
    """Keep items matching any term when at least one does; else keep all. First ``top_n`` by rank."""
    j = items.join(terms, "cluster")
    has_terms = F.col("__terms").isNotNull() & (F.size("__terms") > 0)
    hit = has_terms & contains_any(text, F.col("__terms"))
    j = j.withColumn("__hit", hit).withColumn(
        "__any", F.max(F.col("__hit").cast("int")).over(Window.partitionBy("cluster")))
    kept = j.where(~has_terms | (F.col("__any") == 0) | F.col("__hit"))
    order = Window.partitionBy("cluster").orderBy(F.col(rank_col))
    return kept.withColumn("__pos", F.row_number().over(order)).where(F.col("__pos") <= top_n)


def _ordered_text(df: DataFrame, piece: Column, sep: str, out: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(F.col("__pos").alias("p"), piece.alias("t"))))
    return df.groupBy("cluster").agg(F.array_join(F.transform(parts, lambda s: s["t"]), sep).alias(out))


def list_top_products(top_products: DataFrame, plan: DataFrame, top_n: int = 5,
                      terms_col: str = "product_terms") -> DataFrame:
    """Per plan cluster, first ``top_n`` products by rank (preferring term matches), ", "-joined."""
    terms = plan.select("cluster", plan_terms(plan, terms_col).alias("__terms"))
    picked = _preferred_first(top_products.select("cluster", "product", "product_rank"), terms,
                              F.col("product"), "product_rank", top_n)
    text = _ordered_text(picked, F.col("product"), ", ", "supporting_products")
    return terms.select("cluster").join(text, "cluster", "left").select(
        "cluster", F.coalesce("supporting_products", F.lit("")).alias("supporting_products"))


def list_top_rules(rules: DataFrame, plan: DataFrame, top_n: int = 2, terms_col: str = "rule_terms") -> DataFrame:
    """``a -> c (lift 2.57)`` for the first ``top_n`` rules, "; "-joined; none -> fixed text."""
    terms = plan.select("cluster", plan_terms(plan, terms_col).alias("__terms"))
    text_col = F.concat_ws(" ", F.col("antecedents").cast("string"), F.col("consequents").cast("string"))
    picked = _preferred_first(rules.select("cluster", "antecedents", "consequents", "lift", "rule_rank"), terms,
                              text_col, "rule_rank", top_n)
    piece = F.format_string("%s -> %s (lift %.2f)", F.col("antecedents"), F.col("consequents"), F.col("lift"))
    text = _ordered_text(picked, piece, "; ", "supporting_association_rules")
    return terms.select("cluster").join(text, "cluster", "left").select(
        "cluster", F.coalesce("supporting_association_rules", F.lit(NO_RULES_TEXT)).alias("supporting_association_rules"))


def _require(col: str, what: str) -> Column:
    return F.when(F.col(col).isNull(), F.raise_error(F.concat(
        F.lit(f"Cluster "), F.col("cluster").cast("string"), F.lit(f" was not found in {what}."))))


def cluster_evidence(clusters: DataFrame, cluster_profile: DataFrame, spending_shares: DataFrame,
                     basket_profile: DataFrame, shares=DEFAULT_SHARES) -> DataFrame:
    """G7 (with G1/G2): the fixed evidence sentence per cluster; a cluster absent from any table fails."""
    prof = cluster_profile.select("cluster", "age_mean", "total_lifetime_spend_mean", "has_loyalty_card_mean",
                                  "total_children_home_mean", F.lit(True).alias("__p"))
    sh = spending_shares.select("cluster", *[c for _, c in shares], F.lit(True).alias("__s"))
    bp = basket_profile.select("cluster", "share_of_cluster_customers_with_baskets", F.lit(True).alias("__b"))
    j = clusters.join(prof, "cluster", "left").join(sh, "cluster", "left").join(bp, "cluster", "left")
    share_text = F.concat_ws(", ", *[F.concat(F.lit(f"{name} "), format_percentage(c)) for name, c in shares])
    sentence = F.concat(
        F.lit("Mean age "), F.format_string("%.1f", "age_mean"),
        F.lit("; mean spend "), format_count("total_lifetime_spend_mean"),
        F.lit("; loyalty-card share "), format_percentage("has_loyalty_card_mean"),
        F.lit("; children at home "), F.format_string("%.1f", "total_children_home_mean"),
        F.lit("; "), share_text,
        F.lit(", basket coverage "), format_percentage("share_of_cluster_customers_with_baskets"), F.lit("."))
    guard = F.coalesce(_require("__p", "cluster_profile"), _require("__s", "spending_shares"),
                       _require("__b", "basket_profile"))
    return j.select("cluster", F.coalesce(guard.cast("string"), sentence).alias("main_evidence"))


def create_cluster_promotion_recommendations(plan: DataFrame, cluster_profile: DataFrame,
                                             spending_shares: DataFrame, basket_profile: DataFrame,
                                             top_products: DataFrame, rules: DataFrame,
                                             shares=DEFAULT_SHARES) -> DataFrame:
    """One row per plan row (ordered by cluster), ten output columns."""
    validate_promotion_plan(plan)
    clusters = plan.select("cluster").distinct()
    ev = cluster_evidence(clusters, cluster_profile, spending_shares, basket_profile, shares)
    prods = list_top_products(top_products, plan)
    rls = list_top_rules(rules, plan)
    out = (plan.select(*PLAN_COLUMNS).join(ev, "cluster", "left").join(prods, "cluster", "left")
               .join(rls, "cluster", "left"))
    return out.select(*OUTPUT_COLUMNS).orderBy("cluster")


def cluster_completeness(expected: DataFrame, tables: dict) -> DataFrame:
    """Per evidence table, clusters expected / found / missing / extra (one job per table set)."""
    exp = expected.select("cluster").distinct().withColumn("__e", F.lit(True))
    parts = []
    for name, df in tables.items():
        got = df.select("cluster").distinct().withColumn("__g", F.lit(True))
        j = exp.join(got, "cluster", "full_outer")
        parts.append(j.agg(F.lit(name).alias("table"), F.count("__e").alias("expected_clusters"),
                           F.count("__g").alias("found_clusters"),
                           F.count_if(F.col("__g").isNull()).alias("missing_clusters"),
                           F.count_if(F.col("__e").isNull()).alias("extra_clusters")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def value_context(cluster_profile: DataFrame, plan: DataFrame) -> DataFrame:
    """Profile rows with the persona name attached."""
    return cluster_profile.join(plan.select("cluster", "persona_name"), "cluster", "left")


def cluster_row(frame: DataFrame, cluster, cluster_col: str = "cluster") -> DataFrame:
    """The first row for ``cluster`` (by the frame's remaining columns); none -> error."""
    rest = [c for c in frame.columns if c != cluster_col]
    rows = frame.where(F.col(cluster_col) == F.lit(cluster)).orderBy(*rest).limit(1).collect()
    if not rows:
        raise ValueError(f"Cluster {cluster} was not found.")
    return frame.sparkSession.createDataFrame(rows, frame.schema)
