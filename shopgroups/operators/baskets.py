"""Basket and affinity operators.

Baskets come in two shapes:

* long: one row per item occurrence ``(basket, [group...], item)`` — the
  shape every aggregation here consumes;
* text: one row per basket with list text (the source project's raw form),
  turned into the long shape by :func:`parse_baskets` + :func:`explode_items`.

All operators are single Spark jobs without driver loops: segments are a
grouping key, not a Python ``for``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import parse_goods_list, sorted_pairs

# The columns of a rule table.
RULE_COLUMNS = ["antecedents", "consequents", "antecedent_support", "consequent_support",
                "support", "confidence", "lift", "leverage", "conviction"]


# ---------------------------------------------------------------- B1 / B2
def cluster_contract_counts(clusters: DataFrame, id_col: str = "customer_id",
                            cluster_col: str = "cluster") -> DataFrame:
    """One row: rows, repeated ids (all but the first, NULL counts as a value), missing labels."""
    return clusters.agg(
        F.count(F.lit(1)).alias("number_of_rows"),
        (F.count(F.lit(1)) - F.count_distinct(id_col)
         - F.max(F.col(id_col).isNull().cast("long"))).alias("duplicated_ids"),
        F.count_if(F.col(cluster_col).isNull()).alias("missing_labels"))


def validate_customer_clusters(clusters: DataFrame, expected_rows: int | None = None,
                               id_col: str = "customer_id", cluster_col: str = "cluster") -> None:
    """Contract for a label table; one aggregation job, raises on the first failure."""
    expected = [id_col, cluster_col]
    if clusters.columns != expected:
        raise ValueError(f"a label table has the columns {expected}; these are {clusters.columns}")
    row = cluster_contract_counts(clusters, id_col, cluster_col).first()
    n = row["number_of_rows"]
    if expected_rows is not None and n != expected_rows:
        raise ValueError(f"{n:,} label rows instead of {expected_rows:,}")
    if (row["duplicated_ids"] or 0) > 0:
        raise ValueError(f"{row['duplicated_ids']:,} label rows have a duplicated {id_col}")
    if row["missing_labels"] > 0:
        raise ValueError(f"{row['missing_labels']:,} label rows are missing their {cluster_col}")


def join_baskets_to_clusters(baskets: DataFrame, clusters: DataFrame, id_col: str = "customer_id",
                             cluster_col: str = "cluster", validate: bool = True,
                             expected_rows: int | None = None) -> DataFrame:
    """Left join baskets to labels; an unmatched basket fails the job (lazy check).

    The failure is a ``raise_error`` inside the same plan, so the check costs
    no extra pass over the baskets.
    """
    if validate:
        validate_customer_clusters(clusters, expected_rows, id_col, cluster_col)
    joined = baskets.join(clusters, id_col, "left")
    guard = F.when(F.col(cluster_col).isNull(), F.raise_error(F.concat(
        F.lit("basket row did not match a final cluster: "), F.col(id_col).cast("string"))))
    return joined.withColumn(cluster_col, F.coalesce(F.col(cluster_col), guard.cast(clusters.schema[cluster_col].dataType)))


# ---------------------------------------------------------------- F12 / F13
def parse_baskets(df: DataFrame, text_col: str = "list_of_goods", on_error: str = "fail") -> DataFrame:
    """Add ``goods_list`` (array), ``basket_size`` and ``distinct_products_per_basket``."""
    goods = parse_goods_list(text_col, on_error)
    return (df.withColumn("goods_list", goods)
              .withColumn("basket_size", F.size("goods_list"))
              .withColumn("distinct_products_per_basket", F.size(F.array_distinct("goods_list"))))


def explode_items(df: DataFrame, list_col: str = "goods_list", item_col: str = "product",
                  keep=("invoice_id", "customer_id")) -> DataFrame:
    """Long shape: one row per item occurrence (NULL items dropped)."""
    return (df.select(*keep, F.explode(list_col).alias(item_col))
              .where(F.col(item_col).isNotNull()))


def basket_sizes(lines: DataFrame, basket_col: str = "invoice_id", item_col: str = "product",
                 keys=("customer_id",)) -> DataFrame:
    """Size and distinct size per basket from the long shape."""
    return lines.groupBy(basket_col, *keys).agg(
        F.count(item_col).alias("basket_size"),
        F.count_distinct(item_col).alias("distinct_products_per_basket"))


# ---------------------------------------------------------------- one aggregate of the lines
def basket_items(lines: DataFrame, baskets: DataFrame, clusters: DataFrame | None = None, basket_col: str = "invoice_id",
                 id_col: str = "customer_id", item_col: str = "product") -> DataFrame:
    """(cluster, customer, basket, product, n): how often each product is in each basket, from one scan of the lines.

    A basket without items is one row with a null product and n = 0; null products are not counted. With
    ``clusters`` a basket without a label fails the job.
    """
    counts = lines.where(F.col(item_col).isNotNull()).groupBy(basket_col, item_col).agg(F.count("*").alias("n"))
    items = baskets.select(basket_col, id_col).join(counts, basket_col, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    front = []
    if clusters is not None:
        items, front = join_baskets_to_clusters(items, clusters, id_col, validate=False), ["cluster"]
    return items.select(*front, id_col, basket_col, item_col, "n")


def baskets_of(items: DataFrame, basket_col: str = "invoice_id", id_col: str = "customer_id", item_col: str = "product") -> DataFrame:
    """One row per basket of a ``basket_items`` table, with its sizes."""
    keys = [c for c in items.columns if c not in (item_col, "n")]
    return items.groupBy(*keys).agg(F.sum("n").alias("basket_size"), F.count(item_col).alias("distinct_products_per_basket"))


def item_sets_of(items: DataFrame, basket_col: str = "invoice_id", item_col: str = "product", cluster_col: str = "cluster") -> DataFrame:
    """One row per non-empty basket with its sorted products."""
    return items.where(F.col(item_col).isNotNull()).groupBy(basket_col, cluster_col).agg(F.array_sort(F.collect_list(item_col)).alias("items"))


# ---------------------------------------------------------------- F14 - F16
def customer_basket_features(baskets: DataFrame, lines: DataFrame, id_col: str = "customer_id", basket_col: str = "invoice_id",
                             item_col: str = "product", count_col: str | None = None) -> DataFrame:
    """Per-customer basket statistics and most frequent product (ties: alphabetical).

    ``baskets`` has one row per basket with sizes; ``lines`` the long shape, or one row per
    basket and product with its count in ``count_col``. The favourite product is a ``min`` over ``(-count, product)`` structs, an
    aggregate that combines map-side, so a heavy customer never needs a sort.
    """
    stats = baskets.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.count(basket_col).alias("basket_count"),
        F.avg("basket_size").alias("avg_basket_size"),
        F.max("basket_size").alias("max_basket_size"),
        F.min("basket_size").alias("min_basket_size"),
        F.sum("basket_size").alias("total_items_bought_in_baskets"),
        F.avg("distinct_products_per_basket").alias("avg_distinct_products_per_basket"))
    per_item = lines.where(F.col(id_col).isNotNull() & F.col(item_col).isNotNull()) \
        .groupBy(id_col, item_col).agg((F.sum(count_col) if count_col else F.count("*")).alias("n"))
    fav = per_item.groupBy(id_col).agg(
        F.count("*").alias("distinct_products_in_baskets"),
        F.min(F.struct((-F.col("n")).alias("neg"), F.col(item_col).alias("item")))["item"]
         .alias("most_frequent_product"))
    return stats.join(fav, id_col, "left").select(
        id_col, "basket_count", "avg_basket_size", "max_basket_size", "min_basket_size",
        "total_items_bought_in_baskets", "distinct_products_in_baskets",
        "avg_distinct_products_per_basket", "most_frequent_product")


def attach_basket_features(customers: DataFrame, features: DataFrame, id_col: str = "customer_id",
                           no_basket_label: str = "No Basket") -> DataFrame:
    """Left join; customers without baskets get 0 for numbers and a label for the product."""
    joined = customers.join(features, id_col, "left")
    fills = {}
    for f in features.schema.fields:
        if f.name == id_col:
            continue
        if f.dataType.typeName() == "string":
            fills[f.name] = F.coalesce(F.col(f.name), F.lit(no_basket_label))
        else:
            fills[f.name] = F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType))
    return joined.withColumns(fills)


def attach_basket_counts(customers: DataFrame, baskets: DataFrame, id_col: str = "customer_id",
                         basket_col: str = "invoice_id") -> DataFrame:
    counts = baskets.groupBy(id_col).agg(F.count(basket_col).alias("basket_count"))
    return customers.join(counts, id_col, "left").withColumn(
        "basket_count", F.coalesce("basket_count", F.lit(0)).cast("long"))


# ---------------------------------------------------------------- B3 / B4
def cluster_basket_profile(baskets: DataFrame, lines: DataFrame, clusters: DataFrame,
                           cluster_col: str = "cluster", id_col: str = "customer_id",
                           basket_col: str = "invoice_id", item_col: str = "product") -> DataFrame:
    """Per-cluster basket profile; clusters without baskets stay with zeros.

    ``baskets``: one row per basket with ``cluster_col``, sizes; ``lines``:
    long shape with ``cluster_col``; ``clusters``: (id, cluster) labels.
    The median basket size is an exact percentile over a small value domain.
    """
    sizes = clusters.groupBy(cluster_col).agg(F.count_distinct(id_col).alias("number_of_cluster_customers"))
    prof = baskets.groupBy(cluster_col).agg(
        F.count(basket_col).alias("number_of_baskets"),
        F.count_distinct(id_col).alias("number_of_customers_with_baskets"),
        F.avg("basket_size").alias("average_basket_size"),
        F.median("basket_size").alias("median_basket_size"),
        F.avg("distinct_products_per_basket").alias("average_distinct_products_per_basket"),
        F.sum("basket_size").alias("total_items_in_baskets"))
    prods = lines.where(F.col(item_col).isNotNull()).groupBy(cluster_col).agg(
        F.count_distinct(item_col).alias("number_of_distinct_products"))
    out = sizes.join(prof, cluster_col, "left").join(prods, cluster_col, "left")
    zero_long = ["number_of_baskets", "number_of_customers_with_baskets", "total_items_in_baskets",
                 "number_of_distinct_products"]
    zero_double = ["average_basket_size", "median_basket_size", "average_distinct_products_per_basket"]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in zero_long})
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in zero_double})
    return out.select(
        cluster_col, *zero_long[:2], *zero_double[:2], zero_double[2], zero_long[2], zero_long[3],
        (F.col("number_of_customers_with_baskets") / F.col("number_of_cluster_customers"))
        .alias("share_of_cluster_customers_with_baskets"))


def cluster_top_products(lines: DataFrame, top_n: int = 10, cluster_col: str = "cluster",
                         item_col: str = "product", count_col: str | None = None) -> DataFrame:
    """Item counts per (cluster, product), share of the cluster's items, top-n by count.

    Ranks are a running number (count desc, product asc): no ties. The
    ``row_number <= n`` filter is planned as a window group limit, so each
    partition keeps only its local top-n before the window shuffle.
    """
    counts = lines.where(F.col(item_col).isNotNull()).groupBy(cluster_col, item_col).agg(
        (F.sum(count_col) if count_col else F.count("*")).alias("product_count"))
    by_cluster = Window.partitionBy(cluster_col)
    ranked = Window.partitionBy(cluster_col).orderBy(F.desc("product_count"), F.asc(item_col))
    return (counts
            .withColumn("product_share_within_cluster",
                        F.col("product_count") / F.sum("product_count").over(by_cluster))
            .withColumn("product_rank", F.row_number().over(ranked))
            .where(F.col("product_rank") <= top_n)
            .select(cluster_col, F.col(item_col).alias("product"), "product_count",
                    "product_share_within_cluster", "product_rank"))


# ---------------------------------------------------------------- B5 - B7
def basket_item_sets(lines: DataFrame, basket_col: str = "invoice_id", item_col: str = "product",
                     keys=()) -> DataFrame:
    """One row per non-empty basket: ``items`` = sorted distinct items.

    ``collect_set`` merges map-side, so a basket with millions of lines
    shrinks to its distinct items before the shuffle. Build the sets before
    attaching slowly-changing attributes (customer, segment): those joins then
    move one row per basket instead of one per line.
    """
    return (lines.where(F.col(item_col).isNotNull())
                 .groupBy(*keys, basket_col)
                 .agg(F.array_sort(F.collect_set(item_col)).alias("items")))


def mine_pair_rules(lines: DataFrame, group_cols=("cluster",), basket_col: str = "invoice_id",
                    item_col: str = "product", min_support: float = 0.01,
                    min_confidence: float = 0.15, min_lift: float = 1.2,
                    prune_items: bool = True, lift_digits: int = 9) -> DataFrame:
    """Directed single-item rules ``a -> c`` per group from the long basket shape."""
    sets = basket_item_sets(lines, basket_col, item_col, group_cols)
    return mine_pair_rules_from_sets(sets, group_cols, basket_col, min_support, min_confidence, min_lift,
                                     prune_items, lift_digits)


#: Groups whose small tables the pair rules broadcast; more are joined as AQE decides.
FEW_GROUPS = 1_000


def few_groups(groups: DataFrame, group_col: str = "cluster") -> bool:
    """Whether the (small) table that defines the groups has at most ``FEW_GROUPS`` of them."""
    return groups.select(group_col).distinct().limit(FEW_GROUPS + 1).count() <= FEW_GROUPS


def mine_pair_rules_from_sets(sets: DataFrame, group_cols=("cluster",), basket_col: str = "invoice_id",
                              min_support: float = 0.01, min_confidence: float = 0.15, min_lift: float = 1.2,
                              prune_items: bool = True, lift_digits: int = 9, few: bool = False) -> DataFrame:
    """Directed single-item rules ``a -> c`` per group (A-priori, two levels).

    ``sets``: one row per non-empty basket with its group columns and
    ``items`` (sorted, distinct). Semantics: baskets without items do not
    count in N; filters are inclusive; lift = n_ac·N / (n_a·n_c), so both
    directions of a pair carry the same lift; conviction is +inf when
    confidence is 1. Lift is rounded to ``lift_digits`` before the threshold
    so that values that sit on it compare the same in every engine.

    Plan: item counts and N are aggregations of the sets; items below min
    support are removed from the sets before pairing (lossless: a pair is
    never more frequent than its items); with ``few`` groups (see
    ``few_groups``) the frequent items are broadcast, so the sets are not
    shuffled by group; pairs are generated inside the row and counted with a partial+final aggregation, so there is no self join
    and a hot group is pre-aggregated map-side before its shuffle.
    """
    g = list(group_cols)
    totals = sets.groupBy(*g).agg(F.count("*").alias("n_baskets"))
    item_counts = (sets.select(*g, F.explode("items").alias("item"))
                       .groupBy(*g, "item").agg(F.count("*").alias("n_item")))
    if prune_items:
        frequent = (item_counts.join(totals, g) if g else item_counts.join(totals))
        frequent = (frequent.where(F.col("n_item") / F.col("n_baskets") >= F.lit(min_support))
                            .groupBy(*g).agg(F.collect_list("item").alias("frequent")))
        # a row's list holds at most (mean basket size / min support) items; with a
        # checked number of groups the pairing stays in the stage that builds the sets
        if (few or not g) and min_support > 0:
            frequent = F.broadcast(frequent)
        sets = (sets.join(frequent, g) if g else sets.join(frequent)) \
            .select(*g, basket_col, F.array_sort(F.array_intersect("items", "frequent")).alias("items"))
    pairs = (sets.select(*g, F.explode(sorted_pairs("items")).alias("p"))
                 .groupBy(*g, F.col("p.a").alias("a"), F.col("p.b").alias("b"))
                 .agg(F.count("*").alias("n_pair")))
    if few or not g:
        totals = F.broadcast(totals)
    pairs = (pairs.join(totals, g) if g else pairs.join(totals)) \
        .where(F.col("n_pair") / F.col("n_baskets") >= F.lit(min_support))
    directed = pairs.select(*g, "n_pair", "n_baskets", F.explode(F.array(
        F.struct(F.col("a").alias("ant"), F.col("b").alias("con")),
        F.struct(F.col("b").alias("ant"), F.col("a").alias("con")))).alias("r"))
    ant = item_counts.select(*g, F.col("item").alias("ant"), F.col("n_item").alias("n_ant"))
    con = item_counts.select(*g, F.col("item").alias("con"), F.col("n_item").alias("n_con"))
    rules = (directed.select(*g, "n_pair", "n_baskets", "r.ant", "r.con")
                     .join(ant, [*g, "ant"]).join(con, [*g, "con"]))
    n = F.col("n_baskets").cast("double")
    n_pair = F.col("n_pair").cast("double")
    support = n_pair / n
    confidence = n_pair / F.col("n_ant").cast("double")
    lift = n_pair * n / (F.col("n_ant").cast("double") * F.col("n_con").cast("double"))
    ant_sup = F.col("n_ant").cast("double") / n
    con_sup = F.col("n_con").cast("double") / n
    out = rules.select(
        *g,
        F.col("ant").alias("antecedents"), F.col("con").alias("consequents"),
        ant_sup.alias("antecedent_support"), con_sup.alias("consequent_support"),
        support.alias("support"), confidence.alias("confidence"), lift.alias("lift"),
        (support - ant_sup * con_sup).alias("leverage"),
        F.when(confidence == 1.0, F.lit(float("inf")))
         .otherwise((F.lit(1.0) - con_sup) / (F.lit(1.0) - confidence)).alias("conviction"))
    return out.where((F.col("confidence") >= F.lit(min_confidence))
                     & (F.round("lift", lift_digits) >= F.lit(min_lift)))


def rank_rules(rules: DataFrame, group_cols=("cluster",), top_n: int = 20) -> DataFrame:
    """First ``top_n`` rules per group by lift, confidence, support (desc), then names."""
    g = list(group_cols)
    order = [F.desc("lift"), F.desc("confidence"), F.desc("support"),
             F.asc("antecedents"), F.asc("consequents")]
    w = Window.partitionBy(*g).orderBy(*order) if g else Window.orderBy(*order)
    return (rules.withColumn("rule_rank", F.row_number().over(w))
                 .where(F.col("rule_rank") <= top_n)
                 .select(*g, *RULE_COLUMNS, "rule_rank"))


def cluster_association_rules(lines: DataFrame, cluster_col: str = "cluster", basket_col: str = "invoice_id",
                              item_col: str = "product", min_support: float = 0.01,
                              min_confidence: float = 0.15, min_lift: float = 1.2,
                              top_n: int = 20) -> DataFrame:
    """Rules per cluster, top ``top_n`` each; clusters without rules are absent."""
    rules = mine_pair_rules(lines, (cluster_col,), basket_col, item_col,
                            min_support, min_confidence, min_lift)
    return rank_rules(rules, (cluster_col,), top_n)


def cluster_association_rules_from_sets(sets: DataFrame, cluster_col: str = "cluster",
                                        basket_col: str = "invoice_id", min_support: float = 0.01,
                                        min_confidence: float = 0.15, min_lift: float = 1.2,
                                        top_n: int = 20, few: bool = False) -> DataFrame:
    """B6 from per-basket item sets that already carry the cluster."""
    rules = mine_pair_rules_from_sets(sets, (cluster_col,), basket_col, min_support, min_confidence, min_lift, few=few)
    return rank_rules(rules, (cluster_col,), top_n)


# ---------------------------------------------------------------- B8 / B9
def rule_summary(rules: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    return rules.groupBy(cluster_col).agg(
        F.count("*").alias("number_of_rules"),
        F.avg("lift").alias("average_lift"), F.max("lift").alias("max_lift"),
        F.avg("confidence").alias("average_confidence"), F.max("confidence").alias("max_confidence"))


def top_rules_with_label(rules: DataFrame, n: int = 5, cluster_col: str = "cluster",
                         digits: int = 4) -> DataFrame:
    """First ``n`` ranked rules per cluster with an ``a -> c`` label, rounded."""
    return rules.where(F.col("rule_rank") <= n).select(
        cluster_col, "rule_rank",
        F.concat_ws(" -> ", "antecedents", "consequents").alias("rule"),
        *[F.round(c, digits).alias(c) for c in ("support", "confidence", "lift")])
