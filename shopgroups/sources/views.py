"""Retail views over the driver's star-schema tables.

The source project reads two raw tables (one row per customer, one row per
basket). Here they are derived from the driver data:

* basket / invoice  = ``orders`` (``o_orderkey``, ``o_custkey``)
* goods in a basket = ``lineitem`` joined to ``part``; product = ``p_brand``
* segment           = ``customer.c_mktsegment`` (stands in for a cluster label)
* customer table    = ``customer`` left-joined to per-customer aggregates of
  orders, lines and events (spend per ``p_type`` becomes ``lifetime_spend_*``)

Every view is a lazy DataFrame: scans are pruned to the columns used, joins
and aggregations are planned by Catalyst/AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kept import kept
from .tables import read_table

SPEND_PREFIX = "lifetime_spend_"


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per basket: (invoice_id, customer_id)."""
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("invoice_id"), F.col("o_custkey").alias("customer_id"))


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item occurrence: (invoice_id, product)."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("invoice_id"), F.col("p_brand").alias("product"))


def basket_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(invoice_id, customer_id, product), one row per item occurrence."""
    return invoice_lines(spark, sf_dir).join(invoices(spark, sf_dir), "invoice_id")


def customer_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customer_id, cluster) with the market segment as the label."""
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("cluster"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every invoice with its size; invoices without lines are empty baskets (size 0)."""
    sizes = invoice_lines(spark, sf_dir).groupBy("invoice_id").agg(
        F.count("product").alias("basket_size"),
        F.count_distinct("product").alias("distinct_products_per_basket"))
    return invoices(spark, sf_dir).join(sizes, "invoice_id", "left").select(
        "invoice_id", "customer_id",
        F.coalesce("basket_size", F.lit(0)).alias("basket_size"),
        F.coalesce("distinct_products_per_basket", F.lit(0)).alias("distinct_products_per_basket"))


def basket_list_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baskets in the source project's raw form: list text such as ``["a","a","b"]``.

    Built from per-(invoice, product) counts, so a hot invoice is reduced by
    map-side aggregation before its list is assembled. Invoices without lines
    get the text ``[]``.
    """
    counts = invoice_lines(spark, sf_dir).groupBy("invoice_id", "product").agg(F.count("*").alias("n"))
    lists = counts.groupBy("invoice_id").agg(
        F.array_sort(F.collect_list(F.struct("product", "n"))).alias("pc"))
    text = F.to_json(F.flatten(F.transform("pc", lambda s: F.array_repeat(s["product"], s["n"].cast("int")))))
    return invoices(spark, sf_dir).join(lists, "invoice_id", "left").select(
        "invoice_id", "customer_id", F.coalesce(text, F.lit("[]")).alias("list_of_goods"))


def spend_categories(spark: SparkSession, sf_dir: str) -> list[str]:
    """Distinct ``p_type`` values (a dimension attribute, small by nature)."""
    rows = read_table(spark, sf_dir, "part").select("p_type").distinct().orderBy("p_type").collect()
    return [r[0] for r in rows if r[0] is not None]


#: Tables the customer view reads, and its columns by the table that they need beside ``customer``.
CUSTOMER_SOURCES = ("customer", "orders", "lineitem", "part", "events")
ORDER_COLUMNS = ("customer_birthdate", "kids_home", "teens_home", "year_first_transaction")
LINE_COLUMNS = ("number_complaints", "distinct_stores_visited", "lifetime_total_distinct_products", "percentage_of_products_bought_promotion")
EVENT_COLUMNS = ("typical_hour",)


def customer_info(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    """Reference-shaped customer table (one row per customer, NULLs where no data).

    With ``columns`` only the aggregates they need are assembled, lazily: a table that no column needs is not
    scanned. Without, the whole view is meant: it joins and aggregates the three largest tables, and the cleaning,
    quantile and profile operators read it several times, so it is written once and read from there (``kept``).
    """
    if columns is not None:
        return _assembled(spark, sf_dir, [c for c in columns])
    return kept(spark, sf_dir, CUSTOMER_SOURCES, ("customer_info",), lambda: (_assembled(spark, sf_dir, None), None))[0]


def _line_aggregates(spark: SparkSession, sf_dir: str, wanted, spend: dict) -> DataFrame:
    """(lk, the wanted columns and spends) per customer.

    Distinct counts are an aggregate of their own: together with the others, every (customer, supplier) and
    (customer, part) would carry the buffers of all of them through memory and the shuffle.
    """
    orders = read_table(spark, sf_dir, "orders").where(F.col("o_custkey").isNotNull()).select("o_orderkey", F.col("o_custkey").alias("lk"))
    li = read_table(spark, sf_dir, "lineitem")
    lines = li.join(orders, li.l_orderkey == orders.o_orderkey)
    if spend:
        part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
        lines = lines.join(part, lines.l_partkey == part.p_partkey)
    plain = {"number_complaints": F.count_if(F.col("l_returnflag") == "R").cast("double"),
             "percentage_of_products_bought_promotion": F.avg(F.when(F.col("l_discount") > 0, 1.0).otherwise(0.0))}
    distinct = {"distinct_stores_visited": "l_suppkey", "lifetime_total_distinct_products": "l_partkey"}
    own = [e.alias(n) for n, e in plain.items() if n in wanted]
    own += [F.sum(F.when(F.col("p_type") == t, F.col("l_extendedprice"))).alias(n) for n, t in spend.items()]
    apart = [F.count_distinct(c).cast("double").alias(n) for n, c in distinct.items() if n in wanted]
    tables = [lines.groupBy("lk").agg(*e) for e in (own, apart) if e]
    return tables[0] if len(tables) == 1 else tables[0].join(tables[1], "lk")


def _assembled(spark: SparkSession, sf_dir: str, columns) -> DataFrame:
    wanted = None if columns is None else set(columns)

    def needed(names):
        return [n for n in names if wanted is None or n in wanted]

    asks_spend = wanted is None or any(c.startswith(SPEND_PREFIX) for c in wanted)
    spend = {SPEND_PREFIX + t.lower(): t for t in spend_categories(spark, sf_dir)} if asks_spend else {}
    spend = {n: spend[n] for n in needed(spend)}
    base = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    if needed(ORDER_COLUMNS):
        orders = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ok")).agg(
            F.min(F.year("o_orderdate")).cast("double").alias("year_first_transaction"),
            F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("double").alias("kids_home"),
            F.count_if(F.col("o_orderpriority") == "2-HIGH").cast("double").alias("teens_home"),
            F.min("o_orderdate").alias("first_order"))
        base = base.join(orders, F.col("c_custkey") == F.col("ok"), "left")
    if needed(LINE_COLUMNS) or spend:
        base = base.join(_line_aggregates(spark, sf_dir, needed(LINE_COLUMNS), spend), F.col("c_custkey") == F.col("lk"), "left")
    if needed(EVENT_COLUMNS):
        events = read_table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("ek")).agg(
            F.floor(F.avg(F.hour("ts"))).cast("double").alias("typical_hour"))
        base = base.join(events, F.col("c_custkey") == F.col("ek"), "left")
    nk = F.col("c_nationkey")
    prefix = (F.when(nk % 4 == 0, "Bsc. ").when(nk % 4 == 1, "Msc. ").when(nk % 4 == 2, "Phd. ").otherwise(""))
    columns_in_order = {
        "customer_id": F.col("c_custkey"),
        "customer_name": F.concat(prefix, F.col("c_name")),
        "customer_gender": F.when(F.col("c_acctbal") < 0, F.lit(None).cast("string")).when(nk % 2 == 0, "female").otherwise("male"),
        "customer_birthdate": F.date_format(F.add_months(F.col("first_order"), -12 * (nk + 20)), "MM/dd/yyyy hh:mm a"),
        "kids_home": None, "teens_home": None, "number_complaints": None, "distinct_stores_visited": None, **dict.fromkeys(spend),
        "lifetime_total_distinct_products": None, "year_first_transaction": None,
        "loyalty_card_number": F.when(F.col("c_acctbal") > 0, F.lit(1.0)),
        "percentage_of_products_bought_promotion": None, "typical_hour": None,
        "latitude": nk * 2.5 - 30.0, "longitude": nk * 7.0 - 80.0}
    return base.select(*[(F.col(n) if columns_in_order[n] is None else columns_in_order[n]).alias(n) for n in needed(columns_in_order)])


def embeddings_wide(spark: SparkSession, sf_dir: str, dims: int | None = None,
                    prefix: str = "e") -> DataFrame:
    """(vec_id, label, e0..e{d-1}) as DOUBLE columns for the clustering operators."""
    emb = read_table(spark, sf_dir, "embeddings")
    if dims is None:
        dims = emb.select(F.size("embedding")).first()[0]
    return emb.select("vec_id", "label",
                      *[F.col("embedding")[i].cast("double").alias(f"{prefix}{i}") for i in range(dims)])
