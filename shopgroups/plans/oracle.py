"""DuckDB statements that recompute every registered query from the raw views.

Written independently of the Spark code path (plain joins, self joins and
window functions) so that the driver's comparison checks semantics, not a
transcription. Doubles are rounded like the Spark side (``catalog.DIGITS``).
"""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

D = 6  # rounding digits, equal to catalog.DIGITS


def _r(expr: str, alias: str, digits: int = D) -> str:
    return f"round({expr}, {digits}) AS {alias}"


# ------------------------------------------------------------------ shared CTEs
SEGMENT_LINES = """
seg_lines AS (
  SELECT l.l_orderkey AS invoice_id, o.o_custkey AS customer_id, c.c_mktsegment AS cluster, p.p_brand AS product
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey)"""


def _rules_sql(lines_cte: str, group: bool, support: float, confidence: float, lift: float,
               top_n: int | None, digits: int | None = D) -> str:
    def _r(expr, alias, _d=digits):
        return f"{expr} AS {alias}" if _d is None else f"round({expr}, {_d}) AS {alias}"
    g = "cluster, " if group else ""
    gj = "a.cluster = b.cluster AND " if group else ""
    using = "JOIN tot USING (cluster)" if group else "CROSS JOIN tot"
    gx = "x.cluster = dr.cluster AND " if group else ""
    gy = "y.cluster = dr.cluster AND " if group else ""
    sel = "dr.cluster, " if group else ""
    part = "PARTITION BY cluster " if group else ""
    rank = (f", CAST(row_number() OVER ({part}ORDER BY lift DESC, confidence DESC, support DESC, "
            "antecedents, consequents) AS INTEGER) AS rule_rank") if top_n else ""
    final_rank = ", rule_rank" if top_n else ""
    where_rank = f"WHERE rule_rank <= {top_n}" if top_n else ""
    return f"""
WITH {lines_cte},
bi AS (SELECT DISTINCT {g}invoice_id, product FROM src WHERE product IS NOT NULL),
tot AS (SELECT {g}count(DISTINCT invoice_id) AS n FROM bi {'GROUP BY cluster' if group else ''}),
ic AS (SELECT {g}product AS item, count(*) AS n_item FROM bi GROUP BY ALL),
pc AS (SELECT {'a.cluster, ' if group else ''}a.product AS a, b.product AS b, count(*) AS n_pair
       FROM bi a JOIN bi b ON {gj}a.invoice_id = b.invoice_id AND a.product < b.product
       GROUP BY ALL),
fp AS (SELECT pc.*, tot.n FROM pc {using} WHERE n_pair / n >= {support}),
dr AS (SELECT {g}a AS ant, b AS con, n_pair, n FROM fp UNION ALL SELECT {g}b, a, n_pair, n FROM fp),
r AS (
  SELECT {sel}dr.ant AS antecedents, dr.con AS consequents,
         x.n_item::DOUBLE / n AS antecedent_support,
         y.n_item::DOUBLE / n AS consequent_support,
         n_pair::DOUBLE / n AS support,
         n_pair::DOUBLE / x.n_item AS confidence,
         n_pair::DOUBLE * n / (x.n_item::DOUBLE * y.n_item) AS lift
  FROM dr JOIN ic x ON {gx}x.item = dr.ant JOIN ic y ON {gy}y.item = dr.con),
k AS (
  SELECT *, support - antecedent_support * consequent_support AS leverage,
         CASE WHEN confidence = 1 THEN 'Infinity'::DOUBLE
              ELSE (1 - consequent_support) / (1 - confidence) END AS conviction{rank}
  FROM r WHERE confidence >= {confidence} AND round(lift, 9) >= {lift})
SELECT {g}antecedents, consequents, {_r('antecedent_support', 'antecedent_support')},
       {_r('consequent_support', 'consequent_support')}, {_r('support', 'support')},
       {_r('confidence', 'confidence')}, {_r('lift', 'lift')}, {_r('leverage', 'leverage')},
       {_r('conviction', 'conviction')}{final_rank}
FROM k {where_rank}"""


SUPPORT, CONFIDENCE, LIFT = 0.005, 0.05, 1.0

ORACLE_SQL["segment_association_rules"] = _rules_sql(
    SEGMENT_LINES + ",\nsrc AS (SELECT * FROM seg_lines)", True, SUPPORT, CONFIDENCE, LIFT, 20)
ORACLE_SQL["global_association_rules"] = _rules_sql(
    "src AS (SELECT l.l_orderkey AS invoice_id, p.p_brand AS product FROM lineitem l "
    "JOIN part p ON l.l_partkey = p.p_partkey)", False, SUPPORT, CONFIDENCE, LIFT, None)

RULES_TOP = _rules_sql(SEGMENT_LINES + ",\nsrc AS (SELECT * FROM seg_lines)", True, SUPPORT, CONFIDENCE, LIFT, 20)
RULES_RAW = _rules_sql(SEGMENT_LINES + ",\nsrc AS (SELECT * FROM seg_lines)", True, SUPPORT, CONFIDENCE, LIFT, 20,
                      digits=None)

ORACLE_SQL["rule_summary"] = f"""
WITH t AS ({RULES_RAW})
SELECT cluster, count(*) AS number_of_rules, {_r('avg(lift)', 'average_lift')}, {_r('max(lift)', 'max_lift')},
       {_r('avg(confidence)', 'average_confidence')}, {_r('max(confidence)', 'max_confidence')}
FROM t GROUP BY cluster"""

ORACLE_SQL["rule_top5"] = f"""
WITH t AS ({RULES_RAW})
SELECT cluster, rule_rank, antecedents || ' -> ' || consequents AS rule,
       round(support, 4) AS support, round(confidence, 4) AS confidence, round(lift, 4) AS lift
FROM t WHERE rule_rank <= 5"""

ORACLE_SQL["cluster_contract"] = """
SELECT count(*) AS number_of_rows,
       count(*) - count(DISTINCT c_custkey) - max(CASE WHEN c_custkey IS NULL THEN 1 ELSE 0 END) AS duplicated_ids,
       count(*) FILTER (WHERE c_mktsegment IS NULL) AS missing_labels
FROM customer"""

BASKETS = """
sizes AS (
  SELECT l.l_orderkey AS invoice_id, count(p.p_brand) AS basket_size, count(DISTINCT p.p_brand) AS dp
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1),
baskets AS (
  SELECT o.o_orderkey AS invoice_id, o.o_custkey AS customer_id,
         coalesce(s.basket_size, 0) AS basket_size, coalesce(s.dp, 0) AS distinct_products_per_basket
  FROM orders o LEFT JOIN sizes s ON s.invoice_id = o.o_orderkey)"""

ORACLE_SQL["basket_segment_join"] = f"""
WITH {BASKETS}
SELECT b.invoice_id, b.customer_id, c.c_mktsegment AS cluster, b.basket_size, b.distinct_products_per_basket
FROM baskets b LEFT JOIN customer c ON c.c_custkey = b.customer_id"""

ORACLE_SQL["segment_basket_profile"] = f"""
WITH {BASKETS}, {SEGMENT_LINES.strip()},
seg AS (SELECT c_custkey AS customer_id, c_mktsegment AS cluster FROM customer),
bc AS (SELECT b.*, seg.cluster FROM baskets b JOIN seg USING (customer_id)),
sz AS (SELECT cluster, count(DISTINCT customer_id) AS ncc FROM seg GROUP BY cluster),
pr AS (SELECT cluster, count(invoice_id) AS nb, count(DISTINCT customer_id) AS nc,
              avg(basket_size) AS avg_size, median(basket_size::DOUBLE) AS med_size,
              avg(distinct_products_per_basket) AS avg_dp, sum(basket_size) AS items
       FROM bc GROUP BY cluster),
dp AS (SELECT cluster, count(DISTINCT product) AS ndp FROM seg_lines WHERE product IS NOT NULL GROUP BY cluster)
SELECT sz.cluster, coalesce(nb, 0) AS number_of_baskets, coalesce(nc, 0) AS number_of_customers_with_baskets,
       {_r('coalesce(avg_size, 0)', 'average_basket_size')}, {_r('coalesce(med_size, 0)', 'median_basket_size')},
       {_r('coalesce(avg_dp, 0)', 'average_distinct_products_per_basket')},
       coalesce(items, 0)::BIGINT AS total_items_in_baskets, coalesce(ndp, 0) AS number_of_distinct_products,
       {_r('coalesce(nc, 0)::DOUBLE / ncc', 'share_of_cluster_customers_with_baskets')}
FROM sz LEFT JOIN pr USING (cluster) LEFT JOIN dp USING (cluster)"""

ORACLE_SQL["segment_top_products"] = f"""
WITH {SEGMENT_LINES.strip()},
pc AS (SELECT cluster, product, count(*) AS product_count FROM seg_lines WHERE product IS NOT NULL GROUP BY ALL),
r AS (SELECT *, product_count::DOUBLE / sum(product_count) OVER (PARTITION BY cluster) AS share,
             CAST(row_number() OVER (PARTITION BY cluster ORDER BY product_count DESC, product) AS INTEGER) AS product_rank
      FROM pc)
SELECT cluster, product, product_count, {_r('share', 'product_share_within_cluster')}, product_rank
FROM r WHERE product_rank <= 10"""

ORACLE_SQL["basket_parse"] = """
WITH items AS (
  SELECT l.l_orderkey AS invoice_id, list(p.p_brand ORDER BY p.p_brand) AS goods
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1)
SELECT o.o_orderkey AS invoice_id, o.o_custkey AS customer_id,
       CAST(coalesce(len(goods), 0) AS INTEGER) AS basket_size,
       CAST(coalesce(len(list_distinct(goods)), 0) AS INTEGER) AS distinct_products_per_basket,
       coalesce(array_to_string(goods, ','), '') AS goods_text
FROM orders o LEFT JOIN items i ON i.invoice_id = o.o_orderkey"""

ORACLE_SQL["basket_sizes"] = f"WITH {BASKETS} SELECT * FROM baskets"

BASKET_FEATURES = f"""
{BASKETS},
lines AS (SELECT o.o_custkey AS customer_id, p.p_brand AS product
          FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey),
st AS (SELECT customer_id, count(invoice_id) AS basket_count, avg(basket_size) AS avg_basket_size,
              max(basket_size) AS max_basket_size, min(basket_size) AS min_basket_size,
              sum(basket_size)::BIGINT AS total_items_bought_in_baskets,
              avg(distinct_products_per_basket) AS avg_distinct_products_per_basket
       FROM baskets WHERE customer_id IS NOT NULL GROUP BY customer_id),
pc AS (SELECT customer_id, product, count(*) AS n FROM lines WHERE product IS NOT NULL GROUP BY ALL),
fav AS (SELECT customer_id, count(*) AS distinct_products_in_baskets,
               arg_min(product, (-n, product)) AS most_frequent_product
        FROM pc GROUP BY customer_id),
bf AS (SELECT st.*, fav.distinct_products_in_baskets, fav.most_frequent_product
       FROM st LEFT JOIN fav USING (customer_id))"""

ORACLE_SQL["customer_basket_features"] = f"""
WITH {BASKET_FEATURES}
SELECT customer_id, basket_count, {_r('avg_basket_size', 'avg_basket_size')}, max_basket_size, min_basket_size,
       total_items_bought_in_baskets, distinct_products_in_baskets,
       {_r('avg_distinct_products_per_basket', 'avg_distinct_products_per_basket')}, most_frequent_product
FROM bf"""

ORACLE_SQL["customer_with_basket_features"] = f"""
WITH {BASKET_FEATURES}
SELECT c.c_custkey AS customer_id, c.c_mktsegment AS segment,
       coalesce(basket_count, 0) AS basket_count, {_r('coalesce(avg_basket_size, 0)', 'avg_basket_size')},
       coalesce(max_basket_size, 0) AS max_basket_size, coalesce(min_basket_size, 0) AS min_basket_size,
       coalesce(total_items_bought_in_baskets, 0) AS total_items_bought_in_baskets,
       coalesce(distinct_products_in_baskets, 0) AS distinct_products_in_baskets,
       {_r('coalesce(avg_distinct_products_per_basket, 0)', 'avg_distinct_products_per_basket')},
       coalesce(most_frequent_product, 'No Basket') AS most_frequent_product
FROM customer c LEFT JOIN bf ON bf.customer_id = c.c_custkey"""

ORACLE_SQL["customer_basket_counts"] = """
SELECT c.c_custkey AS customer_id, c.c_mktsegment AS segment, coalesce(n, 0) AS basket_count
FROM customer c LEFT JOIN (SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY 1) o
  ON o.o_custkey = c.c_custkey"""


# ------------------------------------------------------------------ customer view and features
# p_type values of the driver data = spend categories of the customer view
CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
SPEND = [f"lifetime_spend_{c.lower()}" for c in CATEGORIES]
SHARES = [f"share_{c.lower()}" for c in CATEGORIES]

CUSTOMER_INFO = f"""
ci_orders AS (
  SELECT o_custkey AS ok, CAST(min(year(o_orderdate)) AS DOUBLE) AS year_first_transaction,
         CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE) AS kids_home,
         CAST(count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS DOUBLE) AS teens_home,
         min(o_orderdate) AS first_order
  FROM orders GROUP BY 1),
ci_lines AS (
  SELECT o.o_custkey AS lk,
         CAST(count(*) FILTER (WHERE l.l_returnflag = 'R') AS DOUBLE) AS number_complaints,
         CAST(count(DISTINCT l.l_suppkey) AS DOUBLE) AS distinct_stores_visited,
         CAST(count(DISTINCT l.l_partkey) AS DOUBLE) AS lifetime_total_distinct_products,
         avg(CASE WHEN l.l_discount > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS percentage_of_products_bought_promotion,
         {', '.join(f"sum(CASE WHEN p.p_type = '{c}' THEN l.l_extendedprice END) AS {s}" for c, s in zip(CATEGORIES, SPEND))}
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY 1),
ci_events AS (SELECT user_id AS ek, CAST(floor(avg(hour(ts))) AS DOUBLE) AS typical_hour FROM events GROUP BY 1),
customer_info AS (
  SELECT c.c_custkey AS customer_id,
         (CASE c.c_nationkey % 4 WHEN 0 THEN 'Bsc. ' WHEN 1 THEN 'Msc. ' WHEN 2 THEN 'Phd. ' ELSE '' END) || c.c_name AS customer_name,
         CASE WHEN c.c_acctbal < 0 THEN NULL WHEN c.c_nationkey % 2 = 0 THEN 'female' ELSE 'male' END AS customer_gender,
         strftime(first_order - to_years(20 + c.c_nationkey), '%m/%d/%Y %I:%M %p') AS customer_birthdate,
         kids_home, teens_home, number_complaints, distinct_stores_visited, {', '.join(SPEND)},
         lifetime_total_distinct_products, year_first_transaction,
         CASE WHEN c.c_acctbal > 0 THEN 1.0::DOUBLE END AS loyalty_card_number,
         percentage_of_products_bought_promotion, typical_hour,
         c.c_nationkey::DOUBLE * 2.5 - 30.0 AS latitude, c.c_nationkey::DOUBLE * 7.0 - 80.0 AS longitude
  FROM customer c LEFT JOIN ci_orders ON ok = c.c_custkey LEFT JOIN ci_lines ON lk = c.c_custkey
       LEFT JOIN ci_events ON ek = c.c_custkey)"""

KEPT = ["customer_id", "customer_gender", "kids_home", "teens_home", "number_complaints",
        "distinct_stores_visited", "lifetime_total_distinct_products", "year_first_transaction",
        "percentage_of_products_bought_promotion", "typical_hour", "latitude", "longitude"]
ENGINEERED_NUM = ["age", "customer_tenure", "has_loyalty_card", "total_children_home", "has_children",
                  "total_lifetime_spend", *SHARES]
FEATURE_COLS = [*KEPT, *ENGINEERED_NUM, "degree_level"]
MODEL = ["number_complaints", "distinct_stores_visited", "lifetime_total_distinct_products",
         "percentage_of_products_bought_promotion", "typical_hour", "age", "customer_tenure",
         "has_loyalty_card", "total_children_home", "total_lifetime_spend", *SHARES]

_total = (f"CASE WHEN coalesce({', '.join(SPEND)}) IS NOT NULL THEN 0.0::DOUBLE + "
          + " + ".join(f"coalesce({s}, 0.0)" for s in SPEND) + " END")
FEATURES = f"""
{CUSTOMER_INFO},
ref AS (SELECT max(year_first_transaction) AS ry FROM customer_info),
f0 AS (
  SELECT ci.*, ry - year(try_strptime(customer_birthdate, '%m/%d/%Y %I:%M %p')) AS age,
         ry - year_first_transaction AS customer_tenure,
         CAST(loyalty_card_number IS NOT NULL AS INTEGER) AS has_loyalty_card,
         kids_home + teens_home AS total_children_home,
         CAST(coalesce(kids_home + teens_home, 0) > 0 AS INTEGER) AS has_children,
         {_total} AS total_lifetime_spend,
         CASE WHEN starts_with(trim(customer_name), 'Bsc.') THEN 'Bsc'
              WHEN starts_with(trim(customer_name), 'Msc.') THEN 'Msc'
              WHEN starts_with(trim(customer_name), 'Phd.') THEN 'Phd' ELSE 'Unknown' END AS degree_level
  FROM customer_info ci, ref),
features AS (
  SELECT {', '.join(KEPT)}, age, customer_tenure, has_loyalty_card, total_children_home, has_children,
         total_lifetime_spend,
         {', '.join(f"CASE WHEN total_lifetime_spend > 0 THEN {s} / total_lifetime_spend ELSE 0.0 END AS {h}" for s, h in zip(SPEND, SHARES))},
         degree_level
  FROM f0)"""

_NUM = [c for c in FEATURE_COLS if c not in ("customer_id", "customer_gender", "degree_level")]
_INT = {"has_loyalty_card", "has_children"}
CLEAN = f"""
{FEATURES},
clipped AS (
  SELECT * REPLACE (CASE WHEN percentage_of_products_bought_promotion IS NULL THEN NULL
                         ELSE least(greatest(percentage_of_products_bought_promotion, 0), 100) END
                    AS percentage_of_products_bought_promotion)
  FROM features),
med AS (SELECT {', '.join(f"median({c}::DOUBLE) AS m_{c}" for c in _NUM)} FROM clipped),
clean AS (
  SELECT customer_id, coalesce(customer_gender, 'Unknown') AS customer_gender,
         {', '.join(f"coalesce({c}, CAST(coalesce(m_{c}, 0) AS {'INTEGER' if c in _INT else 'DOUBLE'})) AS {c}" for c in _NUM)},
         coalesce(degree_level, 'Unknown') AS degree_level
  FROM clipped, med)"""


def _rounded_select(cols, src, doubles) -> str:
    return "SELECT " + ", ".join(_r(c, c) if c in doubles else c for c in cols) + f" FROM {src}"


_DOUBLES = set(_NUM) - _INT
ORACLE_SQL["customer_info_view"] = (
    f"WITH {CUSTOMER_INFO.strip()} "
    + _rounded_select(["customer_id", "customer_name", "customer_gender", "customer_birthdate", "kids_home",
                       "teens_home", "number_complaints", "distinct_stores_visited", *SPEND,
                       "lifetime_total_distinct_products", "year_first_transaction", "loyalty_card_number",
                       "percentage_of_products_bought_promotion", "typical_hour", "latitude", "longitude"],
                      "customer_info", {"kids_home", "teens_home", "number_complaints", "distinct_stores_visited",
                                        *SPEND, "lifetime_total_distinct_products", "year_first_transaction",
                                        "loyalty_card_number", "percentage_of_products_bought_promotion",
                                        "typical_hour", "latitude", "longitude"}))
ORACLE_SQL["customer_features"] = f"WITH {FEATURES.strip()} " + _rounded_select(FEATURE_COLS, "features", _DOUBLES)
ORACLE_SQL["degree_levels"] = f"""
WITH {CUSTOMER_INFO.strip()}
SELECT customer_id, customer_name,
       CASE WHEN starts_with(trim(customer_name), 'Bsc.') THEN 'Bsc'
            WHEN starts_with(trim(customer_name), 'Msc.') THEN 'Msc'
            WHEN starts_with(trim(customer_name), 'Phd.') THEN 'Phd' ELSE 'Unknown' END AS degree_level
FROM customer_info"""
ORACLE_SQL["segment_one_hot"] = f"""
WITH {FEATURES.strip()}
SELECT customer_id,
       coalesce(CAST(customer_gender = 'female' AS INTEGER), 0) AS gender_female,
       coalesce(CAST(customer_gender = 'male' AS INTEGER), 0) AS gender_male,
       coalesce(CAST(customer_gender = 'other' AS INTEGER), 0) AS gender_other,
       coalesce(CAST(degree_level = 'Bsc' AS INTEGER), 0) AS degree_Bsc,
       coalesce(CAST(degree_level = 'Msc' AS INTEGER), 0) AS degree_Msc,
       coalesce(CAST(degree_level = 'Phd' AS INTEGER), 0) AS degree_Phd
FROM features"""
ORACLE_SQL["clean_features"] = f"WITH {CLEAN.strip()} " + _rounded_select(FEATURE_COLS, "clean", _DOUBLES)
ORACLE_SQL["selected_features"] = (f"WITH {CLEAN.strip()} "
                                   + _rounded_select(["customer_id", *MODEL], "clean", _DOUBLES))


def _scaled_sql(method: str, use_log: bool) -> str:
    x = {c: (f"ln(1 + greatest({c}::DOUBLE, 0))" if use_log else f"{c}::DOUBLE") for c in MODEL}
    if method == "robust":
        stats = ", ".join(f"quantile_cont({x[c]}, [0.25, 0.5, 0.75]) AS q_{c}" for c in MODEL)
        cols = ", ".join(
            f"round(({x[c]} - q_{c}[2]) / CASE WHEN q_{c}[3] - q_{c}[1] = 0 THEN 1 ELSE q_{c}[3] - q_{c}[1] END, {D}) AS {c}"
            for c in MODEL)
    else:
        stats = ", ".join(f"avg({x[c]}) AS m_{c}, stddev_pop({x[c]}) AS s_{c}" for c in MODEL)
        cols = ", ".join(
            f"round(({x[c]} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, {D}) AS {c}" for c in MODEL)
    return f"WITH {CLEAN.strip()}, st AS (SELECT {stats} FROM clean) SELECT customer_id, {cols} FROM clean, st"


ORACLE_SQL["robust_scaled"] = _scaled_sql("robust", False)
ORACLE_SQL["standard_scaled"] = _scaled_sql("standard", False)
ORACLE_SQL["log_robust_scaled"] = _scaled_sql("robust", True)


# ------------------------------------------------------------------ Q1 - Q23
CI_COLS = ["customer_id", "customer_name", "customer_gender", "customer_birthdate", "kids_home", "teens_home",
           "number_complaints", "distinct_stores_visited", *SPEND, "lifetime_total_distinct_products",
           "year_first_transaction", "loyalty_card_number", "percentage_of_products_bought_promotion",
           "typical_hour", "latitude", "longitude"]
CI_TEXT = ["customer_name", "customer_gender", "customer_birthdate"]
CI_NUM = [c for c in CI_COLS if c not in CI_TEXT and c != "customer_id"]
WCI = f"WITH {CUSTOMER_INFO.strip()} "

ORACLE_SQL["customer_table_info"] = WCI + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column, '{'bigint' if c == 'customer_id' else ('string' if c in CI_TEXT else 'double')}' "
    f"AS data_type, count({c}) AS non_null_count, count(*) AS row_count FROM customer_info"
    for i, c in enumerate(CI_COLS))

ORACLE_SQL["customer_describe"] = WCI + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count({c}) AS count, {_r(f'avg({c})', 'mean')}, {_r(f'stddev_samp({c})', 'std')}, "
    f"{_r(f'min({c})', 'min')}, {_r(f'quantile_cont({c}, 0.25)', 'p25')}, {_r(f'quantile_cont({c}, 0.5)', 'p50')}, "
    f"{_r(f'quantile_cont({c}, 0.75)', 'p75')}, {_r(f'max({c})', 'max')} FROM customer_info" for c in CI_NUM)

ORACLE_SQL["customer_describe_text"] = WCI + ", kv AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, {c} AS value FROM customer_info WHERE {c} IS NOT NULL" for c in CI_TEXT) + """),
vc AS (SELECT "column", value, count(*) AS n FROM kv GROUP BY ALL)
SELECT "column", sum(n)::BIGINT AS count, count(*) AS "unique", arg_min(value, (-n, value)) AS top,
       max(n) AS freq
FROM vc GROUP BY 1"""

ORACLE_SQL["order_key_integrity"] = """
WITH a AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS nd,
                  max(CASE WHEN o_orderkey IS NULL THEN 1 ELSE 0 END) AS nul FROM orders),
w AS (SELECT coalesce(sum(c - 1), 0) AS rr FROM (SELECT count(*) AS c FROM orders GROUP BY ALL))
SELECT 'duplicated o_orderkey count' AS check, CAST(n - nd - nul AS VARCHAR) AS value FROM a
UNION ALL SELECT 'unique o_orderkey count', CAST(nd + nul AS VARCHAR) FROM a
UNION ALL SELECT 'o_orderkey is unique', CASE WHEN n - nd - nul = 0 THEN 'true' ELSE 'false' END FROM a
UNION ALL SELECT 'duplicated row count', CAST(rr AS VARCHAR) FROM w"""
# the whole-row group above must group by every column of orders
ORACLE_SQL["order_key_integrity"] = ORACLE_SQL["order_key_integrity"].replace(
    "FROM orders GROUP BY ALL", "FROM orders GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
    "o_orderdate, o_orderpriority")

ORACLE_SQL["customer_missing_summary"] = WCI + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS missing_count, "
    f"{_r(f'count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*)', 'missing_percentage')} FROM customer_info"
    for c in CI_COLS)

ORACLE_SQL["gender_value_counts"] = WCI + "SELECT customer_gender, count(*) AS count FROM customer_info GROUP BY 1"
ORACLE_SQL["segment_value_counts"] = """
SELECT c_mktsegment AS cluster, count(*) AS count FROM customer GROUP BY 1
ORDER BY count DESC, cluster NULLS FIRST LIMIT 3"""
ORACLE_SQL["name_prefix_counts"] = WCI + """
SELECT CASE WHEN regexp_extract(coalesce(customer_name, ''), '^(Bsc\\.|Msc\\.|Phd\\.)', 1) = '' THEN 'No visible prefix'
            ELSE regexp_extract(customer_name, '^(Bsc\\.|Msc\\.|Phd\\.)', 1) END AS prefix, count(*) AS count
FROM customer_info GROUP BY 1"""
ORACLE_SQL["card_presence"] = WCI + """
SELECT CASE WHEN loyalty_card_number = 1.0 THEN 'Present' ELSE 'Missing' END AS status, count(*) AS count
FROM customer_info GROUP BY 1"""

_RULES = [
    ("promotion percentage outside [0, 1]", "percentage_of_products_bought_promotion < 0 OR percentage_of_products_bought_promotion > 1"),
    ("year_first_transaction after 2026", "year_first_transaction > 2026"),
    ("typical_hour outside [0, 23]", "typical_hour < 0 OR typical_hour > 23"),
    ("negative kids_home", "kids_home < 0"),
    ("negative teens_home", "teens_home < 0"),
    ("negative number_complaints", "number_complaints < 0"),
    ("negative distinct_stores_visited", "distinct_stores_visited < 0"),
]
ORACLE_SQL["range_rule_violations"] = WCI + " UNION ALL ".join(
    f"SELECT '{n}' AS check, count(*) FILTER (WHERE {e}) AS count FROM customer_info" for n, e in _RULES)
ORACLE_SQL["negative_value_counts"] = WCI + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} < 0) AS negative_count FROM customer_info"
    for c in CI_NUM) + ") WHERE negative_count > 0"

ORACLE_SQL["customer_event_id_relationship"] = """
WITH l AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey IS NOT NULL),
r AS (SELECT DISTINCT user_id AS id FROM events WHERE user_id IS NOT NULL),
s AS (SELECT (SELECT count(*) FROM l) AS nl, (SELECT count(*) FROM r) AS nr,
             (SELECT count(*) FROM l JOIN r USING (id)) AS nb)
SELECT 'left ids' AS check, CAST(nl AS VARCHAR) AS value FROM s
UNION ALL SELECT 'right ids', CAST(nr AS VARCHAR) FROM s
UNION ALL SELECT 'ids in both', CAST(nb AS VARCHAR) FROM s
UNION ALL SELECT 'left only', CAST(nl - nb AS VARCHAR) FROM s
UNION ALL SELECT 'right only', CAST(nr - nb AS VARCHAR) FROM s
UNION ALL SELECT 'right is subset of left', CASE WHEN nr = nb THEN 'true' ELSE 'false' END FROM s"""

ORACLE_SQL["event_coverage"] = f"""
WITH j AS (SELECT c.c_custkey, e.id FROM customer c
           LEFT JOIN (SELECT DISTINCT user_id AS id FROM events WHERE user_id IS NOT NULL) e ON e.id = c.c_custkey),
a AS (SELECT count(*) AS n, count(id) AS w FROM j)
SELECT 'with events' AS "group", w AS count, {_r('w * 100.0 / n', 'percentage')} FROM a
UNION ALL SELECT 'without events', n - w, {_r('(n - w) * 100.0 / n', 'percentage')} FROM a"""

WF = f"WITH {FEATURES.strip()} "
ORACLE_SQL["reference_year_check"] = WF + f""", a AS (SELECT (SELECT max(year_first_transaction) FROM customer_info) AS ry,
  min(customer_tenure) AS a, max(customer_tenure) AS b, avg(customer_tenure) AS c,
  count(*) FILTER (WHERE customer_tenure < 0) AS d, min(age) AS e, max(age) AS f, avg(age) AS g,
  count(*) FILTER (WHERE age < 0) AS h FROM features)
SELECT 'reference year' AS check, {_r('ry', 'value')} FROM a
UNION ALL SELECT 'min tenure', {_r('a', 'value')} FROM a UNION ALL SELECT 'max tenure', {_r('b', 'value')} FROM a
UNION ALL SELECT 'mean tenure', {_r('c', 'value')} FROM a UNION ALL SELECT 'negative tenure', {_r('d::DOUBLE', 'value')} FROM a
UNION ALL SELECT 'min age', {_r('e', 'value')} FROM a UNION ALL SELECT 'max age', {_r('f', 'value')} FROM a
UNION ALL SELECT 'mean age', {_r('g', 'value')} FROM a UNION ALL SELECT 'negative age', {_r('h::DOUBLE', 'value')} FROM a"""

ORACLE_SQL["spend_quantiles"] = WF + " UNION ALL ".join(
    f"SELECT '{c}' AS column, " + ", ".join(
        _r(f"quantile_cont({c}::DOUBLE, {p})", f"p{int(round(p * 100))}") for p in (0.5, 0.75, 0.9, 0.95, 0.99))
    + " FROM features" for c in ["total_lifetime_spend", "age", "customer_tenure", "typical_hour", "number_complaints"])

ORACLE_SQL["spend_correlation"] = WCI + " UNION ALL ".join(
    f"SELECT '{a}' AS row_column, '{b}' AS col_column, {_r(f'corr({a}, {b})', 'correlation')} FROM customer_info"
    for i, a in enumerate(SPEND) for b in SPEND[:i])

ORACLE_SQL["category_spend"] = WF + " UNION ALL ".join(
    f"SELECT '{s[len('share_'):]}' AS category, {_r(f'avg({s} * total_lifetime_spend)', 'mean_spend')}, "
    f"{_r(f'avg({s})', 'mean_share')} FROM features" for s in SHARES)

ORACLE_SQL["segment_median_spend"] = WF + f"""
SELECT has_loyalty_card, {_r('median(total_lifetime_spend)', 'median_total_lifetime_spend')}
FROM features GROUP BY has_loyalty_card"""

ORACLE_SQL["spend_histogram"] = WF + f""", mm AS (SELECT min(total_lifetime_spend) AS mn, max(total_lifetime_spend) AS mx FROM features),
b AS (SELECT CAST(least(floor((total_lifetime_spend - mn) / (mx - mn) * 30), 29) AS INTEGER) AS bin, mn, mx
      FROM features, mm WHERE total_lifetime_spend IS NOT NULL)
SELECT bin, {_r('mn + bin * ((mx - mn) / 30)', 'lower')}, {_r('mn + (bin + 1) * ((mx - mn) / 30)', 'upper')}, count(*) AS count
FROM b GROUP BY bin, mn, mx"""

ORACLE_SQL["spend_box_stats"] = WF + f""", q AS (
  SELECT quantile_cont(total_lifetime_spend, 0.25) AS q1, quantile_cont(total_lifetime_spend, 0.5) AS q2,
         quantile_cont(total_lifetime_spend, 0.75) AS q3 FROM features)
SELECT 'total_lifetime_spend' AS column, {_r('q1', 'q1')}, {_r('q2', 'median')}, {_r('q3', 'q3')}, {_r('q3 - q1', 'iqr')},
       {_r('min(total_lifetime_spend) FILTER (WHERE total_lifetime_spend >= q1 - 1.5 * (q3 - q1))', 'lower_whisker')},
       {_r('max(total_lifetime_spend) FILTER (WHERE total_lifetime_spend <= q3 + 1.5 * (q3 - q1))', 'upper_whisker')},
       count(*) FILTER (WHERE total_lifetime_spend < q1 - 1.5 * (q3 - q1) OR total_lifetime_spend > q3 + 1.5 * (q3 - q1)) AS outliers
FROM features, q GROUP BY q1, q2, q3"""

ORACLE_SQL["spend_capped"] = WF + f""", q AS (SELECT quantile_cont(total_lifetime_spend, 0.99) AS cap FROM features)
SELECT customer_id, {_r('least(total_lifetime_spend, cap)', 'total_lifetime_spend_capped')} FROM features, q"""

ORACLE_SQL["top_customers_by_baskets"] = """
SELECT o_custkey AS customer_id, count(*) AS number_of_baskets FROM orders WHERE o_custkey IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
ORACLE_SQL["product_frequency"] = """
SELECT p.p_brand AS product, count(*) AS count FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
WHERE p.p_brand IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""
ORACLE_SQL["feature_validation"] = WF + """, a AS (
  SELECT count(*) AS rows, count(DISTINCT customer_id) AS ids, count(*) FILTER (WHERE age IS NULL) AS ma,
         min(age) AS mn, max(age) AS mx, count(*) FILTER (WHERE customer_tenure < 0) AS nt,
         sum(has_loyalty_card) AS lc, count(*) FILTER (WHERE total_lifetime_spend IS NULL) AS ms FROM features)
SELECT 'rows' AS check, CAST(rows AS VARCHAR) AS value FROM a
UNION ALL SELECT 'distinct customer_id', CAST(ids AS VARCHAR) FROM a
UNION ALL SELECT 'missing age', CAST(ma AS VARCHAR) FROM a
UNION ALL SELECT 'min age', CAST(mn AS VARCHAR) FROM a
UNION ALL SELECT 'max age', CAST(mx AS VARCHAR) FROM a
UNION ALL SELECT 'negative tenure', CAST(nt AS VARCHAR) FROM a
UNION ALL SELECT 'customers with loyalty card', CAST(lc AS VARCHAR) FROM a
UNION ALL SELECT 'missing total_lifetime_spend', CAST(ms AS VARCHAR) FROM a"""


# ------------------------------------------------------------------ C9 - C15 on embeddings
EMB = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
long AS (SELECT vec_id, label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM e),
cent AS (SELECT label, i, avg(x) AS c FROM long GROUP BY label, i),
cnt AS (SELECT label, count(*) AS n FROM e GROUP BY label),
dd AS (SELECT l.vec_id, l.label, sum((l.x - c.c) * (l.x - c.c)) AS d2 FROM long l JOIN cent c USING (label, i) GROUP BY 1, 2),
om AS (SELECT i, avg(x) AS m FROM long GROUP BY i),
bw AS (SELECT (SELECT sum(cnt.n * (c.c - om.m) * (c.c - om.m)) FROM cent c JOIN om USING (i) JOIN cnt USING (label)) AS b,
              (SELECT sum(d2) FROM dd) AS w, (SELECT count(*) FROM e) AS n, (SELECT count(*) FROM cnt) AS k),
ch AS (SELECT b * (n - k) / (w * (k - 1)) AS calinski_harabasz_score FROM bw),
s AS (SELECT label, avg(sqrt(d2)) AS s FROM dd GROUP BY label),
cd AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS dist
       FROM cent a JOIN cent b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2),
db AS (SELECT avg(m) AS davies_bouldin_score FROM (
         SELECT la, max((sa.s + sb.s) / dist) AS m FROM cd JOIN s sa ON sa.label = la JOIN s sb ON sb.label = lb GROUP BY la)),
pd AS (SELECT a.vec_id, a.label AS la, b.label AS lb, list_distance(a.v, b.v) AS dist FROM e a, e b),
pm AS (SELECT vec_id, la, lb, sum(dist * dist) AS sd, count(*) AS c FROM pd GROUP BY ALL),
sil AS (
  SELECT o.vec_id, o.la AS label,
         CASE WHEN o.c = 1 THEN 0.0 ELSE (x.b - o.sd / (o.c - 1)) / greatest(o.sd / (o.c - 1), x.b) END AS silhouette
  FROM pm o JOIN (SELECT vec_id, min(sd / c) AS b FROM pm WHERE la <> lb GROUP BY vec_id) x USING (vec_id)
  WHERE o.la = o.lb)"""
WE = f"WITH {EMB.strip()} "

ORACLE_SQL["cluster_summary"] = f"""
SELECT label, count(*) AS count, {_r('count(*) * 100.0 / sum(count(*)) OVER ()', 'percentage')}
FROM embeddings GROUP BY label"""
ORACLE_SQL["calinski_harabasz"] = WE + f"SELECT {_r('calinski_harabasz_score', 'calinski_harabasz_score')} FROM ch"
ORACLE_SQL["davies_bouldin"] = WE + f"SELECT {_r('davies_bouldin_score', 'davies_bouldin_score')} FROM db"
ORACLE_SQL["silhouette_score"] = WE + f"SELECT {_r('avg(silhouette)', 'silhouette_score')} FROM sil"
ORACLE_SQL["silhouette_by_label"] = WE + f"""
SELECT label, {_r('avg(silhouette)', 'mean_silhouette')}, count(*) AS scored_rows FROM sil GROUP BY label"""
ORACLE_SQL["clustering_metrics"] = WE + f"""
SELECT {_r('(SELECT avg(silhouette) FROM sil)', 'silhouette_score')},
       {_r('(SELECT calinski_harabasz_score FROM ch)', 'calinski_harabasz_score')},
       {_r('(SELECT davies_bouldin_score FROM db)', 'davies_bouldin_score')},
       min(n) AS min_cluster_size, max(n) AS max_cluster_size,
       {_r('min(n) * 100.0 / sum(n)', 'min_cluster_percentage')}, {_r('max(n) * 100.0 / sum(n)', 'max_cluster_percentage')}
FROM cnt"""
ORACLE_SQL["ari_labels"] = f"""
WITH j AS (SELECT c.c_mktsegment AS a, n.n_regionkey AS b FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
ct AS (SELECT a, b, count(*) AS n FROM j GROUP BY ALL),
s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM ct) AS idx,
             (SELECT sum(r * (r - 1) / 2.0) FROM (SELECT sum(n) AS r FROM ct GROUP BY a)) AS sa,
             (SELECT sum(r * (r - 1) / 2.0) FROM (SELECT sum(n) AS r FROM ct GROUP BY b)) AS sb,
             (SELECT sum(n)::DOUBLE FROM ct) AS nn)
SELECT {_r('CASE WHEN (sa + sb) / 2.0 = sa * sb / (nn * (nn - 1) / 2.0) THEN 1.0 ELSE (idx - sa * sb / (nn * (nn - 1) / 2.0)) / ((sa + sb) / 2.0 - sa * sb / (nn * (nn - 1) / 2.0)) END', 'adjusted_rand_index')}
FROM s"""
ORACLE_SQL["nearest_centroid"] = f"""
WITH {EMB.split(',' + chr(10) + 'cnt AS')[0].strip()},
d AS (SELECT l.vec_id, c.label AS cl, sum((l.x - c.c) * (l.x - c.c)) AS d2
      FROM long l JOIN cent c ON l.i = c.i GROUP BY 1, 2)
SELECT e.vec_id, e.label, arg_min(cl, (d2, cl)) AS assigned_cluster
FROM d JOIN e USING (vec_id) GROUP BY e.vec_id, e.label"""


# ------------------------------------------------------------------ C20 - C27 on market segments
PROFILE = ["age", "customer_tenure", "total_lifetime_spend", "lifetime_total_distinct_products",
           "percentage_of_products_bought_promotion", "number_complaints", "distinct_stores_visited",
           "has_loyalty_card", "total_children_home", "typical_hour"]
SEGF = f"""{FEATURES},
segf AS (SELECT f.*, c.c_mktsegment AS cluster FROM features f JOIN customer c ON c.c_custkey = f.customer_id)"""
WSF = f"WITH {SEGF.strip()} "


def _mean_median(cols) -> str:
    return ", ".join(f"{_r(f'avg({c})', c + '_mean')}, {_r(f'median({c}::DOUBLE)', c + '_median')}" for c in cols)


ORACLE_SQL["segment_profile"] = WSF + f"SELECT cluster, {_mean_median(PROFILE)} FROM segf GROUP BY cluster"
ORACLE_SQL["segment_spend_shares"] = WSF + "SELECT cluster, " + ", ".join(
    _r(f"avg({s})", s) for s in SHARES) + " FROM segf GROUP BY cluster"
ORACLE_SQL["segment_metric_means"] = WSF + f"""
SELECT cluster, {_r('avg(total_lifetime_spend)', 'mean_total_lifetime_spend')},
       {_r('avg(percentage_of_products_bought_promotion)', 'mean_promotion_share')},
       {_r('avg(has_loyalty_card) * 100.0', 'loyalty_card_percentage')}
FROM segf GROUP BY cluster"""

SPLIT = """
lab AS (SELECT c.c_custkey AS customer_id, c.c_mktsegment AS k5_cluster, n.n_regionkey AS k6_cluster
        FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
big AS (SELECT k5_cluster FROM lab GROUP BY 1 ORDER BY count(*) DESC, k5_cluster LIMIT 1),
sp AS (SELECT l.k5_cluster, l.k6_cluster, count(*) AS customer_count FROM lab l JOIN big USING (k5_cluster) GROUP BY ALL),
tot AS (SELECT k6_cluster, count(*) AS k6_cluster_total_count FROM lab GROUP BY 1),
split AS (SELECT k5_cluster, k6_cluster, customer_count,
                 customer_count / sum(customer_count) OVER () AS share_of_big_k5_cluster, k6_cluster_total_count,
                 customer_count / k6_cluster_total_count AS share_of_k6_cluster_from_big_k5_cluster
          FROM sp LEFT JOIN tot USING (k6_cluster))"""
ORACLE_SQL["segment_split"] = f"""
WITH {SPLIT.strip()}
SELECT k5_cluster, k6_cluster, customer_count, {_r('share_of_big_k5_cluster', 'share_of_big_k5_cluster')},
       k6_cluster_total_count, {_r('share_of_k6_cluster_from_big_k5_cluster', 'share_of_k6_cluster_from_big_k5_cluster')},
       share_of_big_k5_cluster >= 0.05 AS main_split_part
FROM split"""
_SPLIT_PROFILE = [c for c in PROFILE if c != "typical_hour"]
ORACLE_SQL["segment_split_profile"] = f"""
WITH {FEATURES.strip()}, {SPLIT.strip()},
bigrows AS (SELECT l.*, f.* EXCLUDE (customer_id) FROM lab l JOIN big USING (k5_cluster)
            LEFT JOIN features f USING (customer_id)),
agg AS (SELECT k5_cluster, k6_cluster, count(DISTINCT customer_id) AS customer_count, {_mean_median(_SPLIT_PROFILE)},
               {', '.join(_r(f'avg({s})', s + '_mean') for s in SHARES)}
        FROM bigrows GROUP BY ALL)
SELECT a.k5_cluster, a.k6_cluster, a.customer_count, {_r('s.share_of_big_k5_cluster', 'share_of_big_k5_cluster')},
       s.k6_cluster_total_count,
       {_r('s.share_of_k6_cluster_from_big_k5_cluster', 'share_of_k6_cluster_from_big_k5_cluster')},
       s.share_of_big_k5_cluster >= 0.05 AS main_split_part,
       {', '.join(f'a.{c}_mean, a.{c}_median' for c in _SPLIT_PROFILE)}, {', '.join(f'a.{s}_mean' for s in SHARES)}
FROM agg a LEFT JOIN split s USING (k5_cluster, k6_cluster, customer_count)"""
ORACLE_SQL["assignment_checks"] = """
WITH a AS (SELECT count(*) AS n, count(DISTINCT c_custkey) AS nd, count(*) FILTER (WHERE c_mktsegment IS NULL) AS nn
           FROM customer)
SELECT 'input rows' AS check, CAST(n AS VARCHAR) AS value FROM a
UNION ALL SELECT 'assignment rows', CAST(n AS VARCHAR) FROM a
UNION ALL SELECT 'row counts equal', 'true' FROM a
UNION ALL SELECT 'repeated ids', CAST(n - nd AS VARCHAR) FROM a
UNION ALL SELECT 'missing labels', CAST(nn AS VARCHAR) FROM a"""


# ------------------------------------------------------------------ G1 - G12
PLAN = """
plan AS (
  SELECT DISTINCT c_mktsegment AS cluster,
         CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'brand#1, Brand#2,,' END AS product_terms,
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN ['BRAND#2'] END AS rule_terms
  FROM customer),
pterms AS (SELECT cluster, CASE WHEN product_terms IS NULL THEN NULL ELSE
             list_filter(list_transform(string_split(product_terms, ','), lambda x: lower(trim(x))), lambda x: x <> '') END AS t
           FROM plan),
rterms AS (SELECT cluster, CASE WHEN rule_terms IS NULL THEN NULL ELSE list_transform(rule_terms, lambda x: lower(x)) END AS t
           FROM plan)"""
TOP = """
tpc AS (SELECT cluster, product, count(*) AS product_count FROM seg_lines WHERE product IS NOT NULL GROUP BY ALL),
tp AS (SELECT * FROM (SELECT *, product_count::DOUBLE / sum(product_count) OVER (PARTITION BY cluster) AS share,
                             row_number() OVER (PARTITION BY cluster ORDER BY product_count DESC, product) AS product_rank
                      FROM tpc) WHERE product_rank <= 10)"""
PRODUCTS = """
pj AS (SELECT tp.cluster, tp.product, tp.product_rank, t,
              (t IS NOT NULL AND len(t) > 0 AND len(list_filter(t, lambda x: contains(lower(tp.product), x))) > 0) AS hit,
              (t IS NOT NULL AND len(t) > 0) AS has_t
       FROM tp JOIN pterms USING (cluster)),
pk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY product_rank) AS pos
       FROM (SELECT *, max(hit::INT) OVER (PARTITION BY cluster) AS anyhit FROM pj)
       WHERE NOT has_t OR anyhit = 0 OR hit),
pa AS (SELECT cluster, string_agg(product, ', ' ORDER BY pos) AS s FROM pk WHERE pos <= 5 GROUP BY cluster),
products AS (SELECT pterms.cluster, coalesce(s, '') AS supporting_products FROM pterms LEFT JOIN pa USING (cluster))"""
RULETEXT = f"""
rr AS ({RULES_RAW}),
rj AS (SELECT rr.cluster, rr.antecedents, rr.consequents, rr.lift, rr.rule_rank, t,
              (t IS NOT NULL AND len(t) > 0 AND
               len(list_filter(t, lambda x: contains(lower(rr.antecedents || ' ' || rr.consequents), x))) > 0) AS hit,
              (t IS NOT NULL AND len(t) > 0) AS has_t
       FROM rr JOIN rterms USING (cluster)),
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY rule_rank) AS pos
       FROM (SELECT *, max(hit::INT) OVER (PARTITION BY cluster) AS anyhit FROM rj)
       WHERE NOT has_t OR anyhit = 0 OR hit),
ra AS (SELECT cluster, string_agg(printf('%s -> %s (lift %.2f)', antecedents, consequents, lift), '; ' ORDER BY pos) AS s
       FROM rk WHERE pos <= 2 GROUP BY cluster),
ruletext AS (SELECT rterms.cluster, coalesce(s, 'No strong pairwise rules saved.') AS supporting_association_rules
             FROM rterms LEFT JOIN ra USING (cluster))"""
OFFER_SHARE_NAMES = [("economy", "share_economy"), ("large", "share_large"), ("medium", "share_medium"),
                     ("promo", "share_promo")]
EVIDENCE = f"""
prof AS (SELECT cluster, avg(age) AS age_mean, avg(total_lifetime_spend) AS total_lifetime_spend_mean,
                avg(has_loyalty_card) AS has_loyalty_card_mean, avg(total_children_home) AS total_children_home_mean,
                median(age::DOUBLE) AS age_median, median(total_lifetime_spend) AS total_lifetime_spend_median,
                median(has_loyalty_card::DOUBLE) AS has_loyalty_card_median,
                median(total_children_home) AS total_children_home_median
         FROM segf GROUP BY cluster),
shr AS (SELECT cluster, {', '.join(f'avg({s}) AS {s}' for s in SHARES)} FROM segf GROUP BY cluster),
cov AS (SELECT s.cluster, count(DISTINCT o.o_custkey)::DOUBLE / count(DISTINCT s.customer_id) AS coverage
        FROM (SELECT c_custkey AS customer_id, c_mktsegment AS cluster FROM customer) s
        LEFT JOIN orders o ON o.o_custkey = s.customer_id GROUP BY s.cluster),
evidence AS (
  SELECT p.cluster, 'Mean age ' || printf('%.1f', age_mean) || '; mean spend ' || format('{{:,.0f}}', total_lifetime_spend_mean)
         || '; loyalty-card share ' || printf('%.1f%%', has_loyalty_card_mean * 100.0)
         || '; children at home ' || printf('%.1f', total_children_home_mean) || '; '
         || {" || ', ' || ".join(f"'{n} ' || printf('%.1f%%', {s} * 100.0)" for n, s in OFFER_SHARE_NAMES)}
         || ', basket coverage ' || printf('%.1f%%', coverage * 100.0) || '.' AS main_evidence
  FROM plan p JOIN prof USING (cluster) JOIN shr USING (cluster) JOIN cov USING (cluster))"""
OFFERS = f"WITH {SEGF.strip()}, {SEGMENT_LINES.strip()}, {PLAN.strip()}, {TOP.strip()}, {PRODUCTS.strip()}, " \
         f"{RULETEXT.strip()}, {EVIDENCE.strip()} "

ORACLE_SQL["offer_products"] = OFFERS + "SELECT cluster, supporting_products FROM products"
ORACLE_SQL["offer_rules"] = OFFERS + "SELECT cluster, supporting_association_rules FROM ruletext"
ORACLE_SQL["offer_evidence"] = OFFERS + "SELECT cluster, main_evidence FROM evidence"
ORACLE_SQL["offer_recommendations"] = OFFERS + """
SELECT p.cluster, (upper(left(p.cluster, 1)) || lower(substr(p.cluster, 2))) || ' shoppers' AS persona_name,
       'Customers of the ' || lower(p.cluster) || ' segment' AS persona_summary, e.main_evidence,
       'Bundle discount on the strongest pair' AS recommended_promotion, 'bundle' AS promotion_type,
       'Top two brands' AS products_to_promote, pr.supporting_products, rt.supporting_association_rules,
       'Check margins before discounting' AS risk_or_caveat
FROM plan p JOIN evidence e USING (cluster) JOIN products pr USING (cluster) JOIN ruletext rt USING (cluster)"""
ORACLE_SQL["offer_value_context"] = OFFERS + f"""
SELECT cluster, {_r('age_mean', 'age_mean')}, {_r('age_median', 'age_median')},
       {_r('total_lifetime_spend_mean', 'total_lifetime_spend_mean')}, {_r('total_lifetime_spend_median', 'total_lifetime_spend_median')},
       {_r('has_loyalty_card_mean', 'has_loyalty_card_mean')}, {_r('has_loyalty_card_median', 'has_loyalty_card_median')},
       {_r('total_children_home_mean', 'total_children_home_mean')}, {_r('total_children_home_median', 'total_children_home_median')},
       (upper(left(cluster, 1)) || lower(substr(cluster, 2))) || ' shoppers' AS persona_name
FROM prof"""
ORACLE_SQL["offer_completeness"] = OFFERS + """,
ex AS (SELECT DISTINCT c_mktsegment AS cluster FROM customer),
t AS (SELECT 'cluster_profile' AS tbl, cluster FROM prof
      UNION ALL SELECT 'spending_shares', cluster FROM shr
      UNION ALL SELECT 'basket_profile', cluster FROM cov
      UNION ALL SELECT 'top_products', cluster FROM (SELECT DISTINCT cluster FROM tp)
      UNION ALL SELECT 'association_rules', cluster FROM (SELECT DISTINCT cluster FROM rr)),
names AS (SELECT DISTINCT tbl FROM t)
SELECT n.tbl AS "table", (SELECT count(*) FROM ex) AS expected_clusters,
       (SELECT count(*) FROM t WHERE t.tbl = n.tbl) AS found_clusters,
       (SELECT count(*) FROM ex WHERE cluster NOT IN (SELECT cluster FROM t WHERE t.tbl = n.tbl)) AS missing_clusters,
       (SELECT count(*) FROM t WHERE t.tbl = n.tbl AND cluster NOT IN (SELECT cluster FROM ex)) AS extra_clusters
FROM names n"""

ORACLE_SQL["csv_round_trip"] = "SELECT c_custkey AS customer_id, c_mktsegment AS cluster FROM customer"

ORACLE_SQL["complaints_histogram"] = WCI + """
SELECT CAST(floor(number_complaints) AS BIGINT) AS bin, count(*) AS count FROM customer_info
WHERE number_complaints IS NOT NULL GROUP BY 1"""
ORACLE_SQL["segment_spend_box_stats"] = WSF + f""", q AS (
  SELECT cluster, quantile_cont(total_lifetime_spend, 0.25) AS q1, quantile_cont(total_lifetime_spend, 0.5) AS q2,
         quantile_cont(total_lifetime_spend, 0.75) AS q3 FROM segf GROUP BY cluster)
SELECT cluster, {_r('q1', 'q1')}, {_r('q2', 'median')}, {_r('q3', 'q3')}, {_r('q3 - q1', 'iqr')},
       {_r('min(total_lifetime_spend) FILTER (WHERE total_lifetime_spend >= q1 - 1.5 * (q3 - q1))', 'lower_whisker')},
       {_r('max(total_lifetime_spend) FILTER (WHERE total_lifetime_spend <= q3 + 1.5 * (q3 - q1))', 'upper_whisker')},
       count(*) FILTER (WHERE total_lifetime_spend < q1 - 1.5 * (q3 - q1) OR total_lifetime_spend > q3 + 1.5 * (q3 - q1)) AS outliers
FROM segf JOIN q USING (cluster) GROUP BY cluster, q1, q2, q3"""


# ------------------------------------------------------------------ given labels, single steps, samples
def _given(sql: str, label: str) -> str:
    """A statement about market segments with another label of the customers."""
    return sql.replace("c.c_mktsegment", label.replace("c_custkey", "c.c_custkey")).replace("c_mktsegment", label)


ORACLE_SQL["given_label_offers"] = _given(ORACLE_SQL["offer_recommendations"], "('g' || (c_custkey % 4)::VARCHAR)")
ORACLE_SQL["rules_above_all_lifts"] = f"WITH none AS ({ORACLE_SQL['segment_association_rules']}) SELECT * FROM none WHERE lift >= 1e9"

_LONG = EMB.split("," + chr(10) + "cnt AS")[0].strip()
ORACLE_SQL["kmeans_one_step"] = f"""
WITH {_LONG},
d AS (SELECT l.vec_id, c.label AS cl, sum((l.x - c.c) * (l.x - c.c)) AS d2 FROM long l JOIN cent c ON l.i = c.i GROUP BY 1, 2),
a AS (SELECT vec_id, arg_min(cl, (d2, cl)) AS cl, min(d2) AS d2 FROM d GROUP BY vec_id),
t AS (SELECT cl, count(*) AS row_count, sum(d2) AS cost FROM a GROUP BY cl),
n AS (SELECT a.cl, l.i, avg(l.x) AS x FROM a JOIN long l USING (vec_id) GROUP BY ALL)
SELECT c.label::BIGINT AS cluster, 'e' || (c.i - 1) AS column, {_r('coalesce(n.x, c.c)', 'center')}, coalesce(t.row_count, 0) AS row_count,
       {_r('coalesce(t.cost, 0.0)', 'cost')}
FROM cent c LEFT JOIN n ON n.cl = c.label AND n.i = c.i LEFT JOIN t ON t.cl = c.label"""
ORACLE_SQL["gmm_one_step"] = f"""
WITH {_LONG},
p AS (SELECT label, i, avg(x) AS m, var_pop(x) + 1e-6 AS v FROM long GROUP BY label, i),
w AS (SELECT label, count(*)::DOUBLE / (SELECT count(*) FROM e) AS w FROM e GROUP BY label),
lp AS (SELECT l.vec_id, p.label, any_value(ln(w.w)) - 0.5 * sum(ln(2 * pi() * p.v) + (l.x - p.m) * (l.x - p.m) / p.v) AS lp
       FROM long l JOIN p ON l.i = p.i JOIN w ON w.label = p.label GROUP BY l.vec_id, p.label),
top AS (SELECT vec_id, max(lp) AS t FROM lp GROUP BY vec_id),
lse AS (SELECT lp.vec_id, any_value(t) + ln(sum(exp(lp.lp - t))) AS s FROM lp JOIN top USING (vec_id) GROUP BY lp.vec_id),
r AS (SELECT lp.vec_id, lp.label, exp(lp.lp - lse.s) AS r FROM lp JOIN lse USING (vec_id)),
nk AS (SELECT label, sum(r) AS nk FROM r GROUP BY label),
s AS (SELECT r.label, l.i, sum(r.r * l.x) AS s1, sum(r.r * l.x * l.x) AS s2 FROM r JOIN long l USING (vec_id) GROUP BY ALL)
SELECT s.label::BIGINT AS cluster, 'e' || (s.i - 1) AS column, {_r('s1 / nk', 'mean')},
       {_r('greatest(s2 / nk - (s1 / nk) * (s1 / nk), 0) + 1e-6', 'variance')}, {_r('nk / (SELECT sum(nk) FROM nk)', 'weight')},
       {_r('(SELECT avg(s) FROM lse)', 'mean_log_likelihood')}
FROM s JOIN nk USING (label)"""
ORACLE_SQL["variance_along_means"] = f"""
WITH {_LONG},
u AS (SELECT label, i, c / sqrt(sum(c * c) OVER (PARTITION BY label)) AS u FROM cent),
y AS (SELECT u.label, l.vec_id, sum(l.x * u.u) AS y FROM long l JOIN u ON l.i = u.i GROUP BY ALL),
t AS (SELECT sum(v) AS t FROM (SELECT var_pop(x) AS v FROM long GROUP BY i))
SELECT label::BIGINT AS axis, {_r('var_pop(y)', 'variance')}, {_r('var_pop(y) / any_value(t)', 'explained_variance_ratio')} FROM y, t GROUP BY label"""
ORACLE_SQL["given_label_evaluation"] = f"""
WITH m AS ({ORACLE_SQL['clustering_metrics']})
SELECT 'given_labels' AS model, 'given' AS algorithm, (SELECT count(DISTINCT label) FROM embeddings)::INTEGER AS n_clusters, m.*,
       (SELECT max(len(embedding)) FROM embeddings)::INTEGER AS n_features FROM m"""


def _remainder(k: int) -> str:
    """The metrics of the labels' remainders by ``k``."""
    return ORACLE_SQL["clustering_metrics"].replace("SELECT vec_id, label, embedding::DOUBLE[] AS v", f"SELECT vec_id, label % {k} AS label, embedding::DOUBLE[] AS v")


ORACLE_SQL["given_label_recommendation"] = f"""
WITH a AS ({_remainder(5)}), b AS ({_remainder(6)}),
lab AS (SELECT label % 5 AS k5, label % 6 AS k6 FROM embeddings),
ct AS (SELECT k5, k6, count(*) AS n FROM lab GROUP BY ALL),
s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM ct) AS idx, (SELECT sum(r * (r - 1) / 2.0) FROM (SELECT sum(n) AS r FROM ct GROUP BY k5)) AS sa,
             (SELECT sum(r * (r - 1) / 2.0) FROM (SELECT sum(n) AS r FROM ct GROUP BY k6)) AS sb, (SELECT sum(n)::DOUBLE FROM ct) AS nn),
ari AS (SELECT printf('%.3f', (idx - sa * sb / (nn * (nn - 1) / 2.0)) / ((sa + sb) / 2.0 - sa * sb / (nn * (nn - 1) / 2.0))) AS x FROM s),
big AS (SELECT k5 FROM lab GROUP BY 1 ORDER BY count(*) DESC, k5 LIMIT 1),
sp AS (SELECT ct.n / sum(ct.n) OVER () AS share FROM ct JOIN big USING (k5)),
parts AS (SELECT count(*) AS parts, sum(share) AS covered FROM sp WHERE share >= 0.05)
SELECT 'KMeans_k5_compact_robust' AS candidate,
  printf('k=5 gives usable segments with silhouette %.3f, Davies-Bouldin %.3f, and minimum cluster share %.2f%%.',
         a.silhouette_score, a.davies_bouldin_score, a.min_cluster_percentage) AS evidence_for,
  printf('The largest cluster is broad at %.2f%% of customers; k=6 improves balance to a largest cluster of %.2f%% but its silhouette is %.3f and Davies-Bouldin %.3f.',
         a.max_cluster_percentage, b.max_cluster_percentage, b.silhouette_score, b.davies_bouldin_score) AS evidence_against,
  printf('ARI range %s to %s, mean %s.', ari.x, ari.x, ari.x) AS seed_stability,
  printf('k=6 splits the largest k=5 cluster into %d main subgroups covering %.2f%% of that cluster.', parts.parts, parts.covered * 100) AS business_balance_check,
  'Keep the smaller k as the metric-supported segmentation level, and document the larger-k split as a business tradeoff.' AS recommendation
FROM a, b, ari, parts"""
ORACLE_SQL["feature_set_concat"] = f"WITH {CLEAN.strip()} " + _rounded_select(["customer_id", *MODEL], "clean", _DOUBLES).replace(
    " FROM clean", "".join(f", CAST(customer_gender = '{g}' AS INTEGER) AS gender_{g}" for g in ("female", "male"))
    + "".join(f", CAST(degree_level = '{g}' AS INTEGER) AS degree_{g}" for g in ("Bsc", "Msc", "Phd")) + " FROM clean")
ORACLE_SQL["sampled_customers"] = f"SELECT * FROM ({ORACLE_SQL['robust_scaled']}) ORDER BY md5('42:' || customer_id::VARCHAR), customer_id LIMIT 5000"


def _unrounded_scaled() -> str:
    stats = ", ".join(f"quantile_cont({c}::DOUBLE, [0.25, 0.5, 0.75]) AS q_{c}" for c in MODEL)
    cols = ", ".join(f"({c}::DOUBLE - q_{c}[2]) / CASE WHEN q_{c}[3] - q_{c}[1] = 0 THEN 1 ELSE q_{c}[3] - q_{c}[1] END" for c in MODEL)
    return f"{CLEAN.strip()}, st AS (SELECT {stats} FROM clean), f AS (SELECT customer_id, [{cols}] AS v FROM clean, st)"


ORACLE_SQL["dbscan_core_points"] = f"""
WITH {_unrounded_scaled()},
n AS (SELECT a.customer_id, count(*) AS neighbour_count FROM f a JOIN f b ON list_distance(a.v, b.v) <= 3.0 GROUP BY 1)
SELECT customer_id, neighbour_count, neighbour_count >= 10 AS is_core FROM n"""
