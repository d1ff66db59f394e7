"""Customer feature engineering.

One projection over the customer table; the only data-dependent constant
(the reference year) is a one-row aggregate read back as a literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import degree_level

SPEND_PREFIX = "lifetime_spend_"
SHARE_PREFIX = "share_"
BIRTHDATE_FORMAT = "M/d/yyyy h:mm a"

# The raw columns kept next to the engineered ones, in order.
KEPT_COLUMNS = [
    "customer_id", "customer_gender", "kids_home", "teens_home", "number_complaints",
    "distinct_stores_visited", "lifetime_total_distinct_products", "year_first_transaction",
    "percentage_of_products_bought_promotion", "typical_hour", "latitude", "longitude",
]


def spend_columns(df: DataFrame, prefix: str = SPEND_PREFIX) -> list[str]:
    """spend columns found by name prefix, in table order."""
    return [c for c in df.columns if c.startswith(prefix)]


def share_name(spend_col: str, prefix: str = SPEND_PREFIX) -> str:
    return SHARE_PREFIX + spend_col[len(prefix):]


def reference_year(df: DataFrame, col: str = "year_first_transaction") -> float | None:
    """latest first-transaction year in the data set (not today's date)."""
    return df.agg(F.max(F.expr(f"try_cast(`{col}` AS DOUBLE)"))).first()[0]


def age_from_birthdate(birthdate, ref_year) -> Column:
    """reference year minus birth year; unparsable text gives NULL."""
    parsed = F.try_to_timestamp(F.col(birthdate) if isinstance(birthdate, str) else birthdate,
                                F.lit(BIRTHDATE_FORMAT))
    return (F.lit(ref_year) - F.year(parsed)).cast("double")


def add_customer_info_features(df: DataFrame, ref_year: float | None = None,
                               prefix: str = SPEND_PREFIX) -> DataFrame:
    """kept raw columns + age, tenure, loyalty, children, spend total/shares, degree."""
    if ref_year is None:
        ref_year = reference_year(df)
    spend = spend_columns(df, prefix)
    total = F.when(F.coalesce(*[F.col(c) for c in spend]).isNotNull(),
                   sum((F.coalesce(F.col(c), F.lit(0.0)) for c in spend), F.lit(0.0)))
    kids, teens = F.col("kids_home"), F.col("teens_home")
    children = kids + teens
    engineered = [
        age_from_birthdate("customer_birthdate", ref_year).alias("age"),
        (F.lit(ref_year) - F.expr("try_cast(year_first_transaction AS DOUBLE)")).cast("double").alias("customer_tenure"),
        F.col("loyalty_card_number").isNotNull().cast("int").alias("has_loyalty_card"),
        children.alias("total_children_home"),
        (F.coalesce(children, F.lit(0)) > 0).cast("int").alias("has_children"),
        total.alias("total_lifetime_spend"),
    ]
    base = df.select(*df.columns, *engineered)
    shares = [F.when(F.col("total_lifetime_spend") > 0, F.col(c) / F.col("total_lifetime_spend"))
               .otherwise(F.lit(0.0)).alias(share_name(c, prefix)) for c in spend]
    return base.select(*KEPT_COLUMNS, "age", "customer_tenure", "has_loyalty_card", "total_children_home",
                       "has_children", "total_lifetime_spend", *shares,
                       degree_level("customer_name").alias("degree_level"))


def one_hot(df: DataFrame, column: str, categories: list[str], prefix: str | None = None) -> DataFrame:
    """fixed dummy columns; unseen category -> all-zero column, unlisted values dropped."""
    prefix = prefix or column
    return df.select(*df.columns, *[(F.col(column) == F.lit(v)).cast("int").alias(f"{prefix}_{v}")
                                    for v in categories]).withColumns(
        {f"{prefix}_{v}": F.coalesce(F.col(f"{prefix}_{v}"), F.lit(0)) for v in categories})


def removed_columns(before: DataFrame, after: DataFrame) -> list[str]:
    """columns present before and gone after, in the original order."""
    kept = set(after.columns)
    return [c for c in before.columns if c not in kept]


def concat_feature_sets(left: DataFrame, right: DataFrame, id_col: str = "customer_id") -> DataFrame:
    """columns of two feature sets side by side, matched on the id (not on row position).

    An id present on one side only fails the job (the sets must describe the
    same customers), checked lazily inside the same plan.
    """
    clash = [c for c in right.columns if c in left.columns and c != id_col]
    if clash:
        raise ValueError(f"feature sets share columns: {clash}")
    joined = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), id_col, "full_outer")
    guard = F.when(F.col("__l").isNull() | F.col("__r").isNull(), F.raise_error(F.concat(
        F.lit("feature sets do not cover the same ids: "), F.col(id_col).cast("string"))))
    return joined.where(F.coalesce(guard.cast("boolean"), F.lit(True))).drop("__l", "__r")
