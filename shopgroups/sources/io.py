"""CSV / Parquet sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Header CSV. Pass an explicit schema in production (no inference pass)."""
    reader = spark.read.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> str:
    """Overwrite a dataset. CSV gets a header; Parquet keeps types."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return path


def save_cluster_assignments(labels: DataFrame, path: str, id_col: str = "customer_id",
                             cluster_col: str = "cluster", fmt: str = "parquet") -> DataFrame:
    """Write (id, cluster) and return the written projection (S3)."""
    out = labels.select(id_col, cluster_col)
    write_table(out, path, fmt)
    return out


def read_back(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return read_csv(spark, path, schema)
    return spark.read.schema(schema).parquet(path)


def content(df: DataFrame) -> tuple:
    """Row count and an order-independent sum of row hashes."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def round_trip_check(spark: SparkSession, df: DataFrame, path: str, fmt: str = "csv") -> DataFrame:
    """Write, read back with the written schema, and report (check, value) rows.

    Returns the counts and column lists of both sides; raises when they or any value differ.
    """
    write_table(df, path, fmt)
    back = read_back(spark, path, df.schema, fmt)
    written, written_hash = content(df)
    read, read_hash = content(back)
    same_cols = back.columns == df.columns
    if written != read or not same_cols or written_hash != read_hash:
        raise ValueError(f"the table read back differs: {written} rows written, {read} read; "
                         f"columns equal: {same_cols}; values equal: {written_hash == read_hash}")
    rows = [("rows written", str(written)), ("rows read", str(read)),
            ("columns", str(len(back.columns))), ("columns equal", str(same_cols).lower())]
    return spark.createDataFrame(rows, "check string, value string")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Ingest rule: floating NaN becomes NULL (Spark orders NaN above every number)."""
    exprs = []
    for field in df.schema.fields:
        name = field.name
        if field.dataType.typeName() in ("double", "float"):
            exprs.append(F.when(F.isnan(F.col(name)), F.lit(None)).otherwise(F.col(name)).alias(name))
        else:
            exprs.append(F.col(name))
    return df.select(*exprs)


# The source project's raw input layouts (the column names it reads).
SPEND_CATEGORIES = ["groceries", "electronics", "vegetables", "nonalcohol_drinks", "alcohol_drinks", "meat",
                    "fish", "hygiene", "videogames", "petfood"]
CUSTOMER_INFO_SCHEMA = (
    "customer_id LONG, customer_name STRING, customer_gender STRING, customer_birthdate STRING, "
    "kids_home DOUBLE, teens_home DOUBLE, number_complaints DOUBLE, distinct_stores_visited DOUBLE, "
    + ", ".join(f"lifetime_spend_{c} DOUBLE" for c in SPEND_CATEGORIES)
    + ", lifetime_total_distinct_products DOUBLE, year_first_transaction DOUBLE, loyalty_card_number DOUBLE, "
      "percentage_of_products_bought_promotion DOUBLE, typical_hour DOUBLE, latitude DOUBLE, longitude DOUBLE")
CUSTOMER_BASKET_SCHEMA = "invoice_id LONG, customer_id LONG, list_of_goods STRING"


def _read_by_name(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header CSV read as text, then typed column by column by name (file order may differ)."""
    from pyspark.sql.types import _parse_datatype_string
    struct = _parse_datatype_string(schema)
    raw = spark.read.option("header", True).csv(path)
    missing = [f.name for f in struct.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"CSV lacks columns: {missing}")
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in struct.fields])


def read_customer_info(spark: SparkSession, path: str, schema: str = CUSTOMER_INFO_SCHEMA) -> DataFrame:
    """One row per customer from header CSV, typed by name; NaN becomes NULL."""
    return nan_to_null(_read_by_name(spark, path, schema))


def read_customer_basket(spark: SparkSession, path: str, schema: str = CUSTOMER_BASKET_SCHEMA,
                         on_error: str = "fail") -> DataFrame:
    """One row per basket with ``goods_list``, ``basket_size`` and ``distinct_products_per_basket``."""
    from ..operators.baskets import parse_baskets
    return parse_baskets(_read_by_name(spark, path, schema), "list_of_goods", on_error)
