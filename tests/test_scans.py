"""Which tables the plans scan, and how often."""

from shopgroups.operators import baskets as B
from shopgroups.plans import catalog
from shopgroups.sources import views as V
from shopgroups.sources.kept import kept, release

SF = "/root/testdata/sf0.001"


def scans(df, table):
    return df._jdf.queryExecution().executedPlan().toString().count(f"{SF}/{table}.parquet")


def test_customer_columns_scan_only_what_they_need(spark):
    gender = catalog.QUERIES["gender_value_counts"](spark, SF)
    assert scans(gender, "customer") == 1 and not any(scans(gender, t) for t in ("orders", "lineitem", "part", "events"))
    hours = V.customer_info(spark, SF, ["customer_id", "typical_hour"])
    assert scans(hours, "events") == 1 and scans(hours, "lineitem") == 0
    complaints = V.customer_info(spark, SF, ["customer_id", "number_complaints"])
    assert scans(complaints, "lineitem") == 1 and scans(complaints, "part") == 0
    whole = V.customer_info(spark, SF)
    assert complaints.orderBy("customer_id").collect() == whole.select("customer_id", "number_complaints").orderBy("customer_id").collect()


def test_one_scan_of_the_lines_serves_all_basket_tables(spark):
    labels = V.customer_segments(spark, SF)
    assert scans(B.basket_items(V.invoice_lines(spark, SF), V.invoices(spark, SF), labels), "lineitem") == 1
    items = catalog.basket_items(spark, SF, labels)
    for df in (B.cluster_basket_profile(B.baskets_of(items), items, labels), B.cluster_top_products(items, count_col="n"), B.item_sets_of(items)):
        assert scans(df, "lineitem") == 0
    assert catalog.QUERIES["offer_products"](spark, SF).count() == 5


def test_basket_items_keep_empty_baskets_and_skip_null_products(spark):
    lines = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None)], "invoice_id long, product string")
    baskets = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "invoice_id long, customer_id long")
    items = B.basket_items(lines, baskets)
    assert sorted(map(tuple, items.collect()), key=str) == [(10, 1, "a", 2), (10, 1, "b", 1), (10, 2, None, 0), (11, 3, None, 0)]
    assert sorted(map(tuple, B.baskets_of(items).collect())) == [(10, 1, 3, 2), (10, 2, 0, 0), (11, 3, 0, 0)]


def test_kept_tables_follow_their_files(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(f"{tmp_path}/t.parquet"), "more"

    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    for _ in range(2):
        df, more = kept(spark, str(tmp_path), ["t"], ("x",), build)
        assert df.count() == 3 and more == "more"
    assert len(calls) == 1
    spark.range(5).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert kept(spark, str(tmp_path), ["t"], ("x",), build)[0].count() == 5 and len(calls) == 2
    release(spark)
    assert kept(spark, str(tmp_path), ["t"], ("x",), build)[0].count() == 5 and len(calls) == 3
