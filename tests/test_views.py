"""The customer view's aggregates of the lines."""

import datetime

from shopgroups.sources import views as V


def test_distinct_counts_have_an_aggregate_of_their_own(spark, tmp_path):
    """Sums of prices are not carried along with every (customer, supplier) and (customer, part)."""
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    day = datetime.datetime(2020, 5, 1)
    write("customer", [(1, "a", 3, 5.0), (2, "b", 4, -1.0), (3, "c", 5, 0.0)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double")
    write("orders", [(10, 1, day, "1-URGENT"), (11, 1, day, "2-HIGH"), (12, 2, day, "5-LOW"), (13, None, day, "5-LOW")],
          "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string")
    write("lineitem", [(10, 1, 7, 2.0, 0.1, "R"), (10, 2, 7, 3.0, 0.0, "A"), (11, 1, 8, 4.0, 0.0, "R"), (11, None, None, 9.0, 0.5, "R"), (12, 99, 7, 1.0, 0.0, "R"),
                       (13, 2, 7, 1.0, 0.0, "R")], "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, l_discount double, l_returnflag string")
    write("part", [(1, "SMALL"), (2, "LARGE")], "p_partkey long, p_type string")
    write("events", [(1, day)], "user_id long, ts timestamp")
    view = V._assembled(spark, str(tmp_path), None)
    got = {r.customer_id: (r.lifetime_total_distinct_products, r.distinct_stores_visited, r.number_complaints, r.lifetime_spend_small, r.lifetime_spend_large,
                           r.percentage_of_products_bought_promotion) for r in view.collect()}
    assert got == {1: (2.0, 2.0, 2.0, 6.0, 3.0, 1 / 3), 2: (None,) * 6, 3: (None,) * 6}  # customer 2 has a line of an unknown part only
    plan = view._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("gid" in line for line in plan) and not any("gid" in line and "sum(" in line for line in plan)
    alone = V._assembled(spark, str(tmp_path), ["customer_id", "lifetime_total_distinct_products"])
    assert {r[0]: r[1] for r in alone.collect()} == {1: 2.0, 2: 1.0, 3: None}


def test_tasks_are_sized_by_less_than_sparks_default(spark):
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
