import math

import pytest
from pyspark.sql import functions as F

from shopgroups.operators import baskets as B


def _lines(spark, baskets):
    rows = [(i, "s", item) for i, items in enumerate(baskets) for item in items]
    return spark.createDataFrame(rows, "invoice_id long, cluster string, product string")


def test_pair_rules_fixture(spark):
    # {a,b},{a,b},{a},{c,c} and one empty basket (absent from the long shape)
    lines = _lines(spark, [["a", "b"], ["a", "b"], ["a"], ["c", "c"], []])
    rules = B.mine_pair_rules(lines, ("cluster",), min_support=0.0, min_confidence=0.0, min_lift=0.0)
    got = {(r.antecedents, r.consequents): r for r in rules.collect()}
    ab, ba = got[("a", "b")], got[("b", "a")]
    assert ab.support == pytest.approx(0.5)
    assert ab.confidence == pytest.approx(2 / 3)
    assert ab.lift == pytest.approx(4 / 3)
    assert ab.leverage == pytest.approx(0.5 - 0.75 * 0.5)
    assert ab.conviction == pytest.approx(1.5)
    assert ba.confidence == pytest.approx(1.0)
    assert math.isinf(ba.conviction)
    assert ab.lift == ba.lift  # same formula both ways


def test_thresholds_inclusive(spark):
    # Support exactly at the threshold is kept
    lines = _lines(spark, [["a", "b"], ["c"], ["d"], ["e"]])
    rules = B.mine_pair_rules(lines, ("cluster",), min_support=0.25, min_confidence=1.0, min_lift=4.0)
    assert {(r.antecedents, r.consequents) for r in rules.collect()} == {("a", "b"), ("b", "a")}


def test_rank_and_top_n(spark):
    lines = _lines(spark, [["a", "b", "c"], ["a", "b"], ["c", "d"], ["d"]])
    rules = B.cluster_association_rules(lines, min_support=0.0, min_confidence=0.0, min_lift=0.0, top_n=3)
    ranks = sorted(r.rule_rank for r in rules.collect())
    assert ranks == [1, 2, 3]


def test_parse_goods_list(spark):
    # E8
    df = spark.createDataFrame([(1, "[]"), (2, None), (3, "['a','a','b']"), (4, "[\"farmer's\", 'x']")],
                               "invoice_id long, list_of_goods string")
    out = {r.invoice_id: r for r in B.parse_baskets(df).collect()}
    assert out[1].basket_size == 0 and out[2].basket_size == 0
    assert (out[3].basket_size, out[3].distinct_products_per_basket) == (3, 2)
    assert out[4].goods_list == ["farmer's", "x"]
    bad = spark.createDataFrame([(5, "nope")], "invoice_id long, list_of_goods string")
    with pytest.raises(Exception):
        B.parse_baskets(bad).collect()
    assert B.parse_baskets(bad, on_error="empty").first().basket_size == 0


def test_favourite_product_tie(spark):
    # Ties resolve alphabetically
    lines = spark.createDataFrame([(1, 7, "pear"), (1, 7, "apple"), (2, 7, "pear"), (2, 7, "apple")],
                                  "invoice_id long, customer_id long, product string")
    baskets = B.basket_sizes(lines)
    f = B.customer_basket_features(baskets, lines).first()
    assert f.most_frequent_product == "apple"
    assert f.basket_count == 2 and f.distinct_products_in_baskets == 2


def test_profile_keeps_empty_cluster_and_rejects_unmatched(spark):
    # E10
    clusters = spark.createDataFrame([(1, 0), (2, 1)], "customer_id long, cluster int")
    baskets = spark.createDataFrame([(10, 1, 2, 2)], "invoice_id long, customer_id long, basket_size int, "
                                                     "distinct_products_per_basket int")
    bc = B.join_baskets_to_clusters(baskets, clusters)
    lines = spark.createDataFrame([(10, 1, 0, "a"), (10, 1, 0, "b")],
                                  "invoice_id long, customer_id long, cluster int, product string")
    prof = {r.cluster: r for r in B.cluster_basket_profile(bc, lines, clusters).collect()}
    assert prof[1].number_of_baskets == 0 and prof[1].share_of_cluster_customers_with_baskets == 0.0
    assert prof[0].share_of_cluster_customers_with_baskets == 1.0
    orphan = spark.createDataFrame([(11, 99, 1, 1)], baskets.schema)
    with pytest.raises(Exception, match="did not match"):
        B.join_baskets_to_clusters(orphan, clusters).collect()


def test_contract_errors(spark):
    dup = spark.createDataFrame([(1, 0), (1, 1)], "customer_id long, cluster int")
    with pytest.raises(ValueError, match="duplicated"):
        B.validate_customer_clusters(dup)
    with pytest.raises(ValueError, match="rows"):
        B.validate_customer_clusters(dup.limit(1), expected_rows=5)
    missing = spark.createDataFrame([(1, None)], "customer_id long, cluster int")
    with pytest.raises(ValueError, match="missing"):
        B.validate_customer_clusters(missing)


def test_top_products_share_before_cut(spark):
    lines = spark.createDataFrame([(0, "a")] * 3 + [(0, "b")] * 2 + [(0, "c")],
                                  "cluster int, product string")
    top = B.cluster_top_products(lines, top_n=2).orderBy("product_rank").collect()
    assert [r.product for r in top] == ["a", "b"]
    assert top[0].product_share_within_cluster == pytest.approx(0.5)
    assert F is not None


def test_sets_are_not_shuffled_by_a_few_groups(spark):
    sets = spark.createDataFrame([(i, i % 2, [f"p{i % 3}", f"p{i % 3 + 1}"]) for i in range(40)], "invoice_id long, cluster long, items array<string>")
    assert B.few_groups(sets)
    few, many = (B.mine_pair_rules_from_sets(sets, few=f, min_support=0.1, min_confidence=0.0, min_lift=0.0) for f in (True, False))
    plan = few._jdf.queryExecution().executedPlan().toString()
    pairing = plan[plan.index("sorted_pairs") if "sorted_pairs" in plan else plan.index("Generate explode"):]
    assert "BroadcastHashJoin" in pairing
    key = lambda r: (r.cluster, r.antecedents, r.consequents)
    assert sorted(few.collect(), key=key) == sorted(many.collect(), key=key)
