import pytest
from pyspark.sql import functions as F

from shopgroups.operators import offers as G

PLAN_SCHEMA = ("cluster int, persona_name string, persona_summary string, recommended_promotion string, "
               "promotion_type string, products_to_promote string, risk_or_caveat string")


def _plan(spark, terms=None, terms_type="string"):
    base = [(0, "P0", "s", "r", "t", "p", "c"), (1, "P1", "s", "r", "t", "p", "c")]
    df = spark.createDataFrame(base, PLAN_SCHEMA)
    if terms is not None:
        df = df.join(spark.createDataFrame(terms, f"cluster int, product_terms {terms_type}"), "cluster", "left")
    return df


def _top(spark):
    rows = [(0, "Apple juice", 1), (0, "bread", 2), (0, "Apple pie", 3), (1, "milk", 1), (1, "eggs", 2)]
    return spark.createDataFrame(rows, "cluster int, product string, product_rank int")


def test_preferred_terms(spark):
    # Text terms split/trim/lower; no match falls back to all
    plan = _plan(spark, [(0, " APPLE, ,"), (1, "zzz")])
    got = {r.cluster: r.supporting_products for r in G.list_top_products(_top(spark), plan, 5).collect()}
    assert got[0] == "Apple juice, Apple pie"
    assert got[1] == "milk, eggs"
    no_terms = {r.cluster: r.supporting_products for r in G.list_top_products(_top(spark), _plan(spark), 1).collect()}
    assert no_terms == {0: "Apple juice", 1: "milk"}


def test_rule_text_and_fallback(spark):
    # E14
    rules = spark.createDataFrame([(0, "a", "b", 2.5749, 1)], "cluster int, antecedents string, consequents string, "
                                                               "lift double, rule_rank int")
    got = {r.cluster: r.supporting_association_rules for r in G.list_top_rules(rules, _plan(spark)).collect()}
    assert got[0] == "a -> b (lift 2.57)"
    assert got[1] == G.NO_RULES_TEXT


def test_plan_and_cluster_errors(spark):
    # E15
    with pytest.raises(ValueError, match="promotion_type"):
        G.validate_promotion_plan(_plan(spark).drop("promotion_type"))
    prof = spark.createDataFrame([(0, 40.0, 1000.0, 0.5, 1.0)], "cluster int, age_mean double, "
                                 "total_lifetime_spend_mean double, has_loyalty_card_mean double, "
                                 "total_children_home_mean double")
    shares = spark.createDataFrame([(c, 0.1, 0.2, 0.3, 0.4) for c in (0, 1)],
                                   "cluster int, share_groceries double, share_electronics double, "
                                   "share_vegetables double, share_meat double")
    basket = spark.createDataFrame([(0, 0.8), (1, 0.9)], "cluster int, share_of_cluster_customers_with_baskets double")
    ev = G.cluster_evidence(spark.createDataFrame([(0,)], "cluster int"), prof, shares, basket).first()
    assert ev.main_evidence == ("Mean age 40.0; mean spend 1,000; loyalty-card share 50.0%; children at home 1.0; "
                                "groceries 10.0%, electronics 20.0%, vegetables 30.0%, meat 40.0%, "
                                "basket coverage 80.0%.")
    with pytest.raises(Exception, match="Cluster 1 was not found in cluster_profile"):
        G.cluster_evidence(spark.createDataFrame([(1,)], "cluster int"), prof, shares, basket).collect()
    assert F is not None


def test_cluster_row_and_profile_input(spark):
    from shopgroups.operators import profile as PR
    frame = spark.createDataFrame([(0, "a"), (1, "b")], "cluster int, v string")
    assert G.cluster_row(frame, 1).first().v == "b"
    with pytest.raises(ValueError, match="Cluster 7 was not found"):
        G.cluster_row(frame, 7)
    labels = spark.createDataFrame([(1, 0), (2, 1)], "customer_id long, cluster int")
    feats = spark.createDataFrame([(1, 5.0), (2, 6.0)], "customer_id long, x double")
    assert PR.profile_input(labels, feats).count() == 2
    dup = feats.union(spark.createDataFrame([(2, 7.0)], feats.schema))
    with pytest.raises(Exception, match="repeat id"):
        PR.profile_input(labels, dup).collect()
