import pytest

from shopgroups.functions.text import degree_level
from shopgroups.operators import features as FE
from shopgroups.operators import prep as P


def test_degree_levels(spark):
    # E1
    df = spark.createDataFrame([(None,), (" Msc. A",), ("phd. B",), ("Bsc.C",)], "customer_name string")
    got = [r[0] for r in df.select(degree_level("customer_name")).collect()]
    assert got == ["Unknown", "Msc", "Unknown", "Bsc"]


def _customers(spark, rows):
    schema = ("customer_id long, customer_name string, customer_gender string, customer_birthdate string, "
              "kids_home double, teens_home double, number_complaints double, distinct_stores_visited double, "
              "lifetime_spend_a double, lifetime_spend_b double, lifetime_total_distinct_products double, "
              "year_first_transaction double, loyalty_card_number double, "
              "percentage_of_products_bought_promotion double, typical_hour double, latitude double, longitude double")
    return spark.createDataFrame(rows, schema)


def _row(i, birth=None, kids=None, teens=None, a=None, b=None, year=2020.0, promo=0.5):
    return (i, "x", "female", birth, kids, teens, 1.0, 1.0, a, b, 1.0, year, None, promo, 10.0, 0.0, 0.0)


def test_age_children_spend_and_shares(spark):
    rows = [_row(1, "05/07/1984 03:15 PM", 1.0, None, None, None),
            _row(2, "5/7/1984 3:15 PM", 1.0, 1.0, 0.0, 0.0),
            _row(3, "x", None, None, -5.0, 0.0),
            _row(4, None, 0.0, 0.0, None, 10.0)]
    out = {r.customer_id: r for r in FE.add_customer_info_features(_customers(spark, rows)).collect()}
    # E2
    assert out[1].age == 36 and out[2].age == 36 and out[3].age is None and out[4].age is None
    # E3
    assert out[1].total_children_home is None and out[1].has_children == 0 and out[2].has_children == 1
    # E4
    assert out[1].total_lifetime_spend is None and out[1].share_a == 0.0
    assert out[2].total_lifetime_spend == 0.0 and out[2].share_a == 0.0
    assert out[3].total_lifetime_spend == -5.0 and out[3].share_a == 0.0
    assert out[4].share_a is None and out[4].share_b == 1.0


def test_clip_then_median(spark):
    # E5
    df = spark.createDataFrame([(1, -0.2), (2, 0.5), (3, 150.0), (4, None), (5, None)], "customer_id long, p double")
    clean = P.clean_feature_values(df, clip_column="p")
    assert [r.p for r in clean.orderBy("customer_id").collect()] == [0.0, 0.5, 100.0, 0.5, 0.5]


def test_constant_and_all_null_columns(spark):
    # E6, E7
    df = spark.createDataFrame([(1, 7.0, None), (2, 7.0, None)], "customer_id long, c double, n double")
    imputed, fills = P.impute_median(df)
    assert fills["n"] == 0.0
    model = P.fit_scaler(imputed, ["c"], "robust")
    assert model.scale["c"] == 1.0
    scored = model.transform(spark.createDataFrame([(3, 9.0)], "customer_id long, c double")).first()
    assert scored.c == 2.0
    std = P.fit_scaler(imputed, ["c"], "standard")
    assert std.transform(imputed).first().c == 0.0


def test_missing_model_columns(spark):
    df = spark.createDataFrame([(1, 1.0)], "customer_id long, age double")
    with pytest.raises(ValueError, match="Missing required model columns"):
        P.select_model_features(df)


def test_concat_feature_sets_matches_on_id(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "customer_id long, x double")
    b = spark.createDataFrame([(2, 20.0), (1, 10.0)], "customer_id long, y double")
    out = {r.customer_id: (r.x, r.y) for r in FE.concat_feature_sets(a, b).collect()}
    assert out == {1: (1.0, 10.0), 2: (2.0, 20.0)}
    c = spark.createDataFrame([(3, 30.0)], "customer_id long, y double")
    with pytest.raises(Exception, match="same ids"):
        FE.concat_feature_sets(a, c).collect()
