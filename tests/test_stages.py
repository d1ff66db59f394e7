"""The flow from raw CSV files to offers, its manifests and its restarts."""

import csv

import numpy as np
import pytest

from shopgroups.operators import offers as G
from shopgroups.plans.stages import Flow, Settings
from shopgroups.sources import io as IO

PRODUCTS = ["milk", "bread", "beer", "crisps", "tea", "cake"]


def write_raw(folder, n=60):
    """Three kinds of customers; a customer without baskets and a basket without goods."""
    rng = np.random.default_rng(4)
    names = [f.strip().split()[0] for f in IO.CUSTOMER_INFO_SCHEMA.split(",")]
    with open(folder / "customers.csv", "w", newline="") as f:
        out = csv.DictWriter(f, names)
        out.writeheader()
        for i in range(n):
            kind = i % 3
            spend = [c for c in names if c.startswith("lifetime_spend_")]
            row = {c: round(float(rng.normal(50 * (1 + (j + kind) % 3), 0.5)), 2) for j, c in enumerate(spend)}
            row.update({"customer_id": i, "customer_name": ["Bsc. A", "B", "Phd. C"][kind], "customer_gender": "female" if i % 2 else "", "kids_home": kind,
                        "teens_home": 0, "number_complaints": kind, "distinct_stores_visited": 1 + kind, "lifetime_total_distinct_products": 10 * kind + i % 4,
                        "year_first_transaction": 2010 + kind, "loyalty_card_number": "" if kind else 7, "percentage_of_products_bought_promotion": 0.2 * kind,
                        "typical_hour": 9 + kind, "latitude": 1, "longitude": 2, "customer_birthdate": f"0{kind + 1}/02/19{60 + kind * 10} 08:30 AM"})
            out.writerow(row)
    with open(folder / "baskets.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["invoice_id", "customer_id", "list_of_goods"])
        for i in range(4 * n):
            goods = [PRODUCTS[2 * (i % 3)], PRODUCTS[2 * (i % 3) + 1]] if i // 3 % 3 else [PRODUCTS[int(rng.integers(6))]]
            out.writerow([i, i % n if i % n != 5 else 8, str(goods if i else [])])
    return str(folder / "customers.csv"), str(folder / "baskets.csv")


@pytest.fixture(scope="module")
def flow(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    customers, baskets = write_raw(folder)
    plan = spark.createDataFrame([(c, f"p{c}", "s", "o", "t", "x", "r") for c in range(3)], ", ".join(
        f"{c} {'int' if c == 'cluster' else 'string'}" for c in G.PLAN_COLUMNS))
    return Flow(spark, customers, baskets, plan, str(folder / "out"), Settings(clusters=3, k_values=(2, 3), starts=3, min_support=0.05))


STAGES = ["features", "scaled", "segments", "profiles", "baskets", "rules", "offers"]


def test_raw_csv_to_offers(spark, flow):
    tables = flow.run()
    assert flow.ran == STAGES
    assert set(tables) == {"customer_features", "removed_columns", "scaled_features", "customer_clusters", "kmeans_metrics", "cluster_profile_summary",
                           "cluster_spending_shares", "cluster_metric_means", "basket_items", "cluster_basket_profile", "cluster_top_products",
                           "cluster_association_rules", "cluster_rule_summary",
                           "cluster_top_rules", "cluster_promotion_recommendations"}
    labels = {r.customer_id: r.cluster for r in tables["customer_clusters"].collect()}
    assert len(labels) == 60 and len({(i % 3, c) for i, c in labels.items()}) == 3  # the three kinds
    assert sorted(r.column for r in tables["removed_columns"].collect()) == sorted(["customer_name", "customer_birthdate", *[
        f"lifetime_spend_{c}" for c in IO.SPEND_CATEGORIES], "loyalty_card_number"])
    profile = {r.cluster: r for r in tables["cluster_basket_profile"].collect()}
    assert sum(p.number_of_baskets for p in profile.values()) == 240
    assert sum(p.number_of_customers_with_baskets for p in profile.values()) == 59
    offers = tables["cluster_promotion_recommendations"].collect()
    assert [r.cluster for r in sorted(offers, key=lambda r: r.cluster)] == [0, 1, 2] and offers[0].__fields__ == G.OUTPUT_COLUMNS
    kind = {c: i % 3 for i, c in labels.items()}
    for r in offers:  # each kind's own pair of products leads its rules and its products
        a, b = sorted(PRODUCTS[2 * kind[r.cluster]: 2 * kind[r.cluster] + 2])
        assert {a, b} <= set(r.supporting_products.split(", ")[:2]) and f"{a} -> {b}" in r.supporting_association_rules
    k3 = next(r for r in tables["kmeans_metrics"].collect() if r.k == 3)
    assert k3.min_cluster_size == k3.max_cluster_size == 20 and k3.silhouette_score > 0.8


def again(flow, **changes):
    from dataclasses import replace
    new = Flow(flow.spark, flow.customers, flow.baskets, flow.plan, flow.folder, replace(flow.settings, **changes))
    new.run()
    return new.ran


def test_finished_stages_are_not_run_again(flow):
    flow.run()
    assert again(flow) == []


def test_a_stage_without_its_result_is_run_again(spark, flow):
    from shopgroups.sources.tables import remove_folder
    flow.run()
    remove_folder(spark, f"{flow.folder}/cluster_top_products")  # as if it had been lost
    assert again(flow) == ["baskets"]
    remove_folder(spark, f"{flow.folder}/_manifest/rules")  # as if it had not ended
    assert again(flow) == ["rules"]


def test_changed_tables_and_inputs_run_what_depends_on_them(spark, flow):
    flow.run()
    changed = flow.table("cluster_spending_shares").limit(2).collect()
    spark.createDataFrame(changed, flow.table("cluster_spending_shares").schema).write.mode("overwrite").parquet(f"{flow.folder}/cluster_spending_shares")
    assert again(flow) == ["profiles"]
    with open(flow.baskets, "a") as f:
        f.write("9999,1,\"['tea']\"\n")
    assert again(flow) == ["baskets", "rules", "offers"]


def test_plan_rows_without_a_cluster_fail(spark, flow):
    flow.run()
    plan = flow.plan.unionByName(flow.plan.limit(1).replace(0, 9, "cluster"))
    with pytest.raises(Exception, match="9"):
        Flow(spark, flow.customers, flow.baskets, plan, flow.folder, flow.settings).run()
    assert Flow(spark, flow.customers, flow.baskets, plan, flow.folder, flow.settings).manifest("offers") is None
