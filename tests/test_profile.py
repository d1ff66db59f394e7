import pandas as pd
import pytest

from shopgroups.operators import offers as G
from shopgroups.operators import profile as PR


def test_split_counts_largest_and_shares(spark):
    # k5 clusters 0 and 1 tie in size (3 each): the smaller label is the "largest"
    rows = [(1, 0, 5), (2, 0, 5), (3, 0, 6), (4, 1, 6), (5, 1, 6), (6, 1, 7), (7, 2, 7)]
    labels = spark.createDataFrame(rows, "customer_id long, k5_cluster int, k6_cluster int")
    got = {r.k6_cluster: r for r in PR.split_counts(labels, threshold=0.5).collect()}
    assert set(got) == {5, 6}
    assert got[5].customer_count == 2 and got[5].share_of_big_k5_cluster == pytest.approx(2 / 3)
    assert got[6].k6_cluster_total_count == 3
    assert got[6].share_of_k6_cluster_from_big_k5_cluster == pytest.approx(1 / 3)
    assert got[5].main_split_part and not got[6].main_split_part


def test_cluster_profile_matches_pandas(spark):
    rows = [(0, 1.0, 10.0), (0, 2.0, None), (0, 4.0, 30.0), (1, 5.0, 7.0), (1, None, 9.0)]
    df = spark.createDataFrame(rows, "cluster int, a double, b double")
    got = {r.cluster: r for r in PR.create_cluster_profile(df, "cluster").collect()}
    pdf = pd.DataFrame(rows, columns=["cluster", "a", "b"])
    want = pdf.groupby("cluster")[["a", "b"]].agg(["mean", "median"])
    for c in (0, 1):
        for col in ("a", "b"):
            assert got[c][f"{col}_mean"] == pytest.approx(want.loc[c, (col, "mean")])
            assert got[c][f"{col}_median"] == pytest.approx(want.loc[c, (col, "median")])


def test_cluster_completeness(spark):
    expected = spark.createDataFrame([(0,), (1,), (2,)], "cluster int")
    tables = {"profile": spark.createDataFrame([(0,), (1,), (2,)], "cluster int"),
              "rules": spark.createDataFrame([(0,), (0,), (5,)], "cluster int")}
    got = {r.table: r for r in G.cluster_completeness(expected, tables).collect()}
    assert (got["profile"].missing_clusters, got["profile"].extra_clusters) == (0, 0)
    assert (got["rules"].found_clusters, got["rules"].missing_clusters, got["rules"].extra_clusters) == (2, 2, 1)
