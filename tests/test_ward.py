"""Ward linkage against the textbook algorithm on all rows."""

import numpy as np
import pytest

from shopgroups.operators import ward as W


def brute_ward(x, k):
    """Merge the pair whose sum of squares grows least, until k clusters are left: (labels, growths)."""
    clusters, growth = [[i] for i in range(len(x))], []
    while len(clusters) > 1:
        best = None
        for a in range(len(clusters)):
            for b in range(a + 1, len(clusters)):
                n, m = len(clusters[a]), len(clusters[b])
                gap = x[clusters[a]].mean(axis=0) - x[clusters[b]].mean(axis=0)
                cost = n * m / (n + m) * float((gap ** 2).sum())
                if best is None or cost < best[0]:
                    best = (cost, a, b)
        if len(clusters) == k:
            labels = np.zeros(len(x), int)
            for c, rows in enumerate(clusters):
                labels[rows] = c
        growth.append(best[0])
        clusters[best[1]] += clusters.pop(best[2])
    return labels, growth


def same_groups(a, b):
    return len({(int(u), int(v)) for u, v in zip(a, b)}) == len(set(a.tolist())) == len(set(b.tolist()))


def frame(spark, x, parts=4):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double").repartition(parts)


@pytest.mark.parametrize("seed", range(4))
def test_merges_match_the_textbook(seed):
    x = np.random.default_rng(seed).normal(size=(40, 3))
    labels, growth = brute_ward(x, 5)
    merges = W.ward_merges(np.ones(40), x)
    assert np.allclose(merges[:, 2] ** 2 / 2, growth)
    assert same_groups(W.cut_tree(merges, 40, 5), labels)
    assert merges[-1, 3] == 40 and (np.diff(merges[:, 2]) >= 0).all()


def test_all_rows_are_labelled_as_by_the_textbook(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.8, (n, 3)) for c, n in ((0, 30), (4, 20), (9, 10))])
    x = np.concatenate([x, x[:15]])  # repeated rows share a feature, with their weight
    model = W.fit_ward(frame(spark, x), ["a", "b", "c"], "id")
    assert len(model.sizes) == 60 and model.sizes.sum() == 75 and model.micro_inertia == pytest.approx(0, abs=1e-9)
    assert model.total_inertia == pytest.approx(((x - x.mean(axis=0)) ** 2).sum())
    got = model.assign(frame(spark, x), "id", [3, 4, 6]).orderBy("id").toPandas()
    assert got.columns.tolist() == ["id", "cluster_3", "cluster_4", "cluster_6"]
    for k in (3, 4, 6):
        assert same_groups(got[f"cluster_{k}"].to_numpy(), brute_ward(x, k)[0])
        sizes = got[f"cluster_{k}"].value_counts().sort_index().tolist()
        assert sizes == sorted(sizes, reverse=True)  # numbered by size


def test_micro_clusters_keep_groups_and_report_their_share(spark, monkeypatch):
    monkeypatch.setattr(W, "HELD", 2)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.5, (n, 3)) for c, n in ((0, 3000), (6, 2000), (14, 1000))])
    model = W.fit_ward(frame(spark, x, 6), ["a", "b", "c"], "id", max_micro=64)
    assert len(model.sizes) <= 64 and model.sizes.sum() == 6000
    assert 0 < model.micro_inertia < 0.02 * model.total_inertia
    got = model.assign(frame(spark, x), "id", [3]).orderBy("id").toPandas()["cluster_3"].to_numpy()
    assert (got == np.repeat([0, 1, 2], [3000, 2000, 1000])).all()


def test_few_rows(spark):
    one = W.fit_ward(frame(spark, np.ones((5, 3))), ["a", "b", "c"], "id")
    assert one.merges.shape == (0, 4)
    assert {r.cluster_4 for r in one.assign(frame(spark, np.ones((5, 3))), "id", [4]).collect()} == {0}
    with pytest.raises(ValueError):
        W.fit_ward(frame(spark, np.ones((1, 3))).limit(0), ["a", "b", "c"], "id")


def test_nearest_prefers_the_equal_point():
    rng = np.random.default_rng(9)
    points = np.concatenate([rng.normal(1e6, 1, (300, 4)), rng.normal(1e6, 1e-6, (300, 4))])
    assert (W.nearest(points, points) == np.arange(600)).all()


def test_partial_results_are_combined_in_tasks(spark, monkeypatch):
    from shopgroups.operators import blocks as B
    monkeypatch.setattr(B, "FAN", 3)
    x = np.arange(60.0).reshape(20, 3)
    packed = B.PackedRows(frame(spark, x, 11), ["a", "b", "c"], "id")
    total, rows = packed.fold(lambda blocks: tuple(map(sum, zip(*[(b.sum(axis=0), len(b)) for b, _ in blocks]))) or (np.zeros(3), 0))
    packed.unpersist()
    assert rows == 20 and (total == x.sum(axis=0)).all()
