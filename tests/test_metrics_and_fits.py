import numpy as np
import pytest

from shopgroups.operators import cluster as C
from shopgroups.operators import dbscan as D
from shopgroups.operators import metrics as M


def _blobs(spark, n_per=100, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    centers = np.array([[0.0, 0.0, 0.0], [8.0, 8.0, 0.0], [0.0, 8.0, 8.0]])
    sizes = [n_per * 2, n_per, n_per // 2]  # distinct sizes: canonical labels are 0, 1, 2
    rows, truth = [], []
    i = 0
    for j, (c, m) in enumerate(zip(centers, sizes)):
        for x in rng.normal(c, spread, size=(m, 3)):
            rows.append((i, *map(float, x)))
            truth.append(j)
            i += 1
    df = spark.createDataFrame(rows, "id long, x0 double, x1 double, x2 double")
    return df, np.array([r[1:] for r in rows]), np.array(truth)


def _silhouette_np(X, lab):
    d = ((X[:, None, :] - X[None, :, :]) ** 2).sum(axis=2)  # squared Euclidean
    s = []
    for i in range(len(X)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == k].mean() for k in set(lab) if k != lab[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def test_silhouette_ch_db_match_brute_force(spark):
    df, X, truth = _blobs(spark, 30, spread=2.5)
    lab_df = spark.createDataFrame([(i, int(t)) for i, t in enumerate(truth)], "id long, label int")
    df = df.join(lab_df, "id")
    cols = ["x0", "x1", "x2"]
    sil = M.silhouette(df, cols, "label", "id").first()[0]
    assert sil == pytest.approx(_silhouette_np(X, truth), rel=1e-9)
    ks = sorted(set(truth))
    cents = np.array([X[truth == k].mean(axis=0) for k in ks])
    n, k = len(X), len(ks)
    W = sum(((X[truth == j] - cents[j]) ** 2).sum() for j in ks)
    Bv = sum((truth == j).sum() * ((cents[j] - X.mean(axis=0)) ** 2).sum() for j in ks)
    ch = M.calinski_harabasz(df, cols, "label").first()[0]
    assert ch == pytest.approx(Bv * (n - k) / (W * (k - 1)), rel=1e-9)
    s = np.array([np.sqrt(((X[truth == j] - cents[j]) ** 2).sum(axis=1)).mean() for j in ks])
    db_np = np.mean([max((s[i] + s[j]) / np.sqrt(((cents[i] - cents[j]) ** 2).sum()) for j in ks if j != i)
                     for i in ks])
    assert M.davies_bouldin(df, cols, "label").first()[0] == pytest.approx(db_np, rel=1e-9)


def test_singleton_cluster_scores_zero(spark):
    # E19
    df = spark.createDataFrame([(0, 0, 0.0), (1, 0, 1.0), (2, 1, 10.0)], "id long, label int, x double")
    s = {r.id: r.silhouette for r in M.silhouette_samples(df, ["x"], "label", "id").collect()}
    assert s[2] == 0.0


def test_ari_cases(spark):
    # E17
    rows = [(i, i % 3, (i % 3 + 1) % 3, 1, i) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, a int, b int, one int, distinct_label int")
    assert M.adjusted_rand_index(df, "a", "a").first()[0] == pytest.approx(1.0)
    assert M.adjusted_rand_index(df, "a", "b").first()[0] == pytest.approx(1.0)
    assert M.adjusted_rand_index(df, "one", "distinct_label").first()[0] == pytest.approx(0.0)


def test_ari_of_counts_equals_the_plan(spark):
    rng = np.random.default_rng(3)
    pdf = __import__("pandas").DataFrame({"a": rng.integers(0, 4, 200), "b": rng.integers(0, 3, 200)})
    want = M.adjusted_rand_index(spark.createDataFrame(pdf), "a", "b").first()[0]
    assert M.ari_of_counts(pdf.groupby(["a", "b"]).size()) == pytest.approx(want)


def test_kmeans_recovers_blobs_and_is_partition_independent(spark):
    # E16
    df, _, truth = _blobs(spark)
    cols = ["x0", "x1", "x2"]
    model = C.fit_kmeans(df, cols, 3, seed=7, n_init=3, id_col="id")
    assert model.converged
    labels = model.assign(df).orderBy("id").select("cluster").toPandas()["cluster"].to_numpy()
    assert (labels == truth).all()
    model8 = C.fit_kmeans(df.repartition(8), cols, 3, seed=7, n_init=3, id_col="id")
    assert np.allclose(model.centers, model8.centers)
    assert model.inertia == pytest.approx(model8.inertia, rel=1e-9)


def test_gmm_diag_recovers_blobs_and_monotone(spark):
    df, _, truth = _blobs(spark)
    cols = ["x0", "x1", "x2"]
    model = C.fit_gmm_diag(df, cols, 3, seed=3)
    lab = model.assign(df).orderBy("id").toPandas()
    assert M.adjusted_rand_index(spark.createDataFrame(
        [(int(a), int(b)) for a, b in zip(lab["cluster"], truth)], "a int, b int"), "a", "b").first()[0] == 1.0
    assert model.bic() - model.aic() == pytest.approx(model.n_parameters * (np.log(model.n) - 2.0))


def test_dbscan_two_clusters_and_noise(spark):
    # E18
    rows = [(i, 0.0 + 0.01 * i, 0.0) for i in range(20)] + [(100 + i, 5.0 + 0.01 * i, 5.0) for i in range(10)]
    rows.append((999, 50.0, 50.0))
    df = spark.createDataFrame(rows, "id long, x double, y double")
    out = {r.id: r.cluster for r in C.dbscan(df, ["x", "y"], eps=0.5, min_samples=3, id_col="id").collect()}
    assert out[999] == -1
    assert {out[i] for i in range(20)} == {0} and {out[100 + i] for i in range(10)} == {1}
    all_noise = C.dbscan(df, ["x", "y"], eps=0.001, min_samples=3, id_col="id")
    assert {r.cluster for r in all_noise.collect()} == {-1}


def _brute_dbscan(x, eps, min_samples):
    """(degrees, label of each row: smallest core row of its cluster, -1 for noise)."""
    near = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) <= eps * eps
    n = near.sum(axis=1)
    core, label = n >= min_samples, np.full(len(x), -1)
    for i in np.flatnonzero(core):
        todo = [i] if label[i] < 0 else []
        while todo:
            j = todo.pop()
            if label[j] < 0:
                label[j] = i
                todo += np.flatnonzero(near[j] & core & (label < 0)).tolist()
    for i in np.flatnonzero(~core):
        found = label[near[i] & core]
        label[i] = found.min() if len(found) else -1
    return n, label


def test_dbscan_covers_all_rows_and_matches_all_pairs(spark, monkeypatch):
    # more rows than the 5,000 of the former sample; full cells, thin bridges, far noise
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.4, (2600, 3)), rng.normal(0, 0.1, (900, 3)) + [6, 0, 0], rng.uniform(-9, 9, (1900, 3)),
                        np.repeat(rng.uniform(-9, 9, (20, 3)), 6, axis=0)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, x double, y double, z double")
    monkeypatch.setattr(D, "BLOCK_ROWS", 300)
    monkeypatch.setattr(D, "UNIT_ROWS", 700)
    monkeypatch.setattr(D, "CELL_ROWS", 5)
    n, label = _brute_dbscan(x, 0.8, 6)
    got = {r.id: (r.neighbour_count, r.is_core) for r in C.dbscan(df, ["x", "y", "z"], 0.8, 6, "id", neighbours_only=True).collect()}
    assert got == {i: (n[i], n[i] >= 6) for i in range(len(x))}
    out = {r.id: r.cluster for r in C.dbscan(df, ["x", "y", "z"], 0.8, 6, "id").collect()}
    sizes = sorted(((-(label == v).sum(), v) for v in set(label.tolist()) if v >= 0))
    number = {v: i for i, (_, v) in enumerate(sizes)} | {-1: -1}
    assert len(sizes) > 5 and out == {i: number[v] for i, v in enumerate(label.tolist())}
    odd = spark.createDataFrame([(1, 0.0, 1.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 1e300, 1.0), (5, 0.1, 1.0)], "id long, x double, y double")
    assert {r.id: (r.cluster, r.is_core) for r in C.dbscan(odd, ["x", "y"], 0.5, 2, "id").collect()} == {
        1: (0, True), 2: (-1, False), 3: (-1, False), 4: (-1, False), 5: (0, True)}
    assert C.dbscan(odd.limit(0), ["x", "y"], 0.5, 2, "id").count() == 0


def test_validate_clustering_input(spark):
    bad = spark.createDataFrame([(1, 1.0), (1, 2.0)], "customer_id long, x double")
    with pytest.raises(ValueError, match="Duplicated"):
        C.validate_clustering_input(bad)
    nulls = spark.createDataFrame([(1, None)], "customer_id long, x double")
    with pytest.raises(ValueError, match="Missing"):
        C.validate_clustering_input(nulls)


def test_gmm_log_likelihood_monotone_and_partition_independent(spark):
    df, _, _ = _blobs(spark, spread=1.5)
    cols = ["x0", "x1", "x2"]
    one = C.fit_gmm_diag(df.coalesce(1), cols, 3, seed=5)
    eight = C.fit_gmm_diag(df.repartition(8), cols, 3, seed=5)
    hist = np.array(one.history)
    assert (np.diff(hist) >= -1e-9).all()
    assert np.allclose(one.means, eight.means, rtol=1e-6, atol=1e-9)
    assert one.mean_log_likelihood == pytest.approx(eight.mean_log_likelihood, rel=1e-9)


def test_batched_kmeans_equals_separate_fits(spark):
    df, _, _ = _blobs(spark, spread=2.0)
    cols = ["x0", "x1", "x2"]
    configs = [(2, 1), (3, 1), (3, 9), (4, 1)]
    batched = C.fit_kmeans_many(df, cols, configs, n_init=3)
    for (k, seed), model in zip(configs, batched):
        alone = C.fit_kmeans(df, cols, k, seed, n_init=3)
        assert model.centers.shape == (k, 3)
        assert np.allclose(model.centers, alone.centers)
        assert model.inertia == pytest.approx(alone.inertia, rel=1e-12)


def test_batched_gmm_equals_separate_fits(spark):
    df, _, _ = _blobs(spark, spread=1.5)
    cols = ["x0", "x1", "x2"]
    configs = [(2, 3), (3, 3)]
    batched = C.fit_gmm_diag_many(df, cols, configs)
    for (k, seed), model in zip(configs, batched):
        alone = C.fit_gmm_diag(df, cols, k, seed)
        assert np.allclose(model.means, alone.means, rtol=1e-9, atol=1e-12)
        assert model.mean_log_likelihood == pytest.approx(alone.mean_log_likelihood, rel=1e-12)
        assert model.n_iter == alone.n_iter


def test_silhouette_scores_every_row(spark):
    rng = np.random.default_rng(4)
    X = np.concatenate([rng.normal(0, 1, (9000, 2)), rng.normal(3, 1, (3500, 2))])
    lab = np.repeat([0, 1], [9000, 3500])
    df = spark.createDataFrame([(i, int(c), *map(float, x)) for i, (c, x) in enumerate(zip(lab, X))], "id long, label int, x double, y double")
    s = M.silhouette_samples(df, ["x", "y"], "label", "id").orderBy("id").toPandas()["silhouette"].to_numpy()
    assert len(s) == 12_500
    for i in (0, 8999, 9000, 12_499):
        d = ((X - X[i]) ** 2).sum(axis=1)
        a, b = d[lab == lab[i]].sum() / ((lab == lab[i]).sum() - 1), d[lab != lab[i]].mean()
        assert s[i] == pytest.approx((b - a) / max(a, b), rel=1e-9)


def test_metrics_for_centers_equal_single(spark):
    df, _, _ = _blobs(spark, 30, spread=2.5)
    cols = ["x0", "x1", "x2"]
    fits = {str(k): C.fit_kmeans(df, cols, k, 1, n_init=2) for k in (2, 3, 4)}
    many = M.clustering_metrics_for_centers(df, cols, {k: m.centers for k, m in fits.items()})
    for name, model in fits.items():
        single = M.clustering_metrics(model.assign(df), cols, "cluster").first().asDict()
        for key, value in single.items():
            assert many[name][key] == pytest.approx(value, rel=1e-9), (name, key)


def test_start_draw_counts_repeated_rows(spark):
    # nine of ten rows are one point: about nine of ten first centres are it
    rows = [(i, 1.0 if i < 900 else float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, x double")
    X = C._prepared(df, ["x"], "id")
    first = C._kpp_init(X, ["x"], [(seed, 0, 1) for seed in range(400)])[:, 0, 0]
    X.unpersist()
    assert 0.84 < (first == 1.0).mean() < 0.96
    model = C.fit_kmeans(df, ["x"], 4, n_init=1, max_iter=1, id_col="id")
    assert not model.converged and model.n_iter == 1


def test_lloyd_sums_match_plain_distances():
    """Padded centres take no rows, ties go to the first centre, costs are added on request only."""
    from shopgroups.operators import cluster as C
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(50, 1, (300, 4)), np.zeros((5, 4))])
    centers = x[rng.integers(0, 300, (60, 4))]
    centers[1, 2] = centers[1, 0]  # the same centre twice
    valid = np.array([[j < 2 + r % 3 for j in range(4)] for r in range(60)])
    for costs in (False, True):
        n, cost, sums = np.zeros((60, 4)), np.zeros((60, 4)), np.zeros((60, 4, 4))
        C._lloyd_sums(x, centers, valid, (n, cost, sums), costs)
        for r in range(60):
            d = ((x[:, None] - centers[r][None]) ** 2).sum(axis=2)
            d[:, ~valid[r]] = np.inf
            own = d.argmin(axis=1)
            assert n[r].tolist() == np.bincount(own, minlength=4).tolist()
            for j in range(4):
                assert np.allclose(sums[r, j], x[own == j].sum(axis=0)) and np.isclose(cost[r, j], d[own == j, j].sum() if costs else 0.0)


def test_given_models_are_not_fitted_again(spark, monkeypatch):
    from shopgroups.operators import cluster as C
    from shopgroups.plans import segmentation as SEG
    df = spark.createDataFrame([(i, float(i % 3 * 10), float(i % 7)) for i in range(60)], "customer_id long, x double, y double")
    configs = [(2, 1), (2, 2), (3, 1)]
    fitted = C.fit_kmeans_many(df, ["x", "y"], configs, 2)
    plain = SEG.k_sweep(df, ["x", "y"], [2, 3], 1, 2)[0], SEG.seed_stability(df, ["x", "y"], 2, [1, 2], 2).collect()
    monkeypatch.setattr(C, "fit_kmeans_many", None)
    metrics = SEG.k_sweep(df, ["x", "y"], [2, 3], 1, 2, models=[fitted[0], fitted[2]])[0]
    assert [{k: round(v, 9) for k, v in m.items()} for m in metrics] == [{k: round(v, 9) for k, v in m.items()} for m in plain[0]]
    assert SEG.seed_stability(df, ["x", "y"], 2, [1, 2], 2, models=fitted[:2]).collect() == plain[1]
