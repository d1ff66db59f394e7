"""Inner products by M-trees and codes by Orchard's search, against brute force."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shopgroups.llm import metric_tree, orchard
from shopgroups.llm.metric_tree import Space, Tree, build_pages, top_products
from shopgroups.llm.orchard import Orchard, compress_vectors, with_group_total

BAD = [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0]]


def table(spark, rows):
    """(vec_id, embedding, label) and columns whose names the operators use themselves."""
    full = [(i, v, lab, "x", 1, 2, 3.0, 4) for i, v, lab in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<double>, label int, tree string, z int, nth int, code double, error long")


def best_products(rows, k=10, every=100):
    own = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            z = [int(np.floor(1024 * c)) for c in v]
            own[i] = min(own.get(i, z), z)
    out = []
    for q in own:
        if q % every == 0:
            score = sorted((-sum(a * b for a, b in zip(own[q], z)), i) for i, z in own.items() if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(score, 1)]
    return sorted(out)


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    return centres[rng.integers(0, 12, n)] + 0.02 * rng.normal(size=(n, d))


def spoilt(rng, x):
    rows = [(i, v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(x)]
    rows += [(1_000 + i, v, None) for i, v in enumerate(BAD)]
    rows += [(2_000 + i, rows[0][1], 1) for i in range(40)]  # equal vectors
    rows += [(5, [9.0] * x.shape[1], 0), (5, rows[5][1], 0), (None, rows[3][1], 1), (7, rows[7][1], None), (7, rows[7][1], None)]
    rows += [(3_000, [0.5], 2), (3_100, [0.0] * x.shape[1], 2), (-100, (-x[1]).tolist(), 2)]
    return rows


@pytest.mark.parametrize("kind", ["plain", "clustered"])
def test_products_match_brute_force(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(420, 8)) if kind == "plain" else clustered(420, 8, 4)
    rows = spoilt(rng, x)
    for name, value in {"TREE_VECTORS": 60, "PAGE": 8, "FAN": 4, "QUERY_BLOCK": 3, "TOGETHER": 2}.items():
        monkeypatch.setattr(metric_tree, name, value)
    got = top_products(table(spark, rows), lambda i: i % 100 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == best_products(rows)


def test_products_of_few_and_no_rows(spark):
    assert top_products(table(spark, []), lambda i: i % 100 == 0).count() == 0
    assert top_products(table(spark, [(0, None, 1), (100, [float("nan")], 1)]), lambda i: i % 100 == 0).count() == 0
    rows = [(0, [1.0, 2.0], 1), (3, [], 1), (100, [-1.0, 0.25], 1)]
    assert sorted(map(tuple, top_products(table(spark, rows), lambda i: i % 100 == 0).collect())) == best_products(rows)


def test_products_of_large_numbers(spark):
    rows = [(i, [float(i * 2 ** 10 + 0.75), -float(i % 7)], 0) for i in range(0, 400, 25)]
    assert sorted(map(tuple, top_products(table(spark, rows), lambda i: i % 100 == 0).collect())) == best_products(rows)
    with pytest.raises(ValueError):
        top_products(table(spark, [(0, [1e300], 1)]), lambda i: i % 100 == 0)


def test_tree_pages_cover_and_save_work():
    x = np.floor(1024 * clustered(4_000, 16, 5)).astype(np.int64)
    space = Space(16, int(np.abs(x).max()), int((x ** 2).sum(axis=1).max()))
    import pandas as pd
    pages = pd.DataFrame(build_pages(space, x, [[i] for i in range(len(x))], x[0]))
    tree = Tree(space, pages)
    assert sorted(i for ids in tree.ids for i in ids) == list(range(len(x)))
    assert (pages["leaf"].sum() > 30) and max(len(i) for i in tree.ids) <= metric_tree.PAGE
    up = space.lifted(x)
    for p in range(len(pages)):  # a page covers its vectors and its children's
        below = tree.ids[p]
        if len(below):
            assert space.between(up[below], tree.centres[p: p + 1]).max() <= tree.radius[p] + space.slack
    q = x[::100]
    scores, ids, taken = tree.search(space.rows(space.pack(q)), np.arange(0, 4_000, 100), np.full(len(q), metric_tree._FEW), 10)
    full = q @ x.T
    full[np.arange(len(q)), np.arange(0, 4_000, 100)] = -(1 << 60)
    assert (scores == -np.sort(-full, axis=1)[:, :10]).all()
    assert taken < 0.4 * full.size  # most products are avoided where vectors have clusters


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1_000_000), st.integers(1, 64), st.integers(1, 6), st.sampled_from([2, 30, 10_000]))
def test_orchard_finds_the_first_nearest_entry(seed, entries, width, size):
    rng = np.random.default_rng(seed)
    book = rng.integers(-size, size, (entries, width))  # small sizes have equal entries and many ties
    x = rng.integers(-size, size, (50, width))
    far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    at, near, taken = Orchard(book).search(x)
    assert (at == far.argmin(axis=1)).all() and (near == far.min(axis=1)).all()
    assert taken <= 50 * entries


def test_orchard_saves_distances():
    rng = np.random.default_rng(1)
    book, x = rng.normal(0, 1000, (64, 4)).astype(np.int64), rng.normal(0, 1000, (2_000, 4)).astype(np.int64)
    assert Orchard(book).search(x)[2] < 0.5 * x.shape[0] * 64


def codes_by_hand(rows, parts, entries, rounds, scale=256):
    kept = [(i, [int(np.floor(scale * c)) for c in v], lab) for i, v, lab in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(1, -(-max((len(z) for _, z, _ in kept), default=1) // parts))
    kept = [(i, z + [0] * (parts * width - len(z)), lab) for i, z, lab in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))[:entries]
    cut = lambda z, p: z[p * width: (p + 1) * width]
    books = [[cut(z, p) for _, z, _ in first] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), n) for n, e in enumerate(book))
    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            own = [[] for _ in book]
            for _, z, _ in kept:
                own[nearest(cut(z, p), book)[1]].append(cut(z, p))
            new.append([[sum(c) // len(vs) for c in zip(*vs)] if vs else e for vs, e in zip(own, book)])
        books = new
    out = []
    for i, z, lab in kept:
        found = [nearest(cut(z, p), books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found)))
    return out, books


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("parts,entries", [(4, 16), (3, 500)])
def test_codes_match_brute_force(spark, parts, entries):
    rng = np.random.default_rng(6)
    rows = spoilt(rng, rng.normal(size=(200, 8)))
    entries = min(entries, 256)
    got, books = compress_vectors(table(spark, rows), parts=parts, entries=entries, others=["label"])
    want, expected = codes_by_hand(rows, parts, entries, 2)
    assert books.tolist() == expected
    assert ordered(map(tuple, got.collect())) == ordered(want)
    total = with_group_total(got, "label", "error", "label_error")
    sums = {}
    for _, lab, _, error in want:
        sums[lab] = sums.get(lab, 0) + error
    assert ordered(map(tuple, total.collect())) == ordered(w + (sums[w[1]],) for w in want)


def test_group_totals_of_hot_and_rare_groups(spark, monkeypatch):
    monkeypatch.setattr(orchard, "HOT_LABELS", 4)
    rows = [(None, 1)] * 30 + [(1, 2)] * 20 + [(i, i) for i in range(2, 20)]
    got = with_group_total(spark.createDataFrame(rows, "g int, v long"), "g", "v", "t")
    assert ordered(map(tuple, got.collect())) == ordered((g, v, 30 if g is None else 40 if g == 1 else g) for g, v in rows)


def test_codes_of_no_rows(spark):
    got, books = compress_vectors(table(spark, [(1, None, 1), (2, [float("inf")], 1)]))
    assert got.count() == 0 and got.columns == ["vec_id", "code", "error"] and books.size == 0
    got, books = compress_vectors(table(spark, [(1, [], 1)]), parts=2)
    assert [tuple(r) for r in got.collect()] == [(1, "0000", 0)] and books.tolist() == [[[0]], [[0]]]


def test_registered_codes_hash_their_books(spark):
    sf = "/root/testdata/sf0.001"
    row = orchard.op13_codes(spark, sf).first()
    _, books = compress_vectors(spark.read.parquet(sf + "/embeddings.parquet"))
    assert row["codebooks_sha256"] == hashlib.sha256(",".join(str(c) for b in books.tolist() for e in b for c in e).encode()).hexdigest()
