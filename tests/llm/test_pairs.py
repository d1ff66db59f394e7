"""Jaccard components, nearest neighbours and version fingerprints against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from shopgroups.llm import jaccard, vectors, versions
from shopgroups.llm.components import components
from shopgroups.llm.common import work_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, n=4):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def brute_components(rows, percent=85, n=4):
    """(id, set size, smallest id reachable) of every row."""
    sets = [grams(t, n) for _, t, _ in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = defaultdict(list)
    for r, (i, _, _) in zip(root, rows):
        least[r].append(i)
    return sorted(((i, len(s), min((x for x in least[r] if x is not None), default=None)) for r, (i, _, _), s in zip(root, rows, sets)), key=str)


def near_copies(seed, groups=12, copies=9, words=60):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(3, words * 3))]
        for _ in range(rng.randrange(1, copies)):
            text = list(base)
            for _ in range(rng.randrange(0, 3)):
                text[rng.randrange(len(text))] = f"n{rng.randrange(4000)}"
            rows.append((i, " ".join(text), "s"))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [{}, {"unit_sets": 4, "unit_hashes": 300}])
def test_components_match_all_pairs(spark, table, limits):
    rows = near_copies(3) + [(900, None, "s"), (901, "", "s"), (902, " \t\n", "s"), (903, "One two", "s"), (904, "one  TWO\n", "s"), (905, "two one", "s")]
    got = jaccard.jaccard_components(table(rows), **limits).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_components_with_repeated_and_null_ids(spark, table):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(5, "a b c d e f", "s"), (5, "a b c d e f", "s"), (3, "a B c d E f", "s"), (None, "a b c d e f", "s"), (5, "z y x w v u t", "s"),
            (7, long, "s"), (8, long + " more", "s"), (None, "only this text", "s"), (None, None, None)]
    got = sorted(map(tuple, jaccard.jaccard_components(table(rows)).collect()), key=str)
    # rows with null ids that link with nothing keep a null component
    assert got == sorted([(5, 3, 3), (5, 3, 3), (3, 3, 3), (None, 3, 3), (5, 4, 5), (7, 29997, 7), (8, 29998, 7), (None, 1, None), (None, 0, None)], key=str)
    assert jaccard.jaccard_components(table([])).count() == 0


def test_words_bound_the_difference():
    """Fewer words differ than tokens, and sets that link share a word, whatever their sizes."""
    rng, bands = np.random.default_rng(5), jaccard.Bands(85)
    for _ in range(200):
        n = int(rng.integers(1, 300))
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2654435761))
        most = max(d for d in range(n + 1) if 100 * (len(base) - d) >= 85 * len(base))
        other = np.delete(base, rng.choice(len(base), most, replace=False))
        (a, in_a, need_a), (b, in_b, need_b) = jaccard.parity_words(base, bands), jaccard.parity_words(other, bands)
        band = bands.of(len(base))  # the larger set's
        shared = sum(x & 63 == band for x in set(a.tolist()) & set(b.tolist()))
        assert shared >= max(dict(zip(in_a, need_a))[band], dict(zip(in_b, need_b))[band])


def test_keep_one(spark, table):
    rows = near_copies(4, groups=5) + [(2000, "a b c d e f g", "s"), (2000, "a b c d e f g", "s"), (None, "a b c d e f g", "s"), (2001, None, "s"), (2002, "", "s")]
    kept = jaccard.keep_one(table(rows), n=5, percent=80)
    want = {(i if c is not None else None) for i, _, c in brute_components(rows, 80, 5) if i == c}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want | {2000, 2001, 2002})
    assert kept.columns == table([]).columns and jaccard.keep_one(table([])).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), work_folder(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_components_with_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr("shopgroups.llm.components.HOT_ROWS", 2)
    rng = random.Random(5)
    edges = [(500, i) for i in range(0, 60, 2)] + [(1, i) for i in range(61, 90)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    root = {n: n for e in edges for n in e}
    for a, b in edges:
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = {n: new if r == old else r for n, r in root.items()}
    alone = {n for n in root if all(a == b for a, b in edges if n in (a, b))}
    got = components(spark.createDataFrame(edges, "a long, b long"), work_folder(spark, "t"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((n, r) for n, r in root.items() if n not in alone)


def test_neighbours_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 4
    x = centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16))
    x[50:120] = x[50]  # one hot vector
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = defaultdict(list)
    for r in vectors.nearest_neighbours(df, lambda i: i % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 3000, 50):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        far[q] = np.inf
        want = np.lexsort((np.arange(3000), far))[:10]
        hits += len({v for _, v, _ in got[q]} & set(want.tolist()))
        assert [r for r, _, _ in got[q]] == list(range(1, 11)) and all(abs(s - far[v]) < 1e-12 for _, v, s in got[q])
    assert hits / 600 >= 0.95
    assert [v for _, v, _ in got[50]] == list(range(51, 61))  # ties to the smaller id


def test_neighbours_by_small_blocks_of_vectors_and_queries(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, (900, 3)).astype(float) + 1  # many ties and equal vectors
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = sorted(vectors.nearest_neighbours(df, lambda i: i % 4 == 0).collect())
    assert len(whole) == 225 * 10
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    assert sorted(vectors.nearest_neighbours(df, lambda i: i % 4 == 0).collect()) == whole
    for q in range(0, 900, 60):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        far[q] = np.inf
        want = np.lexsort((np.arange(900), far))[:10]
        assert [(r.vec_id, r.score) for r in whole if r.query_id == q] == [(v, far[v]) for v in want]


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e-3, 1e6), (1e200, 0.0)])
def test_preselection_keeps_the_nearest_of_a_block(scale, shift):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)) * scale + shift
    x[100:140] = x[:40]
    ids = [np.array([2 * i, 2 * i + 1]) if i % 3 else np.array([2 * i]) for i in range(300)]
    flat, owner = np.concatenate(ids), np.repeat(np.arange(300), [len(i) for i in ids])
    q = np.concatenate([x[::7], x[::7] + 0.01 * scale])
    with np.errstate(over="ignore"):
        for (query, found, scores), v in zip(vectors.nearest_of_block(x, ids, q, np.arange(len(q)) * 14, 10), q):
            far = np.sqrt(((x - v) ** 2).sum(1))[owner]
            best = [j for j in np.lexsort((flat, far)) if flat[j] != query][:10]
            assert found.tolist() == flat[best].tolist() and scores.tolist() == far[best].tolist()


def test_neighbours_of_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]),
            (7, [3.0, 2.0]), (8, [1.0]), (None, [1.0, 1.0]), (100, [1.0, 3.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in vectors.nearest_neighbours(df, lambda i: i % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 1.0), (0, 3, 7, 2.0), (100, 1, 0, 1.0), (100, 2, 1, 1.0), (100, 3, 7, 5 ** 0.5)]
    assert vectors.nearest_neighbours(df.limit(0), lambda i: i % 100 == 0).count() == 0


def test_neighbours_with_repeated_rows_and_ids(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    x[1] = x[0]
    rows = [(100 + i, v.tolist()) for i, v in enumerate(x)] * 2 + [(100, x[0].tolist())] * 11
    # ids with two vectors, and with many near the query
    rows += [(105, (x[0] + 0.01).tolist())] + [(106, (x[0] + 0.001 * j).tolist()) for j in range(1, 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, round(r.score, 9)) for r in vectors.nearest_neighbours(df, lambda i: i % 100 == 0).orderBy("rank").collect()]
    far = defaultdict(list)
    for i, v in rows:
        far[i].append(float(np.sqrt(((np.array(v) - x[0]) ** 2).sum())))
    want = sorted((min(d), i) for i, d in far.items() if i != 100)[:10]
    assert got == [(n, i, round(d, 9)) for n, (d, i) in enumerate(want, 1)] and got[0] == (1, 101, 0.0)


def test_graph_search_finds_most_of_the_nearest():
    rng = np.random.default_rng(2)
    c, q = rng.normal(size=(700, 8)), rng.normal(size=(50, 8))
    node, far = vectors.CentroidGraph(c).search(q, 20)
    exact = ((q[:, None] - c[None]) ** 2).sum(2)
    found = np.mean([len(set(np.argsort(e)[:10]) & set(n.tolist())) / 10 for e, n in zip(exact, node)])
    assert found > 0.95 and np.allclose(far, np.take_along_axis(exact, node, 1))


def brute_keys(text):
    keys, bounds = versions.paragraph_keys(pa.array([text], pa.large_string()))
    return set(keys.tolist())


def test_versions_recover_exactly_what_differs(spark, table):
    rng = random.Random(6)
    lines = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    pairs = [("", ""), (None, "one"), ("same\nsame\nsame", "same\nsame"), ("\n".join(lines), "\n".join(lines)), ("\n".join(lines), "\n".join(lines[::2])),
             ("\n".join(lines[:5]), "\n".join(lines[100:])), ("x" * 100_000, "x" * 100_000 + "\ny"), ("b\na", "a\nb")]
    df = spark.createDataFrame([(i, a, b, "x") for i, (a, b) in enumerate(pairs)], "doc_id long, old string, new string, rec_id string")
    got = {r.doc_id: r for r in versions.compare_versions(df, "doc_id", "old", "new").collect()}
    for i, (a, b) in enumerate(pairs):
        ka, kb = brute_keys(a or ""), brute_keys(b or "")
        as_unsigned = lambda v: {x % 2**64 for x in v}
        assert as_unsigned(got[i].removed) == ka - kb and as_unsigned(got[i].added) == kb - ka
        assert got[i].likeness == ((len(ka) + len(kb) - len(ka ^ kb)) / (len(ka) + len(kb)) if ka or kb else 1.0)
        assert (got[i].old_fingerprint == got[i].new_fingerprint) == (ka == kb)


def test_equal_keys_of_one_text_end_the_search(monkeypatch):
    """Two pieces whose keys agree cancel in every sketch; two whose digests agree in 48 bits are repeats."""
    key = versions.checked(np.array([0x1234567890AB0000], np.uint64))[0]
    others = versions.checked(np.arange(1, 6, dtype=np.uint64) << np.uint64(20))
    old, new = np.concatenate([[key, key], others]), others[:3]
    owner, found, sign = versions.differences(old, np.array([0, 7]), new, np.array([0, 3]))
    assert sorted(found.tolist()) == sorted([int(key)] * 2 + others[3:].tolist()) and (sign == 1).all() and (owner == 0).all()
    monkeypatch.setattr(versions, "span_hashes", lambda flat, at, size: np.uint64(0xABCDEF0000000000) + np.arange(len(at), dtype=np.uint64))
    keys, bounds = versions.paragraph_keys(pa.array(["a\nb\nc"], pa.large_string()))
    assert len(set(keys.tolist())) == 3 and bounds.tolist() == [0, 3]


def test_chained_versions(spark, table):
    rows = [(7, "last text here", "s"), (1, "first " * 40, "s"), (2, None, "s"), (3, "été " * 2000, "s"), (4, "z", "s"), (5, "w" * 50_000, "s")]
    got = {r.doc_id: r for r in versions.chain_versions(table(rows)).collect()}
    rows = sorted((i, t or "") for i, t, _ in rows)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, e, f = brute_keys(t), brute_keys(edited), brute_keys(after)
        for near, other in ((got[i].near_edited, e), (got[i].near_next, f)):
            assert near == pytest.approx((len(a) + len(other) - len(a ^ other)) / (len(a) + len(other)) if a or other else 1.0)
    assert versions.chain_versions(table([])).count() == 0
    assert [(r.doc_id, r.near_next) for r in versions.chain_versions(table([(None, "one", "s")])).collect()] == [(None, 1.0)]
    assert versions.chain_versions(table([(1, "a b", "s"), (1, "a b", "s"), (1, "c", "s")])).count() == 3


def test_texts_outside_clusters_are_not_shuffled(spark, monkeypatch):
    """More sets than the broadcast of their units takes: hashes of their ids keep the other texts out of the join."""
    from shopgroups.llm import jaccard as J
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " more") for i, t in enumerate(texts[:6])] + [(200, None), (201, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, J.jaccard_components(df).collect()))
    plans = {}

    def recorded(table, folder, name, stored=J.stored):
        plans[name] = table._jdf.queryExecution().optimizedPlan().toString()
        return stored(table, folder, name)

    monkeypatch.setattr(J, "BROADCAST_SETS", 0)
    monkeypatch.setattr(J, "stored", recorded)
    assert sorted(map(tuple, J.jaccard_components(df).collect())) == plain
    assert {r[2] for r in plain if r[0] >= 100 and r[0] < 200} == set(range(6))
    assert "LeftSemi" in plans["links"]
    monkeypatch.setattr(J, "BROADCAST_HASHES", 0)
    assert sorted(map(tuple, J.jaccard_components(df).collect())) == plain
    assert "LeftSemi" not in plans["links"]


def test_copies_share_no_words_and_leave_no_words_on_disk(spark, monkeypatch):
    """Copies of a text in many tasks are one set: their words are not written as shared ones, and all words are deleted."""
    import os

    from shopgroups.llm import jaccard as J
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(5)]
    rows = [(10 * c + i, t) for c in range(6) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(6, "doc_id")
    counts, folders = {}, set()

    def recorded(table, folder, name, stored=J.stored):
        found = stored(table, folder, name)
        counts[name] = found.count()
        folders.add(folder)
        return found

    monkeypatch.setattr(J, "stored", recorded)
    got = {r.doc_id: r.component_id for r in J.jaccard_components(df).collect()}
    assert got == {i: i % 10 for i, _ in rows}
    assert counts["shared"] == 0
    left = {name for folder in folders for name in os.listdir(folder.removeprefix("file:"))}
    assert "slim" in left and not left & {"sets", "shared", "members"}
