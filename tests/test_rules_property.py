"""Pair rules vs a brute-force count, on skewed random baskets."""

from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shopgroups.operators import baskets as B

ITEMS = list("abcdefg")


def brute_rules(baskets, min_support, min_confidence, min_lift):
    """Reference semantics written out directly: per segment, distinct items per basket."""
    out = {}
    by_seg = {}
    for seg, items in baskets:
        if items:
            by_seg.setdefault(seg, []).append(sorted(set(items)))
    for seg, txs in by_seg.items():
        n = len(txs)
        ic, pc = Counter(), Counter()
        for t in txs:
            ic.update(t)
            pc.update(combinations(t, 2))
        for (a, b), c in pc.items():
            if c / n < min_support:
                continue
            for x, y in ((a, b), (b, a)):
                conf = c / ic[x]
                lift = c * n / (ic[x] * ic[y])
                if conf >= min_confidence and round(lift, 9) >= min_lift:
                    out[(seg, x, y)] = (c / n, conf, lift)
    return out


basket_st = st.lists(st.sampled_from(ITEMS), min_size=0, max_size=6)


@settings(max_examples=12, deadline=None)
@given(st.lists(basket_st, min_size=1, max_size=40), st.lists(basket_st, min_size=1, max_size=15),
       st.sampled_from([0.0, 0.05, 0.2]), st.sampled_from([0.0, 0.3]), st.sampled_from([0.0, 1.0, 1.3]))
def test_rules_match_brute_force_under_skew(spark, hot, cold, s, c, lift):
    # the hot segment carries most baskets; items repeat inside baskets; empty baskets exist
    baskets = [("hot", b) for b in hot] + [(f"seg{i % 3}", b) for i, b in enumerate(cold)]
    rows = [(i, seg, item) for i, (seg, items) in enumerate(baskets) for item in items]
    if not rows:
        return
    lines = spark.createDataFrame(rows, "invoice_id long, cluster string, product string")
    got = {(r.cluster, r.antecedents, r.consequents): (r.support, r.confidence, r.lift)
           for r in B.mine_pair_rules(lines, ("cluster",), min_support=s, min_confidence=c, min_lift=lift).collect()}
    want = brute_rules(baskets, s, c, lift)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12)


def test_pair_counts_combine_map_side(spark):
    lines = spark.createDataFrame([(i // 3, "s", ITEMS[i % 5]) for i in range(300)],
                                  "invoice_id long, cluster string, product string")
    plan = B.mine_pair_rules(lines, ("cluster",), min_support=0.0, min_confidence=0.0, min_lift=0.0)._jdf.queryExecution().executedPlan().toString()
    # every aggregation is planned as partial -> exchange -> final (no raw-row shuffle for counting)
    assert "partial_count" in plan
    assert "partial_collect_set" in plan


def test_top_n_cut_is_a_window_group_limit(spark):
    lines = spark.createDataFrame([(i // 3, f"s{i % 2}", ITEMS[i % 5]) for i in range(300)],
                                  "invoice_id long, cluster string, product string")
    ranked = B.cluster_association_rules(lines, min_support=0.0, min_confidence=0.0, min_lift=0.0, top_n=3)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
