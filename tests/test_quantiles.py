import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shopgroups.functions.stats import quantiles


def _np_quantile(values, p):
    return float(np.quantile(np.array(values, dtype=float), p)) if values else None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50), st.floats(-1e6, 1e6, allow_nan=False)),
                min_size=0, max_size=60),
       st.integers(1, 4))
def test_exact_quantiles_match_numpy(spark, values, groups):
    rows = [(i % groups, None if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g int, v double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    res = quantiles(df, ["v"], probs, ["g"], accuracy=20)  # tiny accuracy forces the bracket path
    got = {(o["g"], o["p"]): o["value"] for o in res}
    for g in range(groups):
        vals = [v for gg, v in rows if gg == g and v is not None]
        for p in probs:
            want = _np_quantile(vals, p)
            if want is None:
                assert got.get((g, p)) is None
            else:
                assert got[(g, p)] == pytest.approx(want, rel=1e-12, abs=1e-9)


def test_large_column_uses_bracket(spark):
    rng = np.random.default_rng(0)
    vals = rng.lognormal(size=20_000)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    res = quantiles(df, ["v"], [0.25, 0.5, 0.99], accuracy=1000)
    for o in res:
        assert o["value"] == pytest.approx(float(np.quantile(vals, o["p"])), rel=1e-12)


def test_radix_selection_over_odd_columns_and_groups(spark, monkeypatch):
    """Ties, signs, infinities, zeros of both signs, values that differ in the last bit, null groups; small digits."""
    from shopgroups.functions import stats as S
    monkeypatch.setattr(S, "DIGIT_BITS", 5)
    rng = np.random.default_rng(3)
    near = np.nextafter(1.0, 2.0)
    cols = {"a": rng.normal(size=300), "b": rng.choice([0.0, -0.0, 1.0, near, -1.0, -near], 300), "c": np.full(300, 7.5),
            "d": np.where(rng.random(300) < 0.1, np.inf, rng.lognormal(0, 200, 300)), "e": -rng.lognormal(0, 5, 300)}
    group = rng.integers(0, 3, 300)
    rows = [(None if g == 2 else int(g), "x" if g else None, *[None if rng.random() < 0.05 else float(v[i]) for v in cols.values()], None) for i, g in enumerate(group)]
    df = spark.createDataFrame(rows, "g int, h string, " + ", ".join(f"{c} double" for c in cols) + ", nothing double").repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    for keys in ([], ["g"], ["g", "h"]):
        got = {tuple(o[k] for k in keys) + (o["column"], o["p"]): o["value"] for o in quantiles(df, [*cols, "nothing"], probs, keys)}
        for key in {tuple({"g": r[0], "h": r[1]}[k] for k in keys) for r in rows}:
            for i, c in enumerate(cols):
                vals = sorted(r[2 + i] for r in rows if tuple({"g": r[0], "h": r[1]}[k] for k in keys) == key and r[2 + i] is not None)
                for p in probs:
                    h = p * (len(vals) - 1)
                    low, high = vals[int(np.floor(h))], vals[int(np.ceil(h))]
                    want = low if low == high else low + (h - np.floor(h)) * (high - low)
                    assert got[(*key, c, p)] == want
    assert [o["value"] for o in quantiles(df, ["nothing"], [0.5])] == [None]
    assert quantiles(df.limit(0), ["a"], [0.5], ["g"]) == [] and quantiles(df.limit(0), ["a"], [0.5])[0]["value"] is None


def test_keys_sort_like_their_numbers():
    from shopgroups.functions.stats import of_key, sort_keys
    x = np.array([-np.inf, -1e300, -1.5, -5e-324, 0.0, 5e-324, 1.0, np.nextafter(1.0, 2), 1e300, np.inf])
    assert (np.diff(sort_keys(x).astype(object)) > 0).all() and [of_key(int(k)) for k in sort_keys(x)] == x.tolist()
    assert sort_keys(np.array([-0.0]))[0] == sort_keys(np.array([0.0]))[0]
