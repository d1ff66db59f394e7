"""Exact quantiles that scale.

Spark's ``percentile`` is exact but keeps a value->count map per group in a
single final task: fine for a small value domain (basket sizes), not for a
continuous column with billions of distinct values. ``quantiles`` below selects
order statistics by radix counting instead:

1. the columns are packed once into cached matrix blocks; a double's bits, turned
   so that they sort like the numbers, are its key;
2. a pass counts, for every order statistic still wanted, how many keys have each
   next digit after the key's known beginning, with the least and the largest key
   of each; per task that is a short list, and lists are added up by a fold;
3. the digit that holds the rank is known then. Once it holds one value, or the
   rank is its first or last, the value is known too; else the next digit is counted.

Every pass serves all columns, groups and ranks together; 64 bits end it after six
passes of 11 bits, two or three are usual. No value is exploded, sorted or sent to
one task. Two order statistics are interpolated (pandas / numpy ``linear``, same as
DuckDB ``quantile_cont`` and Spark ``percentile``).
Results are small (groups x columns x probabilities) and returned to the
caller as rows; the data itself never leaves the executors.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import PackedRows

DEFAULT_ACCURACY = 10_000  # of the sketches of ``approx``

#: Bits of a digit, at most, and counts that a pass may have for all order statistics together, about.
DIGIT_BITS, PASS_COUNTS = 11, 1 << 23
_TOP = np.uint64(1 << 63)


def _long(df: DataFrame, cols, group_cols) -> DataFrame:
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
                             for c in cols]))
    return (df.select(*group_cols, kv.alias("kv"))
              .select(*group_cols, "kv.column", "kv.v")
              .where(F.col("v").isNotNull() & ~F.isnan("v")))


def sort_keys(x: np.ndarray) -> np.ndarray:
    """Unsigned integers that sort like the doubles."""
    u = np.ascontiguousarray(x + 0.0).view(np.uint64)  # one zero
    return np.where(u & _TOP, ~u, u | _TOP)


def of_key(key: int) -> float:
    u = np.uint64(key)
    return float(np.array([u & ~_TOP if u & _TOP else ~u]).view(np.float64)[0])


def _tallied(codes: np.ndarray, counts: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple:
    """One entry per code: sum of counts, least and largest key."""
    order = np.argsort(codes, kind="stable")
    codes, counts, least, most = codes[order], counts[order], least[order], most[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    if not len(first):
        return codes, counts, least, most
    return codes[first], np.add.reduceat(counts, first), np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)


def _both(a: tuple, b: tuple) -> tuple:
    return _tallied(*[np.concatenate(pair) for pair in zip(a, b)])


_EMPTY = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _digit_counts(packed: PackedRows, width: int, groups: int, cells: list, known: int, bits: int) -> tuple:
    """Counts by next digit of the keys in ``cells``, pairs of (column and group, key's first ``known`` bits) in order.

    A cell's codes are its place times 2 ** bits plus the digit.
    """
    by_column = []  # per column: key beginnings, composites of (their place, group) that are wanted, and their cells
    for c in range(width):
        own = [(i, slot % groups, begin) for i, (slot, begin) in enumerate(cells) if slot // groups == c]
        begins = np.array(sorted({b for _, _, b in own}), dtype=np.uint64)
        place = {int(b): i for i, b in enumerate(begins)}
        both = sorted((place[b] * groups + g, i) for i, g, b in own)
        by_column.append((begins, np.array([x for x, _ in both], dtype=np.int64), np.array([i for _, i in both], dtype=np.int64)))
    down, mask = np.uint64(64 - known - bits), np.uint64((1 << bits) - 1)

    def step(blocks):
        done = _EMPTY
        for x, _ in blocks:
            group = x[:, width].astype(np.int64) if x.shape[1] > width else np.zeros(len(x), np.int64)
            for c, (begins, wanted, cell) in enumerate(by_column):
                if not len(begins):
                    continue
                rows = np.flatnonzero(~np.isnan(x[:, c]))
                key = sort_keys(x[rows, c])
                begin = key >> np.uint64(64 - known) if known else np.zeros(len(key), np.uint64)
                at = np.minimum(np.searchsorted(begins, begin), len(begins) - 1)
                composite = at * groups + group[rows]
                to = np.minimum(np.searchsorted(wanted, composite), len(wanted) - 1)
                held = (begins[at] == begin) & (wanted[to] == composite)
                key = key[held]
                codes = (cell[to[held]] << bits) + ((key >> down) & mask).astype(np.int64)
                done = _both(done, _tallied(codes, np.ones(len(key), np.int64), key, key))
        return done

    return packed.fold(step, _both)


def _selected(packed: PackedRows, width: int, groups: int, probs) -> dict:
    """{(column, group, p): value} for every column and group that has values."""
    known, cells = 0, [(s, 0) for s in range(width * groups)]
    wanted = {}  # cell: [(target, rank inside)]
    found, ranks, first = {}, {}, True
    while cells:
        bits = max(1, min(DIGIT_BITS, 64 - known, int(math.log2(max(2, PASS_COUNTS // len(cells))))))
        codes, counts, least, most = _digit_counts(packed, width, groups, cells, known, bits)
        bounds = np.searchsorted(codes, np.arange(len(cells) + 1) << bits)
        if first:  # the first pass tells how many values there are
            for i, (slot, begin) in enumerate(cells):
                n = int(counts[bounds[i]: bounds[i + 1]].sum())
                for p in probs if n else ():
                    h = p * (n - 1)
                    ranks[(slot, p)] = h
                    for j in {math.floor(h), math.ceil(h)}:
                        wanted.setdefault((slot, begin), []).append(((slot, j), j))
            first = False
        following = {}
        for i, cell in enumerate(cells):
            lo, hi = bounds[i], bounds[i + 1]
            total = np.cumsum(counts[lo:hi])
            for target, rank in wanted.get(cell, ()):
                at = int(np.searchsorted(total, rank, side="right"))
                inside = rank - (int(total[at - 1]) if at else 0)
                low, high = int(least[lo + at]), int(most[lo + at])
                if low == high or inside == 0:
                    found[target] = of_key(low)
                elif inside == int(counts[lo + at]) - 1:
                    found[target] = of_key(high)
                else:
                    digit = int(codes[lo + at]) & ((1 << bits) - 1)
                    following.setdefault((cell[0], (cell[1] << bits) | digit), []).append((target, inside))
        known, wanted, cells = known + bits, following, sorted(following)
    out = {}
    for (slot, p), h in ranks.items():
        low, high = found[(slot, math.floor(h))], found[(slot, math.ceil(h))]
        out[(slot // groups, slot % groups, p)] = low + (h - math.floor(h)) * (high - low) if high != low else low
    return out


def quantiles(df: DataFrame, cols, probs, group_cols=(), method: str = "exact",
              accuracy: int = DEFAULT_ACCURACY) -> list[dict]:
    """Quantiles of ``cols`` (NULL and NaN skipped) per group.

    Returns a list of dicts ``{**group, "column", "p", "value"}``; ``value``
    is None for an all-NULL column. ``method``: ``exact`` (radix selection, bounded
    memory), ``percentile`` (Spark exact map aggregate, small domains) or
    ``approx`` (GK sketch only, one pass).
    """
    cols, probs, g = list(cols), [float(p) for p in probs], list(group_cols)
    if not cols:
        return []
    if method == "percentile":
        return _percentile_exact(df, cols, probs, g)
    if method == "approx":
        rows = _long(df, cols, g).groupBy(*g, "column").agg(F.percentile_approx("v", probs, accuracy).alias("q")).collect()
        return _with_missing([{**{k: r[k] for k in g}, "column": r["column"], "p": p, "value": v} for r in rows for p, v in zip(probs, r["q"])],
                             df, cols, probs, g)
    groups = [()]
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], *[F.col(c).alias(f"g{i}") for i, c in enumerate(g)])
    names = [f"x{i}" for i in range(len(cols))]
    if g:
        # one row per group, as in the result
        keys = rows.select(*[f"g{i}" for i in range(len(g))]).distinct()
        groups = [tuple(r) for r in keys.collect()]
        if not groups:
            return []
        schema = ", ".join([f"k{i} {keys.schema[f'g{i}'].dataType.simpleString()}" for i in range(len(g))] + ["place double"])
        table = df.sparkSession.createDataFrame([(*k, float(n)) for n, k in enumerate(groups)], schema)
        same = [F.col(f"g{i}").eqNullSafe(F.col(f"k{i}")) for i in range(len(g))]
        rows = rows.join(table, same)
        names = [*names, "place"]
    packed = PackedRows(rows, names, deal=False)
    try:
        values = _selected(packed, len(cols), len(groups), sorted(set(probs)))
    finally:
        packed.unpersist()
    out = [{**dict(zip(g, groups[n])), "column": cols[c], "p": p, "value": values[(c, n, p)]}
           for c in range(len(cols)) for n in range(len(groups)) for p in probs if (c, n, p) in values]
    return _with_missing(out, df, cols, probs, g)


def _with_missing(out, df, cols, probs, g):
    """All-NULL columns (no stats row) get value None when there are no groups."""
    if g:
        return out
    present = {o["column"] for o in out}
    for c in cols:
        if c not in present:
            out.extend({"column": c, "p": p, "value": None} for p in probs)
    return out


def _percentile_exact(df: DataFrame, cols, probs, g) -> list[dict]:
    long = _long(df, cols, g)
    rows = long.groupBy(*g, "column").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()
    out = []
    for r in rows:
        for p, v in zip(probs, r["q"]):
            out.append({**{k: r[k] for k in g}, "column": r["column"], "p": p, "value": v})
    return _with_missing(out, df, cols, probs, g)


def quantile_dict(df: DataFrame, cols, probs, method: str = "exact",
                  accuracy: int = DEFAULT_ACCURACY) -> dict:
    """Global quantiles as ``{(column, p): value}``."""
    return {(o["column"], o["p"]): o["value"] for o in quantiles(df, cols, probs, (), method, accuracy)}
