"""Data-quality and profiling operators (Q1-Q23).

Each check is one aggregation over the table (several columns at once) whose
small result is reshaped into rows with ``explode`` of an array of structs.
Quantile-based profiles use the exact two-pass quantiles from
``functions.stats``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions.stats import quantile_dict, quantiles
from ..functions.text import name_prefix


def _stack(row_exprs: list[Column]) -> Column:
    return F.explode(F.array(*row_exprs))


def table_info(df: DataFrame) -> DataFrame:
    """Q1: column, type, non-NULL count and table row count."""
    agg = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count(F.col(f"`{c}`")).alias(f"nn_{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                     F.lit(f.dataType.simpleString()).alias("data_type"),
                     F.col(f"nn_{i}").alias("non_null_count"), F.col("__rows").alias("row_count"))
            for i, f in enumerate(df.schema.fields)]
    return agg.select(_stack(rows).alias("r")).select("r.*")


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in exclude]


def describe_numeric(df: DataFrame, columns=None) -> DataFrame:
    """Q2: count, mean, sample std, min, exact 25/50/75 % (linear), max per column."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    agg = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"),
        F.min(F.col(c).cast("double")).alias(f"lo{i}"), F.max(F.col(c).cast("double")).alias(f"hi{i}"))]).first()
    q = quantile_dict(df, cols, [0.25, 0.5, 0.75])
    rows = [(c, agg[f"n{i}"], agg[f"m{i}"], agg[f"s{i}"], agg[f"lo{i}"], q.get((c, 0.25)), q.get((c, 0.5)),
             q.get((c, 0.75)), agg[f"hi{i}"]) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "column string, count long, mean double, std double, min double, p25 double, p50 double, "
              "p75 double, max double")


def describe_text(df: DataFrame, columns=None) -> DataFrame:
    """Q3: count, unique, top (most frequent; ties -> smallest value), freq per text column."""
    cols = list(columns) if columns is not None else string_columns(df)
    kv = _stack([F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    counts = (df.select(kv.alias("kv")).select("kv.*").where(F.col("value").isNotNull())
                .groupBy("column", "value").agg(F.count("*").alias("n")))
    return counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.count("*").alias("unique"),
        F.min(F.struct((-F.col("n")).alias("k"), F.col("value").alias("v"))).alias("t")).select(
        "column", "count", "unique", F.col("t.v").alias("top"), (-F.col("t.k")).alias("freq"))


def key_integrity(df: DataFrame, id_col: str) -> DataFrame:
    """Q4: repeated ids (all but the first), distinct ids counting NULL, uniqueness; also whole-row repeats."""
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("nd"),
                 F.max(F.col(id_col).isNull().cast("long")).alias("nul"))
    whole = df.groupBy(*df.columns).agg(F.count("*").alias("c")).agg(
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("row_repeats"))
    dup = F.col("n") - F.col("nd") - F.coalesce(F.col("nul"), F.lit(0))
    checks = agg.select(_stack([
        F.struct(F.lit(f"duplicated {id_col} count").alias("check"), dup.cast("string").alias("value")),
        F.struct(F.lit(f"unique {id_col} count").alias("check"),
                 (F.col("nd") + F.coalesce(F.col("nul"), F.lit(0))).cast("string").alias("value")),
        F.struct(F.lit(f"{id_col} is unique").alias("check"), (dup == 0).cast("string").alias("value")),
    ]).alias("r")).select("r.*")
    rows = whole.select(F.lit("duplicated row count").alias("check"), F.col("row_repeats").cast("string").alias("value"))
    return checks.unionByName(rows)


def missing_summary(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """Q5: NULL count and percentage per column, highest first."""
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    out = agg.select(_stack([F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count"),
                                      (F.col(f"m{i}") * 100.0 / F.col("__n")).alias("missing_percentage"))
                             for i, c in enumerate(df.columns)]).alias("r")).select("r.*")
    if only_missing:
        out = out.where(F.col("missing_count") > 0)
    return out


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Q6: frequency per value including NULL, most frequent first (ties: value ascending)."""
    out = df.groupBy(column).agg(F.count("*").alias("count"))
    if n is not None:
        # top-n: per-partition top-n, then a merge of n rows (no single-partition window)
        out = out.orderBy(F.desc("count"), F.asc_nulls_first(column)).limit(n)
    return out


def name_prefix_counts(df: DataFrame, name_col: str = "customer_name") -> DataFrame:
    """Q7."""
    return df.groupBy(name_prefix(name_col).alias("prefix")).agg(F.count("*").alias("count"))


def presence_counts(df: DataFrame, column: str, present_value=1.0) -> DataFrame:
    """Q8: "Present" when the value equals ``present_value``, else "Missing"."""
    status = F.when(F.col(column) == F.lit(present_value), "Present").otherwise("Missing")
    return df.groupBy(status.alias("status")).agg(F.count("*").alias("count"))


def rule_violations(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Q9: number of rows breaking each rule; a NULL never breaks a rule."""
    agg = df.agg(*[F.count_if(pred).alias(f"v{i}") for i, (_, pred) in enumerate(rules)])
    return agg.select(_stack([F.struct(F.lit(name).alias("check"), F.col(f"v{i}").alias("count"))
                              for i, (name, _) in enumerate(rules)]).alias("r")).select("r.*")


def negative_value_counts(df: DataFrame, columns) -> DataFrame:
    """Q10: columns with negative values and how many, most first."""
    rules = [(c, F.col(c) < 0) for c in columns]
    return rule_violations(df, rules).withColumnRenamed("check", "column") \
        .withColumnRenamed("count", "negative_count").where(F.col("negative_count") > 0)


def id_relationship(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Q11: distinct ids left/right/both/only-left/only-right and the subset test (one job)."""
    lids = left.select(F.col(left_id).alias("id")).where(F.col("id").isNotNull()).distinct() \
        .withColumn("in_left", F.lit(1))
    rids = right.select(F.col(right_id).alias("id")).where(F.col("id").isNotNull()).distinct() \
        .withColumn("in_right", F.lit(1))
    j = lids.join(rids, "id", "full_outer")
    agg = j.agg(F.count("in_left").alias("l"), F.count("in_right").alias("r"),
                F.count_if(F.col("in_left").isNotNull() & F.col("in_right").isNotNull()).alias("b"),
                F.count_if(F.col("in_right").isNull()).alias("lo"),
                F.count_if(F.col("in_left").isNull()).alias("ro"))
    return agg.select(_stack([
        F.struct(F.lit("left ids").alias("check"), F.col("l").cast("string").alias("value")),
        F.struct(F.lit("right ids").alias("check"), F.col("r").cast("string").alias("value")),
        F.struct(F.lit("ids in both").alias("check"), F.col("b").cast("string").alias("value")),
        F.struct(F.lit("left only").alias("check"), F.col("lo").cast("string").alias("value")),
        F.struct(F.lit("right only").alias("check"), F.col("ro").cast("string").alias("value")),
        F.struct(F.lit("right is subset of left").alias("check"), (F.col("ro") == 0).cast("string").alias("value")),
    ]).alias("x")).select("x.*")


def coverage(base: DataFrame, other: DataFrame, base_id: str, other_id: str,
             labels=("with counterpart", "without counterpart")) -> DataFrame:
    """Q12: base rows with / without a counterpart: count and percentage."""
    ids = other.select(F.col(other_id).alias("__id")).where(F.col("__id").isNotNull()).distinct() \
        .withColumn("__hit", F.lit(True))
    j = base.select(base_id).join(ids, base[base_id] == ids["__id"], "left")
    agg = j.agg(F.count(F.lit(1)).alias("n"), F.count("__hit").alias("w"))
    return agg.select(_stack([
        F.struct(F.lit(labels[0]).alias("group"), F.col("w").alias("count"),
                 (F.col("w") * 100.0 / F.col("n")).alias("percentage")),
        F.struct(F.lit(labels[1]).alias("group"), (F.col("n") - F.col("w")).alias("count"),
                 ((F.col("n") - F.col("w")) * 100.0 / F.col("n")).alias("percentage")),
    ]).alias("r")).select("r.*")


def tenure_checks(features: DataFrame, ref_year: float) -> DataFrame:
    """Q13: reference year, and min / max / mean / negative count of tenure and age."""
    agg = features.agg(
        F.min("customer_tenure").alias("a"), F.max("customer_tenure").alias("b"),
        F.avg("customer_tenure").alias("c"), F.count_if(F.col("customer_tenure") < 0).alias("d"),
        F.min("age").alias("e"), F.max("age").alias("f"), F.avg("age").alias("g"),
        F.count_if(F.col("age") < 0).alias("h"))
    names = [("reference year", F.lit(ref_year)), ("min tenure", F.col("a")), ("max tenure", F.col("b")),
             ("mean tenure", F.col("c")), ("negative tenure", F.col("d")), ("min age", F.col("e")),
             ("max age", F.col("f")), ("mean age", F.col("g")), ("negative age", F.col("h"))]
    return agg.select(_stack([F.struct(F.lit(n).alias("check"), v.cast("double").alias("value"))
                              for n, v in names]).alias("r")).select("r.*")


def quantile_table(df: DataFrame, columns, probs=(0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """Q14: exact linear quantiles, one row per column."""
    cols, probs = list(columns), list(probs)
    q = quantile_dict(df, cols, probs)
    names = [f"p{int(round(p * 100))}" for p in probs]
    rows = [(c, *[q.get((c, p)) for p in probs]) for c in cols]
    return df.sparkSession.createDataFrame(rows, "column string, " + ", ".join(f"{n} double" for n in names))


def correlation_lower(df: DataFrame, columns) -> DataFrame:
    """Q15: Pearson correlation below the diagonal, NULLs dropped per pair (one aggregation)."""
    cols = list(columns)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[:i]]

    def both(x, y):
        return F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(x).cast("double"))
    agg = df.agg(*[F.corr(both(a, b), both(b, a)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return agg.select(_stack([F.struct(F.lit(a).alias("row_column"), F.lit(b).alias("col_column"),
                                       F.col(f"c{i}").alias("correlation"))
                              for i, (a, b) in enumerate(pairs)]).alias("r")).select("r.*")


def category_spend(features: DataFrame, share_cols, total_col: str = "total_lifetime_spend",
                   prefix: str = "share_") -> DataFrame:
    """Q16: mean implied spend (share x total) and mean share per category."""
    agg = features.agg(*[e for i, s in enumerate(share_cols) for e in (
        F.avg(F.col(s) * F.col(total_col)).alias(f"s{i}"), F.avg(s).alias(f"m{i}"))])
    return agg.select(_stack([F.struct(F.lit(s[len(prefix):]).alias("category"),
                                       F.col(f"s{i}").alias("mean_spend"), F.col(f"m{i}").alias("mean_share"))
                              for i, s in enumerate(share_cols)]).alias("r")).select("r.*")


def group_median(df: DataFrame, value: str, group: str) -> DataFrame:
    """Q17: exact median per group."""
    res = quantiles(df, [value], [0.5], [group])
    rows = [(o[group], o["value"]) for o in res]
    return df.sparkSession.createDataFrame(
        rows, f"`{group}` {df.schema[group].dataType.simpleString()}, median_{value} double")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Q18: equal-width bins over [min, max]; the last edge is inclusive."""
    mm = df.agg(F.min(F.col(column).cast("double")).alias("mn"), F.max(F.col(column).cast("double")).alias("mx")).first()
    mn, mx = mm["mn"], mm["mx"]
    if mn is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, count long")
    width = (mx - mn) if mx > mn else 1.0
    x = F.col(column).cast("double")
    b = F.least(F.floor((x - F.lit(mn)) / F.lit(width) * F.lit(bins)), F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("count"))
    return counts.select("bin", (F.lit(mn) + F.col("bin") * F.lit(width / bins)).alias("lower"),
                         (F.lit(mn) + (F.col("bin") + 1) * F.lit(width / bins)).alias("upper"), "count")


def integer_histogram(df: DataFrame, column: str) -> DataFrame:
    """Q18 (count data): one bin per integer value, ``bin`` = floor(value)."""
    x = F.col(column).cast("double")
    return df.where(x.isNotNull()).groupBy(F.floor(x).alias("bin")).agg(F.count("*").alias("count"))


def box_stats(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """Q19: quartiles, 1.5·IQR whiskers (most extreme values inside the fences), outliers.

    With ``group``, quartiles are computed per group (exact two-pass) and the
    per-group fences are joined back as a small broadcast table.
    """
    x = F.col(column).cast("double")
    if group is None:
        q = quantile_dict(df, [column], [0.25, 0.5, 0.75])
        q1, q2, q3 = q[(column, 0.25)], q[(column, 0.5)], q[(column, 0.75)]
        iqr = q3 - q1
        lo_f, hi_f = q1 - 1.5 * iqr, q3 + 1.5 * iqr
        return df.agg(
            F.lit(column).alias("column"), F.lit(q1).alias("q1"), F.lit(q2).alias("median"), F.lit(q3).alias("q3"),
            F.lit(iqr).alias("iqr"), F.min(F.when(x >= lo_f, x)).alias("lower_whisker"),
            F.max(F.when(x <= hi_f, x)).alias("upper_whisker"),
            F.count_if((x < lo_f) | (x > hi_f)).alias("outliers"))
    res = quantiles(df, [column], [0.25, 0.5, 0.75], [group])
    table: dict = {}
    for o in res:
        table.setdefault(o[group], {})[o["p"]] = o["value"]
    rows = [(g, v[0.25], v[0.5], v[0.75]) for g, v in table.items()]
    gtype = df.schema[group].dataType.simpleString()
    fences = df.sparkSession.createDataFrame(rows, f"`{group}` {gtype}, q1 double, median double, q3 double") \
        .withColumn("iqr", F.col("q3") - F.col("q1"))
    j = df.join(F.broadcast(fences), group)  # one row per group
    lo_f = F.col("q1") - 1.5 * F.col("iqr")
    hi_f = F.col("q3") + 1.5 * F.col("iqr")
    return j.groupBy(group, "q1", "median", "q3", "iqr").agg(
        F.min(F.when(x >= lo_f, x)).alias("lower_whisker"), F.max(F.when(x <= hi_f, x)).alias("upper_whisker"),
        F.count_if((x < lo_f) | (x > hi_f)).alias("outliers"))


def capped(df: DataFrame, column: str, p: float = 0.99, keep=("customer_id",)) -> DataFrame:
    """Q20: value capped at its p-quantile (display only)."""
    cap = quantile_dict(df, [column], [p])[(column, p)]
    return df.select(*keep, F.least(F.col(column).cast("double"), F.lit(cap)).alias(f"{column}_capped"))


def top_counts(df: DataFrame, key: str, n: int = 10, name: str = "count") -> DataFrame:
    """Q21/Q22: rows per key, top ``n`` (ties: key ascending)."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))
    return counts.orderBy(F.desc(name), F.asc(key)).limit(n)


def checks_table(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Q23: (check, value-as-text) rows from one aggregation."""
    agg = df.agg(*[e.alias(f"k{i}") for i, (_, e) in enumerate(checks)])
    return agg.select(_stack([F.struct(F.lit(n).alias("check"), F.col(f"k{i}").cast("string").alias("value"))
                              for i, (n, _) in enumerate(checks)]).alias("r")).select("r.*")
