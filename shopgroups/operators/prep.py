"""Cleaning, selection and scaling.

Fitting a scaler is one small aggregation whose results (a few numbers per
column) come back as a ``ScalerModel``; applying it is a projection with
literals, so scored data never shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions.stats import quantile_dict

# The source project's final model columns, in order.
FINAL_MODEL_COLUMNS = [
    "number_complaints", "distinct_stores_visited", "lifetime_total_distinct_products",
    "percentage_of_products_bought_promotion", "typical_hour", "age", "customer_tenure",
    "has_loyalty_card", "total_children_home", "total_lifetime_spend",
    "share_groceries", "share_electronics", "share_vegetables", "share_nonalcohol_drinks",
    "share_alcohol_drinks", "share_meat", "share_fish", "share_hygiene", "share_videogames",
    "share_petfood",
]
NON_MODEL_COLUMNS = ["most_frequent_product"]
PROMOTION_COLUMN = "percentage_of_products_bought_promotion"
UNKNOWN = "Unknown"


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in exclude]


def clip(df: DataFrame, column: str, lower: float = 0.0, upper: float = 100.0) -> DataFrame:
    """Clip to [lower, upper]; NULL stays NULL (``greatest`` alone would invent a value)."""
    if column not in df.columns:
        return df
    c = F.col(column)
    return df.withColumn(column, F.when(c.isNull(), c).otherwise(F.least(F.greatest(c, F.lit(lower)), F.lit(upper))))


def impute_median(df: DataFrame, columns=None, id_col: str | None = "customer_id",
                  method: str = "exact") -> tuple[DataFrame, dict]:
    """NULL -> column median (exact); all-NULL column -> 0. The id is never imputed."""
    cols = columns if columns is not None else numeric_columns(df, exclude=(id_col,))
    med = quantile_dict(df, cols, [0.5], method=method)
    fills = {c: (med.get((c, 0.5)) if med.get((c, 0.5)) is not None else 0.0) for c in cols}
    out = df.withColumns({c: F.coalesce(F.col(c), F.lit(fills[c]).cast(df.schema[c].dataType)) for c in cols})
    return out, fills


def fill_categorical(df: DataFrame, columns=None, value: str = UNKNOWN) -> DataFrame:
    """NULL text -> "Unknown"."""
    cols = columns if columns is not None else string_columns(df)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in cols})


def clean_feature_values(df: DataFrame, id_col: str = "customer_id", clip_column: str = PROMOTION_COLUMN,
                         lower: float = 0.0, upper: float = 100.0, method: str = "exact") -> DataFrame:
    """Clip, then median-impute (medians of the clipped data), then fill text."""
    clipped = clip(df, clip_column, lower, upper)
    imputed, _ = impute_median(clipped, id_col=id_col, method=method)
    return fill_categorical(imputed)


def select_model_features(df: DataFrame, columns=None, id_col: str = "customer_id") -> DataFrame:
    """P5: id + model columns in a fixed order; missing columns raise, naming them."""
    cols = list(columns) if columns is not None else FINAL_MODEL_COLUMNS
    required = [id_col, *cols]
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required model columns: {missing}")
    return df.select(*required)


@dataclass
class ScalerModel:
    """Fitted per-column centre and scale: x' = (f(x) - centre) / scale."""
    method: str
    columns: list
    center: dict = field(default_factory=dict)
    scale: dict = field(default_factory=dict)
    use_log: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        exprs = {}
        for c in self.columns:
            x = _log_clip(c) if self.use_log else F.col(c).cast("double")
            exprs[c] = (x - F.lit(self.center[c])) / F.lit(self.scale[c])
        return df.withColumns(exprs)


def _log_clip(c: str):
    """log1p of the value clipped at 0."""
    return F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0)))


def fit_scaler(df: DataFrame, columns, method: str = "robust", use_log: bool = False,
               quantile_method: str = "exact") -> ScalerModel:
    """robust = (x - median) / IQR (exact, linear); standard = (x - mean) / population std.

    A zero IQR or zero std divides by 1, as scikit-learn does (MLlib would
    map the column to 0).
    """
    cols = list(columns)
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required feature columns: {missing}")
    src = df.select(*[(_log_clip(c) if use_log else F.col(c).cast("double")).alias(c) for c in cols])
    model = ScalerModel(method, cols, use_log=use_log)
    if method == "robust":
        q = quantile_dict(src, cols, [0.25, 0.5, 0.75], method=quantile_method)
        for c in cols:
            iqr = (q[(c, 0.75)] or 0.0) - (q[(c, 0.25)] or 0.0)
            model.center[c] = q[(c, 0.5)] or 0.0
            model.scale[c] = iqr if iqr != 0.0 else 1.0
    elif method == "standard":
        row = src.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                      *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
        for i, c in enumerate(cols):
            s = row[f"s_{i}"] or 0.0
            model.center[c] = row[f"m_{i}"] or 0.0
            model.scale[c] = s if s != 0.0 else 1.0
    else:
        raise ValueError(f"unknown scaler {method!r}")
    return model


def scale_features(df: DataFrame, columns=None, method: str = "robust", use_log: bool = False,
                   id_col: str = "customer_id") -> tuple[DataFrame, ScalerModel]:
    """P10: fit on ``df`` and return (id + scaled columns, model)."""
    cols = list(columns) if columns is not None else FINAL_MODEL_COLUMNS
    model = fit_scaler(df, cols, method, use_log)
    keep = [id_col] if id_col in df.columns else []
    return model.transform(df.select(*keep, *cols)), model


def preprocess_for_clustering(df: DataFrame, columns=None, id_col: str = "customer_id",
                              method: str = "robust") -> DataFrame:
    """Clean -> select -> numeric check -> scale; id first."""
    cols = list(columns) if columns is not None else FINAL_MODEL_COLUMNS
    selected = select_model_features(clean_feature_values(df, id_col), cols, id_col)
    non_numeric = [c for c in cols if not isinstance(selected.schema[c].dataType, NumericType)]
    if non_numeric:
        raise ValueError(f"Non-numeric model columns found: {non_numeric}")
    scaled, _ = scale_features(selected, cols, method, id_col=id_col)
    return scaled
