"""String expressions: degree prefixes, term lists, number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the source project's): degree prefixes as they
# appear at the start of a customer name, the label each maps to, and the
# label for everything else.
DEGREE_PREFIXES = [("Bsc.", "Bsc"), ("Msc.", "Msc"), ("Phd.", "Phd")]
UNKNOWN_LABEL = "Unknown"
NO_PREFIX_LABEL = "No visible prefix"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def degree_level(name) -> Column:
    """Degree from a name prefix; case-sensitive, after trimming; NULL -> Unknown."""
    trimmed = F.trim(_col(name))
    expr = None
    for prefix, label in DEGREE_PREFIXES:
        cond = trimmed.startswith(prefix)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(UNKNOWN_LABEL))


def name_prefix(name) -> Column:
    """Visible prefix at the very start of the raw name (no trim), else a fixed label."""
    pattern = "^(" + "|".join(p.replace(".", r"\.") for p, _ in DEGREE_PREFIXES) + ")"
    extracted = F.regexp_extract(F.coalesce(_col(name), F.lit("")), pattern, 1)
    return F.when(extracted == "", F.lit(NO_PREFIX_LABEL)).otherwise(extracted)


def normalize_terms_text(text) -> Column:
    parts = F.transform(F.split(_col(text), ","), lambda t: F.lower(F.trim(t)))
    return F.coalesce(F.filter(parts, lambda t: t != ""), F.array().cast("array<string>"))


def normalize_terms_array(arr) -> Column:
    return F.coalesce(F.transform(_col(arr), lambda t: F.lower(t)), F.array().cast("array<string>"))


def format_percentage(value) -> Column:
    """``12.3%`` style, one decimal."""
    return F.format_string("%.1f%%", _col(value) * F.lit(100.0))


def format_count(value) -> Column:
    """Thousands separators, no decimals (``1,234``)."""
    return F.format_number(_col(value), 0)


def contains_any(text, terms) -> Column:
    """True when the lower-cased text contains any of the (already lower) terms."""
    low = F.lower(_col(text).cast("string"))
    return F.exists(_col(terms), lambda t: F.instr(low, t) > 0)
