"""Array expressions for basket lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _empty_strings() -> Column:
    return F.array().cast("array<string>")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_goods_list(text, on_error: str = "fail") -> Column:
    """Parse list text such as ``"['a', 'b']"`` into ``array<string>``.

    NULL -> empty array. Text that is not a list literal either fails the
    job (``on_error="fail"``) or becomes an empty array (``"empty"``).
    Single-quoted items are accepted (JSON reader option).
    """
    c = _col(text)
    parsed = F.from_json(c, "array<string>", {"allowSingleQuotes": "true"})
    if on_error == "fail":
        bad = F.raise_error(F.concat(F.lit("list text is not a list literal: "), c))
        return F.when(c.isNull(), _empty_strings()).when(parsed.isNull(), bad.cast("array<string>")).otherwise(parsed)
    if on_error == "empty":
        return F.when(c.isNull() | parsed.isNull(), _empty_strings()).otherwise(parsed)
    raise ValueError(f"on_error must be 'fail' or 'empty', got {on_error!r}")


def sorted_pairs(items) -> Column:
    """All (a, b) with a < b from an array of distinct, sorted items.

    Built in the row (no shuffle, no self join): element i pairs with the
    tail after it.
    """
    arr = _col(items)
    n = F.size(arr)
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda i: F.transform(
                F.slice(arr, i + 1, n - i),
                lambda x: F.struct(F.element_at(arr, i).alias("a"), x.alias("b")),
            ),
        )
    )
    empty = F.array().cast("array<struct<a:string,b:string>>")
    return F.when(n >= 2, pairs).otherwise(empty)
