"""Sharding by sampled splitters.

Records are ordered by (group key, id), where the group key is a 64-bit hash
of the text, so equal texts lie side by side. The order is cut in three steps:

1. every record draws size-weighted samples of its key (the draw is a hash of
   the record, so a lost task draws the same again); the quantiles of the
   sample are the splitters of ``RANGES_PER_SHARD * n_shards`` ranges;
2. records are range-partitioned by binary search in the splitter array. A key
   that fills several quantiles or has more than ``range_rows`` records is a
   heavy key and gets cells of its own. A range with more than ``range_rows``
   records is subdivided by key hash, a heavy key by record number;
3. byte and row counts of the cells (a few hundred plus rows / ``range_rows``)
   give every cell its place in the whole order, a window inside each cell
   gives every record its own, and the shard follows from the bytes before it.

No task sees more than a cell, and a cell has about ``range_rows`` records whatever
the skew of keys, sizes and ids. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, stored, text_or_empty, unit_hash, work_folder

#: Ranges per shard before overfull ones are subdivided.
RANGES_PER_SHARD = 8
#: Expected sample draws per range.
DRAWS_PER_RANGE = 64
#: Records in a cell; fuller ranges are subdivided.
RANGE_ROWS = 500_000
#: A group of equal keys up to this part of a shard stays in one shard.
WHOLE_GROUP = 1 / 64
#: Bytes that a record takes besides its text.
RECORD_BYTES = 8


def choose_splitters(records: DataFrame, total: int, n_ranges: int) -> list[int]:
    """Quantile boundaries of a size-weighted key sample of about
    ``n_ranges * DRAWS_PER_RANGE`` draws, whatever the input's size."""
    expected = F.col("size") * F.lit(float(n_ranges * DRAWS_PER_RANGE) / max(total, 1))
    draws = F.floor(expected) + (unit_hash(F.col("key"), F.col("row"), F.lit(7)) < expected - F.floor(expected)).cast("long")
    sample = (records.select("key", draws.alias("w")).filter("w > 0")
              .groupBy("key").agg(F.sum("w").alias("w")))
    upto = F.sum("w").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    every = F.sum("w").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # the quantiles i / n_ranges (0 < i < n_ranges) that fall on this key
    first = F.floor((F.col("upto") - F.col("w")) * n_ranges / F.col("every")).cast("int") + 1
    last = F.least(F.floor(F.col("upto") * n_ranges / F.col("every")).cast("int"), F.lit(n_ranges - 1))
    cuts = (sample.select("key", "w", upto.alias("upto"), every.alias("every"))
            .withColumn("first", first).withColumn("last", last).filter("last >= first")
            .select("key", F.explode(F.sequence("first", "last"))))
    return sorted(r["key"] for r in cuts.collect())


def range_of(key, splitters: list[int]):
    """Number of splitters at or below ``key``: binary search folded over the step sizes."""
    n = len(splitters)
    steps = [1 << b for b in reversed(range(max(n, 1).bit_length()))]
    cuts = F.lit(splitters) if splitters else F.array().cast("array<bigint>")
    return F.aggregate(F.lit(steps), F.lit(0), lambda lo, s: F.when(
        (lo + s <= n) & (F.get(cuts, lo + s - 1) <= key), lo + s).otherwise(lo))


def shard_by_bytes(df: DataFrame, n_shards: int, folder: str, id_col: str = "doc_id", text_col: str = "text",
                   range_rows: int = RANGE_ROWS, whole_group: float = WHOLE_GROUP) -> DataFrame:
    """Place every record of ``df`` into one of ``n_shards`` shards of nearly equal bytes.

    Returns ``id_col, size, text_crc32, shard, slot``: size is the text's UTF-8
    bytes plus 8, slot counts from 0 without gaps inside a shard. Shards differ
    by less than the largest record or the largest group that stays whole.
    Equal texts lie side by side, in consecutive cells; a group of up to ``whole_group`` of a shard is
    never cut by a shard boundary, larger ones are cut between records.

    Null text: empty text. Null or repeated ids: each row keeps its own slot.
    Empty input: no rows. Other columns of ``df`` are ignored.
    """
    text = text_or_empty(text_col)
    records = df.select(F.col(id_col).alias("rec_id"), (F.octet_length(text).cast("long") + RECORD_BYTES).alias("size"),
                        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key"),
                        F.monotonically_increasing_id().alias("row"))
    records = stored(records, folder, "records")
    total = records.agg(F.sum("size")).first()[0] or 0
    splitters = choose_splitters(records, total, n_shards * RANGES_PER_SHARD)
    filled = sorted({k for k, after in zip(splitters, splitters[1:]) if k == after})
    fills = F.array_contains(F.lit(filled), F.col("key")) if filled else F.lit(False)
    # at most one row per quantile and one per range_rows records
    heavy = stored(records.groupBy("key").agg(F.count("*").alias("r"), F.sum("size").alias("own_bytes"))
                   .filter((F.col("r") > range_rows) | fills).drop("r"), folder, "heavy")
    ranged = (records.join(F.broadcast(heavy), "key", "left").withColumn("range", range_of(F.col("key"), splitters))
              .withColumn("heavy", F.col("own_bytes").isNotNull())
              .withColumn("own", F.when(F.col("heavy"), F.col("key")).otherwise(0)))

    # one row per first-level range and one per heavy key
    unit = ["range", "heavy", "own"]
    cell = [*unit, "sub"]
    parts = ranged.groupBy(*unit).agg(F.ceil(F.count("*") / range_rows).alias("parts"))
    spread = F.when(F.col("heavy"), F.xxhash64("row")).otherwise(F.xxhash64("key"))
    celled = (ranged.join(F.broadcast(parts), unit)
              .withColumn("sub", F.pmod(spread, F.col("parts"))).drop("parts"))
    celled = stored(celled, folder, "cells")
    before = Window.orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    places = (celled.groupBy(*cell).agg(F.sum("size").alias("b"), F.count("*").alias("r"))
              .select(*cell, F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_before"),
                      F.coalesce(F.sum("r").over(before), F.lit(0)).alias("rows_before"))
              .withColumn("own_start", F.min("bytes_before").over(Window.partitionBy(*unit))))

    in_cell = Window.partitionBy(*cell).orderBy("key", "rec_id", "row")
    group = Window.partitionBy(*cell, "key")
    placed = (celled.withColumn("n", F.row_number().over(in_cell))
              .withColumn("start", F.sum("size").over(in_cell.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
              .withColumn("group_start", F.min("start").over(group))
              .withColumn("group_bytes", F.coalesce("own_bytes", F.sum("size").over(group)))
              # one row per cell: a few hundred, plus one per range_rows records
              .join(F.broadcast(places), cell))
    group_start = F.when(F.col("heavy"), F.col("own_start")).otherwise(F.col("bytes_before") + F.col("group_start"))
    kept_whole = F.col("group_bytes") <= F.lit(int(total / n_shards * whole_group))
    start = F.when(kept_whole, group_start).otherwise(F.col("bytes_before") + F.col("start"))
    shard = F.least(F.floor(start * n_shards / F.lit(float(max(total, 1)))), F.lit(n_shards - 1)).cast("int")
    placed = placed.select("rec_id", "size", "crc", shard.alias("shard"),
                           (F.col("rows_before") + F.col("n") - 1).alias("place"))
    placed = stored(placed, folder, "placed")
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first_place"))  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("rec_id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("place") - F.col("first_place")).cast("long").alias("slot"))


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23, law ``bytes``; ``grown_shard`` belongs to the law ``key`` and is null."""
    out = shard_by_bytes(documents(spark, sf_dir), 24, work_folder(spark, "shards"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
