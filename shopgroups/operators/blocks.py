"""Feature rows packed into matrix blocks, and folds over them.

An iterative fit reads the same numbers many times. ``PackedRows`` turns every
partition once into binary blocks of rows, kept in memory (and on disk where it
does not fit), so that a pass hands NumPy whole matrices instead of building
them from columns. A fold lets every task reduce its blocks to a few arrays of
a size that the model fixes; a partition's arrays travel as one binary row, and
where there are many partitions they are combined in tasks, ``FAN`` at a time,
until few enough are left for the driver.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

#: Rows of a block, and partial results that one task or the driver combines.
BLOCK_ROWS, FAN = 4_096, 64


def added(a: tuple, b: tuple) -> tuple:
    """Arrays added one by one: the usual way to combine two partial results."""
    return tuple(x + y for x, y in zip(a, b))


class PackedRows:
    """Columns ``cols`` of ``df`` as doubles, with a hash of the row's id, in cached blocks.

    Equal rows keep hashes of their own through their ids; without ``id_col``
    rows are numbered. Nulls are NaN. With ``deal`` fewer partitions than cores are dealt
    out anew; counting them runs the shuffles of ``df``, which is cheap for a stored table only.
    """

    def __init__(self, df: DataFrame, cols, id_col: str | None = None, deal: bool = True):
        spark = df.sparkSession
        ship_package(spark)
        cols = list(cols)
        self.width = len(cols)
        key = F.xxhash64(F.col(id_col)) if id_col else F.xxhash64(F.monotonically_increasing_id())
        rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], key.alias("h"))
        cores = spark.sparkContext.defaultParallelism
        if deal and rows.rdd.getNumPartitions() < cores:
            rows = rows.repartition(cores, "h")
        width = self.width

        def pack(batches):
            for batch in batches:
                for a in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(a, BLOCK_ROWS)
                    x = np.empty((part.num_rows, width))
                    for i in range(width):
                        x[:, i] = part.column(i).to_numpy(zero_copy_only=False)
                    h = part.column(width).to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([h.astype(np.int64).tobytes()], pa.binary())], ["x", "h"])

        self.table = rows.mapInArrow(pack, "x binary, h binary").persist(StorageLevel.MEMORY_AND_DISK)
        self.partitions = self.table.rdd.getNumPartitions()

    def unpersist(self) -> None:
        self.table.unpersist()

    def fold(self, step, combine=added) -> tuple:
        """``step(blocks)`` for every partition, combined to one tuple of arrays.

        ``blocks`` yields (matrix, hashes); ``step`` returns a tuple of arrays whose sizes do not
        depend on the rows. ``combine(a, b)`` must not depend on the order but for rounding.
        """
        width = self.width

        def blocks(batches):
            for batch in batches:
                for x, h in zip(batch.column("x"), batch.column("h")):
                    yield np.frombuffer(x.as_buffer(), np.float64).reshape(-1, width), np.frombuffer(h.as_buffer(), np.uint64)

        def run(batches):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(step(blocks(batches)), 5)], pa.binary())], ["part"])

        parts, count = self.table.mapInArrow(run, "part binary"), self.partitions
        if count > FAN:
            parts = parts.withColumn("i", F.spark_partition_id())

        def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            arrays = None
            for part in pdf["part"]:
                arrays = pickle.loads(part) if arrays is None else combine(arrays, pickle.loads(part))
            return pd.DataFrame({"part": [pickle.dumps(arrays, 5)], "i": [int(key[0])]})

        while count > FAN:
            parts = parts.groupBy(F.floor(F.col("i") / FAN).cast("int").alias("g")).applyInPandas(merge, "part binary, i int")
            count = -(-count // FAN)
        done = None
        for part in parts.select("part").toArrow().column("part"):  # FAN rows at most
            arrays = pickle.loads(part.as_buffer())
            done = arrays if done is None else combine(done, arrays)
        return step(iter(())) if done is None else done
