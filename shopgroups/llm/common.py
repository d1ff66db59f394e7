"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopgroups.operators.components import stored  # noqa: F401
from shopgroups.session import checkpoint_dir, ship_package
from shopgroups.sources.tables import read_table


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this call below the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


#: Rows of an Arrow batch where the session has Spark's default of 10,000; texts are long.
BATCH_ROWS = 2_000


def python_ready(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, and keep their batches small."""
    ship_package(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))


def unit_hash(*cols) -> "F.Column":
    """Uniform number in [0, 1) that depends on the columns' values only."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def unused(names, wanted: str) -> str:
    """``wanted``, or with underscores before it, so that no column has the name."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def text_or_empty(col: str) -> "F.Column":
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
