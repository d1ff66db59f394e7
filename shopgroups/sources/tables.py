"""Parquet table access for the driver data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(table_path(sf_dir, name))


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def path_state(spark: SparkSession, path: str) -> tuple:
    """Path, length and time of change of all files below a path; empty where there is none."""
    system, where = _folder(spark, path)
    state = []
    if system.exists(where):
        files = system.listFiles(where, True)
        while files.hasNext():
            f = files.next()
            state.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(state))


def files_state(spark: SparkSession, sf_dir: str, names) -> tuple:
    """The state of the tables' files: the same as long as the data are."""
    return tuple(path_state(spark, table_path(sf_dir, name)) for name in names)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    system, where = _folder(spark, path)
    system.delete(where, True)
