"""Derived tables that several queries of a session read, written once.

A kept table lies in the shared folder and is used as long as the files it was
made from are the same (path, length, time of change). At most ``KEPT_TABLES``
are kept; beyond that the one that was not used for the longest time is deleted,
so a DataFrame on a kept table must be used before that many others are built.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir
from .tables import files_state, remove_folder

KEPT_TABLES = 16
_KEPT: OrderedDict = OrderedDict()


def kept(spark: SparkSession, sf_dir: str, sources, params: tuple, build) -> tuple:
    """``build()`` = (table, anything), the table written once per application, parameters and state of the source files."""
    key = (spark.sparkContext.applicationId, files_state(spark, sf_dir, sources), params)
    if key not in _KEPT:
        folder = f"{checkpoint_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
        table, more = build()
        table.write.parquet(folder)
        _KEPT[key] = (spark.read.schema(table.schema).parquet(folder), more, folder)
    _KEPT.move_to_end(key)
    found = _KEPT[key]
    while len(_KEPT) > KEPT_TABLES:
        (application, *_), (_, _, old) = _KEPT.popitem(last=False)
        if application == spark.sparkContext.applicationId:
            remove_folder(spark, old)
    return found[:2]


def release(spark: SparkSession) -> None:
    """Delete all kept tables of this application."""
    for key in [k for k in _KEPT if k[0] == spark.sparkContext.applicationId]:
        remove_folder(spark, _KEPT.pop(key)[2])
