"""SparkSession defaults for shopgroups jobs.

On a cluster the session is created by the platform; ``configure`` only
fills settings that are still unset so cluster-level choices win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes
# (small aggregated sides become broadcasts, hot keys get split).
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # shuffled bytes are compressed: Spark's 64 MB may be gigabytes in a task's sorts and hash maps
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "shopgroups", extra: dict | None = None) -> SparkSession:
    """Local/test session builder. Keeps the web UI off."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULTS)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply runtime SQL defaults that are not set yet."""
    for key, value in DEFAULTS.items():
        if key == "spark.sql.execution.arrow.pyspark.enabled":
            continue
        try:
            current = spark.conf.get(key, None)
        except Exception:  # pragma: no cover - conf not readable
            current = None
        if current is None:
            spark.conf.set(key, value)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    Uses ``spark.checkpoint.dir`` from the session (set by the cluster to a
    shared file system). Only when it is unset and Spark runs in this process —
    local runs and tests — a fresh scratch folder is created; on a cluster a
    missing setting is an error, as no machine-local folder would do.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        try:
            conf_dir = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:  # pragma: no cover
            conf_dir = None
    if not conf_dir:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="shopgroups-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``shopgroups`` importable in executor Python workers (once per context).

    Operators that run NumPy inside ``mapInPandas`` pickle functions that live
    in this package; executors resolve them by import. The package is zipped
    and added with ``addPyFile``, which distributes it with the job (no-op
    when it was shipped already).
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import shopgroups
    pkg_dir = os.path.dirname(os.path.abspath(shopgroups.__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="shopgroups-pyfiles-")
    zpath = os.path.join(out_dir, "shopgroups.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
