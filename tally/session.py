"""Session and scratch-space helpers.

Operators never create sessions.  These helpers are for tests, the bench and
the registered queries: they read the cluster's ``spark.checkpoint.dir`` and
only fall back to a private temporary folder when the setting is absent
(local runs and tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "tally", driver_memory: str = "16g") -> SparkSession:
    """A local session configured the way the tests and the bench expect."""
    parts = shuffle_partitions or (cores if isinstance(cores, int) else os.cpu_count() or 8)
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a private one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tally-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (never a local temp dir
    on a cluster: the folder is the one the cluster names)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tally-scratch/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once into the shared folder and read back: what follows starts from
    files, so loops keep a short lineage and survive lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(path: str) -> str:
    """A path for Python-side file I/O (zipfile, os): Spark reports folders as
    ``file:`` URIs; strip the scheme.  Other schemes (HDFS, object stores)
    need a mount for Python-side I/O."""
    for prefix in ("file://", "file:"):
        if path.startswith(prefix):
            return path[len(prefix):]
    return path


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``tally`` importable in Python workers (pandas functions, the
    xlsx data source): zip the package once per application and hand it to
    ``SparkContext.addPyFile``, which distributes it to every executor."""
    import zipfile

    sc = spark.sparkContext
    with _SHIPPING:  # operators call this from several threads at once; the second copy of a file is refused
        if sc.applicationId in _SHIPPED:
            return
        pkg = os.path.dirname(os.path.abspath(__file__))
        folder = local_path(scratch_path(spark, "pyfiles"))
        if "://" in folder:  # not a local file system: the driver's temp folder
            folder = tempfile.mkdtemp(prefix="tally-pyfiles-")
        os.makedirs(folder, exist_ok=True)
        out = os.path.join(folder, "tally.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for root, _, files in os.walk(pkg):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(root, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
        sc.addPyFile(out)
        _SHIPPED.add(sc.applicationId)
