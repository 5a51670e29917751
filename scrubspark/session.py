"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "scrubspark") -> SparkSession:
    """A local session configured the way the tests and bench expect (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SCRUBSPARK_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_FOLDERS: dict[str, str] = {}  # local-mode sessions with no shared folder configured


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared file system).
    Only a local-mode session with nothing configured gets a private folder under /tmp.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext, the conf is all there is
        sc = None
    if not configured and sc is not None:
        configured = sc.getCheckpointDir()
    if not configured:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a shared folder; checkpoints cannot live on one machine.")
        key = sc.applicationId if sc is not None else "connect"
        if key not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[key] = tempfile.mkdtemp(prefix="scrubspark-ckpt-")
        configured = _LOCAL_FOLDERS[key]
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the checkpoint folder for tables an operator writes."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df, label: str):
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back:
    computed once, lineage cut, nothing pinned in executor memory."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
