"""Session helpers: one place for the configuration the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "sectorscope") -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster, call with ``master=None`` and let ``spark-submit`` decide;
    the cluster's ``spark.sql.shuffle.partitions`` is then kept (it is AQE's
    starting point: AQE merges small partitions but never splits a large
    one, so it must be sized for the data). A local session without an
    explicit ``shuffle_partitions`` gets one partition per core.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    local = bool(master) and master.startswith("local")
    parts = shuffle_partitions or (_local_cores(master) if local else None)
    if parts:
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if local:
        builder = builder.config("spark.driver.memory", os.environ.get("SECTORSCOPE_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _local_cores(master: str) -> int:
    """N of ``local[N]``; the machine's cores for ``local`` / ``local[*]``."""
    inner = master[len("local["):-1] if master.startswith("local[") else ""
    head = inner.split(",")[0]
    return int(head) if head.isdigit() else (os.cpu_count() or 1)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting is always used when present. Only a local-mode
    session without one (tests, benches) gets a fresh folder under the
    system temp dir; a cluster session without one is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    conf = spark.conf.get(CHECKPOINT_CONF, None)
    if not conf:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder before running on {master}")
        conf = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="sectorscope-ckpt-")
    try:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(conf)
    except Exception:  # noqa: BLE001 - no SparkContext access (Spark Connect)
        pass
    return conf.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unique path under the shared folder for one job's output."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df, label: str):
    """Write ``df`` as parquet under the shared folder and return it read back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing
    the upstream plan) and lets several passes share one computation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.parquet(path)
