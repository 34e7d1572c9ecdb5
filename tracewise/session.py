"""Spark session helpers.

Library code never creates its own session; callers pass one in.  These
helpers exist for tests, ``bench.py`` and notebooks.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # delete checkpoint files once nothing references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "tracewise", extra: dict | None = None) -> SparkSession:
    """Local session for tests and benchmarks (a cluster supplies its own)."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is; without it this raises, since a folder of one machine is lost to
    the others.  Only a local master (tests, bench) gets a scratch folder.
    """
    sc = spark.sparkContext
    cur = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if cur:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(cur)
        return sc.getCheckpointDir() or cur
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="tracewise-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def materialize(df):
    """Compute ``df`` once and read it back from the shared checkpoint folder.

    For intermediates that feed several branches of one plan (tokens,
    chunks, reference terms): without it each branch re-runs the whole
    lineage.  A reliable checkpoint also bounds recomputation after an
    executor loss.  The frame is persisted while the checkpoint is written,
    so the checkpoint job reads the computed blocks instead of recomputing
    the lineage; the blocks are released once the checkpoint files exist.
    """
    from pyspark import StorageLevel
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cut_lineage(df, eager=True)
    finally:
        df.unpersist()
