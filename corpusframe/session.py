"""Session helpers.

Library code never builds its own session: it takes the caller's. ``local_session``
is for tests and the bench only. Scratch data (materialised tables, lineage
cuts) always goes under the shared folder the session names in
``spark.checkpoint.dir``; a default is set only when the session has none.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a cluster job should run with; applied by ``local_session`` and
# recommended for spark-submit.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "corpusframe") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. Only a session whose driver and
    executors are one process (``local`` master: tests, bench) gets a folder of
    its own if it names none; on a cluster a folder that all executors share
    must be named in ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="corpusframe-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


#: Folders handed out by ``scratch_path`` and not yet cleared.
_HANDED_OUT: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint folder."""
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _HANDED_OUT.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Remove the stored steps of this driver's finished queries from the shared
    folder; returns how many there were. For long-lived sessions, between jobs:
    DataFrames that were returned before read these tables, so write their
    results first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _HANDED_OUT:
        path = jvm.org.apache.hadoop.fs.Path(_HANDED_OUT.pop())
        gone += path.getFileSystem(conf).delete(path, True)
    return gone
