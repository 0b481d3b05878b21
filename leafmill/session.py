"""Session settings."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on; safe to call on any session, local or cluster.

    Adaptive execution stays on (coalescing, skew joins), times are UTC, streams merge a task's sessions before they
    shuffle them.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Only a local master may go without
    one and then gets a temporary folder; a cluster without the setting is refused, as its executors could not
    read one another's files."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="leafmill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("leafmill")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC"))
    return prepare(builder.getOrCreate())
