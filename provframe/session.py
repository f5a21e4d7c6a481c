"""Session settings the plans rely on, and where scratch data goes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Adaptive execution splits the partitions of hot join keys; "force" lets it do so even
# where that costs another shuffle. ANSI mode turns overflow into an error.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


BYTES_PER_SHUFFLE_PARTITION = 64 * 1024 * 1024
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def tune(spark: SparkSession, shuffled_bytes: int | None = None) -> SparkSession:
    """Apply the runtime SQL settings to a session.

    ``shuffled_bytes``, the most that one shuffle of the workload moves (joined rows count, not files),
    sets the number of partitions shuffles start with, so that each has about 64 MB; adaptive
    execution merges what turns out small. Without it the session's own setting holds.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if shuffled_bytes is not None:
        spark.conf.set(INITIAL_PARTITIONS, str(max(1, -(-shuffled_bytes // BYTES_PER_SHUFFLE_PARTITION))))
    return spark


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which all executors share.

    Only a local session without that setting (tests) falls back to a temporary folder
    of this machine; on a cluster its absence is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="provframe-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
