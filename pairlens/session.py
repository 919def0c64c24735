"""Session settings this workload wants."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Generated methods above 8000 bytes are not compiled by the JVM's JIT; below
# that limit Spark falls back to smaller methods. Comparing 29 columns exceeds
# it. The rest keeps adaptive execution and its skew handling on. Keys and lines of
# 64 MB, Spark's default for a task, become pair rows of over 1 GB, more than a task can sort in memory.
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}

# Into how many partitions an exchange is dealt at least before adaptive execution joins small ones to tasks of the size above. It joins
# only, so with a fixed 200 the share of a task would grow with the tables until it is more than a task can hold, and spilled.
PARTITIONS = 1000


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session and return it; a session that deals into more partitions keeps its number."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    own = spark.conf.get(first, None) or spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(first, str(max(PARTITIONS, int(own))))
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pairlens-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
