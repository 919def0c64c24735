"""Intermediate tables in the folder that all executors share.

A written table cuts the lineage: a lost executor costs the tasks after it, not
those before, and a result that was drawn once stays as drawn.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local session, as in tests, may leave it unset and gets a folder of this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pairlens-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 64 << 20) -> None:
    """Rows, and bytes of them, that Spark hands to Python at a time: texts are long, and a batch is held several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written as Parquet and read again."""
    path = new_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by ``stored`` once nothing reads them any more."""
    for frame in frames:
        spark = frame.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
