"""Writing and presenting results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from ..config import REPORT_COLUMNS


# Spark else keeps the shuffle files of an action until the driver's garbage collector finds its plan.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(
    result: DataFrame,
    path: str,
    format: str = "parquet",
    mode: str = "overwrite",
    partition_by: Iterable[str] = (),
    **options,
) -> None:
    """Write a result with any format the session knows. The shuffle files of the write are removed with it, so that saves in turn need the disk of one."""
    writer = result.write.mode(mode).format(format).options(**options)
    partitions = list(partition_by)
    if partitions:
        writer = writer.partitionBy(*partitions)
    conf, own = result.sparkSession.conf, result.sparkSession.conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        writer.save(path)
    finally:
        conf.set(_CLEANUP, own)


def save_batch(result: DataFrame, path: str, format: str = "parquet", batch_column: str = "batch_id", **options) -> None:
    """Write a result next to those of other batches.

    One folder per batch: a repeated run replaces its own batch and leaves the others alone. Spark swaps the new files in
    when the job commits, so a run that fails keeps the old ones. The format must be one of files (Parquet, ORC, JSON, CSV).
    """
    save(result, path, format, partition_by=[batch_column], partitionOverwriteMode="dynamic", **options)


def report(result: DataFrame, columns: Iterable[str] = REPORT_COLUMNS) -> DataFrame:
    """The columns people read; Spark prunes whatever only the others need."""
    return result.select(*columns)
