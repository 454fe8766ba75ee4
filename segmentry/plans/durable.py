"""Cutting lineage where a loop would grow it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the session names in spark.checkpoint.dir.

    A local session (tests) may use a folder of its own; on a cluster that would be the driver's disk, so it is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


#: Bytes for each core below which an input is small.
SMALL = 16 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Rows for work that is dear by the row: a small input often lies in one row group, which is one task, and is dealt out; a large one lies in many."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if size < cores * SMALL else rows
