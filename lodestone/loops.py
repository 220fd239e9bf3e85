"""Cutting lineage in driver loops, and dealing rows over tasks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``. Only a local session that names none gets one of its own."""
    base, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not base and not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return (base or context.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


#: Tasks that ``dealt`` deals rows over, if the session has fewer shuffle partitions.
TASKS = 200


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` shuffled by ``keys`` over a stated number of tasks.

    Adaptive execution merges shuffled partitions up to 64 MB as compressed. Keys, digests and repeated texts compress so well that this is more than 1 GB of a
    task's sorts and maps; a stated number of partitions isn't merged.
    """
    return df.repartition(max(TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)
