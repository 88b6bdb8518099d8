"""Session helpers: where lineage may be cut, and how."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting one only when the session names none.

    A cluster names a shared folder in ``spark.checkpoint.dir``. A local session without one gets a
    temporary folder; a cluster without one is an error, since a machine-local folder would be lost
    with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it: lineage ends, and Spark knows the size of what it joins."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 64 * 1024 * 1024


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Materialise ``df``, measure it, and mark it for broadcast only when it is small enough.

    For a derived side whose size the optimiser cannot know before the other, much larger side has
    been shuffled. Beyond the bound the frame is returned unmarked and joins by shuffle.
    """
    written = cut_lineage(df)
    row = F.lit(16)
    for name, kind in written.dtypes:
        wide = F.col(name).cast("string") if kind != "string" else F.col(name)
        row = row + F.coalesce(F.octet_length(wide), F.lit(0))
    size = written.agg(F.coalesce(F.sum(row), F.lit(0)).alias("bytes")).first()["bytes"]
    return F.broadcast(written) if size <= max_bytes else written


def use_all_cores(df: DataFrame, key: str) -> DataFrame:
    """Spread rows by ``key`` when there are fewer input partitions than cores.

    For work that is heavy per row on inputs of a few files. A large input has more partitions than
    cores and passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
