"""Session settings and the shared scratch area the jobs write to."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the jobs rely on; everything else is left to the cluster.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a split hot key is worth the extra shuffle of an aggregation after the join
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # a repeated JSON key keeps its last value
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or given to ``setCheckpointDir``."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return root.rstrip("/")


# Folders written since the innermost ``scratch`` block began.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the stages written inside the block when it ends.

    Results that read them must have been written by then; keep the block around the final write.
    """
    own: list[str] = []
    token = _written.set(own)
    try:
        yield
    finally:
        _written.reset(token)
        hadoop = spark._jvm.org.apache.hadoop.fs
        for folder in own:
            path = hadoop.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder; outside a ``scratch`` block it stays until someone deletes it."""
    job = f"{scratch_root(spark)}/gondola/{uuid.uuid4().hex}"
    written = _written.get()
    if written is not None:
        written.append(job)
    return f"{job}/{label}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    Cuts the lineage like a reliable checkpoint, but stays columnar, so later
    readers still prune columns. Lost executors re-read files, not the plan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
