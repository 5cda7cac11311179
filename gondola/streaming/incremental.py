"""Incremental ingest: each run takes the answer files that arrived since the last one.

Structured Streaming remembers the files already taken. Every micro-batch is one commit on the
stored tables (``plans.stored.ingest_into``), on top of whatever jobs, merges and other streams have
committed before. The version records the batch under the id of the stream, which its
checkpoint keeps, so a batch repeated after a failure is taken once.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gondola import schemas
from gondola.plans.stored import ingest_into
from gondola.session import prepare

STREAM_ID = "sql.streaming.queryId"  # local property of the thread that runs a micro-batch


def start_ingest(
    spark: SparkSession,
    answers_path: str,
    base: str,
    checkpoint: str,
    now: dt.datetime,
    store_override: str | None = None,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Take all waiting answer files, ``files_per_batch`` at a time, then stop."""
    prepare(spark)

    def save(answers: DataFrame, batch: int) -> None:
        session = answers.sparkSession
        stream = session.sparkContext.getLocalProperty(STREAM_ID)
        if not stream:
            raise RuntimeError("a micro-batch runs without the id of its stream")
        ingest_into(session, base, answers, now, store_override, (stream, batch))

    return (
        spark.readStream.schema(schemas.RESPOSTAS)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(answers_path)
        .writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
