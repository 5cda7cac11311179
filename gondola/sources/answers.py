"""Stored model answers, one text per flyer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola import schemas
from gondola.functions.text import file_name


def read_answer_table(spark: SparkSession, path: str) -> DataFrame:
    """Answers kept as a Parquet table."""
    return spark.read.schema(schemas.RESPOSTAS).parquet(path)


def read_answer_files(spark: SparkSession, path: str) -> DataFrame:
    """Answers kept as one text file per flyer."""
    return (
        spark.read.text(path, wholetext=True)
        .select(
            file_name(F.col("_metadata.file_path")).alias("nome_arquivo"),
            F.col("_metadata.file_path").alias("caminho_arquivo"),
            F.col("value").alias("texto"),
        )
    )
