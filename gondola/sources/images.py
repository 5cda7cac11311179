"""Flyer images: which files of a folder or of a manifest are flyers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola import fixed_values as fx
from gondola.functions.text import file_name


def supported_image(path: Column) -> Column:
    """Extension all lower or all upper case; mixed case is not taken."""
    name = file_name(path)
    known = [e for ext in fx.IMAGE_EXTENSIONS for e in (ext, ext.upper())]
    return F.regexp_extract(name, r"\.[^.]*$", 0).isin(known)


def select_images(files: DataFrame, path: str = "caminho_arquivo") -> DataFrame:
    """The flyers among listed files (a manifest table), with their file name."""
    return files.where(supported_image(F.col(path))).withColumn(
        "nome_arquivo", file_name(F.col(path))
    )


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Flyer images directly in ``folder``: path, size, time. The contents are not read.

    Raises when the folder does not exist or is a file; a folder without images is empty.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(path) and not store.getFileStatus(path).isDirectory():
        raise NotADirectoryError(f"Caminho não é uma pasta: {folder}")
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "false")
        .load(folder)
        .select(F.col("path").alias("caminho_arquivo"), "length", "modificationTime")
    )
    return select_images(found)
