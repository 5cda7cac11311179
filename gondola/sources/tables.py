"""Stored tables as Parquet folders, one layout for jobs, streams, updates and merges.

A write makes a new folder ``<table>/lote=<name>`` and shows when the version that names it is
committed (``versions``). ``precos`` is split further by month of ``validade_fim``, so reports on
valid prices read only the months they need; ``produtos`` by a hash of the normalised name, so a
look-up reads only the buckets its names fall in.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola import schemas
from gondola.schemas import NAME_BUCKET, name_bucket
from gondola.sources import versions
from gondola.sources.versions import Version, read_version

BATCH = "lote"
PRICE_MONTH = "mes_fim"
DELETED = "apagados"
# What a table's folders are split by, and its type.
SPLIT = {"precos": (PRICE_MONTH, "string"), "produtos": (NAME_BUCKET, "int")}
# Rows go with the row they name: column of the table -> table whose deletion they follow.
CASCADES = {"precos": {"produto_id": "produtos", "supermercado_id": "supermercados", "imagem_id": "imagens"}}


def _layout(name: str) -> list[str]:
    return [BATCH, *SPLIT[name][:1]] if name in SPLIT else [BATCH]


def _rows(spark: SparkSession, base: str, name: str, folders: list[str]) -> DataFrame:
    """All columns of some folders, the layout's too; deleted rows included."""
    split = f", {SPLIT[name][0]} {SPLIT[name][1]}" if name in SPLIT else ""
    schema = f"{schemas.TABLES[name]}, {BATCH} string{split}"
    if not folders:
        return spark.createDataFrame([], schema)
    root = f"{base}/{name}"
    return spark.read.schema(schema).option("basePath", root).parquet(*(f"{root}/{f}" for f in folders))


def _without_deleted(rows: DataFrame, base: str, name: str, version: Version) -> DataFrame:
    for column, table in {"id": name, **CASCADES.get(name, {})}.items():
        folders = version.deleted.get(table)
        if folders:
            gone = rows.sparkSession.read.schema("id bigint").parquet(*(f"{base}/{f}" for f in folders))
            rows = rows.join(gone.select(F.col("id").alias(column)), column, "left_anti")
    return rows


def read_rows(spark: SparkSession, base: str, name: str, version: Version | None = None) -> DataFrame:
    """The table with the columns of its layout."""
    version = version or read_version(spark, base)
    rows = _rows(spark, base, name, version.folders.get(name, []))
    return _without_deleted(rows, base, name, version)


def read_table(spark: SparkSession, base: str, name: str, version: Version | None = None) -> DataFrame:
    """The table as it was committed last, or in a given version; empty when there is none yet."""
    rows = read_rows(spark, base, name, version)
    return rows.select(schemas.empty_table(spark, name).columns)


def read_valid_prices(spark: SparkSession, base: str, as_of: dt.date) -> DataFrame:
    """Stored prices that may be valid on ``as_of``: its month, later ones and open ends."""
    month = F.col(PRICE_MONTH)
    prices = read_rows(spark, base, "precos")
    valid = prices.where((month >= as_of.strftime("%Y-%m")) | month.isNull())
    return valid.select(schemas.empty_table(spark, "precos").columns)


class Change:
    """What one job does to the tables of ``base``: nothing of it shows before ``commit``.

    All reads are from the version the change began with.
    """

    def __init__(self, spark: SparkSession, base: str, buckets: int = versions.BUCKETS):
        self.spark, self.base = spark, base
        self.start = read_version(spark, base)
        if not self.start.number:
            self.start = replace(self.start, buckets=buckets)
        self.folders = {name: list(folders) for name, folders in self.start.folders.items()}
        self.deleted = {name: list(folders) for name, folders in self.start.deleted.items()}
        self.last_ids, self.streams = dict(self.start.last_ids), dict(self.start.streams)

    def read(self, name: str) -> DataFrame:
        return read_table(self.spark, self.base, name, self.start)

    def last_id(self, name: str) -> DataFrame:
        """One row with the largest id the table ever had; null before the first."""
        return self.spark.createDataFrame([(self.last_ids.get(name),)], "id bigint")

    def _write(self, df: DataFrame, name: str) -> list[str]:
        """Write a new folder; what a table is split by decides which task writes what.

        Large parts are dealt to several tasks, so a part gets few files whatever the number of tasks.
        """
        rows, folder = schemas.conform(df, name), f"{BATCH}={uuid.uuid4().hex}"
        path = f"{self.base}/{name}/{folder}"
        if name not in SPLIT:
            rows.write.mode("errorifexists").parquet(path)
            return [folder]
        column = SPLIT[name][0]
        dealt = rows.withColumn(column, self._split(name)).hint("rebalance", F.col(column))
        dealt.write.mode("errorifexists").partitionBy(column).parquet(path)
        return [f"{folder}/{part}" for part in versions.children(self.spark, path) if part.startswith(f"{column}=")]

    def _split(self, name: str) -> Column:
        if name == "precos":
            return F.date_format("validade_fim", "yyyy-MM")
        return name_bucket(F.col("nome_normalizado"), self.start.buckets)

    def append(self, name: str, df: DataFrame) -> None:
        written = self._write(df, name)
        self.folders.setdefault(name, []).extend(written)
        if written and "id" in schemas.empty_table(self.spark, name).columns:
            largest = _rows(self.spark, self.base, name, written).agg(F.max("id")).head()[0]
            self.last_ids[name] = max(filter(None, (largest, self.last_ids.get(name))), default=None)

    def rewrite(
        self, name: str, keys: DataFrame, update: Callable[[DataFrame], DataFrame], column: str = "id"
    ) -> int:
        """Replace the folders that hold a row whose ``column`` is in ``keys`` (first column) by their rows after ``update``.

        ``update`` gets all rows of these folders. All other folders stay as they are. To find the
        folders ``column`` alone is read, between the smallest and the largest key. Returns their number.
        """
        wanted = keys.select(F.col(keys.columns[0]).alias(column))
        low, high = wanted.agg(F.min(column), F.max(column)).head()
        if low is None:
            return 0
        rows = read_rows(self.spark, self.base, name, self.start).where(F.col(column).between(low, high))
        layout = _layout(name)
        found = rows.select(column, *layout).join(wanted, column, "left_semi").select(layout).distinct().collect()
        touched = {"/".join(_folder(key, row[key]) for key in layout) for row in found}  # a row per folder
        old = [f for f in self.folders.get(name, []) if f in touched]
        if old:
            before = _without_deleted(_rows(self.spark, self.base, name, old), self.base, name, self.start)
            after = update(before.select(schemas.empty_table(self.spark, name).columns))
            new = self._write(after, name)
            self.folders[name] = [f for f in self.folders[name] if f not in touched] + new
        return len(old)

    def replace_all(self, name: str) -> None:
        """Write the table anew, without its deleted rows, into as few folders as it is split by."""
        self.folders[name] = self._write(self.read(name), name)

    def delete(self, name: str, ids: DataFrame) -> None:
        """Hide the rows with these ids, and the rows of other tables that name them, until a compaction drops them."""
        folder = f"{DELETED}/{name}/{BATCH}={uuid.uuid4().hex}"
        rows = ids.select(F.col("id").cast("bigint").alias("id")).where("id is not null").distinct()
        rows.write.mode("errorifexists").parquet(f"{self.base}/{folder}")
        self.deleted.setdefault(name, []).append(folder)

    def commit(self) -> Version:
        new = replace(
            self.start, number=self.start.number + 1, folders=self.folders, deleted=self.deleted,
            last_ids=self.last_ids, streams=self.streams,
        )
        versions.commit(self.spark, self.base, new)
        return new


def _folder(column: str, value: object) -> str:
    return f"{column}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}"


def write_table(df: DataFrame, base: str, name: str) -> Version:
    """Append the rows to one table, as a version of its own."""
    change = Change(df.sparkSession, base)
    change.append(name, df)
    return change.commit()
