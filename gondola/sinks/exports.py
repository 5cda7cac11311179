"""Exports: price list as CSV, flyer documents as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPORT_COLUMNS = (
    "produto", "marca", "categoria", "preco", "preco_original", "em_promocao", "supermercado",
    "validade_inicio", "validade_fim", "unidade", "created_at",
)


def export_rows(
    produtos: DataFrame, precos: DataFrame, supermercados: DataFrame, ordered: bool = True
) -> DataFrame:
    """All prices with product and store names, newest first."""
    rows = (
        precos.select(
            "id", "produto_id", "supermercado_id", "preco", "preco_original", "em_promocao",
            "validade_inicio", "validade_fim", "unidade", "created_at",
        )
        .join(
            produtos.select(
                F.col("id").alias("produto_id"), F.col("nome").alias("produto"), "marca", "categoria"
            ),
            "produto_id",
        )
        .join(
            supermercados.select(
                F.col("id").alias("supermercado_id"), F.col("nome").alias("supermercado")
            ),
            "supermercado_id",
        )
    )
    if ordered:
        rows = rows.orderBy(F.desc_nulls_first("created_at"), F.desc("id"))
    return rows.select(*EXPORT_COLUMNS)


def write_csv(rows: DataFrame, path: str) -> bool:
    """Write the export as CSV files in the order of the rows; nothing when there are none.

    Every file carries the header. Returns whether anything was written. The rows are computed once:
    whether there are any is seen from what was written, and an empty export is taken back.
    """
    spark = rows.sparkSession
    (
        rows.withColumn("em_promocao", F.initcap(F.col("em_promocao").cast("string")))
        .write.option("header", True)
        .option("encoding", "UTF-8")
        .option("escape", '"')
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )
    if not spark.read.option("header", True).csv(path, schema="produto string").isEmpty():
        return True
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return False


def write_json(flyers: DataFrame, path: str) -> None:
    """Flyer documents as JSON lines keyed by file name."""
    flyers.where(F.col("erro").isNull()).select("nome_arquivo", "dados").write.json(path)
