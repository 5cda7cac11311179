"""Updates, cascades and checks on the stored tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola import fixed_values as fx
from gondola.operators.dimensions import with_normalized_name


def log_flyers(flyers: DataFrame, now: dt.datetime) -> DataFrame:
    """Log rows for processed flyers: saved ones with their document, failed ones with the message."""
    failed = F.col("erro").isNotNull()

    def if_saved(value: str):
        return F.when(~failed, F.col(value))

    stamp = F.lit(now).cast("timestamp_ntz")
    return flyers.select(
        *(["id"] if "id" in flyers.columns else []),
        "nome_arquivo",
        "caminho_arquivo",
        if_saved("supermercado").alias("supermercado_nome"),
        if_saved("validade_inicio").alias("data_panfleto"),
        F.when(failed, fx.STATUS_ERROR).otherwise(fx.STATUS_DONE).alias("status"),
        if_saved("dados").alias("dados_json"),
        F.col("erro").alias("erro_mensagem"),
        stamp.alias("created_at"),
        stamp.alias("processed_at"),
    )


def update_flyer_log(imagens: DataFrame, updates: DataFrame, now: dt.datetime) -> DataFrame:
    """Set status, document and message of the flyers in ``updates`` (one row per id).

    The three values are overwritten as given, NULL included.
    """
    fields = ("status", "dados_json", "erro_mensagem")
    new = updates.select(
        "id", F.lit(True).alias("_novo"), *(F.col(f).alias(f"_{f}") for f in fields)
    )
    changed = F.col("_novo").isNotNull()
    joined = imagens.join(new, "id", "left")
    for field in fields:
        joined = joined.withColumn(field, F.when(changed, F.col(f"_{field}")).otherwise(F.col(field)))
    return joined.withColumn(
        "processed_at",
        F.when(changed, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("processed_at")),
    ).drop("_novo", *(f"_{f}" for f in fields))


def update_products(produtos: DataFrame, updates: DataFrame, now: dt.datetime) -> DataFrame:
    """Set the product fields given in ``updates`` (one row per id; NULL leaves a field alone).

    Every product named there gets a new ``updated_at``; its normalised name follows its name.
    """
    fields = [c for c in updates.columns if c != "id"]
    new = updates.select("id", F.lit(True).alias("_novo"), *(F.col(f).alias(f"_{f}") for f in fields))
    joined = produtos.join(new, "id", "left")
    for field in fields:
        joined = joined.withColumn(field, F.coalesce(f"_{field}", field))
    return with_normalized_name(joined).withColumn(
        "updated_at",
        F.when(F.col("_novo"), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("updated_at")),
    ).drop("_novo", *(f"_{f}" for f in fields))


def remove_with_prices(precos: DataFrame, **removed: DataFrame) -> DataFrame:
    """Prices left after deleting products, stores or flyers.

    ``removed`` maps the price column (``produto_id`` ...) to the deleted rows (``id``).
    """
    for column, rows in removed.items():
        precos = precos.join(rows.select(F.col("id").alias(column)), column, "left_anti")
    return precos


def foreign_key_violations(precos: DataFrame, **parents: DataFrame) -> DataFrame:
    """Per price column: how many prices name a missing parent, and how many distinct ones.

    Prices are counted per key before the join, so a hot parent is one row there. Each parent takes a scan
    of its one column: counts per combination of all parents would have nearly as many rows as there are prices.
    """
    reports = []
    for column, rows in parents.items():
        used = precos.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("id")).count()
        reports.append(
            used.join(rows.select("id"), "id", "left_anti").agg(
                F.lit(column).alias("coluna"),
                F.coalesce(F.sum("count"), F.lit(0)).alias("precos"),
                F.count("*").alias("ausentes"),
            )
        )
    report = reports[0]
    for other in reports[1:]:
        report = report.unionByName(other)
    return report


def admission_problem(produtos: DataFrame) -> DataFrame:
    """Add ``problema``: the first column whose value the stored table would refuse."""
    limits = {
        "nome": fx.MAX_PRODUCT_NAME,
        "marca": fx.MAX_BRAND,
        "categoria": fx.MAX_CATEGORY,
        "categoria_sugerida": fx.MAX_CATEGORY,
        "codigo_barras": fx.MAX_BARCODE,
    }
    rule = F.when(F.col("nome").isNull(), "nome nulo")
    for column, limit in limits.items():
        if column in produtos.columns:
            rule = rule.when(F.length(column) > limit, f"{column} com mais de {limit} caracteres")
    return produtos.withColumn("problema", rule)


def admit_prices(rows: DataFrame) -> DataFrame:
    """Type raw prices as stored and add ``problema`` for those that do not fit.

    Amounts are rounded half away from zero to the column's scale.
    """
    typed = {"preco": "decimal(10,2)", "preco_original": "decimal(10,2)", "confianca": "decimal(3,2)"}
    rule = F.when(F.col("preco").isNull(), "preco nulo")
    for column, kind in typed.items():
        rule = rule.when(
            F.col(column).isNotNull() & F.col(column).try_cast(kind).isNull(),
            f"{column} fora do limite",
        )
    rule = rule.when(
        F.length("unidade") > fx.MAX_UNIT, f"unidade com mais de {fx.MAX_UNIT} caracteres"
    )
    checked = rows.withColumn("problema", rule)
    return checked.withColumns({c: F.col(c).try_cast(k) for c, k in typed.items()})
