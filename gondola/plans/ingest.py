"""Ingest: answers of any number of flyers -> log, stores, products and prices.

The texts are parsed once and the checked flyers staged; flyers are ordered by
path and then by their new id, products by list position, so "first occurrence"
is well defined also for a path that comes twice. Names are resolved per
distinct name, then joined back to the rows.

The result reads from stages; write it inside a ``session.scratch`` block and
they are deleted afterwards.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.functions.columns import compute_once
from gondola.functions.text import normalize_name
from gondola.operators.answers import read_flyers
from gondola.operators.dimensions import get_or_create_products, get_or_create_stores
from gondola.operators.ids import assign_ids
from gondola.operators.items import gate_items, refuse_new, saved_items
from gondola.operators.maintenance import log_flyers
from gondola.session import prepare

ITEM_ORDER = ["caminho_arquivo", "imagem_id", "pos", "alternativa"]


class Ingest(NamedTuple):
    """Rows to append to each table, and one row of figures per saved flyer."""

    imagens: DataFrame
    supermercados: DataFrame
    produtos: DataFrame
    precos: DataFrame
    stats: DataFrame


def ingest(
    answers: DataFrame,
    imagens: DataFrame,
    supermercados: DataFrame,
    produtos: DataFrame,
    precos: DataFrame,
    categorias: DataFrame,
    now: dt.datetime,
    store_override: str | None = None,
    largest: dict[str, DataFrame] | None = None,
    buckets: int | None = None,
) -> Ingest:
    """Ingest all flyers of ``answers`` on top of the stored tables.

    Of ``imagens`` and ``precos`` only the largest ``id`` is read. ``largest`` may give rows with
    the largest ids of ``supermercados`` and ``produtos``, which then need no scan for them.
    ``buckets``: how ``produtos`` is stored (``dimensions.products_named``). Prices are numbered
    once, when the resolved rows are staged; rows that are not saved leave gaps in their ids.
    """
    largest = largest or {}
    prepare(answers.sparkSession)
    checked = read_flyers(answers, store_override).drop("texto")
    flyers = assign_ids(gate_items(checked), imagens)
    sound = flyers.where(F.col("erro").isNull())

    stores, new_stores = get_or_create_stores(
        sound.select("loja", "caminho_arquivo", "id"), supermercados, ["caminho_arquivo", "id"], now,
        numbered=largest.get("supermercados"),
    )
    placed = sound.withColumn("chave", F.lower("loja")).join(
        stores.select("chave", "supermercado_id"), "chave", "left"
    )
    named = saved_items(sound, "caminho_arquivo", "id").withColumnRenamed("id", "imagem_id")
    keys, new_products = get_or_create_products(
        # what is too long for a new product, or comes after it, only finds existing ones
        named.withColumn("cria", ~F.col("longo") & ~F.col("apos_longo")),
        produtos,
        categorias,
        ITEM_ORDER,
        now,
        numbered=largest.get("produtos"),
        buckets=buckets,
    )
    items = saved_items(
        placed,
        "id", "nome_arquivo", "caminho_arquivo", "supermercado_id", "validade_inicio", "validade_fim",
    ).withColumnRenamed("id", "imagem_id")

    resolved = (
        compute_once(items, nome_normalizado=normalize_name(F.col("nome")))
        .join(keys, "nome_normalizado", "left")
        .withColumn(
            "novo", F.coalesce(F.struct(*ITEM_ORDER) == F.col("primeira"), F.lit(False))
        )
        # an item that cannot create must come after the one that does
        .withColumn(
            "conhecido",
            F.col("produto_id").isNotNull()
            & (F.col("primeira").isNull() | (F.struct(*ITEM_ORDER) >= F.col("primeira"))),
        )
        .drop("primeira", "nome_normalizado", "nome", "marca", "categoria")
        .withColumn("created_at", F.lit(now).cast("timestamp_ntz"))
    )
    saved, refused = refuse_new(assign_ids(resolved, precos), "imagem_id", "conhecido")
    return Ingest(
        log_flyers(flyers, now),
        new_stores,
        new_products,
        saved.where("gravar").drop(
            "gravar", "novo", "pos", "alternativa", "nome_arquivo", "caminho_arquivo",
            "longo", "apos_longo", "conhecido",
        ),
        ingest_stats(placed, saved, refused),
    )


def ingest_stats(flyers: DataFrame, rows: DataFrame, refused: DataFrame) -> DataFrame:
    """Figures per saved flyer; ``erros`` keeps the order of the product list.

    The message of a refused product replaces that of its price, which was not reached.
    """
    counts = rows.groupBy("imagem_id").agg(
        F.count_if("novo").alias("produtos_novos"),
        F.count_if(~F.col("novo")).alias("produtos_existentes"),
        F.count_if("gravar").alias("precos_salvos"),
    )
    late = refused.groupBy(F.col("imagem_id").alias("_imagem")).agg(
        F.collect_list(F.struct("pos", F.lit(0).alias("i"), "erro")).alias("_recusas")
    )
    positions = F.transform("_recusas", lambda r: r["pos"])
    errors = F.when(F.col("_recusas").isNull(), F.col("erros")).otherwise(
        F.transform(
            F.array_sort(
                F.concat(F.filter("erros_pos", lambda e: ~F.array_contains(positions, e["pos"])), "_recusas")
            ),
            lambda e: e["erro"],
        )
    )
    figures = ("produtos_novos", "produtos_existentes", "precos_salvos")
    joined = flyers.join(counts, flyers["id"] == counts["imagem_id"], "left").join(
        late, flyers["id"] == late["_imagem"], "left"
    )
    return joined.select(
        F.col("id").alias("imagem_id"),
        "nome_arquivo",
        "supermercado_id",
        "total_produtos",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in figures),
        errors.alias("erros"),
    )


def batch_summary(result: Ingest) -> DataFrame:
    """One row for the batch; flyers that failed count as images and errors only."""
    failed = F.count_if(F.col("erro_mensagem").isNotNull())
    images = result.imagens.agg(F.count("*").alias("imagens"), failed.alias("erros"))
    figures = ("total_produtos", "produtos_novos", "precos_salvos")
    sums = result.stats.agg(F.struct(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in figures)).alias("s"))
    return images.withColumn("_s", sums.scalar()).select("imagens", *(F.col(f"_s.{c}").alias(c) for c in figures), "erros")
