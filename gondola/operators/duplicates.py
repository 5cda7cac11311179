"""Duplicate products: detection, choice of the product to keep, merge.

Products are duplicates when they share a normalised name, so a group is fully
described by its key. Nothing here lists the pairs of a group or gathers its
members in one row: both grow without bound when one name is very frequent.
Groups are aggregates (combined before the shuffle) and members are rows.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola import fixed_values as fx
from gondola.functions.skew import per_key
from gondola.functions.text import normalize_name

FILLABLE = ("marca", "categoria_id", "codigo_barras", "descricao")


def _named(produtos: DataFrame) -> DataFrame:
    return produtos.where(F.col("nome_normalizado").isNotNull())


def duplicate_groups(produtos: DataFrame, ordered: bool = True) -> DataFrame:
    """Names held by several products: size, spellings, oldest and newest id, number of pairs."""
    groups = (
        _named(produtos)
        .groupBy("nome_normalizado")
        .agg(
            F.count("*").alias("quantidade_duplicatas"),
            F.count_distinct("nome").alias("nomes_originais"),
            F.min("id").alias("primeiro_id"),
            F.max("id").alias("ultimo_id"),
        )
        .where(F.col("quantidade_duplicatas") > 1)
        .withColumn(
            "pares",
            F.expr("quantidade_duplicatas * (quantidade_duplicatas - 1) div 2"),
        )
    )
    if ordered:
        groups = groups.orderBy(F.desc("quantidade_duplicatas"), "nome_normalizado")
    return groups


def duplicate_links(produtos: DataFrame, ordered: bool = True) -> DataFrame:
    """Each further product of a name beside the first (smallest id) product of that name.

    Two products are possible duplicates exactly when they are linked to the
    same first product, so the links carry all pairs in one row per product.
    """
    shown = ("id", "nome", "marca", "categoria")
    first = (
        _named(produtos)
        .groupBy("nome_normalizado")
        .agg(F.min_by(F.struct(*shown), "id").alias("p1"), F.count("*").alias("_n"))
        .where(F.col("_n") > 1)
    )
    links = (
        produtos.select("nome_normalizado", F.struct(*shown).alias("p2"))
        .join(per_key(first, "nome_normalizado"), "nome_normalizado")
        .where(F.col("p2.id") != F.col("p1.id"))
        .select(
            *(F.col(f"p1.{c}").alias(f"produto1_{c}") for c in shown),
            *(F.col(f"p2.{c}").alias(f"produto2_{c}") for c in shown),
            F.col("nome_normalizado").alias("nome_normalizado_comum"),
        )
    )
    if ordered:
        links = links.orderBy("nome_normalizado_comum", "produto1_id", "produto2_id")
    return links


def duplicate_group_count(produtos: DataFrame) -> DataFrame:
    """How many names (with and without the missing name) more than one product holds."""
    sizes = produtos.groupBy("nome_normalizado").agg(F.count("*").alias("n")).where("n > 1")
    return sizes.agg(
        F.count_if(F.col("nome_normalizado").isNotNull()).alias("grupos"),
        F.count("*").alias("grupos_com_nulo"),
    )


def require_unique_names(produtos: DataFrame) -> None:
    """Raise when any name is held by more than one product."""
    count = duplicate_group_count(produtos).head()["grupos"]
    if count:
        raise ValueError(f"Ainda existem {count} grupos de duplicatas")


def barcode_violations(produtos: DataFrame) -> DataFrame:
    """Bar codes, where filled, that more than one product holds."""
    return (
        produtos.where(F.col("codigo_barras") != "")
        .groupBy("codigo_barras")
        .agg(F.count("*").alias("quantidade"), F.min("id").alias("primeiro_id"))
        .where(F.col("quantidade") > 1)
    )


def quality_metrics(produtos: DataFrame) -> DataFrame:
    """The four quality figures as rows (metrica, valor), from one scan."""
    totals = produtos.agg(
        F.count("*").alias("total"),
        F.count("nome_normalizado").alias("normalizados"),
        F.count_if(F.coalesce(F.col("codigo_barras") != "", F.lit(False))).alias("com_codigo"),
        F.count_distinct("nome_normalizado").alias("distintos"),
    )
    labels = {
        "total": fx.METRIC_TOTAL,
        "normalizados": fx.METRIC_NORMALIZED,
        "com_codigo": fx.METRIC_BARCODE,
        "distintos": fx.METRIC_DISTINCT,
    }
    pairs = (
        F.struct(F.lit(text).alias("metrica"), F.col(column).cast("string").alias("valor"))
        for column, text in labels.items()
    )
    return totals.select(F.inline(F.array(*pairs)))


def _with_price_counts(produtos: DataFrame, precos: DataFrame) -> DataFrame:
    counts = precos.groupBy(F.col("produto_id").alias("id")).agg(F.count("*").alias("total_precos"))
    return produtos.join(counts, "id", "left").withColumn(
        "total_precos", F.coalesce("total_precos", F.lit(0))
    )


def duplicate_members(produtos: DataFrame, precos: DataFrame, ordered: bool = True) -> DataFrame:
    """The products of every duplicated name with their number of prices, oldest first."""
    names = _named(produtos).groupBy("nome_normalizado").agg(F.count("*").alias("_n"))
    members = _with_price_counts(produtos, precos).join(
        per_key(names.where("_n > 1"), "nome_normalizado"), "nome_normalizado"
    ).select(
        "nome_normalizado", "id", "nome", "marca", "categoria", "categoria_id",
        "categoria_sugerida", "codigo_barras", "descricao", "created_at", "total_precos",
    )
    if ordered:
        members = members.orderBy("nome_normalizado", "created_at", "id")
    return members


def _filled(column: str) -> Column:
    """Not NULL and not the empty value of its type."""
    empty = F.lit(0) if column == "categoria_id" else F.lit("")
    return F.col(column).isNotNull() & (F.col(column) != empty)


def merge_choices(produtos: DataFrame, precos: DataFrame) -> DataFrame:
    """Per duplicated name: the product to keep and the values its empty fields receive.

    Kept is the product with most prices, then most filled fields, then the
    oldest. An empty field receives the value of the newest other product that
    has one. One aggregation finds both: the kept product cannot contribute to
    a field it lacks.
    """
    filled = sum((_filled(c).cast("int") for c in FILLABLE), F.lit(0))
    age = F.unix_micros(F.col("created_at").cast("timestamp"))
    score = F.struct(F.col("total_precos"), filled, -age, -F.col("id"))
    latest = F.struct("created_at", "id")
    return (
        _with_price_counts(_named(produtos), precos)
        .groupBy("nome_normalizado")
        .agg(
            F.max_by("id", score).alias("principal_id"),
            F.count("*").alias("quantidade"),
            F.sum("total_precos").alias("precos"),
            F.max("total_precos").alias("precos_principal"),
            *(F.max_by(c, F.when(_filled(c), latest)).alias(f"novo_{c}") for c in FILLABLE),
        )
        .where(F.col("quantidade") > 1)
    )


def principal_products(produtos: DataFrame, choices: DataFrame) -> DataFrame:
    """The kept product of each duplicated name with its fields filled in."""
    kept = choices.select(
        F.col("principal_id").alias("id"), *(f"novo_{c}" for c in FILLABLE)
    )
    return produtos.join(kept, "id").select(
        "nome_normalizado",
        "id",
        *(F.when(_filled(c), F.col(c)).otherwise(F.coalesce(f"novo_{c}", c)).alias(c) for c in FILLABLE),
    )


def replacement_ids(produtos: DataFrame, choices: DataFrame) -> DataFrame:
    """Removed product id -> kept product id."""
    kept = choices.select("nome_normalizado", F.col("principal_id").alias("novo_id"))
    return (
        _named(produtos).select("nome_normalizado", F.col("id").alias("produto_id"))
        .join(per_key(kept, "nome_normalizado"), "nome_normalizado")
        .where(F.col("produto_id") != F.col("novo_id"))
        .select("produto_id", "novo_id")
    )


def move_prices(precos: DataFrame, replacements: DataFrame) -> DataFrame:
    """Point the prices of removed products to the product that was kept."""
    return (
        precos.join(replacements, "produto_id", "left")
        .withColumn("produto_id", F.coalesce("novo_id", "produto_id"))
        .select(*precos.columns)
    )


def merged_products(produtos: DataFrame, choices: DataFrame, now: dt.datetime) -> DataFrame:
    """Products without the removed ones, kept ones filled in and stamped when changed."""
    kept = choices.select(
        "nome_normalizado", "principal_id", *(f"novo_{c}" for c in FILLABLE)
    )
    joined = produtos.join(per_key(kept, "nome_normalizado"), "nome_normalizado", "left").where(
        F.col("principal_id").isNull() | (F.col("principal_id") == F.col("id"))
    )
    receives = {c: ~F.coalesce(_filled(c), F.lit(False)) & F.col(f"novo_{c}").isNotNull() for c in FILLABLE}
    changed = F.lit(False)
    for condition in receives.values():
        changed = changed | condition
    values = {c: F.when(receives[c], F.col(f"novo_{c}")).otherwise(F.col(c)) for c in FILLABLE}
    stamp = F.when(changed, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("updated_at"))
    return joined.withColumns({**values, "updated_at": stamp}).select(*produtos.columns)


def merge_stats(choices: DataFrame) -> DataFrame:
    """One row: merged groups, removed products, moved prices."""
    return choices.agg(
        F.count("*").alias("grupos_duplicados"),
        F.count("*").alias("produtos_mesclados"),
        F.coalesce(F.sum(F.col("quantidade") - 1), F.lit(0)).alias("produtos_removidos"),
        F.coalesce(F.sum(F.col("precos") - F.col("precos_principal")), F.lit(0)).alias(
            "precos_transferidos"
        ),
    )


class Merge(NamedTuple):
    produtos: DataFrame
    precos: DataFrame
    stats: DataFrame


def merge_duplicates(
    produtos: DataFrame, precos: DataFrame, now: dt.datetime, choices: DataFrame | None = None
) -> Merge:
    """Merge every duplicated name at once: new product and price tables, and the figures."""
    if choices is None:
        choices = merge_choices(produtos, precos)
    return Merge(
        merged_products(produtos, choices, now),
        move_prices(precos, replacement_ids(produtos, choices)),
        merge_stats(choices),
    )


def merge_group(produtos: DataFrame, precos: DataFrame, name: str, now: dt.datetime) -> Merge:
    """Merge the duplicates of one name only; all other rows stay as they are."""
    group = produtos.where(F.col("nome_normalizado") == normalize_name(F.lit(name)))
    used = precos.join(group.select(F.col("id").alias("produto_id")), "produto_id", "left_semi")
    return merge_duplicates(produtos, precos, now, merge_choices(group, used))
