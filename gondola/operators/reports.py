"""The price and category reports.

Prices are the big table: they are filtered and, where the report allows it,
reduced per product and store before they meet the dimensions. No join is
hinted; Spark broadcasts a dimension only while its size is below the limit.
``ordered=False`` leaves out a report's final sort, for results that are
written rather than read from the top.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola import fixed_values as fx
from gondola.functions.pricing import discount_percent, valid_on
from gondola.functions.text import contains_pattern, ellipsis
from gondola.session import stage

LABEL_WIDTH = 50
NAME_WIDTH = 25
SEPARATOR = " | "


def _sorted(df: DataFrame, ordered: bool, *columns: Column) -> DataFrame:
    return df.orderBy(*columns) if ordered else df


def _products(produtos: DataFrame, *columns: str) -> DataFrame:
    return produtos.select(F.col("id").alias("produto_id"), *columns)


def _stores(supermercados: DataFrame) -> DataFrame:
    return supermercados.select(
        F.col("id").alias("supermercado_id"), F.col("nome").alias("supermercado")
    )


def best_prices(
    produtos: DataFrame,
    precos: DataFrame,
    supermercados: DataFrame,
    as_of: dt.date,
    ordered: bool = True,
) -> DataFrame:
    """Every price valid on ``as_of`` or open-ended, by product name and price."""
    offers = (
        precos.where(valid_on(as_of, F.col("validade_fim")))
        .select(
            "produto_id", "supermercado_id", "preco", "preco_original", "em_promocao",
            "validade_inicio", "validade_fim", "created_at",
        )
        .join(_products(produtos, "nome", "marca", "categoria"), "produto_id")
        .join(_stores(supermercados), "supermercado_id")
        .select(
            F.col("produto_id").alias("id"), "nome", "marca", "categoria", "preco",
            "preco_original", "em_promocao", "supermercado", "validade_inicio",
            "validade_fim", "created_at",
        )
    )
    # the trailing keys also let the range sort split a name many rows share
    return _sorted(
        offers, ordered, F.asc_nulls_last("nome"), F.asc_nulls_last("preco"), F.asc("id"),
        F.asc("created_at"),
    )


def store_stats(supermercados: DataFrame, precos: DataFrame) -> DataFrame:
    """Products, prices, average, extremes and promotions per store; empty stores stay."""
    totals = precos.groupBy("supermercado_id").agg(
        F.count_distinct("produto_id").alias("total_produtos"),
        F.count("*").alias("total_precos"),
        F.sum("preco").alias("_soma"),
        F.min("preco").alias("menor_preco"),
        F.max("preco").alias("maior_preco"),
        F.count_if(F.coalesce("em_promocao", F.lit(False))).alias("total_promocoes"),
    )
    stores = supermercados.select("id", "nome")
    return stores.join(totals, stores["id"] == totals["supermercado_id"], "left").select(
        "id",
        "nome",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total_produtos", "total_precos")),
        F.round(F.col("_soma").cast("double") / F.col("total_precos"), 6).alias("preco_medio"),
        "menor_preco",
        "maior_preco",
        F.coalesce("total_promocoes", F.lit(0)).alias("total_promocoes"),
    )


def _cheapest(precos: DataFrame, as_of: dt.date) -> DataFrame:
    return (
        precos.where(valid_on(as_of, F.col("validade_fim"), open_ended=False))
        .groupBy("produto_id", "supermercado_id")
        .agg(F.min("preco").alias("menor_preco"))
    )


def cheapest_by_category(
    produtos: DataFrame, precos: DataFrame, supermercados: DataFrame, as_of: dt.date,
    ordered: bool = True,
) -> DataFrame:
    """Lowest valid price per category, product name and store name."""
    grouped = (
        _cheapest(precos, as_of)
        .join(_products(produtos, "nome", "categoria"), "produto_id")
        .join(_stores(supermercados), "supermercado_id")
        .groupBy("categoria", "nome", "supermercado")
        .agg(F.min("menor_preco").alias("menor_preco"))
    )
    return _sorted(
        grouped, ordered, F.asc_nulls_last("categoria"), F.asc_nulls_last("menor_preco"), F.asc("nome"),
        F.asc("supermercado"),
    )


def cheapest_by_store(
    produtos: DataFrame, precos: DataFrame, supermercados: DataFrame, as_of: dt.date,
    ordered: bool = True,
) -> DataFrame:
    """Lowest valid price per product name and store name."""
    grouped = (
        _cheapest(precos, as_of)
        .join(_products(produtos, "nome"), "produto_id")
        .join(_stores(supermercados), "supermercado_id")
        .groupBy("nome", "supermercado")
        .agg(F.min("menor_preco").alias("preco"))
    )
    return _sorted(
        grouped, ordered, F.asc_nulls_last("preco"), F.asc("nome"), F.asc("supermercado")
    )


def top_cheapest(
    produtos: DataFrame, precos: DataFrame, supermercados: DataFrame, as_of: dt.date, limit: int = 10
) -> DataFrame:
    """The ``limit`` cheapest valid prices.

    Prices must name existing products and stores (``maintenance.foreign_key_violations``): the
    limit is taken before the dimensions are joined.
    """
    order = (F.asc_nulls_last("preco"), F.asc("id"))
    cheapest = (
        precos.where(valid_on(as_of, F.col("validade_fim"), open_ended=False))
        .select("id", "produto_id", "supermercado_id", "preco", "validade_fim")
        .orderBy(*order)
        .limit(limit)
    )
    return (
        cheapest.join(_products(produtos, "nome", "marca"), "produto_id")
        .join(_stores(supermercados), "supermercado_id")
        .orderBy(*order)
        .select("nome", "marca", "preco", "supermercado", "validade_fim")
    )


def active_promotions(
    produtos: DataFrame,
    precos: DataFrame,
    supermercados: DataFrame,
    as_of: dt.date,
    limit: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Valid promotions with their discount, largest first; an unknown discount leads.

    With a ``limit`` the prices must name existing products and stores: it is taken before
    they are joined.
    """
    order = (F.desc_nulls_first("desconto"), F.asc("id"))
    promotions = (
        precos.where(F.col("em_promocao") & valid_on(as_of, F.col("validade_fim"), open_ended=False))
        .select("id", "produto_id", "supermercado_id", "preco_original", "preco")
        .withColumn("desconto", discount_percent(F.col("preco_original"), F.col("preco")))
    )
    if limit is not None:
        promotions = promotions.orderBy(*order).limit(limit)
    promotions = promotions.join(_products(produtos, "nome"), "produto_id").join(
        _stores(supermercados), "supermercado_id"
    )
    return _sorted(promotions, ordered or limit is not None, *order).select(
        "nome", "supermercado", "preco_original", "preco", "desconto"
    )


def all_promotions(produtos: DataFrame, precos: DataFrame, ordered: bool = True) -> DataFrame:
    """All promotions, valid or not, without their store."""
    promotions = (
        precos.where("em_promocao")
        .select("id", "produto_id", "preco_original", "preco")
        .join(_products(produtos, "nome"), "produto_id")
        .withColumn("desconto", discount_percent(F.col("preco_original"), F.col("preco")))
    )
    return _sorted(promotions, ordered, F.desc_nulls_first("desconto"), F.asc("id")).select(
        "nome", "preco_original", "preco", "desconto"
    )


def price_history(
    produtos: DataFrame,
    precos: DataFrame,
    supermercados: DataFrame,
    fragment: str,
    limit: int | None = 20,
    ordered: bool = True,
) -> DataFrame:
    """Prices of the products whose name contains ``fragment``, newest first.

    With a ``limit`` the prices must name existing stores: it is taken before they are joined.
    """
    order = (F.desc_nulls_first("created_at"), F.desc("id"))
    wanted = produtos.where(contains_pattern(F.col("nome"), fragment)).select(
        F.col("id").alias("produto_id")
    )
    history = (
        precos.select(
            "id", "produto_id", "supermercado_id", "preco", "em_promocao", "validade_inicio", "created_at"
        )
        .join(wanted, "produto_id", "left_semi")
    )
    if limit is not None:
        history = history.orderBy(*order).limit(limit)
    history = history.join(_stores(supermercados), "supermercado_id")
    return _sorted(history, ordered or limit is not None, *order).select(
        "supermercado", "preco", "em_promocao", "validade_inicio", "created_at"
    )


def compare_stores(
    produtos: DataFrame, precos: DataFrame, supermercados: DataFrame, fragment: str, as_of: dt.date
) -> DataFrame:
    """Newest valid price per store for a name fragment, cheapest first and flagged.

    The newest prices, one per store, are staged: the flag and the rows come from one scan.
    """
    wanted = produtos.where(contains_pattern(F.col("nome"), fragment)).select(
        F.col("id").alias("produto_id")
    )
    newest = (
        precos.where(valid_on(as_of, F.col("validade_fim")))
        .select(
            "id", "produto_id", "supermercado_id", "preco", "em_promocao", "validade_fim", "created_at"
        )
        .join(wanted, "produto_id", "left_semi")
        .groupBy("supermercado_id")
        .agg(
            F.max_by(
                F.struct("preco", "em_promocao", "validade_fim"), F.struct("created_at", "id")
            ).alias("oferta")
        )
    )
    newest = stage(newest, "ofertas")
    best = newest.agg(
        F.min_by("supermercado_id", F.struct("oferta.preco", "supermercado_id"))
    ).scalar()
    return (
        newest.join(_stores(supermercados), "supermercado_id")
        .select(
            "supermercado_id",
            "supermercado",
            "oferta.*",
            (F.col("supermercado_id") == best).alias("melhor_preco"),
        )
        .orderBy("preco", "supermercado_id")
    )


def global_stats(
    produtos: DataFrame, supermercados: DataFrame, precos: DataFrame, imagens: DataFrame
) -> DataFrame:
    """One row: table sizes, mean price (0 without prices), promotions whatever their validity."""
    count = F.count("*")
    return precos.agg(
        produtos.agg(count).scalar().alias("total_produtos"),
        supermercados.agg(count).scalar().alias("total_supermercados"),
        count.alias("total_precos"),
        imagens.agg(count).scalar().alias("total_imagens"),
        F.coalesce(
            F.round(F.try_divide(F.sum("preco").cast("double"), F.count("preco")), 6), F.lit(0.0)
        ).alias("preco_medio"),
        F.count_if(F.coalesce("em_promocao", F.lit(False))).alias("total_promocoes"),
    )


def _top_groups(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    return (
        rows.groupBy(*keys)
        .agg(F.count("*").alias("quantidade"), F.count_distinct("nome").alias("nomes_distintos"))
        .orderBy(F.desc("quantidade"), *(F.asc_nulls_last(k) for k in keys))
        .limit(limit)
    )


def _of_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the given groups; null keys agree with null keys."""
    same = F.lit(True)
    for key in keys:
        same = same & rows[key].eqNullSafe(groups[key])
    return rows.join(groups.select(*keys), same, "left_semi")


def _suggestion_report(rows: DataFrame, keys: list[str], limit: int, width: int) -> DataFrame:
    """Largest groups of suggestions with a label of ``width`` characters from their product names.

    Only as many names of these groups as can show in the label are brought together: one may be
    empty, each further one adds at least a letter and a separator. ``row_number() <= k`` is cut
    per task before the shuffle.
    """
    top = _top_groups(rows, keys, limit)
    shown = width // (len(SEPARATOR) + 1) + 2
    names = _of_groups(rows, top, keys).select(*keys, "nome").distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("nome"))
    first = (
        names.withColumn("_posto", rank)
        .where(F.col("_posto") <= shown)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("nome")).alias("_nomes"))
    )
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"n.{key}").eqNullSafe(F.col(f"t.{key}"))
    label = ellipsis(F.array_join("_nomes", SEPARATOR), width)
    return (
        top.alias("t")
        .join(first.alias("n"), same)
        .select(
            *(F.col(f"t.{k}").alias(k) for k in keys),
            "quantidade",
            "nomes_distintos",
            label.alias("exemplos_produtos"),
        )
        .orderBy(F.desc("quantidade"), *(F.asc_nulls_last(k) for k in keys))
    )


def _names(rows: DataFrame, keys: list[str], limit: int | None) -> DataFrame:
    """All distinct names of the groups, or of the ``limit`` largest, one per row."""
    if limit is not None:
        rows = _of_groups(rows, _top_groups(rows, keys, limit), keys)
    return rows.groupBy(*keys, "nome").agg(F.count("*").alias("quantidade"))


def _unmapped(produtos: DataFrame) -> DataFrame:
    return produtos.where(
        F.col("categoria_sugerida").isNotNull() & (F.col("categoria") == fx.DEFAULT_CATEGORY)
    ).select("categoria_sugerida", "nome")


def _differs(produtos: DataFrame, category: Column) -> DataFrame:
    return produtos.where(
        F.lower(F.trim("categoria_sugerida")) != F.lower(F.trim(category))
    )


def unmapped_categories(produtos: DataFrame, limit: int = 20, width: int = LABEL_WIDTH) -> DataFrame:
    """Most frequent suggestions that ended in the default category, with a label of names."""
    return _suggestion_report(_unmapped(produtos), ["categoria_sugerida"], limit, width)


def unmapped_category_names(produtos: DataFrame, limit: int | None = None) -> DataFrame:
    """All distinct product names behind each unmapped suggestion, one per row.

    With the report's ``limit``, of the suggestions that ``unmapped_categories`` shows.
    """
    return _names(_unmapped(produtos), ["categoria_sugerida"], limit)


def _mapped(produtos: DataFrame) -> DataFrame:
    return _differs(produtos, F.coalesce("categoria", F.lit(""))).select(
        "categoria_sugerida", F.col("categoria").alias("categoria_mapeada"), "nome"
    )


def mapped_categories(produtos: DataFrame, limit: int = 20, width: int = LABEL_WIDTH) -> DataFrame:
    """Most frequent pairs of suggestion and differing category, with a label of names."""
    return _suggestion_report(_mapped(produtos), ["categoria_sugerida", "categoria_mapeada"], limit, width)


def mapped_category_names(produtos: DataFrame, limit: int | None = None) -> DataFrame:
    """As ``unmapped_category_names``, behind each pair of ``mapped_categories``."""
    return _names(_mapped(produtos), ["categoria_sugerida", "categoria_mapeada"], limit)


def mapped_labels(report: DataFrame) -> DataFrame:
    """``mapped_categories`` as it is printed: both category names cut to a column's width."""
    return report.select(
        ellipsis(F.col("categoria_sugerida"), NAME_WIDTH).alias("sugerida"),
        ellipsis(F.coalesce("categoria_mapeada", F.lit("N/A")), NAME_WIDTH).alias("mapeada"),
        "quantidade",
    )


def unmapped_examples(produtos: DataFrame, limit: int = 20, examples: int = 3) -> DataFrame:
    """Unmapped suggestions with their first ``examples`` distinct names; only names of the top ones are ranked."""
    rows = _unmapped(produtos)
    counts = (
        rows.groupBy("categoria_sugerida")
        .agg(F.count("*").alias("quantidade"))
        .orderBy(F.desc("quantidade"), "categoria_sugerida")
        .limit(limit)
    )
    rank = F.row_number().over(Window.partitionBy("categoria_sugerida").orderBy("nome"))
    first = (
        _of_groups(rows, counts, ["categoria_sugerida"])
        .distinct()
        .withColumn("_posto", rank)
        .where(F.col("_posto") <= examples)
        .groupBy("categoria_sugerida")
        .agg(F.array_join(F.array_sort(F.collect_list("nome")), ", ").alias("exemplos"))
    )
    return counts.join(first, "categoria_sugerida").orderBy(
        F.desc("quantidade"), "categoria_sugerida"
    )


def mapping_stats(produtos: DataFrame) -> DataFrame:
    """How well suggestions were mapped: count and percent per kind."""
    kind = (
        F.when(F.col("categoria") == fx.DEFAULT_CATEGORY, fx.MAPPING_UNMAPPED)
        .when(F.col("categoria_sugerida").isNull(), fx.MAPPING_NO_SUGGESTION)
        .when(
            F.lower(F.trim("categoria_sugerida")) == F.lower(F.trim("categoria")), fx.MAPPING_EXACT
        )
        .otherwise(fx.MAPPING_MAPPED)
    )
    total = F.sum("quantidade").over(Window.partitionBy())  # of at most four rows
    return (
        produtos.groupBy(kind.alias("tipo_mapeamento"))
        .agg(F.count("*").alias("quantidade"))
        .withColumn(
            "percentual",
            F.round(F.col("quantidade").cast("decimal(20,0)") * F.lit(100) / total, 2),
        )
        .orderBy(F.desc("quantidade"), "tipo_mapeamento")
    )


def remapped_products(produtos: DataFrame, limit: int = 50) -> DataFrame:
    """Newest products whose category differs from the suggestion; no category drops out."""
    return (
        _differs(produtos, F.col("categoria"))
        .select("id", "nome", "marca", "categoria_sugerida", "categoria", "created_at")
        .orderBy(F.desc_nulls_first("created_at"), F.desc("id"))
        .limit(limit)
        .select("nome", "marca", "categoria_sugerida", "categoria")
    )


def products_by_suggestion(produtos: DataFrame, suggestion: str, ordered: bool = True) -> DataFrame:
    """Products of one suggested category, newest first."""
    rows = produtos.where(F.col("categoria_sugerida") == suggestion)
    return _sorted(rows, ordered, F.desc_nulls_first("created_at"), F.desc("id")).select(
        "nome", "marca", "categoria", "created_at"
    )


def category_counts(categorias: DataFrame, produtos: DataFrame) -> DataFrame:
    """Products per category, empty categories included."""
    counts = produtos.groupBy("categoria_id").agg(F.count("*").alias("total_produtos"))
    return (
        categorias.join(counts, categorias["id"] == counts["categoria_id"], "left")
        .select(
            F.col("nome").alias("categoria"),
            "icone",
            F.coalesce("total_produtos", F.lit(0)).alias("total_produtos"),
        )
        .orderBy(F.desc("total_produtos"), "categoria")
    )
