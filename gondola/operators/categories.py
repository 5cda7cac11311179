"""Category rules.

The category map is a fixed list, so matching a suggestion is a column
expression over literals: no join, no shuffle, whatever the number of rows or
the most frequent suggestion. Only the look-up of the id joins the (small)
category table; its size decides whether Spark broadcasts it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola import fixed_values as fx
from gondola.functions.columns import compute_once
from gondola.functions.literals import literal_rows
from gondola.functions.skew import per_key
from gondola.functions.text import let, strip


def _literal_map(pairs: tuple[tuple[str, str], ...]) -> Column:
    return F.create_map(*(F.lit(text) for pair in pairs for text in pair))


def _literal_rules(pairs: tuple[tuple[str, str], ...]) -> Column:
    return F.array(
        *(F.struct(F.lit(key).alias("chave"), F.lit(value).alias("valor")) for key, value in pairs)
    )


def mapped_category(suggestion: Column, pairs: tuple[tuple[str, str], ...] = fx.CATEGORY_MAP) -> Column:
    """Exact key first, then the first key that contains or is contained; else unchanged."""

    def match(name: Column) -> Column:
        partial = F.filter(
            _literal_rules(pairs),
            lambda rule: F.contains(name, rule["chave"]) | F.contains(rule["chave"], name),
        )
        return F.coalesce(
            F.try_element_at(_literal_map(pairs), name), F.get(partial, F.lit(0))["valor"]
        )

    return F.when(suggestion == "", suggestion).otherwise(
        F.coalesce(let(strip(F.lower(suggestion)), match), suggestion)
    )


def _by_name(categorias: DataFrame) -> DataFrame:
    """One row per case-insensitive name: key, id, nome."""
    return (
        categorias.groupBy(F.lower("nome").alias("_chave"))
        .agg(F.min("id").alias("_id"), F.min_by("nome", "id").alias("_nome"))
    )


def find_category(rows: DataFrame, categorias: DataFrame, name: str) -> DataFrame:
    """Category by exact name, ignoring outer whitespace and case; blank finds nothing."""
    key = F.nullif(strip(F.lower(F.col(name))), F.lit(""))
    return (
        compute_once(rows, _pedida=key)
        .join(per_key(_by_name(categorias), "_chave"), F.col("_pedida") == F.col("_chave"), "left")
        .withColumn("categoria_id", F.col("_id").cast("int"))
        .withColumn("categoria_encontrada", F.col("_nome"))
        .drop("_chave", "_id", "_nome", "_pedida")
    )


def resolve_category(
    rows: DataFrame, categorias: DataFrame, suggestion: str, blank_is_default: bool = False
) -> DataFrame:
    """Add ``categoria_id`` and ``categoria`` for the suggested category of each row.

    A suggestion that maps to no known category gets the default category. An
    absent or empty suggestion stays uncategorised unless ``blank_is_default``;
    one made of spaces counts as given and gets the default category.
    """
    name = F.col(suggestion)
    given = F.lit(True) if blank_is_default else name.isNotNull() & (name != "")
    key = strip(F.lower(mapped_category(name)))
    default = _by_name(categorias).where(F.col("_chave") == fx.DEFAULT_CATEGORY.lower())
    default_id = default.select("_id").scalar()
    default_name = default.select("_nome").scalar()
    found = compute_once(rows, _pedida=F.when(strip(name) != "", key)).join(
        per_key(_by_name(categorias), "_chave"), F.col("_pedida") == F.col("_chave"), "left"
    )
    category_id = F.when(given, F.coalesce("_id", default_id))
    category = F.when(given, F.coalesce("_nome", default_name))
    return (
        found.withColumn("categoria_id", category_id.cast("int"))
        .withColumn("categoria", F.coalesce(category, name))
        .drop("_chave", "_id", "_nome", "_pedida")
    )


def backfill_category(produtos: DataFrame, categorias: DataFrame) -> DataFrame:
    """Give products without ``categoria_id`` the id their legacy category text stands for."""
    target = F.try_element_at(
        _literal_map(fx.LEGACY_CATEGORY_MAP), F.coalesce("categoria", F.lit(""))
    )
    ids = categorias.select(F.col("nome").alias("_nome"), F.col("id").cast("int").alias("_id"))
    return (
        produtos.join(ids, target == F.col("_nome"), "left")
        .withColumn("categoria_id", F.coalesce("categoria_id", "_id"))
        .drop("_nome", "_id")
    )


def seed_categories(existing: DataFrame) -> DataFrame:
    """``existing`` (id, nome, descricao, icone) plus the seed categories it lacks by name.

    New ids continue after the largest existing one, in seed order. The seed
    list is a constant, so ranking it in one window is bounded.
    """
    spark = existing.sparkSession
    seeds = literal_rows(
        spark,
        [(i, *seed) for i, seed in enumerate(fx.CATEGORIES)],
        ("ordem", "nome", "descricao", "icone"),
    )
    names = existing.select("nome").distinct()
    missing = seeds.join(names, "nome", "left_anti")
    earlier = F.sort_array(missing.agg(F.collect_list("ordem")).scalar())
    last = F.coalesce(existing.agg(F.max("id")).scalar(), F.lit(0))
    return existing.select("id", "nome", "descricao", "icone").union(
        missing.select(
            (last + F.array_position(earlier, F.col("ordem"))).cast("int"),
            "nome",
            "descricao",
            "icone",
        )
    )


def default_categories(spark: SparkSession) -> DataFrame:
    """The seed categories as a table, ids 1..n in seed order."""
    return literal_rows(
        spark,
        [(i, *seed) for i, seed in enumerate(fx.CATEGORIES, 1)],
        ("id", "nome", "descricao", "icone"),
    )
