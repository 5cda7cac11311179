"""Products and stores: look-up, get-or-create, upsert.

"Newest" and "first" are taken by ``max_by`` / ``min_by``, which combine on the
map side, so a name that a third of the rows share is reduced before the
shuffle. Joins back to the rows have one row per key on the other side and go
through ``per_key``, so adaptive execution can split a hot key's partition.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions.columns import compute_once
from gondola.functions.skew import per_key
from gondola.functions.text import normalize_name
from gondola.operators.categories import resolve_category
from gondola.operators.ids import assign_ids
from gondola.schemas import NAME_BUCKET, name_bucket
from gondola.session import stage

_FOUND = ("id", "nome", "marca", "categoria", "categoria_id", "created_at")


def with_normalized_name(produtos: DataFrame) -> DataFrame:
    return produtos.withColumn("nome_normalizado", normalize_name(F.col("nome")))


def _recency() -> Column:
    return F.struct("created_at", "id")


def latest_products(produtos: DataFrame) -> DataFrame:
    """One row per normalised name: the newest product as struct ``produto``."""
    return (
        produtos.where(F.col("nome_normalizado").isNotNull())
        .groupBy("nome_normalizado")
        .agg(F.max_by(F.struct(*_FOUND), _recency()).alias("produto"))
    )


def lookup_products(requests: DataFrame, produtos: DataFrame, name: str = "nome") -> DataFrame:
    """Add ``produto_id`` of the newest product with the same normalised name."""
    latest = per_key(
        latest_products(produtos).select(
            F.col("nome_normalizado").alias("_chave"), F.col("produto.id").alias("produto_id")
        ),
        "_chave",
    )
    asked = compute_once(requests, _pedido=normalize_name(F.col(name)))
    return asked.join(latest, F.col("_pedido") == F.col("_chave"), "left").drop("_chave", "_pedido")


def latest_by_brand(produtos: DataFrame) -> DataFrame:
    """One row per normalised name and brand (ignoring case): the newest product as struct ``produto``."""
    return (
        produtos.where(F.col("nome_normalizado").isNotNull())
        .groupBy("nome_normalizado", F.lower("marca").alias("_marca"))
        .agg(F.max_by(F.struct(*_FOUND), _recency()).alias("produto"))
    )


def lookup_products_by_brand(
    requests: DataFrame, produtos: DataFrame, name: str = "nome", brand: str = "marca"
) -> DataFrame:
    """As ``lookup_products``, but a product of another brand does not count.

    A missing brand on either side matches any. Per name and brand only the
    newest product can win, so the answer is the newest of at most two rows
    found by equality: the request never meets all products of its name.
    """
    by_brand = latest_by_brand(produtos)
    recency = F.struct("produto.created_at", "produto.id")
    by_name = by_brand.groupBy(F.col("nome_normalizado").alias("_nome")).agg(
        F.max_by("produto", recency).alias("_qualquer"),
        F.max_by("produto", F.when(F.col("_marca").isNull(), recency)).alias("_sem_marca"),
    )
    branded = by_brand.where(F.col("_marca").isNotNull()).select(
        F.col("nome_normalizado").alias("_nome_m"), "_marca", F.col("produto").alias("_da_marca")
    )
    asked = compute_once(
        requests, _pedido=normalize_name(F.col(name)), _marca_pedida=F.lower(F.col(brand))
    )
    key = F.col("_pedido")
    joined = asked.join(per_key(by_name, "_nome"), key == F.col("_nome"), "left").join(
        per_key(branded, "_nome_m", "_marca"),
        (key == F.col("_nome_m")) & (F.col("_marca_pedida") == F.col("_marca")),
        "left",
    )

    def newer(left: str, right: str) -> Column:
        l, r = F.col(left), F.col(right)
        take_left = r.isNull() | (
            F.struct(l["created_at"], l["id"]) > F.struct(r["created_at"], r["id"])
        )
        return F.when(l.isNotNull() & take_left, l).otherwise(r)

    chosen = F.when(F.col(brand).isNull(), F.col("_qualquer")).otherwise(
        newer("_da_marca", "_sem_marca")
    )
    return joined.withColumn("produto", chosen).drop(
        "_nome", "_nome_m", "_marca", "_qualquer", "_sem_marca", "_da_marca", "_pedido", "_marca_pedida"
    )


def create_products(
    rows: DataFrame, produtos: DataFrame, categorias: DataFrame, now: dt.datetime, order_by: list[Column]
) -> DataFrame:
    """New product rows (nome, marca, categoria and optional columns) with ids and category."""
    resolved = resolve_category(
        rows.withColumnRenamed("categoria", "categoria_sugerida"), categorias, "categoria_sugerida"
    )
    stamped = with_normalized_name(resolved).withColumns(
        {"created_at": F.lit(now).cast("timestamp_ntz"), "updated_at": F.lit(now).cast("timestamp_ntz")}
    )
    return assign_ids(stamped, produtos, order_by)


def products_named(produtos: DataFrame, names: DataFrame, buckets: int | None = None) -> DataFrame:
    """Products whose normalised name is among ``names`` (staged, one row per name).

    Only these go on to the comparison, so a small batch does not shuffle a large product table.
    Where the table is stored in ``buckets`` of the name, only the buckets the names fall in are read;
    their numbers, at most ``buckets`` integers, are all that reaches the driver.
    """
    if buckets and NAME_BUCKET in produtos.columns:
        needed = names.select(name_bucket(F.col("nome_normalizado"), buckets).alias("b")).distinct().collect()
        produtos = produtos.where(F.col(NAME_BUCKET).isin([row.b for row in needed]))
    return produtos.join(names.select("nome_normalizado"), "nome_normalizado", "left_semi")


def get_or_create_products(
    items: DataFrame,
    produtos: DataFrame,
    categorias: DataFrame,
    order: list[str],
    now: dt.datetime,
    numbered: DataFrame | None = None,
    buckets: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Resolve item names to products.

    New ids continue after the largest in ``numbered``, by default in ``produtos``. ``buckets``: see
    ``products_named``.

    Returns (keys, new): ``keys`` has one row per normalised name with
    ``produto_id`` and ``primeira``, the position that created the product (NULL
    where it existed before); ``new`` are the product rows to append. The first
    item in ``order`` gives a new product its name, brand and category. Items
    with a false ``cria`` (all create without that column) find products but
    create none; a name only they have, and that no product has, is in no key.
    """
    position = F.struct(*order)
    creates = F.col("cria") if "cria" in items.columns else F.lit(True)
    able = F.when(creates, position)
    firsts = stage(
        compute_once(items, nome_normalizado=normalize_name(F.col("nome")))
        .groupBy("nome_normalizado")
        .agg(
            F.min_by(F.struct("nome", "marca", "categoria"), able).alias("item"),
            F.min(able).alias("primeira"),
        ),
        "nomes",
    )
    existing = latest_products(products_named(produtos, firsts, buckets)).select(
        "nome_normalizado", F.col("produto.id").alias("_existente")
    )
    keys = stage(firsts.join(existing, "nome_normalizado", "left"), "chaves")
    new = create_products(
        keys.where(F.col("_existente").isNull() & F.col("primeira").isNotNull()).select("item.*", "primeira"),
        produtos if numbered is None else numbered,
        categorias,
        now,
        [F.col("primeira")],
    )
    known = keys.where(F.col("_existente").isNotNull()).select(
        "nome_normalizado",
        F.col("_existente").alias("produto_id"),
        F.lit(None).cast(keys.schema["primeira"].dataType).alias("primeira"),
    )
    created = new.select("nome_normalizado", F.col("id").alias("produto_id"), "primeira")
    return known.unionByName(created), new.drop("primeira")


def get_or_create_stores(
    flyers: DataFrame, supermercados: DataFrame, order: list[str], now: dt.datetime, name: str = "loja",
    numbered: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """As ``get_or_create_products`` for stores: same name ignoring case, smallest id wins."""
    position = F.struct(*order)
    firsts = flyers.groupBy(F.lower(name).alias("chave")).agg(
        F.min_by(name, position).alias("nome"), F.min(position).alias("primeira")
    )
    existing = supermercados.groupBy(F.lower("nome").alias("chave")).agg(
        F.min("id").alias("_existente")
    )
    keys = stage(firsts.join(existing, "chave", "left"), "lojas")
    new = assign_ids(
        keys.where(F.col("_existente").isNull()).select(
            "chave", "nome", "primeira", F.lit(now).cast("timestamp_ntz").alias("created_at")
        ),
        supermercados if numbered is None else numbered,
        [F.col("primeira")],
    )
    known = keys.where(F.col("_existente").isNotNull()).select(
        "chave",
        F.col("_existente").alias("supermercado_id"),
        F.lit(None).cast(keys.schema["primeira"].dataType).alias("primeira"),
    )
    created = new.select("chave", F.col("id").alias("supermercado_id"), "primeira")
    return known.unionByName(created), new.drop("primeira", "chave")


def upsert_stores(
    supermercados: DataFrame,
    incoming: DataFrame,
    now: dt.datetime,
    order: str = "ordem",
    numbered: DataFrame | None = None,
) -> DataFrame:
    """Insert stores, or overwrite ``rede`` where name, city and state all agree.

    New ids continue after the largest in ``numbered``, by default in ``supermercados``.

    A NULL city or state never agrees with anything, so such rows are always
    added. Among several incoming rows of one store the last ``rede`` counts,
    also when it is NULL.
    """
    keys = ("nome", "cidade", "estado")
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    merged = (
        incoming.where(complete)
        .groupBy(*keys)
        .agg(F.max_by("rede", order).alias("_rede"), F.min(order).alias(order))
    )
    stored = supermercados.join(
        merged.select(*keys, "_rede", F.lit(True).alias("_achado")), list(keys), "left"
    ).select(
        "id",
        *keys,
        F.when(F.col("_achado"), F.col("_rede")).otherwise(F.col("rede")).alias("rede"),
        "created_at",
    )
    added = merged.join(supermercados.select(*keys), list(keys), "left_anti").select(
        *keys, F.col("_rede").alias("rede"), order
    )
    always = incoming.where(~complete).select(*keys, "rede", order)
    new = assign_ids(added.unionByName(always), supermercados if numbered is None else numbered, [F.col(order)])
    return stored.unionByName(
        new.select("id", *keys, "rede", F.lit(now).cast("timestamp_ntz").alias("created_at"))
    )
