"""Products of a flyer -> rows to save, with the errors of those that cannot be saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola import fixed_values as fx
from gondola.functions.columns import compute_once
from gondola.functions.skew import per_key
from gondola.functions.text import let, split_alternatives
from gondola.operators.answers import is_number_text, name_is_empty, number_from_text


def explode_products(flyers: DataFrame) -> DataFrame:
    """One row per product of the list, ``pos`` counting from 1."""
    return (
        flyers.select("nome_arquivo", F.explode_outer("itens").alias("it"))
        .where(F.col("it").isNotNull())
        .select("nome_arquivo", "it.*")
    )


def expand_alternatives(rows: DataFrame, name: str = "nome") -> DataFrame:
    """One row per alternative named in ``name``; the other columns are repeated."""
    others = [c for c in rows.columns if c != name]
    return rows.select(
        *others, F.posexplode_outer(split_alternatives(F.col(name))).alias("_alt", name)
    ).where(F.col("_alt").isNotNull()).select(*others, (F.col("_alt") + 1).alias("alternativa"), name)


def optional_number(kind: Column, text: Column, number: Column) -> Column:
    """Empty values (null, zero, '', false) become NULL, numbers and number texts a double."""
    value = F.when(kind == "STRING", number_from_text(text)).otherwise(number)
    return F.when(kind.isNull() | (text == ""), None).otherwise(
        F.when((kind == "STRING") | (value != 0), value)
    )


def _optional_problem(field: str, kind: Column, text: Column, value: Column, limit: int) -> Column:
    broken = (
        (kind.startswith("ARRAY<") & (kind != "ARRAY<VOID>"))
        | (kind.startswith("OBJECT<") & (kind != "OBJECT<>"))
        | ((kind == "STRING") & (text != "") & ~is_number_text(text))
    )
    return F.when(broken, F.lit(f"{field} não é número")).when(
        F.abs(F.round(value, 2)) >= limit, F.lit(f"{field} fora do limite")
    )


def promotion_flag(kind: Column, value: Column) -> Column:
    """An absent key means no promotion; an explicit null stays NULL."""
    return F.when(kind.isNull(), F.lit(False)).when(
        kind.isin("BOOLEAN", "STRING"), value
    )


def _promotion_problem(kind: Column, value: Column) -> Column:
    return F.when(
        ~kind.isin("VOID", "BOOLEAN", "STRING") | ((kind == "STRING") & value.isNull()),
        F.lit("em_promocao não é booleano"),
    )


def _gate(item: Column) -> Column:
    """Decide what of one product can be saved.

    ``nomes`` are the alternatives to save, ``longos`` tells which of them cannot
    become a new product (a text longer than its column), ``gravar`` says whether
    their price is stored too, ``erros`` are the messages. A failure while storing
    the price comes after the product was looked up or created, so that product
    stays and the remaining alternatives are given up.
    """
    prefix = F.concat(F.lit("Erro ao processar produto "), item["pos"].cast("string"), F.lit(": "))
    no_names = F.array().cast("array<string>")
    kind = item["preco_tipo"]
    price_not_number = (
        (kind == "STRING") | kind.startswith("ARRAY<") | kind.startswith("OBJECT<")
    )
    bad_price = kind.isNull() | (kind == "VOID") | (item["preco"] < 0)
    # outcome of the checks that come before the price is stored
    early = (
        F.when(name_is_empty(item), "sem nome")
        .when(item["nome_tipo"] != "STRING", "nome")
        .when(price_not_number, "tipo do preco")
        .when(bad_price, "preco")
    )
    too_long = F.coalesce(
        (F.length(item["marca"]) > fx.MAX_BRAND)
        | (F.length(item["categoria"]) > fx.MAX_CATEGORY),
        F.lit(False),
    )
    numbers = F.struct(
        optional_number(
            item["original_tipo"], item["original_texto"], item["preco_original"]
        ).alias("original"),
        optional_number(
            item["confianca_tipo"], item["confianca_texto"], item["confianca"]
        ).alias("confianca"),
        split_alternatives(F.coalesce(item["nome"], F.lit(""))).alias("nomes"),
        early.alias("cedo"),
    )

    def check(n: Column) -> Column:
        late = F.coalesce(
            _optional_problem(
                "preco_original", item["original_tipo"], item["original_texto"], n["original"],
                fx.PRICE_LIMIT,
            ),
            _optional_problem(
                "confianca", item["confianca_tipo"], item["confianca_texto"], n["confianca"],
                fx.CONFIDENCE_LIMIT,
            ),
            F.when(F.round(item["preco"], 2) >= fx.PRICE_LIMIT, F.lit("preco fora do limite")),
            _promotion_problem(item["promocao_tipo"], item["em_promocao"]),
            F.when(
                F.length(item["unidade"]) > fx.MAX_UNIT,
                F.lit(f"unidade com mais de {fx.MAX_UNIT} caracteres"),
            ),
        )
        return let(F.struct(late.alias("tarde")), lambda c: decide(n, c))

    def decide(n: Column, c: Column) -> Column:
        names, late = n["nomes"], c["tarde"]
        errors = (
            F.when(
                n["cedo"] == "sem nome",
                F.array(
                    F.concat(F.lit("Produto "), item["pos"].cast("string"), F.lit(": nome vazio"))
                ),
            )
            .when(n["cedo"] == "nome", F.array(F.concat(prefix, F.lit("nome não é texto"))))
            .when(F.size(names) == 0, no_names)
            .when(
                n["cedo"] == "tipo do preco", F.array(F.concat(prefix, F.lit("preço não é número")))
            )
            .when(
                n["cedo"] == "preco",
                F.transform(
                    names, lambda x: F.concat(F.lit("Produto "), x, F.lit(": preço inválido"))
                ),
            )
            .when(late.isNotNull(), F.array(F.concat(prefix, late)))
            .otherwise(no_names)
        )
        count = F.when(n["cedo"].isNotNull(), F.lit(0)).when(late.isNotNull(), F.lit(1)).otherwise(F.size(names))
        kept = F.slice(names, F.lit(1), count)
        return F.struct(
            item["pos"].alias("pos"),
            kept.alias("nomes"),
            F.transform(kept, lambda x: too_long | (F.length(x) > fx.MAX_PRODUCT_NAME)).alias("longos"),
            late.isNull().alias("gravar"),
            errors.alias("erros"),
            item["marca"].alias("marca"),
            item["categoria"].alias("categoria"),
            item["preco"].alias("preco"),
            n["original"].alias("preco_original"),
            promotion_flag(item["promocao_tipo"], item["em_promocao"]).alias("em_promocao"),
            item["unidade"].alias("unidade"),
            item["descricao_adicional"].alias("descricao_adicional"),
            n["confianca"].alias("confianca"),
        )

    return let(numbers, check)


def gate_items(flyers: DataFrame) -> DataFrame:
    """Replace ``itens`` by the gated list and add the ordered messages ``erros``.

    ``total_produtos`` counts the products of the list before any expansion.
    Flyers that failed as a whole get NULL lists. Names too long for a new
    product are judged later, when it is known which products exist.
    """
    sound = F.col("erro").isNull()
    gated = compute_once(
        flyers.withColumn("total_produtos", F.when(sound, F.size("itens"))),
        itens=F.when(sound, F.transform("itens", _gate)),
    )
    return gated.withColumn(
        "erros_pos",
        F.flatten(
            F.transform(
                "itens",
                lambda it: F.transform(
                    it["erros"], lambda e, i: F.struct(it["pos"].alias("pos"), i.alias("i"), e.alias("erro"))
                ),
            )
        ),
    ).withColumn("erros", F.transform("erros_pos", lambda e: e["erro"]))


def refuse_new(resolved: DataFrame, flyer: str, known: str) -> tuple[DataFrame, DataFrame]:
    """Split rows with a look-up result into (saved, refused).

    ``known`` tells whether the row's product exists when its turn comes. The first
    alternative that would need a new product but is too long for one ends its item;
    ``refused`` has that flyer and position once, with the message.
    """
    missing = F.when(~F.col(known), F.col("alternativa"))
    stops = (
        resolved.where("longo or apos_longo")
        .groupBy(flyer, "pos")
        .agg(F.min(missing).alias("_fim"))
        .where(F.col("_fim").isNotNull())
    )
    stops = per_key(stops, flyer, "pos")
    message = F.concat(
        F.lit("Erro ao processar produto "), F.col("pos").cast("string"), F.lit(": texto maior que a coluna")
    )
    saved = resolved.join(stops, [flyer, "pos"], "left").where("_fim is null or alternativa < _fim").drop("_fim")
    return saved, stops.select(flyer, "pos", message.alias("erro"))


def saved_items(gated: DataFrame, *keep: str) -> DataFrame:
    """One row per alternative to save, with the ``keep`` columns of its flyer.

    Prices are typed here: DECIMAL(10,2) and DECIMAL(3,2), rounding half up.
    ``longo``: no new product can be made of it; ``apos_longo``: an earlier
    alternative of the same product is like that.
    """
    return (
        gated.select(*keep, F.explode_outer("itens").alias("it"))
        .select(*keep, "it", F.posexplode_outer(F.arrays_zip("it.nomes", "it.longos")).alias("_alt", "_nome"))
        .where(F.col("_nome").isNotNull())
        .select(
            *keep,
            F.col("it.pos").alias("pos"),
            (F.col("_alt") + 1).alias("alternativa"),
            F.col("_nome.nomes").alias("nome"),
            F.col("_nome.longos").alias("longo"),
            F.exists(F.slice("it.longos", F.lit(1), F.col("_alt")), lambda x: x).alias("apos_longo"),
            F.col("it.marca").alias("marca"),
            F.col("it.categoria").alias("categoria"),
            F.col("it.preco").try_cast("decimal(10,2)").alias("preco"),
            F.col("it.preco_original").try_cast("decimal(10,2)").alias("preco_original"),
            F.col("it.em_promocao").alias("em_promocao"),
            F.col("it.unidade").alias("unidade"),
            F.col("it.descricao_adicional").alias("descricao_adicional"),
            F.col("it.confianca").try_cast("decimal(3,2)").alias("confianca"),
            F.col("it.gravar").alias("gravar"),
        )
    )
