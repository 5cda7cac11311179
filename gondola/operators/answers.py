"""Raw answer text -> checked flyer document.

Everything here is a narrow projection: one answer row in, one flyer row out.
The product list of a flyer stays an array inside its row until
``items.saved_items`` explodes it, so checking a flyer costs no shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola import fixed_values as fx
from gondola.functions.columns import compute_once
from gondola.functions.text import let, strip

FENCE = "```"
FENCE_OPENER = r"```json\s*"
FENCE_CLOSER = r"```\s*$"
JSON_START = r"^[{\[\"\-0-9tfn]"
OUTERMOST_BRACES = r"(?s)\{.*\}"

NUMBER_TEXT = (
    r"(?U)^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"
)
SPECIAL_NUMBER_TEXT = r"(?iU)^\s*[+-]?(inf|infinity|nan)\s*$"
NEGATIVE_INFINITY_TEXT = r"(?iU)^\s*-inf(inity)?\s*$"

# year-month-day, zero padding optional; rules and messages follow Python's documented strptime
DATE_HEAD = r"^\d{4}-(1[0-2]|0[1-9]|[1-9])-(3[0-1]|[1-2]\d|0[1-9]|[1-9]| [1-9])"


def number_from_text(text: Column) -> Column:
    """Number written as text; NULL when the text is no finite number."""
    return F.when(
        text.rlike(NUMBER_TEXT), F.regexp_replace(text, r"(?U)[_\s]", "").try_cast("double")
    )


def is_number_text(text: Column) -> Column:
    return text.rlike(NUMBER_TEXT) | text.rlike(SPECIAL_NUMBER_TEXT)


DUPLICATE_KEYS = "spark.sql.variant.allowDuplicateKeys"


def _one_document(text: Column) -> Column:
    """Parse ``text`` as exactly one JSON value.

    It is parsed as the single element of a list and as the single value of an
    object: text after the document could close one of the two, not both.
    """
    elements = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>"
    )
    value = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = F.filter(F.array(elements), lambda e: F.size(e) == 1)
    return F.when(value.isNotNull(), F.get(F.get(alone, F.lit(0)), F.lit(0)))


def parse_answers(answers: DataFrame) -> DataFrame:
    """Add ``dados`` (VARIANT) and ``erro`` (text, NULL when parsed) to the answers.

    A repeated JSON key keeps its last value, which is a session setting; see ``session.prepare``.
    """
    if answers.sparkSession.conf.get(DUPLICATE_KEYS, "false") != "true":
        raise RuntimeError(f"set {DUPLICATE_KEYS}, or call gondola.session.prepare")
    unfenced = F.regexp_replace(F.regexp_replace("texto", FENCE_OPENER, ""), FENCE_CLOSER, "")
    clean = strip(F.when(F.contains("texto", F.lit(FENCE)), unfenced).otherwise(F.col("texto")))
    # prose before the document would only make the parser throw
    may_be_json = F.col("_limpo").rlike(JSON_START)
    whole = _one_document(F.col("_limpo"))
    braces = F.regexp_extract("_limpo", OUTERMOST_BRACES, 0)
    no_braces = ~F.contains("_limpo", F.lit("{")) | ~F.contains("_limpo", F.lit("}"))
    cleaned = compute_once(answers, _limpo=clean)
    return (
        compute_once(
            cleaned, dados=F.coalesce(F.when(may_be_json, whole), _one_document(braces))
        )
        .withColumn(
            "erro",
            F.when(F.col("dados").isNotNull(), None)
            .when(F.col("_limpo").isNull() | no_braces, fx.MSG_NO_JSON)
            .otherwise(fx.MSG_BAD_JSON),
        )
        .drop("_limpo")
    )


def _field(product: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(product, f"$.{name}", kind)


def _kind(product: Column, name: str) -> Column:
    """JSON type of a field: NULL if the key is absent, VOID for JSON null."""
    return F.schema_of_variant(_field(product, name))


PRODUCT_FIELDS = (
    "nome", "marca", "categoria", "preco", "preco_original", "em_promocao", "unidade",
    "descricao_adicional", "confianca",
)
_PRODUCT_OBJECT = "struct<" + ", ".join(f"{f}: variant" for f in PRODUCT_FIELDS) + ">"


def _read_product(product: Column, index: Column) -> Column:
    def typed(fields: Column) -> Column:
        def kind(name: str) -> Column:
            return F.schema_of_variant(fields[name])

        def value(name: str, wanted: str) -> Column:
            return F.try_variant_get(fields[name], "$", wanted)

        return F.struct(
            (index + 1).alias("pos"),
            fields.isNotNull().alias("objeto"),
            kind("nome").alias("nome_tipo"),
            value("nome", "string").alias("nome"),
            value("marca", "string").alias("marca"),
            value("categoria", "string").alias("categoria"),
            kind("preco").alias("preco_tipo"),
            value("preco", "string").alias("preco_texto"),
            value("preco", "double").alias("preco"),
            kind("preco_original").alias("original_tipo"),
            value("preco_original", "string").alias("original_texto"),
            value("preco_original", "double").alias("preco_original"),
            kind("em_promocao").alias("promocao_tipo"),
            value("em_promocao", "boolean").alias("em_promocao"),
            value("unidade", "string").alias("unidade"),
            value("descricao_adicional", "string").alias("descricao_adicional"),
            kind("confianca").alias("confianca_tipo"),
            value("confianca", "string").alias("confianca_texto"),
            value("confianca", "double").alias("confianca"),
        )

    return let(F.try_variant_get(product, "$", _PRODUCT_OBJECT), typed)


def name_is_empty(item: Column) -> Column:
    """Key absent, JSON null, or an empty value of any type."""
    kind = item["nome_tipo"]
    return (
        kind.isNull()
        | kind.isin("VOID", "ARRAY<VOID>", "OBJECT<>")
        | ((kind == "STRING") & (item["nome"] == ""))
        | F.coalesce(
            (kind != "STRING") & item["nome"].isin("false", "0", "0.0", "0E0"), F.lit(False)
        )
    )


def _product_problem(item: Column) -> Column:
    """First rule a product breaks, or NULL."""
    label = F.concat(F.lit("Produto "), item["pos"].cast("string"))
    kind, text = item["preco_tipo"], item["preco_texto"]
    from_text = kind == "STRING"
    negative = F.when(
        from_text, (number_from_text(text) < 0) | text.rlike(NEGATIVE_INFINITY_TEXT)
    ).otherwise(item["preco"] < 0)
    not_number = (
        (kind == "VOID")
        | kind.startswith("ARRAY<")
        | kind.startswith("OBJECT<")
        | (from_text & ~is_number_text(text))
    )
    return (
        F.when(~item["objeto"], F.concat(label, F.lit(" não é um objeto")))
        .when(name_is_empty(item), F.concat(label, F.lit(": campo 'nome' obrigatório")))
        .when(kind.isNull(), F.concat(label, F.lit(": campo 'preco' obrigatório")))
        .when(not_number, F.concat(label, F.lit(": preço inválido")))
        .when(negative, F.concat(label, F.lit(": preço negativo")))
    )


def read_products(parsed: DataFrame) -> DataFrame:
    """Add ``itens``, the typed product list, and ``_produtos`` for the list checks."""
    listed = F.try_variant_get("_produtos", "$", "array<variant>")
    return compute_once(
        parsed.withColumn("_produtos", F.try_variant_get("dados", "$.produtos", "variant")),
        itens=F.transform(listed, _read_product),
    )


def validate(parsed: DataFrame) -> DataFrame:
    """Add ``invalido``: the first broken rule of the flyer, NULL when it is sound."""
    problems = F.filter(F.transform("itens", _product_problem), lambda p: p.isNotNull())
    rules = (
        F.when(F.col("dados").isNull(), None)
        .when(F.col("_produtos").isNull(), fx.MSG_NO_PRODUCTS_KEY)
        .when(F.col("itens").isNull(), fx.MSG_PRODUCTS_NOT_LIST)
        .when(F.size("itens") == 0, fx.MSG_NO_PRODUCTS)
        .otherwise(F.get(problems, F.lit(0)))
    )
    return compute_once(read_products(parsed), invalido=rules).drop("_produtos")


def _date(text: Column) -> Column:
    return F.try_to_date(F.regexp_replace(text, " ", ""), "yyyy-M-d")


def _date_problem(kind: Column, text: Column) -> Column:
    rest = F.regexp_replace(text, DATE_HEAD, "")
    return (
        F.when(kind.isNull() | (kind == "VOID") | (text == ""), None)
        .when(kind != "STRING", "data não é texto")
        .when(
            ~text.rlike(DATE_HEAD),
            F.concat(
                F.lit("time data '"), text, F.lit("' does not match format '%Y-%m-%d'")
            ),
        )
        .when(rest != "", F.concat(F.lit("unconverted data remains: "), rest))
        .when(_date(text).isNull(), "day is out of range for month")
    )


def _with_store(doc: Column, store: str) -> Column:
    """The document with another store; what is no object stays as it is."""
    fields = F.try_variant_get(doc, "$", "map<string,variant>")
    name = F.create_map(F.lit("supermercado"), F.parse_json(F.lit(json.dumps(store))))
    others = F.map_filter(fields, lambda key, _: key != "supermercado")
    return F.coalesce(F.to_variant_object(F.map_concat(others, name)), doc)


def read_header(parsed: DataFrame, override: str | None = None) -> DataFrame:
    """Add store name, validity dates and ``cabecalho_erro`` (bad date, NULL when fine).

    ``override`` replaces the store of every flyer, also inside ``dados``; an empty one does not.
    ``loja`` is the name to look up: the store or, without one, the default.
    """
    if override:
        parsed = parsed.withColumn("dados", _with_store(F.col("dados"), override))
    doc = F.col("dados")
    start, end = "data_validade_inicio", "data_validade_fim"
    store = F.coalesce(
        F.nullif(F.lit(override).cast("string"), F.lit("")), _field(doc, "supermercado", "string")
    )
    return (
        parsed.withColumn("supermercado", store)
        .withColumn("loja", F.coalesce(F.nullif("supermercado", F.lit("")), F.lit(fx.DEFAULT_STORE)))
        .withColumn(
            "cabecalho_erro",
            F.coalesce(
                _date_problem(_kind(doc, start), _field(doc, start, "string")),
                _date_problem(_kind(doc, end), _field(doc, end, "string")),
                F.when(
                    F.length("loja") > fx.MAX_STORE_NAME,
                    f"nome do supermercado com mais de {fx.MAX_STORE_NAME} caracteres",
                ),
            ),
        )
        .withColumn("validade_inicio", _date(_field(doc, start, "string")))
        .withColumn("validade_fim", _date(_field(doc, end, "string")))
    )


def read_flyers(answers: DataFrame, override: str | None = None) -> DataFrame:
    """All flyer checks in order; ``erro`` holds the message of the first that failed."""
    checked = read_header(validate(parse_answers(answers)), override)
    return checked.withColumn(
        "erro",
        F.coalesce(
            "erro",
            F.concat(F.lit("Dados inválidos: "), F.col("invalido")),
            "cabecalho_erro",
        ),
    ).drop("invalido", "cabecalho_erro")


def cheapest_items(flyers: DataFrame, count: int = 3) -> DataFrame:
    """The ``count`` cheapest products inside each flyer; ties keep list order.

    Sorts the list inside the flyer's row: no shuffle, no window.
    """
    ranked = F.slice(
        F.array_sort(
            F.transform(
                "itens",
                lambda it: F.struct(
                    F.coalesce(it["preco"], F.lit(float("inf"))).alias("ordem"),
                    it["pos"].alias("pos"),
                    it["nome"].alias("nome"),
                    it["preco"].alias("preco"),
                ),
            )
        ),
        1,
        count,
    )
    return (
        flyers.where(F.col("erro").isNull())
        .select("nome_arquivo", F.posexplode_outer(ranked).alias("_i", "it"))
        .where(F.col("it").isNotNull())
        .select(
            "nome_arquivo",
            (F.col("_i") + 1).alias("posto"),
            F.col("it.nome").alias("nome"),
            F.col("it.preco").alias("preco"),
        )
    )
