import pytest
from pyspark.sql import functions as F

from gondola.functions import pricing, text
from gondola.functions import sql as sql_functions
from gondola.operators import items


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).head()[0]


@pytest.mark.parametrize(
    "name, key",
    [
        ("COCA COLA LATA", "coca cola lata"),
        ("  Coca  Cola  Lata  ", "coca cola lata"),
        ("Café  Pilão\t500g", "café pilão 500g"),
        ("açúcar", "açúcar"),
        ("", ""),
        (None, None),
    ],
)
def test_normalize_name(spark, name, key):
    assert one(spark, name, text.normalize_name) == key
    sql_functions.register(spark)
    assert one(spark, name, lambda c: F.call_function("normalizar_nome", c)) == key


@pytest.mark.parametrize(
    "name, names",
    [
        ("Picanha OU Alcatra OU Contra Filé", ["Picanha", "Alcatra", "Contra Filé"]),
        ("Couve", ["Couve"]),
        ("  Couve ", ["  Couve "]),
        ("A ou ou B", ["A", "ou B"]),
        (" ou ", []),
        ("Couro", ["Couro"]),
        ("a Ou\nb", ["a", "b"]),
    ],
)
def test_split_alternatives(spark, name, names):
    assert one(spark, name, text.split_alternatives) == names


def test_expand_keeps_other_columns(spark):
    rows = spark.createDataFrame([(1, "a ou b"), (2, " ou "), (3, "c")], "k int, nome string")
    found = items.expand_alternatives(rows).orderBy("k", "alternativa").collect()
    assert [tuple(r) for r in found] == [(1, 1, "a"), (1, 2, "b"), (3, 1, "c")]


@pytest.mark.parametrize(
    "value, shown",
    [(1234.5, "R$ 1.234,50"), (0.0, "R$ 0,00"), (1234567.891, "R$ 1.234.567,89"), (-3.0, "R$ -3,00")],
)
def test_format_brl(spark, value, shown):
    assert one(spark, value, text.format_brl, "double") == shown


def test_ellipsis(spark):
    assert one(spark, "x" * 50, lambda c: text.ellipsis(c, 50)) == "x" * 50
    assert one(spark, "x" * 51, lambda c: text.ellipsis(c, 50)) == "x" * 47 + "..."
    assert one(spark, "ç" * 26, lambda c: text.ellipsis(c, 25)) == "ç" * 22 + "..."


def test_strip_takes_all_whitespace(spark):
    assert one(spark, " \n a b \t", text.strip) == "a b"


def test_contains_pattern_keeps_wildcards(spark):
    assert one(spark, "Arroz Branco", lambda c: text.contains_pattern(c, "ROZ b")) is True
    assert one(spark, "Arroz Branco", lambda c: text.contains_pattern(c, "a_roz%o")) is True
    assert one(spark, "Feijão", lambda c: text.contains_pattern(c, "arroz")) is False


@pytest.mark.parametrize(
    "name, fragment, found",
    [
        ("100% Cacau", r"100\%", True), ("100 Cacau", r"100\%", False), ("1000 Cacau", "100%cacau", True),
        ("a_b", r"A\_B", True), ("axb", r"a\_b", False), ("axb", "a_b", True),
        ("a\\b", r"a\\b", True), ("ab", r"a\\b", False), ("ab", r"a\b", True), ("a\\b", r"a\b", False),
        ("leite\\", "leite\\", True), ("leite em pó", "leite\\", False), ("leite%", "leite\\", False),
        ("x\\", "\\\\", True), ("x", "\\", False), ("x", "", True),
    ],
)
def test_backslash_in_a_fragment(spark, name, fragment, found):
    assert one(spark, name, lambda c: text.contains_pattern(c, fragment)) is found


def test_file_name(spark):
    assert one(spark, "/a/b/c.jpg", text.file_name) == "c.jpg"


def test_discount(spark):
    rows = spark.sql("SELECT cast(35.90 as decimal(10,2)) o, cast(29.90 as decimal(10,2)) p UNION ALL SELECT 0, 1")
    found = {float(r.o): r.d for r in rows.withColumn("d", pricing.discount_percent(F.col("o"), F.col("p"))).collect()}
    assert float(found[35.9]) == 16.71
    assert found[0.0] is None
