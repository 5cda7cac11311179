import pytest
from pyspark.sql import functions as F

from gondola.operators import categories, reports

CATEGORIES = {
    "bebidas em pó": "Bebidas",
    "Produtos Gourmet": "Produtos Gourmet",
    "Carnes": "Carnes",
    "Alimentos": "Congelados",
    "Aguardente": "Bebidas",
    "Higiene e Limpeza": "Higiene Pessoal",
    "Frango Congelado": "Carnes",
    "a": "Bebidas",
    "  TEMPEROS ": "Molhos e Temperos",
    "": "",
    None: None,
}


def test_mapped_category(spark):
    rows = spark.createDataFrame([(n,) for n in CATEGORIES], "nome string")
    found = rows.select("nome", categories.mapped_category(F.col("nome")).alias("c")).collect()
    assert {r.nome: r.c for r in found} == CATEGORIES


def test_resolve_category(spark):
    rows = spark.createDataFrame(
        [(None,), ("",), (" ",), ("Carnes",), ("Produtos Gourmet",), ("vinhos finos",)], "s string"
    )
    table = categories.default_categories(spark)
    found = {r.s: (r.categoria_id, r.categoria) for r in categories.resolve_category(rows, table, "s").collect()}
    assert found == {
        None: (None, None),
        "": (None, ""),
        " ": (15, "Outros"),
        "Carnes": (3, "Carnes"),
        "Produtos Gourmet": (15, "Outros"),
        "vinhos finos": (2, "Bebidas Alcoólicas"),
    }
    given = categories.resolve_category(rows, table, "s", blank_is_default=True).collect()
    assert {r.s: r.categoria_id for r in given} == {
        None: 15, "": 15, " ": 15, "Carnes": 3, "Produtos Gourmet": 15, "vinhos finos": 2,
    }


def test_resolve_without_default_category(spark):
    rows = spark.createDataFrame([("Produtos Gourmet",), ("Carnes",)], "s string")
    table = categories.default_categories(spark).where("nome = 'Carnes'")
    found = {r.s: (r.categoria_id, r.categoria) for r in categories.resolve_category(rows, table, "s").collect()}
    assert found == {"Produtos Gourmet": (None, "Produtos Gourmet"), "Carnes": (3, "Carnes")}


@pytest.mark.parametrize("text, expected", [("Temperos", 6), ("Congelados", None), (None, 15), ("Frios", 4)])
def test_backfill(spark, text, expected):
    rows = spark.createDataFrame([(1, text, None), (2, text, 7)], "id int, categoria string, categoria_id int")
    found = categories.backfill_category(rows, categories.default_categories(spark)).orderBy("id").collect()
    assert [r.categoria_id for r in found] == [expected, 7]


def test_seed_only_what_is_missing(spark):
    stored = spark.createDataFrame(
        [(40, "Carnes", None, None), (41, "Pet", None, None)], "id int, nome string, descricao string, icone string"
    )
    rows = categories.seed_categories(stored).orderBy("id").collect()
    assert len(rows) == 16
    assert [(r.id, r.nome) for r in rows][:4] == [(40, "Carnes"), (41, "Pet"), (42, "Bebidas"), (43, "Bebidas Alcoólicas")]
    assert rows[-1].id == 55 and rows[-1].nome == "Outros"
    again = categories.seed_categories(categories.seed_categories(stored))
    assert again.count() == 16


def test_mapping_kinds(spark):
    rows = spark.createDataFrame(
        [(None, "Carnes"), ("Carnes", " carnes "), ("Outros", "x"), ("Bebidas", None)],
        "categoria string, categoria_sugerida string",
    )
    found = {r.tipo_mapeamento: (r.quantidade, float(r.percentual)) for r in reports.mapping_stats(rows).collect()}
    assert found == {"Mapeada": (1, 25.0), "Exata": (1, 25.0), "Não Mapeada": (1, 25.0), "Sem Sugestão": (1, 25.0)}


def test_label_needs_only_its_first_names(spark):
    names = [""] + [chr(97 + i) for i in range(26)]
    rows = spark.createDataFrame([("g", "Outros", n) for n in names], "categoria_sugerida string, categoria string, nome string")
    full = " | ".join(sorted(names))
    row = reports.unmapped_categories(rows).head()
    assert row.exemplos_produtos == full[:47] + "..."
    assert row.nomes_distintos == 27
    few = rows.where("nome in ('a', 'b')")
    assert reports.unmapped_categories(few).head().exemplos_produtos == "a | b"
