import datetime as dt
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gondola import fixed_values as fx
from gondola import schemas
from gondola.operators import answers, items
from gondola.session import prepare

OK = '{"nome":"a","preco":1}'


def table(spark, *texts):
    rows = [(f"{i}.jpg", f"/f/{i:03d}.jpg", text) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, schemas.RESPOSTAS)


def flyer(*products, **header):
    start = json.dumps(header)[1:-1]
    return "{" + (start + "," if start else "") + '"produtos":[' + ",".join(products) + "]}"


def test_parse(spark):
    texts = [
        '```json\n{"a": 1}\n```',
        'Segue: {"a": 1} fim',
        '{"a": 1} e {"b": 2}',
        "sem json",
        '{"a": ',
        '{"a": 1, "a": 2}',
        "} nada {",
        "```\n{\"a\": 1}\n```",
        None,
        "{'a': 1}",
        '{"a": 1} resto',
    ]
    got = answers.parse_answers(table(spark, *texts)).selectExpr("to_json(dados)", "erro").collect()
    assert [r[0] for r in got] == [
        '{"a":1}', '{"a":1}', None, None, None, '{"a":2}', None, '{"a":1}', None, None, '{"a":1}',
    ]
    assert [r[1] for r in got] == [
        None, None, "JSON inválido", "Nenhum JSON encontrado na resposta",
        "Nenhum JSON encontrado na resposta", None, "JSON inválido", None,
        "Nenhum JSON encontrado na resposta", "JSON inválido", None,
    ]


CASES = [
    ("{}", "Campo 'produtos' não encontrado"),
    ('{"produtos":"x"}', "Campo 'produtos' deve ser uma lista"),
    ('{"produtos":null}', "Campo 'produtos' deve ser uma lista"),
    ('{"produtos":{"nome":"a"}}', "Campo 'produtos' deve ser uma lista"),
    ('{"produtos":[]}', "Nenhum produto encontrado"),
    (flyer(OK, "5"), "Produto 2 não é um objeto"),
    (flyer(OK, "null"), "Produto 2 não é um objeto"),
    (flyer('{"preco":1}'), "Produto 1: campo 'nome' obrigatório"),
    (flyer('{"nome":"","preco":1}'), "Produto 1: campo 'nome' obrigatório"),
    (flyer('{"nome":null,"preco":1}'), "Produto 1: campo 'nome' obrigatório"),
    (flyer('{"nome":0,"preco":1}'), "Produto 1: campo 'nome' obrigatório"),
    (flyer('{"nome":"a"}'), "Produto 1: campo 'preco' obrigatório"),
    (flyer('{"nome":"a","preco":null}'), "Produto 1: preço inválido"),
    (flyer('{"nome":"a","preco":-1}'), "Produto 1: preço negativo"),
    (flyer('{"nome":"a","preco":"-1"}'), "Produto 1: preço negativo"),
    (flyer('{"nome":"a","preco":"29,90"}'), "Produto 1: preço inválido"),
    (flyer('{"nome":"a","preco":[1]}'), "Produto 1: preço inválido"),
    (flyer('{"nome":"a","preco":{"v":1}}'), "Produto 1: preço inválido"),
    (flyer('{"nome":"a","preco":"12.5"}'), None),
    (flyer('{"nome":"a","preco":" 1_000.5e-1 "}'), None),
    (flyer('{"nome":"a","preco":true}'), None),
    (flyer(OK, '{"nome":"","preco":1}', '{"nome":"x"}'), "Produto 2: campo 'nome' obrigatório"),
    ("[1, 2]", "Campo 'produtos' não encontrado"),
]


def test_validate(spark):
    checked = answers.validate(answers.parse_answers(table(spark, *(c[0] for c in CASES))))
    assert [r.invalido for r in checked.collect()] == [c[1] for c in CASES]


def test_header(spark):
    texts = [
        flyer(OK, data_validade_inicio="2025-1-5", data_validade_fim=None),
        flyer(OK, data_validade_inicio="2025-01-15x"),
        flyer(OK, data_validade_inicio="2025-02-30"),
        flyer(OK, data_validade_inicio="15/01/2025"),
        flyer(OK, data_validade_inicio=""),
        flyer(OK, data_validade_fim=20250101),
        flyer(OK, supermercado="Assaí"),
    ]
    read = answers.read_flyers(table(spark, *texts)).collect()
    assert read[0].validade_inicio == dt.date(2025, 1, 5) and read[0].validade_fim is None
    assert [r.erro for r in read] == [
        None,
        "unconverted data remains: x",
        "day is out of range for month",
        "time data '15/01/2025' does not match format '%Y-%m-%d'",
        None,
        "data não é texto",
        None,
    ]
    assert read[0].loja == "Desconhecido" and read[6].loja == "Assaí"
    given = answers.read_flyers(table(spark, *texts), override="Campeão").collect()
    assert {r.loja for r in given} == {"Campeão"}
    assert answers.read_flyers(table(spark, texts[6]), override="").head().loja == "Assaí"


def saved(spark, *texts):
    gated = items.gate_items(answers.read_flyers(table(spark, *texts)))
    return items.saved_items(gated, "nome_arquivo").orderBy("nome_arquivo", "pos", "alternativa").collect(), [
        r.erros for r in gated.orderBy("nome_arquivo").select("erros").collect()
    ]


def test_gate(spark):
    rows, errors = saved(
        spark,
        flyer('{"nome":"a","preco":"12.5"}', '{"nome":"b","preco":true}'),
        flyer('{"nome":"a ou b","preco":1e9}'),
        flyer('{"nome":["a"],"preco":1}', '{"nome":" ou ","preco":"1"}'),
        flyer('{"nome":"c","preco":1,"preco_original":"x"}', '{"nome":"d","preco":1,"confianca":12}'),
        flyer('{"nome":"a ou ' + "y" * 256 + ' ou b","preco":1}'),
        flyer('{"nome":"e","preco":1,"marca":"' + "m" * 101 + '"}'),
        flyer('{"nome":"f","preco":1,"em_promocao":"talvez"}', '{"nome":"g","preco":1,"em_promocao":"sim"}'),
    )
    long = "y" * 256
    # too long for a new product is no error yet: the product may exist (test_long_texts_are_refused_after_the_look_up)
    assert [(r.nome_arquivo, r.nome, r.gravar, r.longo, r.apos_longo) for r in rows] == [
        ("0.jpg", "b", True, False, False),
        ("1.jpg", "a", False, False, False),
        ("3.jpg", "c", False, False, False),
        ("3.jpg", "d", False, False, False),
        ("4.jpg", "a", True, False, False),
        ("4.jpg", long, True, True, False),
        ("4.jpg", "b", True, False, True),
        ("5.jpg", "e", True, True, False),
        ("6.jpg", "f", False, False, False),
        ("6.jpg", "g", False, False, False),
    ]
    assert str(rows[0].preco) == "1.00"
    assert errors[0] == ["Erro ao processar produto 1: preço não é número"]
    assert errors[1] == ["Erro ao processar produto 1: preco fora do limite"]
    assert errors[2] == ["Erro ao processar produto 1: nome não é texto"]
    assert errors[3] == [
        "Erro ao processar produto 1: preco_original não é número",
        "Erro ao processar produto 2: confianca fora do limite",
    ]
    assert errors[4] == errors[5] == []


@pytest.mark.parametrize(
    ("known", "names", "refused"),
    [
        (set(), ["a"], [("4.jpg", 1), ("5.jpg", 1)]),
        ({"y" * 256, "b"}, ["a", "b", "y" * 256], [("5.jpg", 1)]),
        ({"y" * 256, "e"}, ["a", "e", "y" * 256], [("4.jpg", 1)]),
    ],
)
def test_long_texts_are_refused_after_the_look_up(spark, known, names, refused):
    """Too long for a new product: an error unless the product exists; what follows in the item goes too."""
    texts = {
        "4.jpg": flyer('{"nome":"a ou ' + "y" * 256 + ' ou b","preco":1}'),
        "5.jpg": flyer('{"nome":"e","preco":1,"marca":"' + "m" * 101 + '"}'),
    }
    rows = spark.createDataFrame([(n, f"/f/{n}", x) for n, x in texts.items()], "nome_arquivo string, caminho_arquivo string, texto string")
    found = items.saved_items(items.gate_items(answers.read_flyers(rows)), "nome_arquivo")
    creates = ~F.col("longo") & ~F.col("apos_longo")
    saved, stops = items.refuse_new(found.withColumn("conhecido", creates | F.col("nome").isin(list(known))), "nome_arquivo", "conhecido")
    assert sorted(r.nome for r in saved.collect()) == names
    message = "Erro ao processar produto 1: texto maior que a coluna"
    assert sorted((r.nome_arquivo, r.pos, r.erro) for r in stops.collect()) == [(*r, message) for r in refused]


def test_gate_without_validation(spark):
    parsed = answers.read_header(
        answers.read_products(
            answers.parse_answers(
                table(spark, flyer('{"preco":1}', '{"nome":"a ou b","preco":null}', '{"nome":"c","preco":-1}'))
            )
        )
    )
    gated = items.gate_items(parsed)
    assert gated.head().erros == [
        "Produto 1: nome vazio",
        "Produto a: preço inválido",
        "Produto b: preço inválido",
        "Produto c: preço inválido",
    ]
    assert items.saved_items(gated, "nome_arquivo").count() == 0


def test_optional_fields(spark):
    rows, _ = saved(
        spark,
        flyer(
            '{"nome":"a","preco":0.615,"preco_original":0,"confianca":0}',
            '{"nome":"b","preco":1,"preco_original":"3.5","em_promocao":null}',
            '{"nome":"c","preco":1,"preco_original":"","confianca":"0","em_promocao":true}',
        ),
    )
    assert [(str(r.preco), r.preco_original and str(r.preco_original), r.em_promocao) for r in rows] == [
        ("0.62", None, False),
        ("1.00", "3.50", None),
        ("1.00", None, True),
    ]
    assert rows[0].confianca is None and str(rows[2].confianca) == "0.00"


def test_cheapest_keeps_list_order_on_ties(spark):
    text = flyer(*(f'{{"nome":"{n}","preco":{p}}}' for n, p in [("a", 3), ("b", 1), ("c", 2), ("d", 1)]))
    found = answers.cheapest_items(answers.read_flyers(table(spark, text))).orderBy("posto").collect()
    assert [r.nome for r in found] == ["b", "d", "c"]


names = st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs", "Cc")), min_size=1, max_size=20)
product = st.fixed_dictionaries(
    {"nome": names, "preco": st.integers(0, 10**9).map(lambda c: c / 100)},
    optional={"marca": st.none() | names, "em_promocao": st.booleans(), "unidade": names},
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(product, min_size=1, max_size=5), min_size=1, max_size=4))
def test_parse_reads_back_what_was_written(spark, flyers):
    texts = [json.dumps({"produtos": products}, ensure_ascii=False) for products in flyers]
    rows = answers.read_flyers(table(spark, *texts)).orderBy("caminho_arquivo").collect()
    for row, products in zip(rows, flyers):
        assert row.erro is None
        assert [(i.nome, i.preco, i.marca, i.em_promocao, i.unidade) for i in row.itens] == [
            (p["nome"], p["preco"], p.get("marca"), p.get("em_promocao"), p.get("unidade")) for p in products
        ]


@pytest.mark.parametrize("text", ['{"produtos":[]}] {x}', '{"produtos":[]}] sobra }', 'Veja: {"produtos":[1]}], fim}', '{"a":1},"w":{"b":2}', '{"a":1} {"b":2}'])
def test_text_after_the_document_is_an_error(spark, text):
    rows = spark.createDataFrame([("f", "/f", text)], schemas.RESPOSTAS)
    row = answers.parse_answers(rows).head()
    assert (row.dados, row.erro) == (None, fx.MSG_BAD_JSON)


def test_parsing_needs_the_duplicate_key_setting(spark):
    rows = spark.createDataFrame([("f", "/f", '{"a":1,"a":2}')], schemas.RESPOSTAS)
    spark.conf.unset("spark.sql.variant.allowDuplicateKeys")
    try:
        with pytest.raises(RuntimeError, match="allowDuplicateKeys"):
            answers.parse_answers(rows)
    finally:
        prepare(spark)
    assert answers.parse_answers(rows).select("dados").head() is not None
