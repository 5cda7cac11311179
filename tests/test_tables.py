import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gondola import schemas, session
from gondola.operators import dimensions, duplicates, maintenance, reports
from gondola.operators.categories import default_categories
from gondola.operators.ids import assign_ids
from gondola.plans.ingest import batch_summary, ingest
from gondola.plans.stored import ingest_into, merge_stored
from gondola.sinks import exports
from gondola.sources import images
from gondola.sources.answers import read_answer_files
from gondola.sources.tables import read_table, read_valid_prices, write_table
from gondola.streaming.incremental import start_ingest

NOW = dt.datetime(2025, 10, 15, 12, 0)


def products(spark, *rows):
    """(id, nome, marca, created minute) and further columns by name."""
    base = [
        {
            "id": r[0], "nome": r[1], "marca": r[2],
            "created_at": dt.datetime(2025, 1, 1, 0, r[3]), "updated_at": dt.datetime(2025, 1, 1, 0, r[3]),
            **(r[4] if len(r) > 4 else {}),
        }
        for r in rows
    ]
    schema = schemas.empty_table(spark, "produtos").schema
    data = [tuple(b.get(f.name) for f in schema.fields) for b in base]
    return dimensions.with_normalized_name(spark.createDataFrame(data, schema)).select(*schema.names)


def prices(spark, *pairs):
    rows = [(i, p, 1, 1, str(v)) for i, (p, v) in enumerate(pairs, 1)]
    raw = spark.createDataFrame(rows, "id bigint, produto_id bigint, supermercado_id bigint, imagem_id bigint, preco string")
    return schemas.conform(raw, "precos")


@pytest.mark.parametrize("parts", [1, 7])
def test_ids_are_dense_and_ordered(spark, parts):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(parts)
    existing = spark.createDataFrame([(5,), (41,)], "id bigint")
    found = assign_ids(rows, existing, [F.col("k")]).orderBy("id").collect()
    assert [(r.id, r.k) for r in found] == [(42 + i, i) for i in range(1000)]
    loose = assign_ids(rows, existing.where("id < 0"))
    assert sorted(r.id for r in loose.collect()) == list(range(1, 1001))


def test_lookup_by_brand_matches_brute_force(spark):
    brands = [None, "A", "a", "B"]
    rows = [(i, ["Arroz", " ARROZ ", "Feijão"][i % 3], brands[i * 7 % 4], i * 11 % 60) for i in range(40)]
    table = products(spark, *rows)
    asked = [(n, b) for n in ("arroz", "FEIJÃO", "sal") for b in (None, "A", "b", "C")]
    requests = spark.createDataFrame(asked, "nome string, marca string")
    got = {
        (r.nome, r.marca): r.produto and r.produto.id
        for r in dimensions.lookup_products_by_brand(requests, table).collect()
    }

    def expected(name, brand):
        fits = [
            r for r in rows
            if r[1].strip().lower() == name.lower()
            and (brand is None or r[2] is None or r[2].lower() == brand.lower())
        ]
        return max(fits, key=lambda r: (r[3], r[0]))[0] if fits else None

    assert got == {key: expected(*key) for key in asked}


def test_store_upsert(spark):
    stored = spark.createDataFrame(
        [(1, "A", None, None, "r0"), (2, "B", "X", "SP", "r1")],
        "id bigint, nome string, cidade string, estado string, rede string",
    ).withColumn("created_at", F.lit(NOW).cast("timestamp_ntz"))
    incoming = spark.createDataFrame(
        [("A", None, None, "n1", 1), ("A", None, None, "n2", 2), ("B", "X", "SP", "n3", 3), ("B", "X", "SP", None, 4),
         ("C", "X", "SP", "n5", 5), ("C", "X", "SP", "n6", 6)],
        "nome string, cidade string, estado string, rede string, ordem int",
    )
    found = dimensions.upsert_stores(stored, incoming, NOW).orderBy("id").collect()
    assert [(r.id, r.nome, r.rede) for r in found] == [
        (1, "A", "r0"), (2, "B", None), (3, "A", "n1"), (4, "A", "n2"), (5, "C", "n6"),
    ]


def test_merge(spark):
    table = products(
        spark,
        (1, "Arroz", None, 0),
        (2, "ARROZ ", "X", 1, {"descricao": "d2"}),
        (3, "arroz", "Y", 2, {"codigo_barras": "", "categoria_id": 3}),
        (4, "Feijão", "Z", 3),
        (5, "Sal", None, 4),
        (6, "SAL", None, 4),
        (7, "Óleo", None, 9),
        (8, "óleo", "M", 10),
    )
    facts = prices(spark, (1, 1), (1, 2), (2, 3), (4, 4), (6, 5), (5, 6), (7, 1), (8, 1))
    merge = duplicates.merge_duplicates(table, facts, NOW)
    kept = {r.id: r for r in merge.produtos.collect()}
    assert set(kept) == {1, 4, 5, 8}
    assert (kept[1].marca, kept[1].descricao, kept[1].categoria_id) == ("Y", "d2", 3)
    assert kept[1].updated_at == NOW and kept[4].updated_at != NOW and kept[5].updated_at != NOW
    assert {r.id: r.produto_id for r in merge.precos.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 8, 8: 8}
    assert merge.stats.head().asDict() == {
        "grupos_duplicados": 3, "produtos_mesclados": 3, "produtos_removidos": 4, "precos_transferidos": 3,
    }
    assert duplicates.duplicate_group_count(merge.produtos).head()[0] == 0
    duplicates.require_unique_names(merge.produtos)
    with pytest.raises(ValueError):
        duplicates.require_unique_names(table)


def test_links_give_all_pairs(spark):
    table = products(spark, *((i, ["a", "A ", "b"][i % 3], None, i) for i in range(12)), (20, "só", None, 30))
    rows = [(r.id, r.nome_normalizado) for r in table.collect()]
    pairs = {(x[0], y[0]) for x in rows for y in rows if x[1] == y[1] and x[0] < y[0]}
    links = duplicates.duplicate_links(table).collect()
    groups = {}
    for link in links:
        groups.setdefault(link.produto1_id, {link.produto1_id}).add(link.produto2_id)
    assert {(a, b) for g in groups.values() for a in g for b in g if a < b} == pairs
    assert sum(r.pares for r in duplicates.duplicate_groups(table).collect()) == len(pairs)


def test_maintenance(spark):
    facts = prices(spark, (1, 1), (2, 2), (None, 3), (9, 4))
    ids = spark.createDataFrame([(1,), (2,)], "id bigint")
    assert maintenance.foreign_key_violations(facts, produto_id=ids).head().asDict() == {
        "coluna": "produto_id", "precos": 1, "ausentes": 1,
    }
    left = maintenance.remove_with_prices(facts, produto_id=ids.where("id = 1"))
    assert sorted(r.id for r in left.collect()) == [2, 3, 4]
    table = products(spark, (1, "a" * 256, None, 0), (2, "b", "m" * 101, 0), (3, "c", None, 0, {"codigo_barras": "1" * 14}), (4, "d", None, 0))
    found = maintenance.admission_problem(table).orderBy("id").collect()
    assert [bool(r.problema) for r in found] == [True, True, True, False]


def answers_of(spark, flyers):
    rows = [(f"{i}.jpg", f"/f/{i:03d}.jpg", json.dumps(f, ensure_ascii=False)) for i, f in enumerate(flyers)]
    return spark.createDataFrame(rows, schemas.RESPOSTAS)


FLYERS = [
    {"supermercado": "Assaí", "produtos": [{"nome": "Arroz ou Feijão", "preco": 5, "categoria": "grãos"}, {"nome": "ARROZ", "preco": 6}]},
    {"supermercado": "ASSAÍ", "produtos": [{"nome": " feijão ", "preco": 7, "marca": "B"}, {"nome": "Sal", "preco": "1"}]},
    {"produtos": []},
    {"produtos": [{"nome": "Picanha", "preco": 50, "categoria": "Churrasco"}, {"nome": "Sal", "preco": 2, "marca": "C"}]},
]


def run_ingest(spark, answers, state=None):
    state = state or {n: schemas.empty_table(spark, n) for n in ("imagens", "supermercados", "produtos", "precos")}
    return ingest(
        answers, state["imagens"], state["supermercados"], state["produtos"], state["precos"], default_categories(spark), NOW
    )


def test_ingest(spark):
    result = run_ingest(spark, answers_of(spark, FLYERS))
    found = {r.id: r for r in result.produtos.collect()}
    assert [(i, found[i].nome, found[i].marca, found[i].categoria) for i in sorted(found)] == [
        (1, "Arroz", None, "Mercearia"), (2, "Feijão", None, "Mercearia"), (3, "Picanha", None, "Outros"), (4, "Sal", "C", None),
    ]
    assert [(r.id, r.nome) for r in result.supermercados.orderBy("id").collect()] == [(1, "Assaí"), (2, "Desconhecido")]
    stats = {r.nome_arquivo: r for r in result.stats.collect()}
    assert set(stats) == {"0.jpg", "1.jpg", "3.jpg"}
    first = stats["0.jpg"]
    assert (first.total_produtos, first.produtos_novos, first.produtos_existentes, first.precos_salvos) == (2, 2, 1, 3)
    assert stats["1.jpg"].erros == ["Erro ao processar produto 2: preço não é número"]
    assert stats["1.jpg"].supermercado_id == 1
    log = {r.nome_arquivo: r.erro_mensagem for r in result.imagens.collect()}
    assert log["2.jpg"] == "Dados inválidos: Nenhum produto encontrado" and log["0.jpg"] is None
    assert sorted(r.id for r in result.imagens.collect()) == [1, 2, 3, 4]
    assert sorted(r.id for r in result.precos.collect()) == [1, 2, 3, 4, 5, 6]
    assert batch_summary(result).head().asDict() == {
        "imagens": 4, "total_produtos": 6, "produtos_novos": 4, "precos_salvos": 6, "erros": 1,
    }


def test_ingest_again_creates_nothing(spark):
    answers = answers_of(spark, FLYERS)
    first = run_ingest(spark, answers)
    state = {n: schemas.conform(getattr(first, n), n) for n in ("imagens", "supermercados", "produtos", "precos")}
    again = run_ingest(spark, answers, state)
    assert again.produtos.count() == 0 and again.supermercados.count() == 0
    assert min(r.id for r in again.precos.collect()) == 7
    assert {r.produtos_novos for r in again.stats.collect()} == {0}


def test_ingest_does_not_depend_on_partitions(spark):
    def outcome(parts, shuffle):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        flyers = [
            {"supermercado": f"Loja {i % 3}", "produtos": [{"nome": f"P{(i * k) % 11}", "marca": f"m{i}", "preco": k} for k in range(1, 5)]}
            for i in range(30)
        ]
        result = run_ingest(spark, answers_of(spark, flyers).repartition(parts))
        rows = sorted(tuple(r) for r in result.produtos.select("id", "nome", "marca").collect())
        facts = sorted(tuple(r) for r in result.precos.select("produto_id", "supermercado_id", "preco").collect())
        spark.conf.set("spark.sql.shuffle.partitions", before)
        return rows, facts

    assert outcome(1, "1") == outcome(9, "64")


def test_csv(spark, tmp_path):
    table = products(spark, (1, 'Arroz "T"', None, 0))
    stores = spark.createDataFrame([(1, "Loja; Á")], "id bigint, nome string")
    facts = prices(spark, (1, "12.5")).withColumn("em_promocao", F.lit(True)).withColumn(
        "created_at", F.lit(NOW).cast("timestamp_ntz")
    )
    rows = exports.export_rows(table, facts, stores)
    assert exports.write_csv(rows, str(tmp_path / "csv"))
    text = "".join(p.read_text("utf-8") for p in (tmp_path / "csv").glob("*.csv"))
    assert text.splitlines() == [
        ",".join(exports.EXPORT_COLUMNS),
        '"Arroz ""T""",,,12.50,,True,Loja; Á,,,,2025-10-15 12:00:00',
    ]
    assert not exports.write_csv(rows.where("preco < 0"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_folder(spark, tmp_path):
    for name in ("a.jpg", "b.JPG", "c.Jpg", "d.webp", "e.txt", "f", "g.png.txt"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "h.jpg").write_bytes(b"x")
    found = images.list_folder(spark, str(tmp_path))
    assert sorted(r.nome_arquivo for r in found.collect()) == ["a.jpg", "b.JPG", "d.webp"]
    with pytest.raises(NotADirectoryError):
        images.list_folder(spark, str(next(p for p in tmp_path.iterdir() if p.is_file())))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        images.list_folder(spark, str(tmp_path / "x"))


def test_answer_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("```json\n{}\n```")
    row = read_answer_files(spark, str(tmp_path)).head()
    assert (row.nome_arquivo, row.texto) == ("a.txt", "```json\n{}\n```")


def test_stored_prices_are_pruned_by_month(spark, tmp_path):
    facts = prices(spark, (1, 1), (2, 2), (3, 3)).withColumn(
        "validade_fim", F.when(F.col("id") < 3, F.make_date(F.lit(2025), F.col("id").cast("int"), F.lit(10)))
    )
    write_table(facts, str(tmp_path), "precos")
    found = read_valid_prices(spark, str(tmp_path), dt.date(2025, 2, 1))
    assert sorted(r.id for r in found.collect()) == [2, 3]
    assert read_valid_prices(spark, str(tmp_path / "none"), dt.date(2025, 2, 1)).count() == 0


def test_store_without_prices_stays(spark):
    stores = spark.createDataFrame([(1, "A"), (2, "B")], "id bigint, nome string")
    found = {r.id: r for r in reports.store_stats(stores, prices(spark, (1, 1), (1, 3))).collect()}
    assert (found[2].total_precos, found[2].preco_medio, found[2].total_promocoes) == (0, None, 0)
    assert (found[1].total_produtos, found[1].total_precos, found[1].preco_medio) == (1, 2, 2.0)


def test_global_stats_of_nothing(spark):
    empty = {n: schemas.empty_table(spark, n) for n in schemas.TABLES}
    row = reports.global_stats(empty["produtos"], empty["supermercados"], empty["precos"], empty["imagens"]).head()
    assert row.asDict() == {
        "total_produtos": 0, "total_supermercados": 0, "total_precos": 0, "total_imagens": 0,
        "preco_medio": 0.0, "total_promocoes": 0,
    }


def test_labels_of_another_width_and_names_of_the_top(spark):
    rows = [(f"nome {i:02d}", "Xis") for i in range(30)] + [("só um", "Ipsilon")]
    table = spark.createDataFrame(rows, "nome string, categoria_sugerida string").withColumn("categoria", F.lit("Outros"))
    joined = " | ".join(f"nome {i:02d}" for i in range(30))
    for width in (12, 50, 120):
        first = reports.unmapped_categories(table, limit=1, width=width).collect()[0]
        assert (first.quantidade, first.exemplos_produtos) == (30, joined[: width - 3] + "...")
    assert reports.unmapped_category_names(table, limit=1).count() == 30
    assert reports.unmapped_category_names(table).count() == 31
    assert reports.mapped_category_names(table, limit=1).count() == 30


def test_scratch_must_be_configured_and_is_freed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_root", lambda spark: str(tmp_path / "scratch"))
    table = products(spark, (1, "Arroz", None, 0), (2, "arroz", "X", 1))
    write_table(table, str(tmp_path / "v2"), "produtos")
    write_table(prices(spark, (1, 1), (2, 2)), str(tmp_path / "v2"), "precos")
    assert merge_stored(spark, str(tmp_path / "v2"), NOW).stats.produtos_removidos == 1
    assert read_table(spark, str(tmp_path / "v2"), "precos").count() == 2
    answer = '{"supermercado":"A","produtos":[{"nome":"Arroz","preco":1}]}'
    spark.createDataFrame([("f", "/f", answer)], schemas.RESPOSTAS).write.parquet(str(tmp_path / "in"))
    start_ingest(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"), NOW).awaitTermination()
    assert read_table(spark, str(tmp_path / "t"), "precos").count() == 1
    answers = spark.read.schema(schemas.RESPOSTAS).parquet(str(tmp_path / "in"))
    assert ingest_into(spark, str(tmp_path / "t"), answers, NOW).precos_salvos == 1
    assert list((tmp_path / "scratch" / "gondola").iterdir()) == []
    monkeypatch.undo()

    class Bare:
        conf = sparkContext = type("", (), {"get": staticmethod(lambda *_: None), "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(Bare)


def test_a_path_that_comes_twice_creates_once(spark):
    text = '{"supermercado":"A","produtos":[{"nome":"Arroz","marca":"%s","preco":1}]}'
    rows = [("f", "/f", text % brand) for brand in ("X", "Y")]
    answers = spark.createDataFrame(rows, schemas.RESPOSTAS).coalesce(1)
    empty = {n: schemas.empty_table(spark, n) for n in ("imagens", "supermercados", "produtos", "precos")}
    result = ingest(answers, *empty.values(), default_categories(spark), NOW)
    found = {r.imagem_id: (r.produtos_novos, r.produtos_existentes) for r in result.stats.collect()}
    assert found == {1: (1, 0), 2: (0, 1)}
    assert [(r.nome, r.marca) for r in result.produtos.collect()] == [("Arroz", "X")]
