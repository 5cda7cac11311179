"""Jobs, streams, merges, updates and deletes on one set of stored tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gondola import schemas
from gondola.operators import dimensions
from gondola.plans import stored
from gondola.sources import versions
from gondola.sources.tables import Change, read_rows, read_table, read_valid_prices, write_table
from gondola.streaming.incremental import start_ingest

NOW = dt.datetime(2025, 10, 15, 12, 0)
LATER = dt.datetime(2025, 11, 1)
TABLES = ("imagens", "supermercados", "produtos", "precos")


def flyers(*names, store="Assaí", start=0, until="2025-10-20"):
    """One flyer per list of product names."""
    return [
        {"supermercado": store, "data_validade_fim": until, "produtos": [{"nome": n, "preco": start + k + 1.5} for k, n in enumerate(some)]}
        for some in names
    ]


def answers_of(spark, some, first=0):
    rows = [(f"{i}.jpg", f"/f/{i:03d}.jpg", json.dumps(f, ensure_ascii=False)) for i, f in enumerate(some, first)]
    return spark.createDataFrame(rows, schemas.RESPOSTAS)


def ids(spark, base, name):
    return sorted(r.id for r in read_table(spark, base, name).collect())


def rows_of(spark, base, name):
    return sorted(map(str, read_table(spark, base, name).collect()))


def state(spark, base):
    return {name: rows_of(spark, base, name) for name in TABLES}


def stream(spark, source, base, checkpoint):
    start_ingest(spark, source, base, checkpoint, NOW).awaitTermination()


@pytest.fixture
def base(tmp_path):
    return str(tmp_path / "t")


def folders(spark, base, name):
    return versions.read_version(spark, base).folders.get(name, [])


def test_job_then_streams_then_compaction_lose_and_repeat_nothing(spark, base, tmp_path):
    figures = stored.ingest_into(spark, base, answers_of(spark, flyers(["Arroz", "Feijão"])), NOW)
    assert (figures.imagens, figures.produtos_novos, figures.precos_salvos) == (1, 2, 2)
    source, points = str(tmp_path / "a"), str(tmp_path / "c")
    answers_of(spark, flyers(["ARROZ", "Leite"]), 1).coalesce(1).write.parquet(source)
    stream(spark, source, base, points)
    names = {r.nome: r.id for r in read_table(spark, base, "produtos").collect()}
    assert names == {"Arroz": 1, "Feijão": 2, "Leite": 3}
    assert ids(spark, base, "precos") == [1, 2, 3, 4] and ids(spark, base, "imagens") == [1, 2]
    # another stream, with a checkpoint of its own, begins at batch 0 again
    other = str(tmp_path / "b")
    answers_of(spark, flyers(["Sal"], store="Extra"), 2).coalesce(1).write.parquet(other)
    stream(spark, other, base, str(tmp_path / "c2"))
    assert ids(spark, base, "precos") == [1, 2, 3, 4, 5]
    before = state(spark, base)
    stored.compact(spark, base)
    assert state(spark, base) == before
    answers_of(spark, flyers(["Sal", "Café"], store="extra"), 3).coalesce(1).write.mode("append").parquet(source)
    stream(spark, source, base, points)
    assert ids(spark, base, "produtos") == [1, 2, 3, 4, 5]
    assert ids(spark, base, "precos") == list(range(1, 8))
    assert [r.nome for r in read_table(spark, base, "supermercados").orderBy("id").collect()] == ["Assaí", "Extra"]


def test_a_batch_repeated_after_its_commit_is_taken_once(spark, base):
    answers = answers_of(spark, flyers(["Arroz", "Feijão"]))
    assert stored.ingest_into(spark, base, answers, NOW, stream=("s", 0)) is None
    before = state(spark, base)
    stored.ingest_into(spark, base, answers, NOW, stream=("s", 0))
    assert state(spark, base) == before
    stored.ingest_into(spark, base, answers, NOW, stream=("s", 1))
    assert ids(spark, base, "precos") == [1, 2, 3, 4] and ids(spark, base, "produtos") == [1, 2]
    assert versions.read_version(spark, base).streams == {"s": 1}


def products(spark, *rows):
    """(id, nome, marca, created minute)."""
    schema = schemas.empty_table(spark, "produtos").schema
    when = lambda m: dt.datetime(2025, 1, 1, 0, m)
    named = [{"id": i, "nome": n, "marca": b, "created_at": when(m), "updated_at": when(m)} for i, n, b, m in rows]
    data = [tuple(r.get(f.name) for f in schema.fields) for r in named]
    return dimensions.with_normalized_name(spark.createDataFrame(data, schema)).select(*schema.names)


def prices(spark, *rows):
    """(id, product, store, flyer, end of validity)."""
    raw = spark.createDataFrame(
        [(i, p, s, f, "1.50", end and dt.date.fromisoformat(end)) for i, p, s, f, end in rows],
        "id bigint, produto_id bigint, supermercado_id bigint, imagem_id bigint, preco string, validade_fim date",
    )
    return schemas.conform(raw, "precos")


def test_what_was_not_committed_does_not_show(spark, base):
    write_table(products(spark, (1, "Arroz", None, 0)), base, "produtos")
    before = state(spark, base)
    change = Change(spark, base)
    change.append("produtos", read_table(spark, base, "produtos"))
    change.delete("produtos", spark.createDataFrame([(1,)], "id bigint"))
    assert state(spark, base) == before


def test_the_second_of_two_writers_is_refused(spark, base):
    write_table(products(spark, (1, "Arroz", None, 0)), base, "produtos")
    change = Change(spark, base)
    write_table(products(spark, (2, "Feijão", None, 0)), base, "produtos")
    change.delete("produtos", spark.createDataFrame([(1,)], "id bigint"))
    with pytest.raises(versions.ConcurrentWrite):
        change.commit()
    assert ids(spark, base, "produtos") == [1, 2]
    assert not [n for n in versions.children(spark, f"{base}/{versions.FOLDER}") if n.startswith(".") and not n.endswith(".crc")]


def test_ingest_merge_ingest(spark, base):
    stored.ingest_into(spark, base, answers_of(spark, flyers(["Arroz", "Feijão"], until="2025-10-20")), NOW)
    # duplicates as they come from other systems
    write_table(products(spark, (10, "ARROZ ", "X", 5), (11, "Sal", None, 1)), base, "produtos")
    write_table(prices(spark, (50, 10, 1, 1, "2025-12-01"), (51, 11, 1, 1, "2025-11-05"), (52, 2, 1, 1, "2025-12-01")), base, "precos")
    before = {name: (folders(spark, base, name), rows_of(spark, base, name)) for name in TABLES}
    merged = stored.merge_stored(spark, base, LATER)
    assert (merged.stats.grupos_duplicados, merged.stats.produtos_removidos, merged.stats.precos_transferidos) == (1, 1, 1)
    assert merged.rewritten["precos"] == 1
    for name in ("supermercados", "imagens"):
        assert (folders(spark, base, name), rows_of(spark, base, name)) == before[name]
    untouched = set(before["precos"][0]) & set(folders(spark, base, "precos"))
    assert len(untouched) == len(before["precos"][0]) - 1
    # both have one price; the one with a brand stays
    assert ids(spark, base, "produtos") == [2, 10, 11]
    assert {r.id: r.produto_id for r in read_table(spark, base, "precos").collect()} == {1: 10, 2: 2, 50: 10, 51: 11, 52: 2}
    stored.ingest_into(spark, base, answers_of(spark, flyers(["arroz", "Novo"]), 1), NOW)
    assert ids(spark, base, "produtos") == [2, 10, 11, 12]
    assert ids(spark, base, "precos") == [1, 2, 50, 51, 52, 53, 54]
    assert stored.merge_stored(spark, base, LATER).stats.grupos_duplicados == 0


def test_a_merge_that_stops_shows_the_old_version(spark, base, monkeypatch):
    write_table(products(spark, (1, "Arroz", None, 0), (2, "ARROZ", "X", 5)), base, "produtos")
    write_table(prices(spark, (1, 1, 1, 1, None), (2, 2, 1, 1, "2025-12-01")), base, "precos")
    before = state(spark, base)

    def fail(*_):
        raise OSError("lost")

    monkeypatch.setattr(stored, "merged_products", fail)  # after the prices are written
    with pytest.raises(OSError, match="lost"):
        stored.merge_stored(spark, base, LATER)
    assert state(spark, base) == before
    monkeypatch.undo()
    assert stored.merge_stored(spark, base, LATER).stats.produtos_removidos == 1
    assert {r.produto_id for r in read_table(spark, base, "precos").collect()} == {2}


def log(spark, *ids):
    rows = [(k, f"{k}.jpg", "pendente") for k in ids]
    return spark.createDataFrame(rows, "id bigint, nome_arquivo string, status string")


def test_updates_write_only_the_folders_they_change(spark, base):
    for k in range(3):
        write_table(log(spark, 2 * k + 1, 2 * k + 2), base, "imagens")
    write_table(products(spark, *((k, f"Nome {k}", None, 0) for k in range(1, 40))), base, "produtos")
    logs, kept = folders(spark, base, "imagens"), folders(spark, base, "produtos")
    change = spark.createDataFrame([(3, "erro", "sem resposta"), (99, "erro", "x")], "id bigint, status string, erro_mensagem string")
    change = change.withColumn("dados_json", F.lit(None).cast("variant"))
    assert stored.update_log(spark, base, change, LATER) == 1
    assert len(set(logs) & set(folders(spark, base, "imagens"))) == 2 and ids(spark, base, "imagens") == [1, 2, 3, 4, 5, 6]
    rows = {r.id: (r.status, r.erro_mensagem, r.processed_at) for r in read_table(spark, base, "imagens").collect()}
    assert rows[3] == ("erro", "sem resposta", LATER) and rows[4] == ("pendente", None, None)
    renamed = spark.createDataFrame([(4, "Outro  NOME")], "id bigint, nome string")
    assert stored.update_stored_products(spark, base, renamed, LATER) == 1
    assert len(set(kept) - set(folders(spark, base, "produtos"))) == 1
    assert ids(spark, base, "produtos") == list(range(1, 40))
    # a look-up by bucket finds it under its new name
    names = spark.createDataFrame([("outro nome",), ("nome 4",)], "nome_normalizado string")
    found = dimensions.products_named(read_rows(spark, base, "produtos"), names, versions.BUCKETS)
    assert [r.id for r in found.collect()] == [4]
    version = versions.read_version(spark, base).number
    assert stored.update_stored_products(spark, base, renamed.where("id < 0"), LATER) == 0
    assert versions.read_version(spark, base).number == version


def test_stores_are_inserted_or_updated_in_place(spark, base):
    schema = "id bigint, nome string, cidade string, estado string, rede string"
    write_table(spark.createDataFrame([(1, "A", "X", "SP", "r1"), (2, "B", "X", "SP", "r2")], schema), base, "supermercados")
    write_table(spark.createDataFrame([(3, "C", "X", "SP", "r3"), (4, "D", None, "SP", "r4")], schema), base, "supermercados")
    stored.delete_rows(spark, base, supermercados=spark.createDataFrame([(4,)], "id bigint"))
    before = folders(spark, base, "supermercados")
    rows = [("B", "X", "SP", "n2", 1), ("E", "X", "SP", "n5", 2), ("E", "X", "SP", None, 3), ("B", None, "SP", "n6", 4)]
    incoming = spark.createDataFrame(rows, "nome string, cidade string, estado string, rede string, ordem int")
    assert stored.upsert_stored_stores(spark, base, incoming, NOW) == 1
    assert before[1] in folders(spark, base, "supermercados") and before[0] not in folders(spark, base, "supermercados")
    found = {r.id: (r.nome, r.cidade, r.rede) for r in read_table(spark, base, "supermercados").collect()}
    assert found == {1: ("A", "X", "r1"), 2: ("B", "X", "n2"), 3: ("C", "X", "r3"), 5: ("E", "X", None), 6: ("B", None, "n6")}
    version = versions.read_version(spark, base).number
    assert stored.upsert_stored_stores(spark, base, incoming.where("ordem < 0"), NOW) == 0
    assert versions.read_version(spark, base).number == version


def test_deleted_rows_stay_away_before_and_after_compaction(spark, base):
    write_table(products(spark, *((k, f"P{k}", None, k) for k in range(1, 7))), base, "produtos")
    write_table(prices(spark, *((k, k % 6 + 1, k % 3 + 1, k % 4 + 1, f"2025-1{k % 3}-01") for k in range(30)), (40, None, None, None, None)), base, "precos")
    stores = spark.createDataFrame([(k, f"L{k}") for k in (1, 2, 3)], "id bigint, nome string")
    write_table(stores, base, "supermercados")
    some = lambda *k: spark.createDataFrame([(x,) for x in k], "id bigint")
    stored.delete_rows(spark, base, produtos=some(1, 2, 2), supermercados=some(3), precos=some(7))
    stored.delete_rows(spark, base, imagens=some(4))
    left = {40, *(k for k in range(30) if k % 6 + 1 > 2 and k % 3 + 1 != 3 and k % 4 + 1 != 4 and k != 7)}
    for compacted in (False, True):
        assert set(ids(spark, base, "precos")) == left and ids(spark, base, "produtos") == [3, 4, 5, 6]
        assert ids(spark, base, "supermercados") == [1, 2]
        valid = read_valid_prices(spark, base, dt.date(2025, 12, 1))
        assert {r.id for r in valid.collect()} == {k for k in left if k == 40 or k % 3 == 2}
        assert "PartitionFilters: [((mes_fim" in valid._jdf.queryExecution().toString()
        if not compacted:
            stored.compact(spark, base)
            assert not versions.read_version(spark, base).deleted
    # deleted ids are not given again
    stored.delete_rows(spark, base, produtos=some(6))
    stored.compact(spark, base)
    assert Change(spark, base).last_id("produtos").head().id == 6
    with pytest.raises(ValueError, match="no such table"):
        stored.delete_rows(spark, base, outros=some(1))


def test_only_the_buckets_of_the_names_are_read(spark, base):
    write_table(products(spark, *((k, f"Produto {k}", None, 0) for k in range(1, 200))), base, "produtos")
    assert len(folders(spark, base, "produtos")) == versions.BUCKETS
    names = spark.createDataFrame([("produto 7",), ("produto 8",), ("ausente",)], "nome_normalizado string")
    found = dimensions.products_named(read_rows(spark, base, "produtos"), names, versions.BUCKETS)
    assert sorted(r.id for r in found.collect()) == [7, 8]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [balde" in plan
    needed = {r[0] for r in names.select(schemas.name_bucket(F.col("nome_normalizado"), versions.BUCKETS)).collect()}
    scans = found._jdf.queryExecution().optimizedPlan().toString()
    assert needed and "balde" in scans
    read = read_rows(spark, base, "produtos").where(F.col("balde").isin(list(needed)))
    assert read.select("balde").distinct().count() == len(needed) < versions.BUCKETS


def test_expired_versions_free_their_folders(spark, base):
    for k in range(1, 4):
        write_table(products(spark, (k, f"N{k}", None, 0)), base, "produtos")
    stored.compact(spark, base)
    before = state(spark, base)
    running = Change(spark, base)
    running.append("produtos", products(spark, (70, "Z", None, 0)))
    assert versions.expire(spark, base, keep=2) == 2
    assert versions.version_numbers(spark, base) == [3, 4]
    assert read_table(spark, base, "produtos", versions.read_version(spark, base, 3)).count() == 3
    assert versions.expire(spark, base) == 1
    assert state(spark, base) == before
    running.commit()
    assert ids(spark, base, "produtos") == [1, 2, 3, 70]
    with pytest.raises(ValueError):
        versions.expire(spark, base, 0)


def test_nothing_stored_yet(spark, base):
    assert all(read_table(spark, base, name).count() == 0 for name in schemas.TABLES)
    assert versions.read_version(spark, base).number == 0
    with pytest.raises(ValueError):
        stored.compact(spark, base)
    assert stored.merge_stored(spark, base, NOW).stats.grupos_duplicados == 0
    write_table(read_table(spark, base, "produtos"), base, "produtos")
    assert read_table(spark, base, "produtos").count() == 0
