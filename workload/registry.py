"""Every checked query: operator applied to the derived tables, columns as in the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola import schemas
from gondola.functions import sql as sql_functions
from gondola.functions import text as text_rules
from gondola.operators import answers, categories, dimensions, duplicates, items, maintenance, reports
from gondola.plans import ingest as ingest_plan
from gondola.plans import stored
from gondola.session import scratch_path
from gondola.sinks import exports
from gondola.sources import images
from gondola.sources.answers import read_answer_table
from gondola.sources.tables import read_table, write_table
from gondola.streaming.incremental import start_ingest
from workload import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FRAGMENT = "wid"
LEGACY = {
    "STANDARD": "Frios",
    "SMALL": "Temperos",
    "ECONOMY": "Congelados",
    "MEDIUM": "Doces",
    "LARGE": "",
}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# ---- sources and sinks -------------------------------------------------------


@query
def src_folder_inventory(spark, d):
    return images.select_images(t.arquivos(spark, d))


@query
def src_folder_listing(spark, d):
    """Real folders of the manifest's files, one portion at a time: extensions of all kinds and cases, and a sub-folder to be left out."""
    found = t.listed_files(t.prepare(spark), t.arquivos(spark, d))
    return found.select("nome_arquivo", F.col("length").alias("tamanho"))


@query
def src_raw_answers(spark, d):
    path = scratch_path(t.prepare(spark), "respostas")
    t.respostas(spark, d).write.parquet(path)
    return read_answer_table(spark, path).select(
        "nome_arquivo",
        "caminho_arquivo",
        F.col("texto").startswith("```json").alias("em_bloco"),
        F.contains("texto", F.lit('"produtos":[')).alias("tem_lista"),
        F.length(F.regexp_extract("texto", r'"supermercado":"([^"]*)"', 1))
        .cast("bigint")
        .alias("tamanho_loja"),
    )


@query
def seed_categories(spark, d):
    stored = (
        t.produtos(spark, d)
        .where(F.col("categoria").isNotNull())
        .groupBy(F.col("categoria").alias("nome"))
        .agg(F.min("id").cast("int").alias("id"))
        .select(
            "id", "nome", F.lit(None).cast("string").alias("descricao"),
            F.lit(None).cast("string").alias("icone"),
        )
    )
    return categories.seed_categories(stored)


@query
def export_prices(spark, d):
    return exports.export_rows(t.produtos(spark, d), t.precos(spark, d), t.supermercados(spark, d))


@query
def export_json(spark, d):
    path = scratch_path(t.prepare(spark), "json")
    exports.write_json(answers.read_flyers(t.respostas(spark, d)), path)
    return (
        spark.read.schema(
            "nome_arquivo string, dados struct<supermercado string, produtos array<struct<nome string>>>"
        )
        .json(path)
        .select("nome_arquivo", "dados.supermercado", F.size("dados.produtos").cast("bigint").alias("produtos"))
    )


# ---- answers -----------------------------------------------------------------


@query
def parse_answers(spark, d):
    parsed = answers.parse_answers(t.respostas(spark, d))
    return parsed.select(
        "nome_arquivo",
        "erro",
        F.try_variant_get("dados", "$.supermercado", "string").alias("supermercado"),
        F.size(F.try_variant_get("dados", "$.produtos", "array<variant>")).cast("bigint").alias("produtos"),
    )


@query
def validate_answers(spark, d):
    checked = answers.validate(answers.parse_answers(t.respostas(spark, d)))
    return checked.select("nome_arquivo", F.coalesce("erro", "invalido").alias("mensagem"))


@query
def validate_valid_count(spark, d):
    checked = answers.validate(answers.parse_answers(t.respostas(spark, d)))
    return checked.agg(
        F.count_if(F.col("erro").isNull() & F.col("invalido").isNull()).alias("validos"),
        F.count_if(F.coalesce("erro", "invalido").isNotNull()).alias("rejeitados"),
    )


@query
def explode_products(spark, d):
    flyers = answers.validate(answers.parse_answers(t.respostas(spark, d)))
    return items.explode_products(flyers.where(F.coalesce("erro", "invalido").isNull())).select(
        "nome_arquivo", F.col("pos").cast("bigint").alias("pos"), "nome", "marca", "categoria", "unidade"
    )


@query
def flyer_header(spark, d):
    return answers.read_header(answers.parse_answers(t.respostas(spark, d))).where("erro is null").select(
        "nome_arquivo", "supermercado", "validade_inicio", "validade_fim", "cabecalho_erro"
    )


@query
def expand_alternatives(spark, d):
    documents = t.read(spark, d, "documents").select("doc_id", F.col("text").alias("nome"))
    return items.expand_alternatives(documents).select(
        "doc_id", F.col("alternativa").cast("bigint").alias("alternativa"), "nome"
    )


def _gated(spark, d):
    return items.gate_items(answers.read_flyers(t.respostas(spark, d)))


@query
def price_gate(spark, d):
    return (
        _gated(spark, d)
        .select("nome_arquivo", F.explode_outer("erros").alias("mensagem"))
        .where(F.col("mensagem").isNotNull())
    )


@query
def optional_fields(spark, d):
    return items.saved_items(_gated(spark, d), "nome_arquivo").select(
        "nome_arquivo",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("alternativa").cast("bigint").alias("alternativa"),
        "nome", "preco", "preco_original", "em_promocao", "confianca", "gravar",
    )


@query
def store_default(spark, d):
    own = answers.read_header(answers.parse_answers(t.respostas(spark, d))).select("dados", F.col("loja").alias("resposta"))
    # on top of the first reading, so the answers are made and parsed once
    both = answers.read_header(own, override="Campeão").select("resposta", F.col("loja").alias("manual"))
    return (
        both.select(F.stack(F.lit(2), F.lit("resposta"), "resposta", F.lit("manual"), "manual").alias("origem", "loja"))
        .groupBy("origem", "loja")
        .agg(F.count("*").alias("panfletos"))
        .select("loja", "panfletos", "origem")
    )


@query
def flyer_errors(spark, d):
    log = maintenance.log_flyers(answers.read_flyers(t.respostas(spark, d)), t.NOW)
    return log.where("status = 'erro'").select(
        "nome_arquivo", "caminho_arquivo", "status", "erro_mensagem", "supermercado_nome", "processed_at"
    )


@query
def admission_checks(spark, d):
    raw = t.read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_extendedprice") * F.col("l_quantity") * 100).alias("preco"),
        F.col("l_extendedprice").alias("preco_original"),
        F.col("l_quantity").alias("confianca"),
        F.repeat("l_linestatus", F.col("l_quantity").cast("int") * 2).alias("unidade"),
    )
    return maintenance.admit_prices(raw)


# ---- scalar functions --------------------------------------------------------


@query
def normalize_name(spark, d):
    return t.read(spark, d, "documents").select(
        "doc_id", text_rules.normalize_name(F.col("text")).alias("nome_normalizado")
    )


@query
def normalize_name_products(spark, d):
    return t.produtos_crus(spark, d).select("id", "nome", "nome_normalizado")


@query
def normalize_name_sql(spark, d):
    sql_functions.register(t.prepare(spark))
    return t.produtos_crus(spark, d).select("id", F.expr("normalizar_nome(nome)").alias("nome_normalizado"))


@query
def format_brl(spark, d):
    return t.precos(spark, d).select("id", text_rules.format_brl(F.col("preco")).alias("texto"))


@query
def truncate_labels(spark, d):
    text = F.col("text")
    return t.read(spark, d, "documents").select(
        "doc_id",
        text_rules.ellipsis(text, 50).alias("rotulo50"),
        text_rules.ellipsis(text, 25).alias("rotulo25"),
    )


# ---- categories --------------------------------------------------------------


@query
def category_exact(spark, d):
    padded = F.concat(F.lit(" \t"), F.upper("categoria_sugerida"), F.lit(" "))
    rows = t.produtos_crus(spark, d).select("id", padded.alias("procurada"))
    return categories.find_category(rows, t.categorias(spark), "procurada").select(
        "id", "categoria_id", "categoria_encontrada"
    )


@query
def category_mapped(spark, d):
    return t.produtos_crus(spark, d).select(
        "id", "categoria_sugerida", categories.mapped_category(F.col("categoria_sugerida")).alias("categoria")
    )


@query
def category_mapped_texts(spark, d):
    mapped = categories.mapped_category
    return t.read(spark, d, "documents").select(
        "doc_id", mapped(F.col("text")).alias("do_texto"), mapped(F.col("lang")).alias("do_idioma")
    )


@query
def category_resolved(spark, d):
    return t.produtos(spark, d).select("id", "categoria_sugerida", "categoria", "categoria_id")


@query
def category_or_default(spark, d):
    rows = t.produtos_crus(spark, d).select("id", "categoria_sugerida")
    return categories.resolve_category(
        rows, t.categorias(spark), "categoria_sugerida", blank_is_default=True
    ).select("id", "categoria_id")


@query
def category_backfill(spark, d):
    pairs = (F.lit(text) for pair in LEGACY.items() for text in pair)
    legacy = t.produtos_crus(spark, d).select(
        "id",
        F.try_element_at(F.create_map(*pairs), F.col("p_type")).alias("categoria"),
        F.when(F.col("p_size") > 40, F.lit(13)).alias("categoria_id"),
    )
    return categories.backfill_category(legacy, t.categorias(spark))


@query
def category_counts(spark, d):
    return reports.category_counts(t.categorias(spark), t.produtos(spark, d))


# ---- products and stores -----------------------------------------------------


def _requests(spark, d):
    """One look-up per flyer line: the product's plain name and, at times, its brand.

    Lines of every seventh order ask for a name no product has.
    """
    return (
        t.read(spark, d, "lineitem")
        .join(t.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.concat(
                F.lit(" "), F.upper("p_name"), F.when(F.col("l_orderkey") % 7 == 0, " ausente").otherwise("")
            ).alias("nome"),
            F.when(F.col("l_returnflag") != "R", F.upper("p_brand")).alias("marca"),
        )
    )


@query
def product_lookup(spark, d):
    return dimensions.lookup_products(_requests(spark, d), t.produtos(spark, d)).drop("marca")


@query
def product_lookup_brand(spark, d):
    found = dimensions.lookup_products_by_brand(_requests(spark, d), t.produtos(spark, d))
    return found.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("produto.id").alias("produto_id"),
        F.col("produto.nome").alias("produto_nome"),
        F.col("produto.marca").alias("produto_marca"),
        F.col("produto.categoria_id").alias("categoria_id"),
    )


@query
def product_lookup_sql(spark, d):
    sql_functions.register(t.prepare(spark), t.produtos(spark, d))
    return spark.sql("SELECT * FROM buscar_produto_por_nome_normalizado('  Red   WIDGET ', 'brand#17')")


@query
def product_lookup_lateral(spark, d):
    """The SQL function over a whole table of requests."""
    sql_functions.register(t.prepare(spark), t.produtos(spark, d))
    _requests(spark, d).createOrReplaceTempView("pedidos")
    return spark.sql("""
        SELECT q.l_orderkey, q.l_linenumber, q.l_partkey, q.l_suppkey, p.id AS produto_id, p.nome AS produto_nome,
               p.marca AS produto_marca, p.categoria_id
        FROM pedidos q LEFT JOIN LATERAL buscar_produto_por_nome_normalizado(q.nome, q.marca) p
    """)


@query
def product_get_or_create(spark, d):
    keys, new = dimensions.get_or_create_products(
        items.saved_items(_gated(spark, d), "caminho_arquivo").withColumn("cria", F.expr("not longo and not apos_longo")),
        t.produtos_existentes(spark, d),
        t.categorias(spark),
        ["caminho_arquivo", "pos", "alternativa"],
        t.NOW,
    )
    keys = keys.where("produto_id is not null")
    return keys.join(new.withColumnRenamed("id", "produto_id"), ["produto_id", "nome_normalizado"], "left").select(
        "nome_normalizado", "produto_id", F.col("primeira").isNotNull().alias("novo"),
        "nome", "marca", "categoria", "categoria_id", "categoria_sugerida",
    )


@query
def store_get_or_create(spark, d):
    flyers = answers.read_flyers(t.respostas(spark, d)).where("erro is null")
    keys, new = dimensions.get_or_create_stores(
        flyers, t.supermercados_existentes(spark, d), ["caminho_arquivo"], t.NOW
    )
    return keys.join(new.withColumnRenamed("id", "supermercado_id"), "supermercado_id", "left").select(
        "chave", "supermercado_id", F.col("primeira").isNotNull().alias("novo"), "nome"
    )


def _incoming_stores(spark, d):
    return t.supermercados(spark, d).select(
        "nome", "cidade", "estado",
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("Nova "), "rede")).alias("rede"),
        F.col("id").alias("ordem"),
    )


@query
def store_upsert(spark, d):
    incoming = _incoming_stores(spark, d)
    return dimensions.upsert_stores(t.supermercados_existentes(spark, d), incoming, t.NOW).drop("created_at")


@query
def store_upsert_stored(spark, d):
    base = scratch_path(t.prepare(spark), "tabelas")
    write_table(t.supermercados_existentes(spark, d), base, "supermercados")
    stored.upsert_stored_stores(spark, base, _incoming_stores(spark, d), t.NOW)
    return read_table(spark, base, "supermercados").drop("created_at")


def _log_updates(log):
    return log.where("status = 'pendente'").select(
        "id",
        F.when(F.col("id") % 2 == 0, "erro").otherwise("processado").alias("status"),
        F.lit(None).cast("variant").alias("dados_json"),
        F.when(F.col("id") % 2 == 0, "sem resposta").alias("erro_mensagem"),
    )


@query
def flyer_log_update(spark, d):
    log = t.imagens(spark, d)
    return maintenance.update_flyer_log(log, _log_updates(log), t.NOW).select(
        "id", "nome_arquivo", "status", "erro_mensagem", "processed_at"
    )


def _product_updates(produtos):
    return produtos.where("p_type = 'SMALL'").select(
        "id",
        F.concat(F.lit("Novo  "), "nome").alias("nome"),
        F.when(F.col("marca").isNull(), "Sem Marca").alias("marca"),
    )


@query
def product_update(spark, d):
    produtos = t.produtos(spark, d)
    return maintenance.update_products(produtos, _product_updates(produtos), t.NOW).select(
        "id", "nome", "nome_normalizado", "marca", "updated_at"
    )


@query
def cascade_delete(spark, d):
    return maintenance.remove_with_prices(
        t.precos(spark, d),
        produto_id=t.produtos_crus(spark, d).where("p_type = 'PROMO'"),
        supermercado_id=t.supermercados(spark, d).where("s_acctbal < 0"),
        imagem_id=t.imagens(spark, d).where("status = 'erro'"),
    ).select("id", "produto_id", "supermercado_id", "imagem_id", "preco")


@query
def fk_violations(spark, d):
    return maintenance.foreign_key_violations(
        t.precos(spark, d),
        produto_id=t.produtos_existentes(spark, d),
        supermercado_id=t.supermercados_existentes(spark, d),
        imagem_id=t.imagens(spark, d),
    )


# ---- ingest ------------------------------------------------------------------


def _ingest(spark, d, store=None):
    return ingest_plan.ingest(
        t.respostas(spark, d),
        t.imagens(spark, d),
        t.supermercados_existentes(spark, d),
        t.produtos_existentes(spark, d),
        t.precos(spark, d),
        t.categorias(spark),
        t.NOW,
        store,
    )


def _log(spark, d, store=None):
    return _ingest(spark, d, store).imagens.select(
        "nome_arquivo", "caminho_arquivo", "supermercado_nome", "data_panfleto", "status",
        F.col("dados_json").isNotNull().alias("tem_dados"),
        F.try_variant_get("dados_json", "$.supermercado", "string").alias("loja_no_documento"),
        F.size(F.try_variant_get("dados_json", "$.produtos", "array<variant>")).cast("bigint").alias("produtos"),
        "erro_mensagem", "processed_at",
    )


@query
def flyer_log(spark, d):
    return _log(spark, d)


@query
def flyer_log_manual(spark, d):
    return _log(spark, d, "Campeão")


@query
def table_defaults(spark, d):
    """Prices and log rows that lack the columns with a default."""
    prices = schemas.conform(t.precos(spark, d).drop("em_promocao", "created_at"), "precos")
    log = schemas.conform(t.imagens(spark, d).drop("status", "created_at"), "imagens")
    now = F.col("created_at").isNotNull().alias("com_data")
    return prices.select("id", F.col("em_promocao").cast("string").alias("valor"), now).union(
        log.select("id", "status", now)
    )


@query
def product_admission(spark, d):
    size = F.col("p_size").cast("int")
    wide = t.produtos_crus(spark, d).select(
        "id",
        F.expr("case when id % 50 > 0 then repeat(nome, p_size) end").alias("nome"),
        F.repeat("marca", size).alias("marca"),
        F.repeat("categoria_sugerida", F.greatest(size - 40, F.lit(1))).alias("categoria_sugerida"),
        F.concat("codigo_barras", F.repeat(F.lit("0"), size)).alias("codigo_barras"),
    )
    return maintenance.admission_problem(wide).select("id", "problema")


@query
def ingest_stats(spark, d):
    return _ingest(spark, d).stats.select(
        "nome_arquivo", "supermercado_id",
        F.col("total_produtos").cast("bigint").alias("total_produtos"),
        "produtos_novos", "produtos_existentes", "precos_salvos",
        F.array_join("erros", "; ").alias("erros"),
    )


@query
def ingest_prices(spark, d):
    result = _ingest(spark, d)
    files = result.imagens.select(F.col("id").alias("imagem_id"), "nome_arquivo")
    return result.precos.join(files, "imagem_id").select(
        "nome_arquivo", "produto_id", "supermercado_id", "preco", "preco_original", "em_promocao",
        "validade_inicio", "validade_fim", "unidade", "confianca",
    )


@query
def batch_summary(spark, d):
    return ingest_plan.batch_summary(_ingest(spark, d))


@query
def ingest_incremental(spark, d):
    t.prepare(spark)
    root = scratch_path(spark, "incremental")
    # four files at least, and one per task where there are more tasks: files and reading tasks grow with the input
    most = max(1, -(-t.read(spark, d, "orders").count() // 4))
    t.respostas(spark, d).write.option("maxRecordsPerFile", most).parquet(f"{root}/respostas")
    files = len(spark.read.parquet(f"{root}/respostas").inputFiles())
    start_ingest(
        spark, f"{root}/respostas", f"{root}/tabelas", f"{root}/pontos", t.NOW, files_per_batch=max(1, -(-files // 2))
    ).awaitTermination()
    return _price_sums(spark, f"{root}/tabelas")


def _price_sums(spark, base):
    prices = read_table(spark, base, "precos")
    products = read_table(spark, base, "produtos").select(
        F.col("id").alias("produto_id"), "nome_normalizado"
    )
    return prices.join(products, "produto_id").groupBy("nome_normalizado").agg(
        F.count_distinct("produto_id").alias("produtos"),
        F.count("*").alias("precos"),
        F.sum("preco").cast("double").alias("soma"),
    )


@query
def ingest_after_job(spark, d):
    """A job, two streams with checkpoints of their own, and a compaction between them, on one set of tables."""
    root = scratch_path(t.prepare(spark), "partes")
    answers = t.respostas(spark, d).withColumn("parte", F.pmod(F.xxhash64("nome_arquivo"), F.lit(3)))
    answers.write.partitionBy("parte").parquet(f"{root}/respostas")
    parts = [f"{root}/respostas/parte={k}" for k in range(3)]
    base = f"{root}/tabelas"
    stored.ingest_into(spark, base, spark.read.schema(schemas.RESPOSTAS).parquet(parts[0]), t.NOW)
    start_ingest(spark, parts[1], base, f"{root}/pontos1", t.NOW).awaitTermination()
    stored.compact(spark, base)
    start_ingest(spark, parts[2], base, f"{root}/pontos2", t.NOW).awaitTermination()
    return _price_sums(spark, base)


def _store_star(spark, d):
    """The derived tables as stored ones."""
    base = scratch_path(t.prepare(spark), "tabelas")
    for name, rows in (
        ("produtos", t.produtos(spark, d)), ("precos", t.precos(spark, d)),
        ("supermercados", t.supermercados(spark, d)), ("imagens", t.imagens(spark, d)),
    ):
        write_table(rows, base, name)
    return base


@query
def merge_stored(spark, d):
    """A merge of stored tables, then an ingest on top of it: products, prices and their ids."""
    base = _store_star(spark, d)
    stored.merge_stored(spark, base, t.NOW)
    before = read_table(spark, base, "precos")
    last = before.agg(F.max("id")).scalar()
    stored.ingest_into(spark, base, t.respostas(spark, d), t.NOW)
    after = read_table(spark, base, "precos")
    named = read_table(spark, base, "produtos").select(F.col("id").alias("produto_id"), "nome_normalizado")
    return (
        after.withColumn("antes", F.col("id") <= last)
        .join(named, "produto_id")
        .groupBy("nome_normalizado")
        .agg(
            F.count_distinct("produto_id").alias("produtos"),
            F.count_if("antes").alias("precos_antes"),
            F.count_if(~F.col("antes")).alias("precos_novos"),
            F.count_distinct("id").alias("ids"),
        )
    )


@query
def flyer_log_update_stored(spark, d):
    base = scratch_path(t.prepare(spark), "tabelas")
    log = t.imagens(spark, d)
    for part in (log.where("id % 2 = 0"), log.where("id % 2 = 1")):
        write_table(part, base, "imagens")
    stored.update_log(spark, base, _log_updates(log), t.NOW)
    return read_table(spark, base, "imagens").select("id", "nome_arquivo", "status", "erro_mensagem", "processed_at")


@query
def product_update_stored(spark, d):
    base = scratch_path(t.prepare(spark), "tabelas")
    write_table(t.produtos(spark, d), base, "produtos")
    stored.update_stored_products(spark, base, _product_updates(t.produtos(spark, d)), t.NOW)
    return read_table(spark, base, "produtos").select("id", "nome", "nome_normalizado", "marca", "updated_at")


def _deleted_star(spark, d):
    base = _store_star(spark, d)
    stored.delete_rows(
        spark, base,
        produtos=t.produtos_crus(spark, d).where("p_type = 'PROMO'"),
        supermercados=t.supermercados(spark, d).where("s_acctbal < 0"),
        imagens=t.imagens(spark, d).where("status = 'erro'"),
    )
    return base


@query
def cascade_delete_stored(spark, d):
    return read_table(spark, _deleted_star(spark, d), "precos").select(
        "id", "produto_id", "supermercado_id", "imagem_id", "preco"
    )


@query
def cascade_delete_compacted(spark, d):
    base = _deleted_star(spark, d)
    stored.compact(spark, base)
    return read_table(spark, base, "precos").select("id", "produto_id", "supermercado_id", "imagem_id", "preco")


@query
def flyer_top3(spark, d):
    return answers.cheapest_items(answers.read_flyers(t.respostas(spark, d))).select(
        "nome_arquivo", F.col("posto").cast("bigint").alias("posto"), "nome", "preco"
    )


# ---- reports -----------------------------------------------------------------


def _star(spark, d):
    return t.produtos(spark, d), t.precos(spark, d), t.supermercados(spark, d)


@query
def best_prices(spark, d):
    return reports.best_prices(*_star(spark, d), t.AS_OF)


@query
def store_stats(spark, d):
    return reports.store_stats(t.supermercados(spark, d), t.precos(spark, d))


@query
def cheapest_by_category(spark, d):
    return reports.cheapest_by_category(*_star(spark, d), t.AS_OF)


@query
def cheapest_by_store(spark, d):
    return reports.cheapest_by_store(*_star(spark, d), t.AS_OF)


@query
def top_cheapest(spark, d):
    return reports.top_cheapest(*_star(spark, d), t.AS_OF)


def _discount_as_double(df):
    return df.withColumn("desconto", F.col("desconto").cast("double"))


@query
def active_promotions(spark, d):
    return _discount_as_double(reports.active_promotions(*_star(spark, d), t.AS_OF))


@query
def top_promotions(spark, d):
    return _discount_as_double(reports.active_promotions(*_star(spark, d), t.AS_OF, limit=10))


@query
def all_promotions(spark, d):
    produtos, precos, _ = _star(spark, d)
    return _discount_as_double(reports.all_promotions(produtos, precos))


@query
def price_history(spark, d):
    return reports.price_history(*_star(spark, d), FRAGMENT)


@query
def price_history_all(spark, d):
    return reports.price_history(*_star(spark, d), FRAGMENT, limit=None)


@query
def compare_stores(spark, d):
    return reports.compare_stores(*_star(spark, d), FRAGMENT, t.AS_OF)


@query
def global_stats(spark, d):
    produtos, precos, supermercados = _star(spark, d)
    return reports.global_stats(produtos, supermercados, precos, t.imagens(spark, d))


@query
def unmapped_categories(spark, d):
    return reports.unmapped_categories(t.produtos(spark, d))


@query
def unmapped_category_names(spark, d):
    return reports.unmapped_category_names(t.produtos(spark, d))


@query
def unmapped_examples3(spark, d):
    return reports.unmapped_examples(t.produtos(spark, d))


@query
def mapped_categories(spark, d):
    return reports.mapped_categories(t.produtos(spark, d))


@query
def mapped_category_names(spark, d):
    return reports.mapped_category_names(t.produtos(spark, d))


@query
def mapped_labels(spark, d):
    return reports.mapped_labels(reports.mapped_categories(t.produtos(spark, d)))


@query
def mapping_stats(spark, d):
    return reports.mapping_stats(t.produtos(spark, d)).withColumn(
        "percentual", F.col("percentual").cast("double")
    )


@query
def remapped_products(spark, d):
    return reports.remapped_products(t.produtos(spark, d))


@query
def products_by_suggestion(spark, d):
    return reports.products_by_suggestion(t.produtos(spark, d), "Produtos Gourmet")


# ---- duplicates --------------------------------------------------------------


@query
def duplicate_links(spark, d):
    return duplicates.duplicate_links(t.produtos(spark, d))


@query
def duplicate_groups(spark, d):
    return duplicates.duplicate_groups(t.produtos(spark, d))


@query
def duplicate_group_count(spark, d):
    return duplicates.duplicate_group_count(t.produtos(spark, d))


@query
def barcode_violations(spark, d):
    return duplicates.barcode_violations(t.produtos_crus(spark, d))


@query
def quality_metrics(spark, d):
    return duplicates.quality_metrics(t.produtos(spark, d))


@query
def duplicate_members(spark, d):
    return duplicates.duplicate_members(t.produtos(spark, d), t.precos(spark, d))


def _choices(spark, d):
    return duplicates.merge_choices(t.produtos(spark, d), t.precos(spark, d))


@query
def merge_principal(spark, d):
    return _choices(spark, d).select("nome_normalizado", "principal_id", "quantidade", "precos")


@query
def merge_fill(spark, d):
    return duplicates.principal_products(t.produtos(spark, d), _choices(spark, d))


@query
def merge_transfer(spark, d):
    produtos, precos, _ = _star(spark, d)
    moved = duplicates.move_prices(precos, duplicates.replacement_ids(produtos, _choices(spark, d)))
    return moved.select("id", "produto_id", "preco")


@query
def merge_products(spark, d):
    return duplicates.merged_products(t.produtos(spark, d), _choices(spark, d), t.NOW).select(
        "id", "nome", "marca", "categoria", "categoria_id", "codigo_barras", "descricao", "updated_at"
    )


@query
def merge_stats(spark, d):
    return duplicates.merge_stats(_choices(spark, d))


@query
def merge_one_group(spark, d):
    merge = duplicates.merge_group(t.produtos(spark, d), t.precos(spark, d), " Red  WIDGET ", t.NOW)
    return merge.produtos.select(
        "id", "nome", "marca", "categoria", "categoria_id", "codigo_barras", "descricao", "updated_at"
    )
