"""Flyer tables derived from the test tables (FIXTURES.md describes the mapping)."""

from __future__ import annotations

import datetime as dt
import gc
import os
import zlib

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola import session
from gondola.operators.categories import default_categories, resolve_category
from gondola.operators.dimensions import with_normalized_name
from gondola.session import scratch, scratch_path
from gondola.sources.images import file_name, list_folder
from workload.scratch import ensure


def prepare(spark: SparkSession) -> SparkSession:
    return session.prepare(ensure(spark))


AS_OF = dt.date(2001, 6, 1)
NOW = dt.datetime(2002, 1, 1)

SUGGESTIONS = {
    "STANDARD": "Carnes",
    "SMALL": "bebidas em pó",
    "ECONOMY": "Cervejas Especiais",
    "MEDIUM": "Alimentos",
    "LARGE": "Produtos Gourmet",
}

# Last product of a flyer of each kind (kind = order key modulo KINDS); kinds
# not named here carry the flyer's own products only.
KINDS = 32
LAST_PRODUCT = {
    4: '"texto solto"',
    5: '{"preco":1.5}',
    6: '{"nome":"item sem preco"}',
    7: '{"nome":"item nulo","preco":null}',
    8: '{"nome":"item negativo","preco":-1}',
    9: '{"nome":"item virgula","preco":"29,90"}',
    10: '{"nome":"item texto","preco":"12.5"}',
    14: '{"nome":"item logico","preco":true,"preco_original":0,"confianca":0}',
    15: '{"nome":"item caro","preco":1000000000,"categoria":"Produtos Gourmet"}',
    16: '{"nome":"' + "x" * 256 + '","preco":1}',
    17: '{"nome":"item unidade ou item outro","preco":2.345,"unidade":"' + "u" * 51 + '"}',
    18: '{"nome":"item promocao","preco":3.455,"em_promocao":null,"confianca":"0.5"}',
    # a brand too long for a new product: refused for an unknown name, not for a known one (kind 21)
    20: '{"nome":"item longo","marca":"' + "m" * 101 + '","preco":4}',
}
NO_KEY, NOT_A_LIST, EMPTY_LIST, NO_BRACES, CUT_OFF, BAD_DATE, TRAILING, KNOWN = 1, 2, 3, 11, 12, 13, 19, 21


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _ntz(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("timestamp_ntz")


def _suggestion() -> Column:
    pairs = (F.lit(text) for pair in SUGGESTIONS.items() for text in pair)
    return F.try_element_at(F.create_map(*pairs), F.col("p_type"))


def categorias(spark: SparkSession) -> DataFrame:
    return default_categories(spark)


def produtos_crus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products before their category is resolved."""
    key = F.col("p_partkey")
    name = (
        F.when(key % 4 == 0, F.upper("p_name"))
        .when(
            key % 4 == 1,
            F.concat(F.lit("  "), F.replace(F.col("p_name"), F.lit(" "), F.lit("   ")), F.lit(" ")),
        )
        .otherwise(F.col("p_name"))
    )
    barcode = F.concat(F.lit("789"), F.lpad(F.expr("p_partkey div 2").cast("string"), 10, "0"))
    created = F.expr(
        "timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(0, 0, cast(p_partkey as int), 0)"
    )
    rows = read(spark, sf_dir, "part").select(
        key.alias("id"),
        name.alias("nome"),
        F.when(key % 11 != 0, F.col("p_brand")).alias("marca"),
        _suggestion().alias("categoria_sugerida"),
        F.when(F.col("p_size") % 3 == 0, barcode).alias("codigo_barras"),
        F.when(F.col("p_size") > 40, F.col("p_type")).alias("descricao"),
        created.alias("created_at"),
        created.alias("updated_at"),
        "p_size",
        "p_type",
    )
    return with_normalized_name(rows)


def produtos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_category(
        produtos_crus(spark, sf_dir), categorias(spark), "categoria_sugerida"
    )


def produtos_existentes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product table before the flyers arrive: the smaller packs."""
    return produtos(spark, sf_dir).where("p_size <= 25")


def supermercados(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "supplier")
        .join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("nome"),
            F.concat(F.lit("Rede "), (F.col("n_nationkey") % 5).cast("string")).alias("rede"),
            F.col("n_name").alias("cidade"),
            F.when(F.col("s_suppkey") % 4 != 0, F.lit("SP")).alias("estado"),
            F.lit(dt.datetime(1995, 1, 1)).cast("timestamp_ntz").alias("created_at"),
            "s_acctbal",
        )
    )


def supermercados_existentes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store table before the flyers arrive: stores with the lower balances."""
    return supermercados(spark, sf_dir).where("s_acctbal < 4500")


def precos(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(10,2)")
    ship = F.col("l_shipdate").cast("date")
    return read(spark, sf_dir, "lineitem").select(
        F.expr(
            "((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber"
        ).alias("id"),
        F.col("l_partkey").alias("produto_id"),
        F.col("l_suppkey").alias("supermercado_id"),
        F.col("l_orderkey").alias("imagem_id"),
        _net_price().alias("preco"),
        F.when(F.col("l_returnflag") != "R", price).alias("preco_original"),
        (F.col("l_discount") >= 0.05).alias("em_promocao"),
        ship.alias("validade_inicio"),
        F.when(F.col("l_linenumber") != 7, F.date_add(ship, 7)).alias("validade_fim"),
        F.col("l_linestatus").alias("unidade"),
        F.lit(None).cast("string").alias("descricao_adicional"),
        (1 - F.col("l_discount").cast("decimal(3,2)")).cast("decimal(3,2)").alias("confianca"),
        _ntz("l_shipdate").alias("created_at"),
    )


def _net_price() -> Column:
    return (
        F.col("l_extendedprice").cast("decimal(10,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    ).cast("decimal(10,2)")


def imagens(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("flyer_"), F.col("o_orderkey").cast("string"), F.lit(".jpg"))
    status = (
        F.when(F.col("o_orderstatus") == "F", "processado")
        .when(F.col("o_orderstatus") == "O", "pendente")
        .otherwise("erro")
    )
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        name.alias("nome_arquivo"),
        F.concat(F.lit("/flyers/"), name).alias("caminho_arquivo"),
        F.lit(None).cast("string").alias("supermercado_nome"),
        F.col("o_orderdate").cast("date").alias("data_panfleto"),
        status.alias("status"),
        F.lit(None).cast("string").alias("texto_extraido"),
        F.lit(None).cast("variant").alias("dados_json"),
        F.when(F.col("o_orderstatus") == "P", "erro de teste").alias("erro_mensagem"),
        _ntz("o_orderdate").alias("created_at"),
        _ntz("o_orderdate").alias("processed_at"),
    )


def arquivos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of files of several kinds, one per order."""
    ending = (
        F.when(F.col("o_orderpriority") == "1-URGENT", ".jpg")
        .when(F.col("o_orderpriority") == "2-HIGH", ".JPEG")
        .when(F.col("o_orderpriority") == "3-MEDIUM", ".Png")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", ".txt")
        .otherwise(".webp")
    )
    return read(spark, sf_dir, "orders").select(
        F.concat(
            F.lit("/flyers/"), F.date_format("o_orderdate", "yyyy-MM"), F.lit("/f"),
            F.col("o_orderkey").cast("string"), ending,
        ).alias("caminho_arquivo")
    )


def write_files(manifest: DataFrame, folder: str) -> None:
    """Make the manifest's files real: those before 1998 in ``folder``, the others in a sub-folder of it.

    Each file holds its own name. Tasks write them through the store of the folder, which all see. Files that
    lay in the folder go; on a local disk the new ones take them over, written anew and under their own names:
    where many files were just deleted, ext4 without a journal may search a millisecond for each one made.
    """
    tasks, before = manifest.sparkSession.sparkContext.defaultParallelism, "-antes"

    def place():
        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(f"{root}/depois", recursive=True)
        return store, root

    def left_over(store, root: str) -> list[str]:
        """This task's share of the files that lay in the folder."""
        if not isinstance(store, fs.LocalFileSystem):
            return []
        own = TaskContext.get().partitionId()
        found = (x.path for part in ("", "/depois") for x in os.scandir(f"{root}{before}{part}") if x.is_file())
        return [path for path in found if zlib.crc32(os.fsencode(path)) % tasks == own]

    def taken_over(old: list[str], path: str, content: bytes) -> bool:
        while old:
            source = old.pop()
            try:
                with open(source, "r+b", buffering=0) as out:
                    out.write(content)
                    out.truncate()
                os.replace(source, path)
            except FileNotFoundError:  # an earlier attempt of the task took it
                continue
            return True
        return False

    def write(rows) -> None:
        store, root = place()
        old = left_over(store, root)
        for row in rows:
            name = row.caminho_arquivo.rsplit("/", 1)[1]
            where = root if row.caminho_arquivo < "/flyers/1998" else f"{root}/depois"
            if not taken_over(old, f"{where}/{name}", name.encode()):
                with store.open_output_stream(f"{where}/{name}") as out:
                    out.write(name.encode())

    store, root = place()
    if store.get_file_info(root + before).type == fs.FileType.Directory:  # a run that was broken off
        store.delete_dir(root + before)
    store.move(root, root + before)
    place()  # also without rows
    manifest.repartition(tasks).foreachPartition(write)
    store.delete_dir(root + before)


def listed_files(spark: SparkSession, manifest: DataFrame, portion_files: int = 50_000) -> DataFrame:
    """What ``list_folder`` finds of the manifest's files, made real and listed some ``portion_files`` at a time.

    A small file takes a whole block of disk, so the files of a portion give way to the next once their listing is
    written: the disk they take does not grow with the manifest. The manifest is dealt to its portions once.
    """
    portions = max(1, -(-manifest.count() // portion_files))
    root = scratch_path(spark, "panfletos")
    # by the name in the folder: rows that name the same file share its portion
    portion = F.pmod(F.xxhash64(file_name(F.col("caminho_arquivo"))), F.lit(portions))
    dealt = manifest.select("caminho_arquivo", portion.alias("porcao"))
    dealt.repartition("porcao").write.partitionBy("porcao").parquet(f"{root}/porcoes")
    dealt = spark.read.schema("caminho_arquivo string, porcao long").parquet(f"{root}/porcoes")
    tasks = spark.sparkContext.defaultParallelism
    with scratch(spark):
        folder = scratch_path(spark, "porcao")
        for k in range(portions):
            write_files(dealt.where(F.col("porcao") == k).select("caminho_arquivo"), folder)
            found = list_folder(spark, folder).select("nome_arquivo", "length")
            found.coalesce(tasks).write.mode("append").parquet(f"{root}/lista")
            del found
            gc.collect()  # py4j's objects hold each other, and the driver's listings of the portions with them
    return spark.read.schema("nome_arquivo string, length long").parquet(f"{root}/lista")


def respostas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model answer per order: its lines are the products of the flyer.

    Fixed defects are given to some flyers by their key; an order without
    lines is a flyer without products.
    """
    line = ("l_linenumber", "l_partkey", "l_suppkey")
    product = F.struct(
        F.when(
            F.col("l_linenumber") % 5 == 0, F.concat("p_name", F.lit(" OU "), "p_type")
        ).otherwise(F.col("p_name")).alias("nome"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("p_brand")).alias("marca"),
        _suggestion().alias("categoria"),
        _net_price().alias("preco"),
        F.when(F.col("l_returnflag") == "N", F.col("l_extendedprice").cast("decimal(10,2)"))
        .when(F.col("l_returnflag") == "A", F.lit(0).cast("decimal(10,2)"))
        .alias("preco_original"),
        F.when(
            (F.col("l_discount") >= 0.05) | (F.col("l_linestatus") == "O"), F.col("l_discount") >= 0.05
        ).alias("em_promocao"),
        F.col("l_linestatus").alias("unidade"),
        (1 - F.col("l_discount").cast("decimal(3,2)")).cast("decimal(3,2)").alias("confianca"),
    )
    # the narrow join comes first, and the rows go to their order as columns: they are wider as JSON
    lines = (
        read(spark, sf_dir, "lineitem")
        .join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .repartition("l_orderkey")
        .select("l_orderkey", F.struct(*line, F.to_json(product).alias("json"), "s_name", "p_name").alias("linha"))
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_list("linha")).alias("linhas"))
    )
    kind = F.col("o_orderkey") % KINDS
    own = F.coalesce(F.transform("linhas", lambda x: x["json"]), F.array().cast("array<string>"))
    swap = F.try_element_at(
        F.create_map(*(F.lit(v) for pair in LAST_PRODUCT.items() for v in pair)), kind.cast("int")
    )
    # the name of the flyer's first product again, with a brand that is too long
    again = F.concat(
        F.lit('{"nome":"'), F.upper(F.get("linhas", F.lit(0))["p_name"]), F.lit('","marca":"' + "m" * 101 + '","preco":5}')
    )
    swap = F.when(kind == KNOWN, F.when(F.size(own) > 1, again)).otherwise(swap)
    products = F.when(
        swap.isNotNull() & (F.size(own) > 0),
        F.concat(F.slice(own, F.lit(1), F.size(own) - 1), F.array(swap)),
    ).otherwise(own)
    listed = F.concat(F.lit("["), F.array_join(products, ","), F.lit("]"))
    start = F.date_format(
        "o_orderdate", "yyyy-MM-dd"
    )
    start = F.when(kind == BAD_DATE, F.concat(start, F.lit("x"))).when(
        F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-M-d")
    ).otherwise(start)
    header = F.to_json(
        F.struct(
            F.when(F.col("o_orderpriority") != "5-LOW", F.get("linhas", F.lit(0))["s_name"]).alias(
                "supermercado"
            ),
            start.alias("data_validade_inicio"),
            F.when(
                F.col("o_orderstatus") != "P",
                F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 7), "yyyy-MM-dd"),
            ).alias("data_validade_fim"),
        )
    )
    opening = F.substring(header, F.lit(1), F.length(header) - 1)  # without the closing brace
    document = (
        F.when(kind == NO_KEY, header)
        .when(kind == NOT_A_LIST, F.concat(opening, F.lit(',"produtos":"nenhum"}')))
        .when(kind == EMPTY_LIST, F.concat(opening, F.lit(',"produtos":[]}')))
        .when(kind == NO_BRACES, F.lit("Não consegui ler este panfleto."))
        .when(kind == CUT_OFF, F.concat(opening, F.lit(',"produtos":[{"nome":"a"}')))
        .when(kind == TRAILING, F.concat(opening, F.lit(',"produtos":'), listed, F.lit("}] {x}")))
        .otherwise(F.concat(opening, F.lit(',"produtos":'), listed, F.lit("}")))
    )
    key = F.col("o_orderkey") % 3
    text = (
        F.when(key == 0, F.concat(F.lit("```json\n"), document, F.lit("\n```")))
        .when(key == 1, F.concat(F.lit("Segue o resultado: "), document))
        .otherwise(document)
    )
    name = F.concat(F.lit("flyer_"), F.col("o_orderkey").cast("string"), F.lit(".jpg"))
    return (
        read(spark, sf_dir, "orders")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            name.alias("nome_arquivo"),
            F.concat(F.lit("/flyers/"), name).alias("caminho_arquivo"),
            text.alias("texto"),
        )
    )
