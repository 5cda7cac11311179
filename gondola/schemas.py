"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.fixed_values import STATUS_PENDING

PRODUTOS = (
    "id bigint, nome string, nome_normalizado string, marca string, categoria string, "
    "categoria_id int, categoria_sugerida string, codigo_barras string, descricao string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
SUPERMERCADOS = (
    "id bigint, nome string, rede string, cidade string, estado string, created_at timestamp_ntz"
)
IMAGENS = (
    "id bigint, nome_arquivo string, caminho_arquivo string, supermercado_nome string, "
    "data_panfleto date, status string, texto_extraido string, dados_json variant, "
    "erro_mensagem string, created_at timestamp_ntz, processed_at timestamp_ntz"
)
PRECOS = (
    "id bigint, produto_id bigint, supermercado_id bigint, imagem_id bigint, "
    "preco decimal(10,2), preco_original decimal(10,2), em_promocao boolean, "
    "validade_inicio date, validade_fim date, unidade string, descricao_adicional string, "
    "confianca decimal(3,2), created_at timestamp_ntz"
)
CATEGORIAS = "id int, nome string, descricao string, icone string, created_at timestamp_ntz"
RESPOSTAS = "nome_arquivo string, caminho_arquivo string, texto string"

TABLES = {
    "produtos": PRODUTOS,
    "supermercados": SUPERMERCADOS,
    "imagens": IMAGENS,
    "precos": PRECOS,
    "categorias": CATEGORIAS,
}


# Stored products are split by this hash of their normalised name.
NAME_BUCKET = "balde"


def name_bucket(normalized: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(normalized), F.lit(buckets)).cast("int")


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


# What a column gets that the input does not have; all others get NULL.
DEFAULTS = {
    "produtos": {"created_at": "localtimestamp()", "updated_at": "localtimestamp()"},
    "supermercados": {"created_at": "localtimestamp()"},
    "imagens": {"status": f"'{STATUS_PENDING}'", "created_at": "localtimestamp()"},
    "precos": {"em_promocao": "false", "created_at": "localtimestamp()"},
    "categorias": {"created_at": "localtimestamp()"},
}


def conform(df: DataFrame, name: str) -> DataFrame:
    """Order and cast the columns as the stored table has them.

    A column the input lacks gets its default. A NULL that is there stays.
    """
    fields = empty_table(df.sparkSession, name).schema.fields
    present, defaults = set(df.columns), DEFAULTS.get(name, {})
    return df.selectExpr(
        *(
            f"cast({f'`{f.name}`' if f.name in present else defaults.get(f.name, 'null')} "
            f"as {f.dataType.simpleString()}) as `{f.name}`"
            for f in fields
        )
    )
