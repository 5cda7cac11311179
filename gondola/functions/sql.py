"""The rules as SQL functions, for users who write SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gondola.operators.dimensions import latest_by_brand

NORMALIZE_NAME = """
CREATE OR REPLACE TEMPORARY FUNCTION normalizar_nome(texto STRING)
RETURNS STRING
RETURN lower(trim(regexp_replace(texto, r'(?U)\\s+', ' ')))
"""

FIND_PRODUCT = """
CREATE OR REPLACE TEMPORARY FUNCTION buscar_produto_por_nome_normalizado(
  p_nome STRING, p_marca STRING DEFAULT NULL, p_categoria_id INT DEFAULT NULL)
RETURNS TABLE (id BIGINT, nome STRING, marca STRING, categoria STRING, categoria_id INT,
               created_at TIMESTAMP_NTZ)
RETURN SELECT p.id, p.nome, p.marca, p.categoria, p.categoria_id, p.created_at
       FROM (SELECT nome_normalizado, produto.* FROM {newest}) p
       WHERE p.nome_normalizado = normalizar_nome(p_nome)
         AND (p_marca IS NULL OR p.marca IS NULL OR lower(p.marca) = lower(p_marca))
       ORDER BY p.created_at DESC, p.id DESC
       LIMIT 1
"""


def register(spark: SparkSession, produtos: DataFrame | None = None, view: str = "produtos") -> None:
    """Create ``normalizar_nome`` and, given products, the product look-up function.

    The products become the temporary view ``view``, in place of any view of that name, and the
    newest of each name and brand the view ``<view>_recentes``, which the look-up reads. It takes constants,
    or columns of a table of requests:

        SELECT q.*, p.id FROM pedidos q LEFT JOIN LATERAL buscar_produto_por_nome_normalizado(q.nome, q.marca) p

    Spark turns that into a join by name of the distinct requests with one product per name and
    brand, and a join back; no request meets all products of its name.
    """
    spark.sql(NORMALIZE_NAME)
    if produtos is not None:
        produtos.createOrReplaceTempView(view)
        newest = f"{view}_recentes"
        latest_by_brand(produtos).createOrReplaceTempView(newest)
        spark.sql(FIND_PRODUCT.format(newest=f"`{newest}`"))
