"""The same results in plain SQL over the test tables, written apart from the Spark code."""

from __future__ import annotations

from gondola import fixed_values as fx


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join(
        "(" + ", ".join(_text(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows
    )


MAPA = f"mapa(ordem, chave, valor) AS (VALUES {_values((i, *p) for i, p in enumerate(fx.CATEGORY_MAP))})"
CATEGORIAS = (
    "categorias(id, nome, descricao, icone) AS "
    f"(VALUES {_values((i, *c) for i, c in enumerate(fx.CATEGORIES, 1))})"
)

PRODUTOS_CRUS = """
produtos_crus AS (
  SELECT p_partkey AS id, p_size, p_type,
         CASE WHEN p_partkey % 4 = 0 THEN upper(p_name)
              WHEN p_partkey % 4 = 1 THEN '  ' || replace(p_name, ' ', '   ') || ' '
              ELSE p_name END AS nome,
         CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS marca,
         CASE p_type WHEN 'STANDARD' THEN 'Carnes' WHEN 'SMALL' THEN 'bebidas em pó'
              WHEN 'ECONOMY' THEN 'Cervejas Especiais' WHEN 'MEDIUM' THEN 'Alimentos'
              WHEN 'LARGE' THEN 'Produtos Gourmet' END AS categoria_sugerida,
         CASE WHEN p_size % 3 = 0 THEN '789' || lpad(CAST(p_partkey // 2 AS VARCHAR), 10, '0') END AS codigo_barras,
         CASE WHEN p_size > 40 THEN p_type END AS descricao,
         TIMESTAMP '1995-01-01 00:00:00' + to_minutes(p_partkey) AS created_at,
         lower(trim(regexp_replace(nome, '\\s+', ' ', 'g'))) AS nome_normalizado
  FROM part)"""

RESOLVIDAS = """
sugestoes AS (SELECT DISTINCT categoria_sugerida AS s FROM produtos_crus),
exatas AS (SELECT s, valor AS m FROM sugestoes JOIN mapa ON chave = trim(lower(s))),
parciais AS (SELECT s, arg_min(valor, ordem) AS m FROM sugestoes, mapa
             WHERE contains(trim(lower(s)), chave) OR contains(chave, trim(lower(s))) GROUP BY s),
mapeadas AS (SELECT g.s, coalesce(e.m, p.m, g.s) AS m
             FROM sugestoes g LEFT JOIN exatas e ON e.s = g.s LEFT JOIN parciais p ON p.s = g.s),
resolvidas AS (SELECT s, coalesce(c.id, 15) AS categoria_id
               FROM mapeadas LEFT JOIN categorias c ON lower(c.nome) = lower(trim(m)) WHERE s IS NOT NULL)"""

PRODUTOS = """
produtos AS (
  SELECT p.*, r.categoria_id, c.nome AS categoria
  FROM produtos_crus p LEFT JOIN resolvidas r ON r.s = p.categoria_sugerida
  LEFT JOIN categorias c ON c.id = r.categoria_id)"""

LOJAS = """
supermercados AS (
  SELECT s_suppkey AS id, s_name AS nome, 'Rede ' || (n_nationkey % 5) AS rede, n_name AS cidade,
         CASE WHEN s_suppkey % 4 <> 0 THEN 'SP' END AS estado, s_acctbal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

PRECOS = """
precos AS (
  SELECT ((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS id,
         l_partkey AS produto_id, l_suppkey AS supermercado_id, l_orderkey AS imagem_id,
         CAST(CAST(l_extendedprice AS DECIMAL(10,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(10,2)) AS preco,
         CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(10,2)) END AS preco_original,
         l_discount >= 0.05 AS em_promocao,
         CAST(l_shipdate AS DATE) AS validade_inicio,
         CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate + INTERVAL 7 DAY AS DATE) END AS validade_fim,
         l_linestatus AS unidade,
         l_shipdate AS created_at
  FROM lineitem)"""

# Flyers: one per order, its lines in order, the defects by the order key.
PANFLETOS = """
linhas AS (
  SELECT l_orderkey AS pedido, s_name, l_linenumber,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos,
         count(*) OVER (PARTITION BY l_orderkey) AS n,
         p_name, p_type,
         CASE WHEN l_partkey % 11 <> 0 THEN p_brand END AS marca,
         CASE p_type WHEN 'STANDARD' THEN 'Carnes' WHEN 'SMALL' THEN 'bebidas em pó'
              WHEN 'ECONOMY' THEN 'Cervejas Especiais' WHEN 'MEDIUM' THEN 'Alimentos'
              WHEN 'LARGE' THEN 'Produtos Gourmet' END AS categoria,
         CAST(CAST(l_extendedprice AS DECIMAL(10,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(10,2)) AS preco,
         CASE WHEN l_returnflag = 'N' AND l_extendedprice <> 0 THEN CAST(l_extendedprice AS DECIMAL(10,2)) END AS preco_original,
         l_discount >= 0.05 AS em_promocao,
         l_linestatus AS unidade,
         CAST(1 - CAST(l_discount AS DECIMAL(3,2)) AS DECIMAL(3,2)) AS confianca
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
primeiras AS (SELECT pedido, s_name, n FROM linhas WHERE pos = 1),
panfletos AS (
  SELECT o_orderkey AS pedido, o_orderkey % 32 AS tipo, coalesce(n, 0) AS n,
         'flyer_' || o_orderkey || '.jpg' AS nome_arquivo,
         '/flyers/flyer_' || o_orderkey || '.jpg' AS caminho_arquivo,
         CASE WHEN o_orderpriority <> '5-LOW' THEN s_name END AS supermercado,
         CAST(o_orderdate AS DATE) AS inicio,
         CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate + INTERVAL 7 DAY AS DATE) END AS fim,
         CASE WHEN tipo = 11 THEN 'Nenhum JSON encontrado na resposta'
              WHEN tipo IN (12, 19) THEN 'JSON inválido' END AS erro_json,
         CASE WHEN tipo IN (11, 12, 19) THEN NULL
              WHEN tipo = 1 THEN 'Campo ''produtos'' não encontrado'
              WHEN tipo = 2 THEN 'Campo ''produtos'' deve ser uma lista'
              WHEN tipo = 3 OR coalesce(n, 0) = 0 THEN 'Nenhum produto encontrado'
              WHEN tipo = 4 THEN 'Produto ' || n || ' não é um objeto'
              WHEN tipo = 5 THEN 'Produto ' || n || ': campo ''nome'' obrigatório'
              WHEN tipo = 6 THEN 'Produto ' || n || ': campo ''preco'' obrigatório'
              WHEN tipo IN (7, 9) THEN 'Produto ' || n || ': preço inválido'
              WHEN tipo = 8 THEN 'Produto ' || n || ': preço negativo' END AS invalido,
         CASE WHEN tipo = 13 THEN 'unconverted data remains: x' END AS cabecalho_erro,
         coalesce(erro_json, 'Dados inválidos: ' || invalido, cabecalho_erro) AS erro
  FROM orders LEFT JOIN primeiras ON pedido = o_orderkey),
proprias AS (
  SELECT f.pedido, f.nome_arquivo, f.caminho_arquivo, l.* EXCLUDE (pedido, n)
  FROM linhas l JOIN panfletos f ON f.pedido = l.pedido
  WHERE (f.tipo NOT IN (4, 5, 6, 7, 8, 9, 10, 14, 15, 16, 17, 18, 20) AND (f.tipo <> 21 OR f.n < 2)) OR l.pos < l.n),
extras(tipo, nome, preco, categoria, em_promocao, confianca, gravar) AS (VALUES
  (14, 'item logico', 1.00, NULL, false, NULL, true),
  (15, 'item caro', NULL, 'Produtos Gourmet', false, NULL, false),
  (17, 'item unidade', 2.35, NULL, false, NULL, false),
  (18, 'item promocao', 3.46, NULL, NULL, 0.50, true)),
conhecidas AS (
  SELECT f.nome_arquivo, f.caminho_arquivo, f.pedido, f.n, upper(p_name) AS nome
  FROM panfletos f JOIN linhas l ON l.pedido = f.pedido AND l.pos = 1
  WHERE f.tipo = 21 AND f.n > 1 AND f.erro IS NULL),
itens AS (
  SELECT p.nome_arquivo, p.caminho_arquivo, p.pedido, pos, 1 AS alternativa, p_name AS nome, marca, categoria,
         preco, preco_original, em_promocao, confianca, unidade, true AS gravar
  FROM proprias p JOIN panfletos f USING (pedido) WHERE f.erro IS NULL
  UNION ALL
  SELECT p.nome_arquivo, p.caminho_arquivo, p.pedido, pos, 2, p_type, marca, categoria,
         preco, preco_original, em_promocao, confianca, unidade, true
  FROM proprias p JOIN panfletos f USING (pedido) WHERE f.erro IS NULL AND l_linenumber % 5 = 0
  UNION ALL
  SELECT nome_arquivo, caminho_arquivo, pedido, n, 1, nome, NULL, categoria, CAST(preco AS DECIMAL(10,2)), NULL,
         em_promocao, CAST(confianca AS DECIMAL(3,2)), NULL, gravar
  FROM panfletos f JOIN extras USING (tipo) WHERE f.erro IS NULL
  UNION ALL
  SELECT nome_arquivo, caminho_arquivo, pedido, n, 1, nome, NULL, NULL, 5.00, NULL, false, NULL, NULL, true
  FROM conhecidas),
mensagens AS (
  SELECT nome_arquivo, 'Erro ao processar produto ' || n || CASE tipo
           WHEN 10 THEN ': preço não é número' WHEN 15 THEN ': preco fora do limite'
           WHEN 16 THEN ': texto maior que a coluna' WHEN 20 THEN ': texto maior que a coluna' ELSE ': unidade com mais de 50 caracteres' END AS mensagem
  FROM panfletos WHERE erro IS NULL AND tipo IN (10, 15, 16, 17, 20))"""

EXISTENTES = """
existentes AS (SELECT * FROM produtos WHERE p_size <= 25),
atuais AS (SELECT nome_normalizado, arg_max(id, (created_at, id)) AS id FROM existentes GROUP BY ALL)"""

CHAVES = """
ordenados AS (
  SELECT *, lower(trim(nome)) AS chave,
         row_number() OVER (PARTITION BY chave ORDER BY caminho_arquivo, pos, alternativa) AS vez
  FROM itens),
novos AS (
  SELECT chave, nome, marca, categoria AS categoria_sugerida,
         (SELECT max(id) FROM existentes)
           + row_number() OVER (ORDER BY caminho_arquivo, pos, alternativa) AS id
  FROM ordenados WHERE vez = 1 AND chave NOT IN (SELECT nome_normalizado FROM atuais)),
chaves AS (
  SELECT nome_normalizado AS chave, id AS produto_id, false AS novo FROM atuais
  WHERE nome_normalizado IN (SELECT chave FROM ordenados)
  UNION ALL SELECT chave, id, true FROM novos)"""

LOJAS_CHAVES = """
lojas_existentes AS (SELECT * FROM supermercados WHERE s_acctbal < 4500),
lojas_panfletos AS (
  SELECT lower(coalesce(supermercado, 'Desconhecido')) AS chave,
         arg_min(coalesce(supermercado, 'Desconhecido'), caminho_arquivo) AS nome,
         min(caminho_arquivo) AS primeira
  FROM panfletos WHERE erro IS NULL GROUP BY 1),
lojas_chaves AS (
  SELECT p.chave, e.id AS supermercado_id, false AS novo, NULL AS nome
  FROM lojas_panfletos p JOIN lojas_existentes e ON lower(e.nome) = p.chave
  UNION ALL
  SELECT chave, (SELECT max(id) FROM lojas_existentes) + row_number() OVER (ORDER BY primeira), true, nome
  FROM lojas_panfletos WHERE chave NOT IN (SELECT lower(nome) FROM lojas_existentes))"""

CAT = [MAPA, CATEGORIAS, PRODUTOS_CRUS, RESOLVIDAS]
PROD = [*CAT, PRODUTOS]
STAR = [*PROD, LOJAS, PRECOS]
INGEST = [*PROD, PANFLETOS, EXISTENTES, CHAVES, LOJAS, LOJAS_CHAVES]

SQL: dict[str, str] = {}


def _add(name: str, parts: list[str], body: str) -> None:
    SQL[name] = (f"WITH {','.join(parts)}\n" if parts else "") + body.strip()


VALID = "(validade_fim >= DATE '2001-06-01' OR validade_fim IS NULL)"
VALID_CLOSED = "validade_fim >= DATE '2001-06-01'"
JOIN3 = "precos pp JOIN produtos p ON pp.produto_id = p.id JOIN supermercados s ON pp.supermercado_id = s.id"
DISCOUNT = "round(CAST((preco_original - preco) / nullif(preco_original, 0) * 100 AS DOUBLE), 2)"

# ---- sources and sinks
_add("src_folder_inventory", [], """
SELECT caminho, split_part(caminho, '/', 4) AS nome_arquivo FROM (
  SELECT '/flyers/' || strftime(o_orderdate, '%Y-%m') || '/f' || o_orderkey ||
         CASE o_orderpriority WHEN '1-URGENT' THEN '.jpg' WHEN '2-HIGH' THEN '.JPEG' ELSE '.webp' END AS caminho
  FROM orders WHERE o_orderpriority NOT IN ('3-MEDIUM', '4-NOT SPECIFIED'))
""".replace("SELECT caminho,", "SELECT caminho AS caminho_arquivo,", 1))
_add("src_folder_listing", [], """
SELECT nome AS nome_arquivo, CAST(length(nome) AS BIGINT) AS tamanho FROM (
  SELECT 'f' || o_orderkey || CASE o_orderpriority WHEN '1-URGENT' THEN '.jpg' WHEN '2-HIGH' THEN '.JPEG' ELSE '.webp' END AS nome
  FROM orders WHERE o_orderpriority NOT IN ('3-MEDIUM', '4-NOT SPECIFIED') AND o_orderdate < TIMESTAMP '1998-01-01')
""")
_add("src_raw_answers", [PANFLETOS], """
SELECT nome_arquivo, caminho_arquivo, pedido % 3 = 0 AS em_bloco,
       tipo NOT IN (1, 2, 11) AS tem_lista,
       CASE WHEN tipo = 11 OR supermercado IS NULL THEN 0 ELSE length(supermercado) END AS tamanho_loja
FROM panfletos
""")
_add("seed_categories", PROD, """
, guardadas AS (SELECT categoria AS nome, min(id) AS id FROM produtos WHERE categoria IS NOT NULL GROUP BY 1)
SELECT CAST(id AS INTEGER) AS id, nome, NULL AS descricao, NULL AS icone FROM guardadas
UNION ALL
SELECT CAST((SELECT max(id) FROM guardadas) + row_number() OVER (ORDER BY id) AS INTEGER), nome, descricao, icone
FROM categorias WHERE nome NOT IN (SELECT nome FROM guardadas)
""")
_add("export_prices", STAR, f"""
SELECT p.nome AS produto, p.marca, p.categoria, preco, preco_original, em_promocao, s.nome AS supermercado,
       validade_inicio, validade_fim, unidade, pp.created_at AS created_at
FROM {JOIN3} ORDER BY pp.created_at DESC
""")
_add("export_json", [PANFLETOS], """
SELECT nome_arquivo, supermercado, n AS produtos FROM panfletos WHERE erro IS NULL
""")

# ---- answers
_add("parse_answers", [PANFLETOS], """
SELECT nome_arquivo, erro_json AS erro, CASE WHEN erro_json IS NULL THEN supermercado END AS supermercado,
       CASE WHEN tipo IN (1, 2, 11, 12, 19) THEN NULL WHEN tipo = 3 THEN 0 ELSE n END AS produtos
FROM panfletos
""")
_add("validate_answers", [PANFLETOS], """
SELECT nome_arquivo, coalesce(erro_json, invalido) AS mensagem FROM panfletos
""")
_add("validate_valid_count", [PANFLETOS], """
SELECT count(*) FILTER (coalesce(erro_json, invalido) IS NULL) AS validos,
       count(*) FILTER (coalesce(erro_json, invalido) IS NOT NULL) AS rejeitados
FROM panfletos
""")
_add("explode_products", [PANFLETOS], f"""
SELECT p.nome_arquivo, pos, CASE WHEN l_linenumber % 5 = 0 THEN p_name || ' OU ' || p_type ELSE p_name END AS nome,
       marca, categoria, unidade
FROM proprias p JOIN panfletos f USING (pedido) WHERE coalesce(erro_json, invalido) IS NULL
UNION ALL
SELECT nome_arquivo, n, CASE tipo WHEN 10 THEN 'item texto' WHEN 14 THEN 'item logico' WHEN 15 THEN 'item caro'
         WHEN 16 THEN repeat('x', 256) WHEN 17 THEN 'item unidade ou item outro' ELSE 'item promocao' END,
       NULL, CASE tipo WHEN 15 THEN 'Produtos Gourmet' END, CASE tipo WHEN 17 THEN repeat('u', 51) END
FROM panfletos WHERE coalesce(erro_json, invalido) IS NULL AND tipo IN (10, 14, 15, 16, 17, 18)
UNION ALL
SELECT nome_arquivo, n, 'item longo', repeat('m', 101), NULL, NULL
FROM panfletos WHERE coalesce(erro_json, invalido) IS NULL AND tipo = 20
UNION ALL SELECT nome_arquivo, n, nome, repeat('m', 101), NULL, NULL FROM conhecidas
""")
_add("flyer_header", [PANFLETOS], """
SELECT nome_arquivo, supermercado, CASE WHEN tipo <> 13 THEN inicio END AS validade_inicio,
       fim AS validade_fim, cabecalho_erro
FROM panfletos WHERE erro_json IS NULL
""")
_add("expand_alternatives", [], """
SELECT doc_id, generate_subscripts(partes, 1) AS alternativa, unnest(partes) AS nome FROM (
  SELECT doc_id, CASE WHEN len(p) > 1
                      THEN list_filter(list_transform(p, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')
                      ELSE [text] END AS partes
  FROM (SELECT doc_id, text, regexp_split_to_array(text, '(?i)\\s+ou\\s+') AS p FROM documents))
""")
_add("price_gate", [PANFLETOS], """
SELECT nome_arquivo, mensagem FROM mensagens WHERE mensagem NOT LIKE '%: texto maior que a coluna'
""")
_add("optional_fields", [PANFLETOS], """
SELECT nome_arquivo, pos, CAST(alternativa AS BIGINT) AS alternativa, nome, preco, preco_original, em_promocao,
       confianca, gravar
FROM itens
UNION ALL
SELECT nome_arquivo, n, 1, CASE tipo WHEN 16 THEN repeat('x', 256) ELSE 'item longo' END,
       CASE tipo WHEN 16 THEN 1.00 ELSE 4.00 END, NULL, false, NULL, true
FROM panfletos WHERE erro IS NULL AND tipo IN (16, 20)
""")
_add("store_default", [PANFLETOS], """
SELECT coalesce(CASE WHEN erro_json IS NULL THEN supermercado END, 'Desconhecido') AS loja,
       count(*) AS panfletos, 'resposta' AS origem
FROM panfletos GROUP BY 1
UNION ALL SELECT 'Campeão', count(*), 'manual' FROM panfletos
""")
_add("flyer_errors", [PANFLETOS], """
SELECT nome_arquivo, caminho_arquivo, 'erro' AS status, erro AS erro_mensagem,
       CAST(NULL AS VARCHAR) AS supermercado_nome, TIMESTAMP '2002-01-01 00:00:00' AS processed_at
FROM panfletos WHERE erro IS NOT NULL
""")
_add("admission_checks", [], """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       TRY_CAST(p AS DECIMAL(10,2)) AS preco, CAST(l_extendedprice AS DECIMAL(10,2)) AS preco_original,
       TRY_CAST(l_quantity AS DECIMAL(3,2)) AS confianca, u AS unidade,
       CASE WHEN TRY_CAST(p AS DECIMAL(10,2)) IS NULL THEN 'preco fora do limite'
            WHEN TRY_CAST(l_quantity AS DECIMAL(3,2)) IS NULL THEN 'confianca fora do limite'
            WHEN length(u) > 50 THEN 'unidade com mais de 50 caracteres' END AS problema
FROM (SELECT *, l_extendedprice * l_quantity * 100 AS p,
             repeat(l_linestatus, CAST(l_quantity AS INTEGER) * 2) AS u FROM lineitem)
""")

# ---- scalar functions
_add("normalize_name", [], """
SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS nome_normalizado FROM documents
""")
_add("normalize_name_products", [PRODUTOS_CRUS], "SELECT id, nome, nome_normalizado FROM produtos_crus")
_add("normalize_name_sql", [PRODUTOS_CRUS], "SELECT id, nome_normalizado FROM produtos_crus")
_add("format_brl", [PRECOS], """
SELECT id, 'R$ ' || translate(format('{:,.2f}', CAST(preco AS DOUBLE)), ',.', '.,') AS texto FROM precos
""")
_add("truncate_labels", [], """
SELECT doc_id,
       CASE WHEN length(text) > 50 THEN substring(text, 1, 47) || '...' ELSE text END AS rotulo50,
       CASE WHEN length(text) > 25 THEN substring(text, 1, 22) || '...' ELSE text END AS rotulo25
FROM documents
""")

# ---- categories
_add("category_exact", [CATEGORIAS, PRODUTOS_CRUS], """
SELECT p.id, CAST(c.id AS INTEGER) AS categoria_id, c.nome AS categoria_encontrada
FROM produtos_crus p LEFT JOIN categorias c ON lower(c.nome) = lower(p.categoria_sugerida)
""")
_add("category_mapped", CAT, """
SELECT id, categoria_sugerida, m AS categoria
FROM produtos_crus LEFT JOIN mapeadas ON s = categoria_sugerida
""")
_add("category_mapped_texts", [MAPA], """
, nomes AS (SELECT doc_id, text AS s, 'texto' AS campo FROM documents
            UNION ALL SELECT doc_id, lang, 'idioma' FROM documents),
baixos AS (SELECT *, regexp_replace(lower(s), '^\\s+|\\s+$', '', 'g') AS b FROM nomes),
acertos AS (SELECT doc_id, campo, any_value(s) AS s, any_value(CASE WHEN chave = b THEN valor END) AS exata,
                   arg_min(valor, ordem) FILTER (contains(b, chave) OR contains(chave, b)) AS parcial
            FROM baixos, mapa GROUP BY doc_id, campo)
SELECT doc_id,
       max(CASE WHEN campo = 'texto' THEN coalesce(exata, parcial, s) END) AS do_texto,
       max(CASE WHEN campo = 'idioma' THEN coalesce(exata, parcial, s) END) AS do_idioma
FROM acertos GROUP BY doc_id
""")
_add("category_resolved", PROD, "SELECT id, categoria_sugerida, categoria, categoria_id FROM produtos")
_add("category_or_default", PROD, "SELECT id, coalesce(categoria_id, 15) AS categoria_id FROM produtos")
_add("category_backfill", [PRODUTOS_CRUS], """
SELECT id, CASE p_type WHEN 'STANDARD' THEN 'Frios' WHEN 'SMALL' THEN 'Temperos' WHEN 'ECONOMY' THEN 'Congelados'
                WHEN 'MEDIUM' THEN 'Doces' WHEN 'LARGE' THEN '' END AS categoria,
       CAST(CASE WHEN p_size > 40 THEN 13 WHEN p_type = 'STANDARD' THEN 4 WHEN p_type = 'SMALL' THEN 6
            WHEN p_type = 'MEDIUM' THEN 9 WHEN p_type IN ('LARGE', 'PROMO') THEN 15 END AS INTEGER) AS categoria_id
FROM produtos_crus
""")
_add("category_counts", PROD, """
SELECT c.nome AS categoria, c.icone, count(p.id) AS total_produtos
FROM categorias c LEFT JOIN produtos p ON p.categoria_id = c.id
GROUP BY c.id, c.nome, c.icone ORDER BY total_produtos DESC, c.nome
""")

# ---- products and stores
_add("product_lookup", PROD, """
, todos AS (SELECT nome_normalizado, arg_max(id, (created_at, id)) AS id FROM produtos GROUP BY ALL),
pedidos AS (SELECT *, p_name || CASE WHEN l_orderkey % 7 = 0 THEN ' ausente' ELSE '' END AS pedido
            FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       ' ' || upper(p_name) || CASE WHEN l_orderkey % 7 = 0 THEN ' ausente' ELSE '' END AS nome, a.id AS produto_id
FROM pedidos LEFT JOIN todos a ON a.nome_normalizado = lower(pedido)
""")
_add("product_lookup_brand", PROD, """
, pedidos AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
                     lower(p_name) || CASE WHEN l_orderkey % 7 = 0 THEN ' ausente' ELSE '' END AS chave,
                     CASE WHEN l_returnflag <> 'R' THEN lower(p_brand) END AS marca
              FROM lineitem JOIN part ON l_partkey = p_partkey),
distintos AS (SELECT DISTINCT chave, marca FROM pedidos),
achados AS (
  SELECT d.chave, d.marca, arg_max(e.id, (e.created_at, e.id)) AS id
  FROM distintos d JOIN produtos e ON e.nome_normalizado = d.chave
   AND (d.marca IS NULL OR e.marca IS NULL OR lower(e.marca) = d.marca)
  GROUP BY d.chave, d.marca)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, e.id AS produto_id, e.nome AS produto_nome,
       e.marca AS produto_marca, CAST(e.categoria_id AS INTEGER) AS categoria_id
FROM pedidos q LEFT JOIN achados a ON a.chave = q.chave AND a.marca IS NOT DISTINCT FROM q.marca
LEFT JOIN produtos e ON e.id = a.id
""")
SQL["product_lookup_lateral"] = SQL["product_lookup_brand"]
_add("product_lookup_sql", PROD, """
SELECT id, nome, marca, categoria, CAST(categoria_id AS INTEGER) AS categoria_id, created_at FROM produtos
WHERE nome_normalizado = 'red widget' AND (marca IS NULL OR lower(marca) = 'brand#17')
ORDER BY created_at DESC LIMIT 1
""")
_add("product_get_or_create", INGEST, """
SELECT k.chave AS nome_normalizado, k.produto_id, k.novo, n.nome, n.marca,
       coalesce(c.nome, n.categoria_sugerida) AS categoria, CAST(c.id AS INTEGER) AS categoria_id,
       n.categoria_sugerida
FROM chaves k LEFT JOIN novos n ON n.chave = k.chave LEFT JOIN resolvidas r ON r.s = n.categoria_sugerida
LEFT JOIN categorias c ON c.id = r.categoria_id
""")
_add("store_get_or_create", [PANFLETOS, LOJAS, LOJAS_CHAVES], """
SELECT chave, supermercado_id, novo, nome FROM lojas_chaves
""")
_add("store_upsert", [LOJAS], """
, chegadas AS (SELECT nome, cidade, estado, CASE WHEN id % 7 <> 0 THEN 'Nova ' || rede END AS rede, id AS ordem
               FROM supermercados),
guardadas AS (SELECT * FROM supermercados WHERE s_acctbal < 4500),
juntas AS (SELECT g.id, g.nome, g.cidade, g.estado, c.ordem IS NOT NULL AS achado, g.rede, c.rede AS nova
           FROM guardadas g LEFT JOIN chegadas c
             ON c.nome = g.nome AND c.cidade = g.cidade AND c.estado = g.estado)
SELECT id, nome, cidade, estado, CASE WHEN achado THEN nova ELSE rede END AS rede FROM juntas
UNION ALL
SELECT (SELECT max(id) FROM guardadas) + row_number() OVER (ORDER BY ordem), nome, cidade, estado, rede
FROM chegadas c WHERE NOT EXISTS (
  SELECT 1 FROM guardadas g WHERE g.nome = c.nome AND g.cidade = c.cidade AND g.estado = c.estado)
""")
_add("flyer_log_update", [], """
SELECT o_orderkey AS id, 'flyer_' || o_orderkey || '.jpg' AS nome_arquivo,
       CASE WHEN o_orderstatus = 'F' THEN 'processado' WHEN o_orderstatus = 'P' THEN 'erro'
            WHEN o_orderkey % 2 = 0 THEN 'erro' ELSE 'processado' END AS status,
       CASE WHEN o_orderstatus = 'P' THEN 'erro de teste'
            WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'sem resposta' END AS erro_mensagem,
       CASE WHEN o_orderstatus = 'O' THEN TIMESTAMP '2002-01-01 00:00:00' ELSE o_orderdate END AS processed_at
FROM orders
""")
_add("product_update", [PRODUTOS_CRUS], """
SELECT id, n AS nome, lower(trim(regexp_replace(n, '\\s+', ' ', 'g'))) AS nome_normalizado,
       CASE WHEN p_type = 'SMALL' THEN coalesce(marca, 'Sem Marca') ELSE marca END AS marca,
       CASE WHEN p_type = 'SMALL' THEN TIMESTAMP '2002-01-01 00:00:00' ELSE created_at END AS updated_at
FROM (SELECT *, CASE WHEN p_type = 'SMALL' THEN 'Novo  ' || nome ELSE nome END AS n FROM produtos_crus)
""")
_add("cascade_delete", [LOJAS, PRECOS], """
SELECT id, produto_id, supermercado_id, imagem_id, preco FROM precos
WHERE produto_id NOT IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')
  AND supermercado_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
  AND imagem_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
""")
SQL["store_upsert_stored"] = SQL["store_upsert"]
SQL["flyer_log_update_stored"] = SQL["flyer_log_update"]
SQL["product_update_stored"] = SQL["product_update"]
SQL["cascade_delete_stored"] = SQL["cascade_delete_compacted"] = SQL["cascade_delete"]
_add("fk_violations", [PRECOS], """
SELECT 'produto_id' AS coluna, CAST(count(*) AS BIGINT) AS precos, count(DISTINCT produto_id) AS ausentes
FROM precos WHERE produto_id NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)
UNION ALL
SELECT 'supermercado_id', count(*), count(DISTINCT supermercado_id)
FROM precos WHERE supermercado_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 4500)
UNION ALL
SELECT 'imagem_id', count(*), count(DISTINCT imagem_id)
FROM precos WHERE imagem_id NOT IN (SELECT o_orderkey FROM orders)
""")

# ---- ingest
for _name, _store in (("flyer_log", "supermercado"), ("flyer_log_manual", "'Campeão'")):
    _add(_name, [PANFLETOS], f"""
SELECT nome_arquivo, caminho_arquivo, CASE WHEN erro IS NULL THEN {_store} END AS supermercado_nome,
       CASE WHEN erro IS NULL THEN inicio END AS data_panfleto,
       CASE WHEN erro IS NULL THEN 'processado' ELSE 'erro' END AS status,
       erro IS NULL AS tem_dados, CASE WHEN erro IS NULL THEN {_store} END AS loja_no_documento,
       CASE WHEN erro IS NULL THEN n END AS produtos,
       erro AS erro_mensagem, TIMESTAMP '2002-01-01 00:00:00' AS processed_at
FROM panfletos
""")
_add("table_defaults", [PRECOS], """
SELECT id, 'false' AS valor, true AS com_data FROM precos
UNION ALL SELECT o_orderkey, 'pendente', true FROM orders
""")
_add("product_admission", [PRODUTOS_CRUS], """
SELECT id, CASE WHEN id % 50 = 0 THEN 'nome nulo'
  WHEN length(repeat(nome, p_size)) > 255 THEN 'nome com mais de 255 caracteres'
  WHEN length(repeat(marca, p_size)) > 100 THEN 'marca com mais de 100 caracteres'
  WHEN length(repeat(categoria_sugerida, greatest(p_size - 40, 1))) > 100
    THEN 'categoria_sugerida com mais de 100 caracteres'
  WHEN length(codigo_barras) + p_size > 13 THEN 'codigo_barras com mais de 13 caracteres' END AS problema
FROM produtos_crus
""")
_add("ingest_stats", INGEST, """
, marcados AS (SELECT o.nome_arquivo, o.gravar, k.novo AND o.vez = 1 AS novo
               FROM ordenados o JOIN chaves k ON k.chave = o.chave),
contas AS (SELECT nome_arquivo, count(*) FILTER (novo) AS novos, count(*) FILTER (NOT novo) AS existentes,
                  count(*) FILTER (gravar) AS gravados
           FROM marcados GROUP BY 1)
SELECT f.nome_arquivo, l.supermercado_id, n AS total_produtos, coalesce(novos, 0) AS produtos_novos,
       coalesce(existentes, 0) AS produtos_existentes, coalesce(gravados, 0) AS precos_salvos,
       coalesce(m.mensagem, '') AS erros
FROM panfletos f LEFT JOIN contas c ON c.nome_arquivo = f.nome_arquivo
LEFT JOIN mensagens m ON m.nome_arquivo = f.nome_arquivo
JOIN lojas_chaves l ON l.chave = lower(coalesce(f.supermercado, 'Desconhecido'))
WHERE f.erro IS NULL
""")
_add("ingest_prices", INGEST, """
SELECT o.nome_arquivo, k.produto_id, l.supermercado_id, o.preco, o.preco_original, o.em_promocao,
       f.inicio AS validade_inicio, f.fim AS validade_fim, o.unidade, o.confianca
FROM ordenados o JOIN chaves k ON k.chave = o.chave JOIN panfletos f ON f.pedido = o.pedido
JOIN lojas_chaves l ON l.chave = lower(coalesce(f.supermercado, 'Desconhecido'))
WHERE o.gravar
""")
_add("batch_summary", INGEST, """
SELECT (SELECT count(*) FROM panfletos) AS imagens,
       (SELECT CAST(sum(n) AS BIGINT) FROM panfletos WHERE erro IS NULL) AS total_produtos,
       (SELECT count(*) FROM novos) AS produtos_novos,
       (SELECT count(*) FROM itens WHERE gravar) AS precos_salvos,
       (SELECT count(*) FROM panfletos WHERE erro IS NOT NULL) AS erros
""")
_add("ingest_incremental", [PANFLETOS], """
SELECT lower(nome) AS nome_normalizado, CAST(1 AS BIGINT) AS produtos, count(*) AS precos,
       CAST(sum(preco) AS DOUBLE) AS soma
FROM itens WHERE gravar GROUP BY 1
""")
SQL["ingest_after_job"] = SQL["ingest_incremental"]
_add("merge_stored", [*STAR, PANFLETOS], """
, antes AS (SELECT nome_normalizado, count(*) AS n, count(DISTINCT precos.id) AS u
          FROM precos JOIN produtos p ON p.id = produto_id GROUP BY 1),
depois AS (SELECT lower(nome) AS nome_normalizado, count(*) AS n FROM itens WHERE gravar GROUP BY 1)
SELECT nome_normalizado, CAST(1 AS BIGINT) AS produtos, coalesce(a.n, 0) AS precos_antes,
       coalesce(d.n, 0) AS precos_novos, coalesce(a.u, 0) + coalesce(d.n, 0) AS ids
FROM antes a FULL JOIN depois d USING (nome_normalizado)
""")
_add("flyer_top3", [PANFLETOS], """
, listas AS (
  SELECT p.nome_arquivo, pos, CASE WHEN l_linenumber % 5 = 0 THEN p_name || ' OU ' || p_type ELSE p_name END AS nome,
         CAST(preco AS DOUBLE) AS preco
  FROM proprias p JOIN panfletos f USING (pedido) WHERE f.erro IS NULL
  UNION ALL
  SELECT nome_arquivo, n, CASE tipo WHEN 10 THEN 'item texto' WHEN 14 THEN 'item logico' WHEN 15 THEN 'item caro'
           WHEN 16 THEN repeat('x', 256) WHEN 17 THEN 'item unidade ou item outro' ELSE 'item promocao' END,
         CASE tipo WHEN 10 THEN 12.5 WHEN 14 THEN 1 WHEN 15 THEN 1000000000 WHEN 16 THEN 1 WHEN 17 THEN 2.345
              ELSE 3.455 END
  FROM panfletos WHERE erro IS NULL AND tipo IN (10, 14, 15, 16, 17, 18)
  UNION ALL SELECT nome_arquivo, n, 'item longo', 4 FROM panfletos WHERE erro IS NULL AND tipo = 20
  UNION ALL SELECT nome_arquivo, n, nome, 5 FROM conhecidas),
postos AS (SELECT *, row_number() OVER (PARTITION BY nome_arquivo ORDER BY preco, pos) AS posto FROM listas)
SELECT nome_arquivo, posto, nome, preco FROM postos WHERE posto <= 3
""")

# ---- reports
_add("best_prices", STAR, f"""
SELECT p.id, p.nome, p.marca, p.categoria, preco, preco_original, em_promocao, s.nome AS supermercado,
       validade_inicio, validade_fim, pp.created_at AS created_at
FROM {JOIN3} WHERE {VALID} ORDER BY p.nome, preco
""")
_add("store_stats", [LOJAS, PRECOS], """
SELECT s.id, s.nome, count(DISTINCT produto_id) AS total_produtos, count(pp.id) AS total_precos,
       round(CAST(sum(preco) AS DOUBLE) / count(preco), 6) AS preco_medio, min(preco) AS menor_preco,
       max(preco) AS maior_preco, count(*) FILTER (em_promocao) AS total_promocoes
FROM supermercados s LEFT JOIN precos pp ON pp.supermercado_id = s.id GROUP BY s.id, s.nome
""")
_add("cheapest_by_category", STAR, f"""
SELECT p.categoria, p.nome, min(preco) AS menor_preco, s.nome AS supermercado
FROM {JOIN3} WHERE {VALID_CLOSED} GROUP BY p.categoria, p.nome, s.nome
""")
_add("cheapest_by_store", STAR, f"""
SELECT p.nome, min(preco) AS preco, s.nome AS supermercado
FROM {JOIN3} WHERE {VALID_CLOSED} GROUP BY p.nome, s.nome
""")
_add("top_cheapest", STAR, f"""
SELECT p.nome, p.marca, preco, s.nome AS supermercado, validade_fim
FROM {JOIN3} WHERE {VALID_CLOSED} ORDER BY preco, pp.id LIMIT 10
""")
for _name, _limit in (("active_promotions", ""), ("top_promotions", "LIMIT 10")):
    _add(_name, STAR, f"""
SELECT p.nome, s.nome AS supermercado, preco_original, preco, {DISCOUNT} AS desconto
FROM {JOIN3} WHERE em_promocao AND {VALID_CLOSED} ORDER BY desconto DESC NULLS FIRST, pp.id {_limit}
""")
_add("all_promotions", STAR, f"""
SELECT p.nome, preco_original, preco, {DISCOUNT} AS desconto
FROM precos pp JOIN produtos p ON pp.produto_id = p.id WHERE em_promocao
""")
for _name, _limit in (("price_history", "LIMIT 20"), ("price_history_all", "")):
    _add(_name, STAR, f"""
SELECT s.nome AS supermercado, preco, em_promocao, validade_inicio, pp.created_at AS created_at
FROM {JOIN3} WHERE lower(p.nome) LIKE lower('%wid%') ORDER BY pp.created_at DESC, pp.id DESC {_limit}
""")
_add("compare_stores", STAR, f"""
, ultimos AS (
  SELECT s.id AS supermercado_id, s.nome AS supermercado, preco, em_promocao, validade_fim,
         row_number() OVER (PARTITION BY s.id ORDER BY pp.created_at DESC, pp.id DESC) AS vez
  FROM {JOIN3} WHERE lower(p.nome) LIKE lower('%wid%') AND {VALID})
SELECT supermercado_id, supermercado, preco, em_promocao, validade_fim,
       row_number() OVER (ORDER BY preco, supermercado_id) = 1 AS melhor_preco
FROM ultimos WHERE vez = 1
""")
_add("global_stats", [PRECOS], """
SELECT (SELECT count(*) FROM part) AS total_produtos,
       (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey) AS total_supermercados,
       count(*) AS total_precos, (SELECT count(*) FROM orders) AS total_imagens,
       coalesce(round(CAST(sum(preco) AS DOUBLE) / count(preco), 6), 0) AS preco_medio,
       count(*) FILTER (em_promocao) AS total_promocoes
FROM precos
""")
_JOINED = "string_agg(DISTINCT nome, ' | ' ORDER BY nome)"
_add("unmapped_categories", PROD, f"""
SELECT categoria_sugerida, count(*) AS quantidade, count(DISTINCT nome) AS nomes_distintos,
       CASE WHEN length({_JOINED}) > 50 THEN substring({_JOINED}, 1, 47) || '...' ELSE {_JOINED} END AS exemplos_produtos
FROM produtos WHERE categoria_sugerida IS NOT NULL AND categoria = 'Outros'
GROUP BY 1 ORDER BY quantidade DESC, 1 LIMIT 20
""")
_add("unmapped_category_names", PROD, """
SELECT categoria_sugerida, nome, count(*) AS quantidade FROM produtos
WHERE categoria_sugerida IS NOT NULL AND categoria = 'Outros' GROUP BY 1, 2
""")
_add("unmapped_examples3", PROD, """
, nomes AS (SELECT DISTINCT categoria_sugerida, nome FROM produtos
            WHERE categoria_sugerida IS NOT NULL AND categoria = 'Outros'),
primeiros AS (SELECT *, row_number() OVER (PARTITION BY categoria_sugerida ORDER BY nome) AS vez FROM nomes)
SELECT categoria_sugerida,
       (SELECT count(*) FROM produtos p WHERE p.categoria_sugerida = n.categoria_sugerida AND p.categoria = 'Outros') AS quantidade,
       string_agg(nome, ', ' ORDER BY nome) AS exemplos
FROM primeiros n WHERE vez <= 3 GROUP BY 1 ORDER BY quantidade DESC, 1 LIMIT 20
""")
_DIFFERS = "lower(trim(categoria_sugerida)) <> lower(trim(coalesce(categoria, '')))"
_add("mapped_categories", PROD, f"""
SELECT categoria_sugerida, categoria AS categoria_mapeada, count(*) AS quantidade,
       count(DISTINCT nome) AS nomes_distintos,
       CASE WHEN length({_JOINED}) > 50 THEN substring({_JOINED}, 1, 47) || '...' ELSE {_JOINED} END AS exemplos_produtos
FROM produtos WHERE {_DIFFERS} GROUP BY 1, 2 ORDER BY quantidade DESC, 1, 2 LIMIT 20
""")
_add("mapped_category_names", PROD, f"""
SELECT categoria_sugerida, categoria AS categoria_mapeada, nome, count(*) AS quantidade
FROM produtos WHERE {_DIFFERS} GROUP BY 1, 2, 3
""")
_add("mapped_labels", PROD, f"""
SELECT CASE WHEN length(categoria_sugerida) > 25 THEN substring(categoria_sugerida, 1, 22) || '...'
            ELSE categoria_sugerida END AS sugerida,
       CASE WHEN length(categoria) > 25 THEN substring(categoria, 1, 22) || '...'
            ELSE coalesce(categoria, 'N/A') END AS mapeada,
       count(*) AS quantidade
FROM produtos WHERE {_DIFFERS} GROUP BY categoria_sugerida, categoria
ORDER BY quantidade DESC, categoria_sugerida, categoria LIMIT 20
""")
_add("mapping_stats", PROD, """
SELECT CASE WHEN categoria = 'Outros' THEN 'Não Mapeada' WHEN categoria_sugerida IS NULL THEN 'Sem Sugestão'
            WHEN lower(trim(categoria_sugerida)) = lower(trim(categoria)) THEN 'Exata'
            ELSE 'Mapeada' END AS tipo_mapeamento,
       count(*) AS quantidade,
       round(CAST(count(*) * 100.0 / (SELECT count(*) FROM produtos) AS DOUBLE), 2) AS percentual
FROM produtos GROUP BY 1
""")
_add("remapped_products", PROD, """
SELECT nome, marca, categoria_sugerida, categoria FROM produtos
WHERE categoria_sugerida IS NOT NULL AND lower(trim(categoria_sugerida)) <> lower(trim(categoria))
ORDER BY created_at DESC, id DESC LIMIT 50
""")
_add("products_by_suggestion", PROD, """
SELECT nome, marca, categoria, created_at FROM produtos
WHERE categoria_sugerida = 'Produtos Gourmet' ORDER BY created_at DESC
""")

# ---- duplicates
_add("duplicate_links", PROD, """
, primeiros AS (SELECT nome_normalizado, min(id) AS id FROM produtos GROUP BY 1)
SELECT p1.id AS produto1_id, p1.nome AS produto1_nome, p1.marca AS produto1_marca,
       p1.categoria AS produto1_categoria, p2.id AS produto2_id, p2.nome AS produto2_nome,
       p2.marca AS produto2_marca, p2.categoria AS produto2_categoria,
       p1.nome_normalizado AS nome_normalizado_comum
FROM primeiros f JOIN produtos p1 ON p1.id = f.id
JOIN produtos p2 ON p2.nome_normalizado = f.nome_normalizado AND p1.id < p2.id
""")
_add("duplicate_groups", PROD, """
SELECT nome_normalizado, count(*) AS quantidade_duplicatas, count(DISTINCT nome) AS nomes_originais,
       min(id) AS primeiro_id, max(id) AS ultimo_id, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS pares
FROM produtos GROUP BY 1 HAVING count(*) > 1
""")
_add("duplicate_group_count", PROD, """
SELECT count(*) FILTER (nome_normalizado IS NOT NULL) AS grupos, count(*) AS grupos_com_nulo
FROM (SELECT nome_normalizado FROM produtos GROUP BY 1 HAVING count(*) > 1)
""")
_add("barcode_violations", [PRODUTOS_CRUS], """
SELECT codigo_barras, count(*) AS quantidade, min(id) AS primeiro_id FROM produtos_crus
WHERE codigo_barras <> '' GROUP BY 1 HAVING count(*) > 1
""")
_add("quality_metrics", PROD, """
SELECT 'Total de Produtos' AS metrica, CAST(count(*) AS VARCHAR) AS valor FROM produtos
UNION ALL SELECT 'Produtos com Nome Normalizado', CAST(count(*) AS VARCHAR) FROM produtos WHERE nome_normalizado IS NOT NULL
UNION ALL SELECT 'Produtos com Código de Barras', CAST(count(*) AS VARCHAR) FROM produtos
          WHERE codigo_barras IS NOT NULL AND codigo_barras <> ''
UNION ALL SELECT 'Nomes Únicos (Normalizados)', CAST(count(DISTINCT nome_normalizado) AS VARCHAR) FROM produtos
""")
_add("duplicate_members", [*PROD, PRECOS], """
SELECT nome_normalizado, id, nome, marca, categoria, CAST(categoria_id AS INTEGER) AS categoria_id,
       categoria_sugerida, codigo_barras, descricao, created_at,
       (SELECT count(*) FROM precos WHERE produto_id = p.id) AS total_precos
FROM produtos p
WHERE nome_normalizado IN (SELECT nome_normalizado FROM produtos GROUP BY 1 HAVING count(*) > 1)
""")
FUSAO = """
contados AS (SELECT p.*, coalesce(c.n, 0) AS total_precos FROM produtos p
             LEFT JOIN (SELECT produto_id, count(*) AS n FROM precos GROUP BY 1) c ON c.produto_id = p.id),
pontuados AS (
  SELECT *, count(*) OVER (PARTITION BY nome_normalizado) AS quantidade,
         row_number() OVER (PARTITION BY nome_normalizado ORDER BY total_precos DESC,
           (coalesce(marca, '') <> '')::INT + (coalesce(categoria_id, 0) <> 0)::INT
           + (coalesce(codigo_barras, '') <> '')::INT + (coalesce(descricao, '') <> '')::INT DESC,
           created_at, id) AS lugar
  FROM contados),
membros AS (SELECT * FROM pontuados WHERE quantidade > 1),
principais AS (SELECT * FROM membros WHERE lugar = 1),
doados AS (
  SELECT nome_normalizado,
         arg_max(marca, (created_at, id)) FILTER (coalesce(marca, '') <> '') AS marca,
         arg_max(categoria_id, (created_at, id)) FILTER (coalesce(categoria_id, 0) <> 0) AS categoria_id,
         arg_max(codigo_barras, (created_at, id)) FILTER (coalesce(codigo_barras, '') <> '') AS codigo_barras,
         arg_max(descricao, (created_at, id)) FILTER (coalesce(descricao, '') <> '') AS descricao
  FROM membros WHERE lugar > 1 GROUP BY 1),
preenchidos AS (
  SELECT p.nome_normalizado, p.id, p.nome, p.categoria, p.created_at,
         coalesce(p.marca, d.marca) AS marca, CAST(coalesce(p.categoria_id, d.categoria_id) AS INTEGER) AS categoria_id,
         coalesce(p.codigo_barras, d.codigo_barras) AS codigo_barras, coalesce(p.descricao, d.descricao) AS descricao,
         (p.marca IS NULL AND d.marca IS NOT NULL) OR (p.categoria_id IS NULL AND d.categoria_id IS NOT NULL)
         OR (p.codigo_barras IS NULL AND d.codigo_barras IS NOT NULL)
         OR (p.descricao IS NULL AND d.descricao IS NOT NULL) AS mudou
  FROM principais p JOIN doados d USING (nome_normalizado))"""
MERGE = [*PROD, PRECOS, FUSAO]
_add("merge_principal", MERGE, """
SELECT nome_normalizado, id AS principal_id, quantidade,
       (SELECT CAST(sum(total_precos) AS BIGINT) FROM membros m WHERE m.nome_normalizado = p.nome_normalizado) AS precos
FROM principais p
""")
_add("merge_fill", MERGE, """
SELECT nome_normalizado, id, marca, categoria_id, codigo_barras, descricao FROM preenchidos
""")
_add("merge_transfer", MERGE, """
SELECT c.id, coalesce(q.id, c.produto_id) AS produto_id, preco
FROM precos c LEFT JOIN membros m ON m.id = c.produto_id
LEFT JOIN principais q ON q.nome_normalizado = m.nome_normalizado
""")
_add("merge_products", MERGE, """
SELECT id, nome, marca, categoria, categoria_id, codigo_barras, descricao,
       CASE WHEN mudou THEN TIMESTAMP '2002-01-01 00:00:00' ELSE created_at END AS updated_at
FROM preenchidos
UNION ALL
SELECT id, nome, marca, categoria, CAST(categoria_id AS INTEGER), codigo_barras, descricao, created_at
FROM pontuados WHERE quantidade = 1
""")
_add("merge_stats", MERGE, """
SELECT count(*) FILTER (lugar = 1) AS grupos_duplicados, count(*) FILTER (lugar = 1) AS produtos_mesclados,
       count(*) FILTER (lugar > 1) AS produtos_removidos,
       CAST(coalesce(sum(total_precos) FILTER (lugar > 1), 0) AS BIGINT) AS precos_transferidos
FROM membros
""")
_add("merge_one_group", MERGE, """
SELECT id, nome, marca, categoria, categoria_id, codigo_barras, descricao,
       CASE WHEN mudou THEN TIMESTAMP '2002-01-01 00:00:00' ELSE created_at END AS updated_at
FROM preenchidos WHERE nome_normalizado = 'red widget'
UNION ALL
SELECT id, nome, marca, categoria, CAST(categoria_id AS INTEGER), codigo_barras, descricao, created_at
FROM pontuados WHERE nome_normalizado IS DISTINCT FROM 'red widget' OR quantidade = 1
""")
