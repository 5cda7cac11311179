"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm import (
    centroids,
    language_model,
    licenses,
    metric_tree,
    mixing,
    near_dedup,
    packing,
    quality_rules,
    sentencepiece_codec,
    source_audit,
    substring_dedup,
    templates,
    warc,
)
from gondola.llm.shared import prepare
from workload.scratch import ensure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(ensure(spark)).read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file; its folder is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[function.__name__] = function
    return function


@query
def op1_metric_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = metric_tree.whole_vectors(read(spark, sf_dir, "embeddings"), 1024)
    index = metric_tree.build_index(vectors)
    if index is None:
        return vectors.selectExpr("id as query_id", "1 as rank", "id as vec_id", "id as score").limit(0)
    return metric_tree.top_k(index, vectors.where("id % 100 = 0"), 10)


SQL["op1_metric_tree_search"] = r"""
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op2_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = templates.extract(read(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", "labels").alias("labels"),
        "score",
        F.size("detections").cast("long").alias("n_detections"),
    )


@query
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_model.score(docs, language_model.train(docs))


@query
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = near_dedup.Settings(shingle_words=2)
    return near_dedup.groups(read(spark, sf_dir, "documents"), settings)


SQL["op5_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^ 	-
]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE
    WHEN len(words) = 0 THEN []
    WHEN len(words) = 1 THEN words
    ELSE list_distinct([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) END AS shingles
  FROM w
), e AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) + any_value(y.n) AS total, count(*) AS common
  FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
    AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY ALL
), l AS (
  SELECT a, b FROM c WHERE 100 * common >= 80 * (total - common)
), r AS (
  SELECT doc_id AS id, doc_id AS reach FROM s
  UNION
  SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a
), m AS (
  SELECT id, min(reach) AS component_id FROM r GROUP BY id
)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN m ON m.id = s.doc_id
"""


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), with_ids=False)


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = substring_dedup.remove_repeats(docs, window=20, with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL["op7_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS pos FROM w WHERE len(words) >= 20
), k AS (
  SELECT doc_id, pos, array_to_string(words[pos:pos + 19], ' ') AS seq FROM s
), f AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY seq ORDER BY doc_id, pos) AS place FROM k
), g AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS word FROM f WHERE place > 1
), r AS (
  SELECT doc_id, list(word) AS gone FROM g GROUP BY doc_id
), p AS (
  SELECT w.doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN r USING (doc_id)
)
SELECT doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(array_to_string([words[i] FOR i IN range(1, len(words) + 1) IF NOT list_contains(gone, i)], ' '))
    AS kept_sha256
FROM p
"""


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer("piece_bpe_32k.model")
    encoded = sentencepiece_codec.encode(read(spark, sf_dir, "documents"), model)
    decoded = sentencepiece_codec.decode(encoded, model)
    return decoded.select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_ids"),
        F.length("text").cast("long").alias("decoded_chars"),
        (F.xxhash64("text") == F.col("tag")).alias("round_trip"),
    )


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, read(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules)


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    index = warc.write_archive(read(spark, sf_dir, "pages"), folder)
    found = warc.read_records(index, folder, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


SQL["op10_warc"] = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first,
    array_to_string([
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(hex, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1)
      FOR k IN range(32)], '') AS digest
  FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, url
FROM d
"""


@query
def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.repetitions(read(spark, sf_dir, "documents"))
    return taken.select(
        F.col("row.doc_id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "copies",
    )


# A source stops at twice its size exactly when those with a smaller size per weight, itself and its
# part of the rest leave as much to give; the rest is shared by weight.
SQL["op11_source_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM d GROUP BY source
), w AS (
  SELECT source, source_size, [5, 2, 1][((place - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS k FROM w
), b AS (
  SELECT a.source, a.source_size, a.weight,
    coalesce(sum(z.source_size) FILTER (z.k < a.k), 0)::BIGINT AS sizes_before,
    coalesce(sum(z.weight) FILTER (z.k < a.k), 0)::BIGINT AS weights_before,
    sum(z.source_size)::BIGINT AS total, sum(z.weight)::BIGINT AS weights
  FROM o a, o z GROUP BY a.source, a.source_size, a.weight, a.k
), f AS (
  SELECT *, 2 * source_size * (weights - weights_before) * 2 <= weight * (3 * total - 4 * sizes_before) AS is_full FROM b
), r AS (
  SELECT coalesce(sum(source_size) FILTER (is_full), 0)::BIGINT AS full_size,
    coalesce(sum(weight) FILTER (NOT is_full), 0)::BIGINT AS free_weight FROM f
), g AS (
  SELECT source, source_size, CASE WHEN is_full THEN (2 * source_size)::DOUBLE
    ELSE (weight * (3 * total - 4 * full_size))::DOUBLE / (2 * free_weight)::DOUBLE END AS target
  FROM f, r
), c AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || t), 1, 13))::BIGINT::DOUBLE
      / 4503599627370496 AS draw
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), n AS (
  SELECT *, floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM c
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies FROM n
"""


@query
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = centroids.Settings()
    vectors = centroids.whole_vectors(read(spark, sf_dir, "embeddings"), settings)
    return centroids.with_inertia(centroids.cluster(vectors, settings))


def _lloyd_rounds(rounds: int) -> str:
    """Assignment and means of each round as SQL steps; centroids are (c, v)."""
    step = r"""a{r} AS MATERIALIZED (
  SELECT k, v, arg_min(c, d * 8 + c) AS c, min(d) AS d FROM (
    SELECT x.k, x.v, m.c, list_sum([(x.v[i] - m.v[i]) * (x.v[i] - m.v[i]) FOR i IN range(1, 65)])::BIGINT AS d
    FROM x, c{r} m
  ) GROUP BY k, v
)"""
    mean = r"""n{r} AS (
  SELECT c, i, floor_div FROM (
    SELECT c, i, (sum(e)::HUGEINT - ((sum(e)::HUGEINT % count(*)) + count(*)) % count(*)) // count(*) AS floor_div
    FROM (SELECT c, unnest(range(1, 65)) AS i, unnest(v) AS e FROM a{r}) GROUP BY c, i
  )
), c{s} AS MATERIALIZED (
  SELECT m.c, coalesce(z.v, m.v) AS v FROM c{r} m
  LEFT JOIN (SELECT c, list(floor_div::BIGINT ORDER BY i) AS v FROM n{r} GROUP BY c) z ON z.c = m.c
)"""
    return ", ".join(x.format(r=r, s=r + 1) for r in range(rounds + 1) for x in ((step, mean) if r < rounds else (step,)))


SQL["op12_centroid_clustering"] = (
    r"""
WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id, [floor(1024 * e::DOUBLE)::BIGINT FOR e IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS c, v FROM (
    SELECT sha256('3:' || vec_id) AS h, v FROM x ORDER BY h LIMIT 8
  )
), """
    + _lloyd_rounds(10)
    + r""", i AS (
  SELECT c, sum(d)::BIGINT AS cluster_inertia FROM a10 GROUP BY c
)
SELECT x.vec_id, a10.c::INT AS cluster, a10.d AS distance, i.cluster_inertia,
  (SELECT sum(d)::BIGINT FROM a10) AS inertia,
  sha256(array_to_string([e::VARCHAR FOR e IN c10.v], ',')) AS centroid_sha256
FROM a10 JOIN x ON x.k = a10.k JOIN i ON i.c = a10.c JOIN c10 ON c10.c = a10.c
"""
)


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(read(spark, sf_dir, "documents"))


SQL["op13_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (
  SELECT k, lang, source, unnest(terms) AS term FROM d
), m AS (
  SELECT lang, term, count(*)::BIGINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 3
), v AS (
  SELECT lang, count(*)::BIGINT AS v, sum(n)::BIGINT AS n FROM m GROUP BY lang
), g AS (
  SELECT lang, source, coalesce(any_value(s.n), 0)::BIGINT AS n FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (
    SELECT lang, source, count(*) AS n FROM t JOIN m USING (lang, term) GROUP BY lang, source
  ) s USING (lang, source) GROUP BY lang, source
), c AS (
  SELECT lang, source, term, count(*)::BIGINT AS n FROM t JOIN m USING (lang, term) GROUP BY lang, source, term
), p AS MATERIALIZED (
  SELECT g.lang, g.source, m.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + v.v) AS p,
    1 + (1000000000::HUGEINT * (m.n + 1)) // (v.n + v.v) AS q
  FROM g JOIN m ON m.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = m.term
), z AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(z.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN z ON z.lang = a.lang AND z.source = a.source AND z.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q
), k AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r
)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 200
"""
