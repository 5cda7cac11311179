"""Registered queries against their SQL, and the pipeline against a plain version of its rules."""

import collections
import html
import re

import corpus_pipeline
import duckdb
import helpers as h
import pytest

from gondola.llm import quality_rules
from gondola.llm.queries import QUERIES, SQL, read
from gondola.session import scratch_path

SF_DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels".split()


def test_every_operator_has_a_query():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = QUERIES[name](spark, SF_DIR)
    cursor = connection.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, cursor.fetchall()))


@pytest.mark.parametrize("name", ["op2_template_removal", "op8_sentencepiece"])
def test_other_queries_give_a_row_each(spark, name):
    rows = QUERIES[name](spark, SF_DIR).collect()
    table = "pages" if "template" in name else "documents"
    assert len(rows) == read(spark, SF_DIR, table).count()
    assert name != "op8_sentencepiece" or all(r.round_trip for r in rows)


def plain_article(page):
    """Blocks of the one article element of a page, by regular expressions only."""
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    inside = re.sub(r"<!--.*?-->|<(script|style|aside|nav|form)\b.*?</\1>", "", inside, flags=re.S)
    inside = re.sub(r"<br\s*/?>", " ", inside)
    blocks = re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|section|blockquote|table|tr|td|pre|hr|figure)\b[^>]*>", inside)
    texts = [" ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", "", b)).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_template_removal_equals_plain_articles(spark):
    pages = {r.page_id: r.html for r in read(spark, SF_DIR, "pages").collect()}
    found = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op2_template_removal"](spark, SF_DIR).collect()}
    assert len(found) == len(pages) > 0
    for page_id, page in pages.items():
        text = plain_article(page)
        assert found[page_id] == (text, len(text))


def plain_verdict(text, rules):
    """Whether the base rules and the learned ones keep a text, in plain Python."""
    w = h.words(text)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if h.words(x)]
    if len(w) < 20 or 100 * len(repeated) > 30 * len(w):
        return False
    row = {
        "word_length": sum(map(len, w)) / len(w),
        "symbol_share": len(re.findall(r"[#*$%&|<>]", text)) / len(w),
        "dup_line_share": (len(lines) - len(set(lines))) / max(1, len(lines)),
        "repeat_share": len(repeated) / len(w),
        "distinct_share": len(set(w)) / len(w),
    }
    values = [row[f] for f in quality_rules.FEATURES]
    return not any(all(c.holds(values) for c in rule) for rule in rules.rules)


def test_quality_verdicts_equal_plain_rules(spark):
    docs = read(spark, SF_DIR, "documents")
    rules = quality_rules.fit(docs, read(spark, SF_DIR, "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = quality_rules.judge(docs, rules).collect()
    assert {r.doc_id: r.kept for r in found} == {i: plain_verdict(t, rules) for i, t in texts.items()}
    for r in found:
        w = h.words(texts[r.doc_id])
        assert r.base_failed == (len(w) < 20 or 100 * r.n_repeat_words > 30 * len(w))


def test_pipeline_takes_odd_documents(spark):
    """Null and repeated ids, null and empty texts, repeated rows, other columns, no rows at all."""
    docs = h.documents(spark)
    for rows in (docs, h.empty(spark)):
        for number, (_, function) in enumerate(corpus_pipeline.STAGES):
            path = scratch_path(spark, f"odd{number}")
            function(spark, rows, SF_DIR).write.parquet(path)
            rows = spark.read.parquet(path)
            if number < 3:
                assert rows.columns == docs.columns
        found = rows.collect()
        kept = {r.doc_id for r in found}
        if found:
            # of the copies and near copies of 1 one stays, and the rows without id
            assert kept & {1, 2} == {1} and {None, 8, 9, 10} <= kept and not kept & {4, 5, 6, 7, 12, 13, 15}
            assert sum(r.length for r in found if r.doc_id == 10) > 60_000


def test_pipeline_stages(spark):
    docs = read(spark, SF_DIR, "documents")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    steps = []
    for number, (_, function) in enumerate(corpus_pipeline.STAGES):
        path = scratch_path(spark, f"stage{number}")
        function(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        steps.append(docs.collect())
        assert number == 3 or docs.columns == columns
    good, single, cut, packed = steps
    rules = quality_rules.fit(read(spark, SF_DIR, "documents"), read(spark, SF_DIR, "labels"))
    assert {r.doc_id for r in good} == {i for i, text in texts.items() if plain_verdict(text, rules)}
    labels = {r.doc_id: r.quality for r in read(spark, SF_DIR, "labels").collect()}
    kept = {r.doc_id for r in good}
    long = {i for i, t in texts.items() if len(h.words(t)) >= 20}
    assert not [i for i in long - kept if labels.get(i) == 1]
    assert {r.doc_id: r.text for r in good}.items() <= texts.items()

    from test_llm_dedup import brute_groups, brute_removed

    rows = [(r.doc_id, r.text) for r in good]
    groups = brute_groups(rows, 5)
    assert {r.doc_id for r in single} == {i for i, root in groups.items() if i == root}
    rows = [(r.doc_id, r.text) for r in single]
    gone = brute_removed(rows, corpus_pipeline.PASSAGE_WORDS)
    after = {r.doc_id: r.text for r in cut}
    for doc_id, text in rows:
        out = gone.get((doc_id, text), set())
        assert h.words(after[doc_id]) == [w for k, w in enumerate(h.words(text)) if k not in out]
    assert {r.doc_id for r in packed} == set(after)
    filled = {}
    for r in packed:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 1024
    assert len(filled) <= sum(filled.values()) / 1024 * 1.05 + 1


def test_pipeline_runs_whole(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0
