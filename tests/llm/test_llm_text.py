import collections
import re
import zlib
from pathlib import Path

import helpers as h
import numpy as np
import public_tokenizers
import pytest

from gondola.llm import language_model, license_rules, licenses, packing, quality_rules, sentencepiece_codec


def test_quality_statistics(spark):
    found = quality_rules.statistics(h.documents(spark)).collect()
    expected = []
    for doc_id, text, *_ in h.rows():
        w = h.words(text)
        lines = [x for x in (text or "").split("\n") if h.words(x)]
        places = {}
        for i in range(len(w) - 7):
            places.setdefault(tuple(w[i : i + 8]), []).append(i)
        repeated = {x for p in places.values() if len(p) > 1 for i in p for x in range(i, i + 8)}
        symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
        expected.append((doc_id, len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(repeated)))
    left = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found]
    assert sorted(map(str, left)) == sorted(map(str, expected))
    assert quality_rules.statistics(h.empty(spark)).collect() == []


def test_learned_rules_reject_junk_only(spark):
    good = [(k, " ".join(f"plain{k}w{i}" for i in range(30)), 1) for k in range(60)]
    junk = [(k, " ".join(f"ju$nk{k}#w{i}" for i in range(30)), 0) for k in range(60, 90)]
    rows = spark.createDataFrame(good + junk, "doc_id long, text string, quality int")
    odd = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    labels = rows.select("doc_id", "quality").union(odd)
    rules = quality_rules.fit(rows, labels)
    assert rules.rules
    kept = {r.doc_id for r in quality_rules.keep_good(rows, rules).collect()}
    assert kept == {k for k, _, _ in good}
    assert quality_rules.keep_good(rows, rules).columns == rows.columns
    assert quality_rules.fit(rows, labels.limit(0)).rules == ()
    judged = quality_rules.judge(h.documents(spark), rules)
    assert judged.count() == len(h.rows())
    assert quality_rules.judge(h.empty(spark), quality_rules.DecisionList()).collect() == []


def test_quality_plan_has_no_python(spark):
    plan = quality_rules.judge(h.documents(spark), quality_rules.DecisionList())._jdf.queryExecution().toString()
    plan += licenses.scan(h.documents(spark))._jdf.queryExecution().toString()
    assert not re.search("EvalPython|MapInArrow|MapInPandas|ArrowEval|Exchange", plan)


def brute_scan(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", h.lower(text))
    base = [
        (i, label)
        for phrase, label in license_rules.BASE_PHRASES
        for i in range(len(w))
        if w[i : i + len(phrase.split())] == phrase.split()
    ]
    line = " " + " ".join(w) + " "
    hits = []
    for rule in license_rules.rules():
        for m in re.finditer(rule.regex, line):
            start = line[: m.start()].count(" ") - 1
            hits.append((start, -start - m[0].count(" ") - 1, -rule.priority, rule.number, rule.label))
    hits.sort()
    kept = [x for k, x in enumerate(hits) if not any(e[1] <= x[1] and e[2] <= x[2] for e in hits[:k])]
    return w, base, kept


def test_license_scan(spark):
    texts = [r[1] for r in h.rows()] + [
        "Licensed under the Apache License, Version 2.0. See CC BY cc by CC-BY 4.0",
        "SPDX-License-Identifier: MIT",
        "distributed under the terms of the GNU Lesser General Public License version 2.1 or any later version",
        "released under a license; all rights reserved; ALL RIGHTS RESERVED",
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
        "K is the Kelvin sign; mit licenİce; GPLv3 gpl 2",
        "under the GNU General Public License, or (at your option) any later version, thanks",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(docs).collect():
        w, base, kept = brute_scan(texts[r.doc_id])
        assert r.n_words == len(w)
        assert r.n_base == len(base)
        assert r.first_word == min((i for i, _ in base), default=None)
        assert r.last_word == max((i for i, _ in base), default=None)
        assert r.base_labels == sorted({label for _, label in base})
        assert [(d.start, -d.end, -d.priority, d.rule, d.label) for d in r.detections] == kept
        assert r.labels == sorted({label for _, label in base} | {x[4] for x in kept})
        assert 0 <= r.score <= 1
    found = {r.doc_id: r.labels for r in licenses.scan(docs).collect()}
    assert "Apache-2.0" in found[len(h.rows())] and found[len(h.rows()) + 1] == ["MIT"]
    assert "LGPL-2.1" in found[len(h.rows()) + 2]
    last = [r for r in licenses.scan(docs).collect() if r.doc_id == len(texts) - 1][0]
    assert ("GPL", 2, 13) in [(d.label, d.start, d.end) for d in last.detections]
    assert licenses.scan(h.empty(spark)).collect() == []


def most_spaces(parsed):
    """How many spaces a match can hold at most."""
    total = 0
    for op, value in parsed:
        kind = str(op)
        if kind == "LITERAL":
            total += value == ord(" ")
        elif kind == "NOT_LITERAL":
            total += value != ord(" ")
        elif kind == "IN":
            total += any((str(o), v) == ("LITERAL", 32) or str(o) == "RANGE" and v[0] <= 32 <= v[1] for o, v in value)
        elif kind == "BRANCH":
            total += max(map(most_spaces, value[1]))
        elif kind == "SUBPATTERN":
            total += most_spaces(value[-1])
        elif kind == "MAX_REPEAT":
            one = most_spaces(value[2])
            total += one * int(value[1]) if one else 0
        else:
            assert kind in ("ASSERT", "ASSERT_NOT"), kind
    return total


def test_rules_are_many_and_short_enough():
    found = license_rules.rules()
    assert len(found) >= 200
    assert len({r.number for r in found}) == len(found)
    assert max(most_spaces(re._parser.parse(rule.regex)) + 1 for rule in found) <= license_rules.MAX_MATCH_WORDS


@pytest.mark.parametrize("bound", [1 << 20, 300])
def test_language_model(spark, bound):
    """Base score exactly, model score against plain counts, in one pass and in many, with and without a join."""
    docs = h.documents(spark)
    settings = language_model.Settings(broadcast_bytes=bound, bits_per_key=24)
    model = language_model.train(docs, settings)
    found = language_model.score(docs, model).collect()
    rows = [(r[0], r[1]) for r in h.rows()]
    assert len(found) == len(rows)
    tokens = [(i, [w.encode() for w in h.words(h.lower(t))] + [None]) for i, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in rows]
    c = {}
    for (_, w), out in zip(tokens, held):
        for x in [] if out else w:
            c[x] = c.get(x, 0) + 1
    total, types = sum(c.values()), len(c)
    expected = []
    for (i, w), out in zip(tokens, held):
        base = sum(np.log10((c.get(x, 0) + 0.1) / (total + 0.1 * (types + 1))) for x in w)
        expected.append((i, out, len(w), sum(x in c for x in w), total, f"{base:.6f}"))
    left = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.6f}") for r in found]
    assert sorted(map(str, left)) == sorted(map(str, expected))
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[10].score > by_id[10].base_score  # seen bigrams help
    if bound == 300:
        assert len(model.shards()) > 1
        whole = language_model.score(docs, language_model.train(docs, language_model.Settings(bits_per_key=24))).collect()
        assert sorted(f"{r.doc_id} {r.score:.6f}" for r in whole) == sorted(f"{r.doc_id} {r.score:.6f}" for r in found)


def test_unigrams_beyond_the_bound_are_joined(spark, monkeypatch):
    docs = h.documents(spark)

    def scores(bound):
        settings = language_model.Settings(broadcast_bytes=bound, bits_per_key=3)  # many false positives
        found = language_model.score(docs, language_model.train(docs, settings)).collect()
        return sorted(f"{r.doc_id} {r.n_tokens} {r.n_known} {r.base_score:.6f} {r.score:.6f}" for r in found)

    whole, asked, filter_of = scores(1 << 20), [], language_model.Model.filter
    monkeypatch.setattr(language_model.Model, "filter", lambda self, kind, parts=None: asked.append(kind) or filter_of(self, kind, parts))
    assert scores(10_000) == whole
    assert set(asked) == {2}


def test_frequent_words_and_texts_are_not_joined(spark, monkeypatch):
    """Beyond the bound only rare words go to the documents that hold them, and what is written of a text is shorter than it."""
    draw = np.random.default_rng(4)
    ranks = (draw.pareto(0.8, (300, 150)) * 3).astype(int) % 2000
    texts = [" ".join(f"someword{x}" for x in r[: 1 + k % 150]) + f" only{k}" for k, r in enumerate(ranks.tolist())]
    rows = [*enumerate(texts), (0, texts[0]), (None, None), (7, ""), (None, "onlyhere onlyhere someword0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked, written, plain, path = [], [], language_model.Model.unigrams_of, language_model.scratch_path
    monkeypatch.setattr(language_model.Model, "unigrams_of", lambda self, words: asked.append(words.count()) or plain(self, words))
    monkeypatch.setattr(language_model.Model, "shards", lambda self: [[*range(1 << self.part_bits)]])
    monkeypatch.setattr(language_model, "scratch_path", lambda *a: written.append(path(*a)) or written[-1])

    def scores(bound):
        model = language_model.train(docs, language_model.Settings(broadcast_bytes=bound))
        found = language_model.score(docs, model).collect()
        return model, sorted(f"{r.doc_id} {r.held_out} {r.n_tokens} {r.n_known} {r.base_score!r} {r.score!r}" for r in found)

    _, whole = scores(1 << 24)
    assert not asked and not written
    model, found = scores(7000)
    assert found == whole and len(found) == len(rows)
    assert 300 <= asked[0] < model.types * 0.8
    size = sum(f.stat().st_size for f in Path(written[0]).glob("*.parquet"))
    assert size < sum(map(len, texts)) / 2
    assert not [*Path(written[0]).parents[1].glob("*/numbered")]  # what came before is gone
    assert scores(10)[1] == whole  # no type is frequent


def test_counts_beyond_32_bits(spark):
    settings = language_model.Settings()
    gram, most = np.uint64(5), 0xFFFFFFFF
    blocks = [gram.tobytes()] * 3, [np.uint32(most).tobytes()] * 3
    row = language_model._merged(1, 0, 6, settings, *blocks)
    schema = "kind int, part int, grams binary, counts binary, bits binary, types long, tokens long, ends long"
    model = language_model.Model(spark.createDataFrame([row], schema), 6, row[6], 1, 1, len(row[4]), settings)
    assert model.tokens == 3 * most
    assert [x.tolist() for x in model.vocabulary()] == [[5], [3 * most]]
    found = model.unigrams_of(spark.createDataFrame([(5,), (6,)], "gram long")).collect()
    assert sorted((r.gram, r.c) for r in found) == [(5, 3 * most), (6, 0)]


def test_language_model_without_rows(spark):
    model = language_model.train(h.empty(spark))
    assert (model.tokens, model.types) == (0, 0)
    assert language_model.score(h.empty(spark), model).collect() == []
    assert all(r.base_score == 0 for r in language_model.score(h.documents(spark), model).where("n_tokens = 1").collect())


def test_levels_keep_small_counts():
    counts = np.arange(1, 2000)
    for base in (2.0, 1.5, 1.1):
        low, high = language_model.span_of(language_model.level_of(counts, base), base)
        assert low[0] == high[0] == 1
        assert ((low <= counts) & (counts <= high) & (high - low <= counts * (base - 1) + 1)).all()
    assert [x.tolist() for x in language_model.span_of(np.array([0]), 2.0)] == [[0], [0]]


def plain_model(rows, settings):
    """p(word, context) from plain counts of the training rows, quantised as the filter's levels are; None is the end and the begin."""
    ones, twos, documents = collections.Counter(), collections.Counter(), 0
    for doc_id, text in rows:
        if zlib.crc32(str(doc_id).encode()) % 10:
            tokens = [*h.words(h.lower(text)), None]
            ones.update(tokens)
            twos.update(zip([None, *tokens[:-1]], tokens))
            documents += 1
    below = sum(ones.values()) + 0.1 * (len(ones) + 1)

    def span(count, base):
        return [x.item() for x in language_model.span_of(language_model.level_of(np.array([count]), base) if count else np.array([0]), base)]

    def p(word, context):
        seen = documents if context is None else span(ones[context], settings.unigram_base)[1]
        single = (span(ones[word], settings.unigram_base)[0] + 0.1) / below
        return (min(seen, span(twos[context, word], settings.bigram_base)[0]) + settings.prior * single) / (seen + settings.prior)

    return p, ones


@pytest.mark.parametrize("bound", [1 << 24, 20_000])
def test_model_score_equals_plain_counts(spark, bound):
    """With bits enough to exclude false hits; and what may follow a context never exceeds 1."""
    draw = np.random.default_rng(8)
    ranks = (draw.pareto(0.9, (250, 40)) * 3).astype(int) % 180
    rows = [(k, " ".join(f"W{x}" for x in r[: k % 41])) for k, r in enumerate(ranks.tolist())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    settings = language_model.Settings(bits_per_key=200, broadcast_bytes=bound)
    found = {r.doc_id: r.score for r in language_model.score(docs, language_model.train(docs, settings)).collect()}
    p, ones = plain_model(rows, settings)
    for doc_id, text in rows:
        tokens = [*h.words(h.lower(text)), None]
        plain = sum(np.log10(p(w, c)) for c, w in zip([None, *tokens[:-1]], tokens))
        assert found[doc_id] == pytest.approx(plain, rel=1e-9)
    words = [*ones, "no such word"]
    sums = [sum(p(w, c) for w in words) for c in ones]
    assert max(sums) <= 1 + 1e-9 and min(sums) > 0.3


PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_packing_of_odd_documents(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    found = packing.pack(h.documents(spark), PATH, group_rows=10).collect()
    pieces = []
    for doc_id, text, *_ in h.rows():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or min(1024, len(ids))
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        cuts = cuts if cuts[-1] == len(ids) else [*cuts, len(ids)]
        for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
            crc = zlib.crc32(np.array(ids[a:b], "<u4").tobytes())
            pieces.append((doc_id, number, a, b - a, crc, ids[a:b]))
    left = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in found]
    assert sorted(map(str, left)) == sorted(map(str, pieces))
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in places.values():
        inside.sort()
        assert [o for o, _ in inside] == list(np.cumsum([0, *(n for _, n in inside[:-1])]))
        assert sum(n for _, n in inside) <= 1024
    assert packing.pack(h.empty(spark), PATH).collect() == []


@pytest.mark.parametrize("text", ["", "  a  b \n c\n\n d  ", " x\x1cy \x85 z q", "it's  's", "a\tb \tc  \n", "<|endoftext|> x", "é 日本 ☃"])
def test_piece_ids_are_the_tokenizers(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    found = np.frombuffer(next(packing.PieceIds(PATH).encode([text])), "<u4").tolist()
    assert found == tokenizer.encode(text, add_special_tokens=False).ids


def test_new_parts_of_a_text_reach_the_tokenizer_in_one_call():
    known = packing.PieceIds(PATH, limit=8)
    texts = ["a b c d", "b c d e a", "x  y z", "z it's", "k l m n o p q r s t"]
    asked, plain = [], known.ids

    def ids(pieces):
        asked.append(pieces)
        return plain(pieces)

    known.ids = ids
    assert list(known.encode(texts)) == list(plain(texts))
    assert asked[0] == ["a", "b", "x ", "z", "k"]
    assert [sorted(p.split()) for p, in asked[1:3]] == [["b", "c", "d"], ["a", "e"]]
    assert len(known.parts) == 9  # of the text that alone exceeds the limit


MARKED = ["see <|endoftext|> x", "a  <|endoftext|>", "<|endoftext|>  b c", "no mark  here", "x<|endoftext|>y \n <|endoftext|>", "<|endoftext"]


def test_pieces_are_those_of_the_plain_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string")
    found = {r.doc_id: r.ids for r in packing.pieces(docs, PATH).collect()}
    assert found == {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for k, t in enumerate(MARKED)}


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_respects_every_capacity(rule):
    draw = np.random.default_rng(3)
    lengths = draw.integers(1, 101, 500)
    capacity = packing.Capacity(tokens=100, documents=4, attention=6000)
    bins, offsets = packing.best_fit(lengths, capacity, packing.Choice(rule, (1.0, 0.1, 0.1)))
    for number in range(bins.max() + 1):
        inside = lengths[bins == number]
        assert inside.sum() <= 100 and len(inside) <= 4
        assert (inside.astype(float) ** 2).sum() <= 6000 or len(inside) == 1
    assert bins.max() + 1 >= lengths.sum() / 100
    loose, _ = packing.best_fit(lengths, packing.Capacity(100, 100, 10_000), packing.Choice(rule))
    assert loose.max() + 1 <= 1.02 * lengths.sum() / 100 + 2


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def brute_ids(vocabulary, text):
    """The whole lattice at once."""
    best = [(0.0, [])] + [None] * len(text)
    for at in range(len(text)):
        single = False
        for end in range(at + 1, min(len(text), at + vocabulary.longest) + 1):
            found = vocabulary.pieces.get(text[at:end])
            if found:
                single = single or end == at + 1
                score = best[at][0] + found[0]
                if best[end] is None or score > best[end][0]:
                    best[end] = (score, [*best[at][1], found[1]])
        if not single:
            score = best[at][0] + vocabulary.unknown_score
            if best[at + 1] is None or score > best[at + 1][0]:
                best[at + 1] = (score, best[at][1] + vocabulary.fallback(text[at]))
    return best[-1][1]


def test_sentencepiece_against_the_whole_lattice():
    codec = sentencepiece_codec.Codec(MODEL)
    for text in ["", " ", "Hello   world\n\tx  ", "\na\n", "日本語 ☃ 🎉 x", "a▁b", "é\x00z", "<0x41> <s>", "thing " * 20, "x" * 700]:
        escaped = (" " + text).replace(" ", "▁") if text else ""
        ids = np.frombuffer(codec.encode(text), np.int32)
        assert ids.tolist() == brute_ids(codec.v, escaped)
        assert codec.decode(ids) == text.replace("▁", " ")
        for portion in (1, 7, 64):
            codec.portion = portion
            assert codec.stream(escaped) == ids.tobytes()


def test_streaming_keeps_a_bounded_window():
    viterbi = sentencepiece_codec.Viterbi(sentencepiece_codec.Vocabulary(MODEL))
    ids, most = [], 0
    for _ in range(400):
        ids += viterbi.feed("ababbanana" * 10)
        most = max(most, len(viterbi.text))
    assert most < 300 and len(ids) > 1000


def test_no_segmentation_of_the_library_scores_more():
    import sentencepiece

    with open(MODEL, "rb") as file:
        raw = file.read()
    at = raw.index(b"\x18\x02", raw.index(b"tok_v0"))  # the model type: 1 is the unigram search
    library = sentencepiece.SentencePieceProcessor(model_proto=raw[:at] + b"\x18\x01" + raw[at + 2 :])
    codec = sentencepiece_codec.Codec(MODEL)
    score = lambda ids: sum(library.get_score(i) for i in ids)
    equal = 0
    for word in "sttible and other quick brown foxes jumped over lazily sleeping dogs ththereou ouellement".split():
        own, theirs = np.frombuffer(codec.encode(word), np.int32).tolist(), library.encode(word)
        assert score(own) >= score(theirs)
        equal += own == theirs
    assert equal > 5


def test_sentencepiece_of_odd_documents(spark):
    encoded = sentencepiece_codec.encode(h.documents(spark), MODEL)
    decoded = sentencepiece_codec.decode(encoded, MODEL).collect()
    left = sorted(f"{r.doc_id} {r.text}" for r in decoded)
    assert left == sorted(f"{r[0]} {r[1] or ''}" for r in h.rows())
    assert sentencepiece_codec.encode(h.empty(spark), MODEL).collect() == []


def test_license_words_are_counted_by_their_gaps(spark):
    texts = ["", " ", "a", "a ", " a", "-a--b-", "A.Z1", "\x00\x7f", "é ü", "\U00020000 x", "\n\na\t\tB\u00a0c ", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scanned = licenses.scan(docs)
    found = {r.doc_id: r.n_words for r in scanned.collect()}
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    assert found == {k: len(words.findall((t or "").lower())) for k, t in enumerate(texts)}
    # a negated class is tested character by character through several calls: it took 70 percent of the scan
    patterns = re.findall(r"regexp_\w+\(.*?\)", scanned._jdf.queryExecution().optimizedPlan().toString())
    assert patterns and not any("[^\\x00" in p for p in patterns)
