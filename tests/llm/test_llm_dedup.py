import hashlib
import itertools
import random

import helpers as h
import numpy as np
import pytest

from gondola.llm import near_dedup, substring_dedup
from gondola.llm.near_dedup import Settings
from gondola.llm.shared import WordHashes


def brute_groups(rows, words):
    sets = {}
    for doc_id, text in rows:
        w = h.words(h.lower(text))
        n = min(words, len(w))
        found = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        sets.setdefault(doc_id, []).append(found)
    parent = {i: i for i in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(parent, 2):
        if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in parent}


def check_groups(found, rows, words):
    expected = brute_groups(rows, words)
    assert len(found) == len(rows)
    for r in found:
        assert r.component_id == expected.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)


def test_groups_of_odd_documents(spark):
    rows = [(r[0], r[1]) for r in h.rows()]
    for words in (2, 5):
        found = near_dedup.groups(h.documents(spark), Settings(shingle_words=words)).collect()
        check_groups(found, rows, words)
    assert near_dedup.groups(h.empty(spark)).collect() == []
    kept = near_dedup.keep_one(h.documents(spark), Settings(shingle_words=2))
    assert kept.columns == h.documents(spark).columns
    assert {2, 3} & {r.doc_id for r in kept.collect()} == set()


@pytest.mark.parametrize("rounds", [1, 3])
def test_groups_of_chains_and_rings(spark, rounds):
    """Neighbours in a chain are linked, its ends are not; the smallest id is in the middle."""
    draw = random.Random(5)
    rows = []
    for chain in range(6):
        words = [f"c{chain}w{i}" for i in range(60)]
        ids = [chain * 100 + i for i in range(12)]
        ids = ids[6:] + ids[:6]
        for k, doc_id in enumerate(ids):
            w = list(words)
            for x in range(k * 2):
                w[x] = f"c{chain}n{x}"
            rows.append((doc_id, " ".join(w)))
    common = [f"p{i}" for i in range(60)]
    rows += [(5000 + k, " ".join(common + [f"d{k}x{i}" for i in range(40)])) for k in range(40)]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    settings = Settings(shingle_words=2, star_rounds=rounds, block=4, broadcast_ids=0)
    check_groups(near_dedup.groups(docs, settings).collect(), rows, 2)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (50, 49), (49, 50)]
    found = {r.id: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(31)}, **{k: 100 for k in range(100, 140)}, 49: 49, 50: 49}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_removed(rows, window):
    first = {}
    places = []
    for doc_id, text in rows:
        w = h.words(text)
        key = -(1 << 63) if doc_id is None else doc_id
        for i in range(len(w) - window + 1):
            seq = tuple(w[i : i + window])
            places.append((doc_id, text, i, seq, key))
            first[seq] = min(first.get(seq, (key, i)), (key, i))
    gone = {}
    for doc_id, text, i, seq, key in places:
        if (key, i) > first[seq]:
            gone.setdefault((doc_id, text), set()).update(range(i, i + window))
    return gone


@pytest.mark.parametrize("window", [1, 4, 20, 23])
def test_removed_words(spark, window):
    rows = [(r[0], r[1]) for r in h.rows()]
    expected = brute_removed(rows, window)
    found = substring_dedup.remove_repeats(h.documents(spark).repartition(3), window).collect()
    assert len(found) == len(rows)
    left = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found]
    right = []
    for doc_id, text in rows:
        w, gone = h.words(text), expected.get((doc_id, text), set())
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        right.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(map(str, left)) == sorted(map(str, right))
    for r in found:
        text = next(t for i, t in rows if i == r.doc_id and len(h.words(t)) == r.n_words)
        if not r.n_removed:
            assert r.text == text
        assert hashlib.sha256(" ".join(h.words(r.text)).encode()).hexdigest() == r.kept_sha256
    assert substring_dedup.remove_repeats(h.empty(spark), window).collect() == []


def test_a_tiny_filter_loses_nothing(spark):
    docs = h.documents(spark)
    wide = substring_dedup.remove_repeats(docs, 20).collect()
    tight = substring_dedup.remove_repeats(docs, 20, max_filter_bytes=16).collect()
    assert sorted(map(str, wide)) == sorted(map(str, tight))


def test_lengths_double():
    assert substring_dedup.level_lengths(20) == [5, 10, 20]
    assert substring_dedup.level_lengths(50) == [7, 13, 25, 50]
    assert substring_dedup.level_lengths(4) == [4]


def unlike(k, n):
    return [f"u{k}x{i}" for i in range(n)]


def test_levels_hold_what_repeats_at_every_shorter_length(spark):
    """Passages of 6, 12 and 30 words in otherwise different texts: each level knows only those that reach it."""
    rows, doc_id = [], 0
    for passages, n in ((4, 6), (3, 12), (2, 30)):
        for p in range(passages):
            for _ in range(2):
                doc_id += 1
                rows.append((doc_id, " ".join(unlike(doc_id, 25) + [f"p{n}n{p}w{i}" for i in range(n)] + unlike(-doc_id, 25))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    levels = substring_dedup.repeated_levels(docs, 20)
    assert [x.length for x in levels] == [5, 10]
    # of 6 words only a fifth can repeat; at 10 words nothing of those passages is left
    assert levels[0].repeated > levels[1].repeated >= 2
    found = substring_dedup.remove_repeats(docs, 20).collect()
    assert sum(r.n_removed for r in found) == 2 * 30
    short = [(i, t) for i, t in rows if i <= 8]
    only = spark.createDataFrame(short, "doc_id long, text string")
    levels = substring_dedup.repeated_levels(only, 40)
    assert [(x.length, x.repeated > 0) for x in levels] == [(5, True), (10, False)]  # the level of 20 is not looked at
    assert not any(r.n_removed for r in substring_dedup.remove_repeats(only, 40).collect())


def test_nothing_repeats_after_the_first_level(spark):
    docs = spark.createDataFrame([(k, " ".join(unlike(k, 60))) for k in range(9)], "doc_id long, text string")
    assert [(x.length, x.repeated) for x in substring_dedup.repeated_levels(docs, 20)] == [(5, 0)]
    assert substring_dedup.later_windows(docs, 20).collect() == []


def test_candidates_are_hashed_alike_at_every_level():
    draw = random.Random(3)
    texts = [" ".join(draw.choices("abcde", k=n)).encode() for n in (3, 19, 20, 90, 400)]
    lengths = substring_dedup.level_lengths(20)
    c = substring_dedup.Candidates(texts, WordHashes(), lengths)
    assert len(c.alive) == 1 + 71 + 381
    every = type("All", (), {"contains": staticmethod(lambda names: np.ones(len(names), bool))})
    words = [w for t in texts for w in t.split()]
    for length in lengths:
        place, names = c.named()
        assert all(a <= p <= a + 20 - length for a, p in zip(c.alive, place, strict=True))
        seen = {}
        for p, name in zip(place.tolist(), names.tolist(), strict=True):
            assert seen.setdefault(tuple(words[p : p + length]), name) == name
        assert len(set(seen.values())) == len(seen)
        if length < 20:
            c.keep(every, names)


@pytest.mark.parametrize("task_windows", [1, 50])
def test_small_tasks_lose_nothing(spark, task_windows):
    rows = [(r[0], r[1]) for r in h.rows() if r[1] != h.LONG]
    rows += [(100 + k, " ".join(f"s{i % 30}" for i in range(k, k + 45))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    gone = brute_removed(rows, 20)
    for r in substring_dedup.remove_repeats(docs, 20, task_windows=task_windows).collect():
        text = next((t for i, t in rows if i == r.doc_id and len(h.words(t)) == r.n_words))
        assert r.n_removed == len(gone.get((r.doc_id, text), ()))


def test_rewrite_cuts_the_passage_and_keeps_columns(spark):
    docs = h.documents(spark)
    out = {r.doc_id: r for r in substring_dedup.rewrite(docs, 50).where("doc_id in (8, 9, 7)").collect()}
    assert out[8].text == f"Start here. {h.PASSAGE} and this is the end of eight"
    assert out[9].text == "Another beginning\nwith another end, of nine"
    assert out[7].text == "one"
    assert substring_dedup.rewrite(docs, 50).columns == docs.columns
