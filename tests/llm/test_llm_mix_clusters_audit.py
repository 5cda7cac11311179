"""Source mixing, centroid clustering and the source audit against plain Python versions."""

import collections
import hashlib
import heapq
import random
from fractions import Fraction

import helpers as h
import numpy as np
import pytest

from gondola.llm import centroids, mixing, source_audit

# ---- mixing --------------------------------------------------------------------

MIX_SCHEMA = "doc_id long, text string, source string, row string, size long, target string, _draw int"


def plain_targets(sizes, settings):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: settings.weights[k % len(settings.weights)] for k, s in enumerate(names)}
    left, full = Fraction(settings.share) * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        given = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if given[s] >= settings.ceiling * sizes[s]]
        if not above:
            return {**{s: float(x) for s, x in given.items()}, **{s: float(x) for s, x in full.items()}}
        full |= {s: settings.ceiling * sizes[s] for s in above}
        left -= sum(settings.ceiling * sizes[s] for s in above)


def mix_rows():
    rows = [(k, f"w{k} " * (k % 30 + 1), f"s{k % 7}" if k % 3 else "hot", "r", k, None, None) for k in range(3000)]
    rows += [(None, None, None, None, None, None, None), (5, "", "s1", "r", 0, None, 1), (6, " \t\n ", "only blank", "r", 0, None, 1)]
    rows += [(9000, h.LONG, "", "r", 1, None, 1), (9001, "É\x1c日本 x", None, "r", 1, None, 1)]
    return rows + rows[:2]


@pytest.mark.parametrize("settings", [mixing.Settings(), mixing.Settings((1,), Fraction(1, 3), 1), mixing.Settings((9, 1, 1, 4), Fraction(5, 2), 7)])
@pytest.mark.parametrize("joined", [False, True])
def test_mix(spark, settings, joined):
    rows = mix_rows()
    docs = spark.createDataFrame(rows, MIX_SCHEMA).repartition(3)
    settings = mixing.Settings(settings.weights, settings.share, settings.ceiling, broadcast_bytes=0 if joined else 1 << 20)
    out = mixing.repetitions(docs, settings)
    found = out.collect()
    assert len(found) == len(rows)
    assert sorted(map(str, (tuple(r.row) for r in found))) == sorted(map(str, rows))
    sizes = collections.Counter()
    for r in rows:
        sizes[r[2]] += len(h.words(r[1]))
    targets = plain_targets(sizes, settings)
    taken = collections.Counter()
    for r in found:
        assert r["size"] == len(h.words(r.row.text))
        assert (r.source_size, r.target) == (sizes[r.row.source], targets[r.row.source])
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in ({int(rate)} if rate == int(rate) else {int(rate), int(rate) + 1})
        assert r.copies <= settings.ceiling
        taken[r.row.source] += r.copies * r["size"]
    for source in ("hot", "s1", "s4"):
        assert abs(taken[source] - targets[source]) <= 0.12 * sizes[source]
    again = mixing.repetitions(docs.repartition(7), settings).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    mixed = mixing.mix(docs, settings)
    assert mixed.columns == docs.columns
    whole = collections.Counter(str(tuple(r)) for r in mixed.collect())
    expected = collections.Counter()
    for r in found:
        expected[str(tuple(r.row))] += r.copies
    assert whole == +expected


def test_targets_stop_at_the_ceiling_and_pass_on_the_rest(spark):
    docs = spark.createDataFrame([(1, "a " * 10, "a"), (2, "b " * 100, "b"), (3, "c " * 1000, "c")], "doc_id long, text string, source string")
    rows = mixing.source_targets(docs).orderBy("source").collect()
    assert [(r.source_size, r.weight, r.target) for r in rows] == [(10, 5, 20.0), (100, 2, 200.0), (1000, 1, 1445.0)]


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], MIX_SCHEMA)
    assert mixing.repetitions(empty).collect() == [] and mixing.mix(empty).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, "", "x")], "doc_id long, text string, source string")
    assert [(r["size"], r.target, r.copies) for r in mixing.repetitions(blank).collect()] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("wrong", [{"weights": ()}, {"weights": (1, 0)}, {"share": Fraction(5, 2)}])
def test_mix_settings_are_checked(wrong):
    with pytest.raises(ValueError):
        mixing.Settings(**wrong)


def test_mix_runs_without_python(spark):
    plan = mixing.mix(spark.createDataFrame(mix_rows()[:50], MIX_SCHEMA))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("ArrowEvalPython", "MapInArrow", "MapInPandas", "BatchEvalPython"))


# ---- clusters ------------------------------------------------------------------


def plain_lloyd(rows, settings):
    """rows: (vec_id, list of ints); assignments, centroids, as the contract words it."""
    def order(r):
        digest = hashlib.sha256(f"{settings.seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "~"
        return digest, r[1]

    means = [list(r[1]) for r in sorted(rows, key=order)[: settings.k]]
    for last in range(settings.rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(means)) for _, v in rows]
        if last == settings.rounds:
            return sorted((str(i), c, d) for (i, _), (d, c) in zip(rows, own)), means
        for c in range(len(means)):
            members = [v for (_, v), (_, x) in zip(rows, own) if x == c]
            if members:
                means[c] = [sum(x) // len(members) for x in zip(*members)]


VECTORS = "vec_id long, embedding array<float>, v string, block int"


def vector_rows(n, spread, components=4):
    pick = random.Random(n)
    rows = [(k, [float(np.float32(pick.gauss(k % 5, spread))) for _ in range(components)], "x", 1) for k in range(n)]
    rows += [rows[0], (None, rows[1][1], None, None), (7, [float("nan")] * components, "x", 1), (8, None, "x", 1)]
    rows += [(9, [1.0] * (components + 1), "x", 1), (10, [1.0] * (components - 1) + [None], "x", 1), (11, [float("inf")] * components, "x", 1)]
    return rows + [(500 + k, [0.5] * components, "copy", 2) for k in range(40)] + [(600, [3e9] * components, "", 0), (601, [-9e5] + [0.0] * (components - 1), "", 0)]


@pytest.mark.parametrize(("n", "spread", "k", "block"), [(300, 0.3, 5, 16), (300, 2.0, 8, 64), (60, 0.0, 8, 7), (3, 1.0, 8, 4)])
def test_clusters_equal_plain_rounds(spark, n, spread, k, block):
    settings = centroids.Settings(k=k, components=4, block_rows=block, bucket_blocks=3)
    rows = vector_rows(n, spread)
    vectors = centroids.whole_vectors(spark.createDataFrame(rows, VECTORS).repartition(3), settings)
    found = centroids.cluster(vectors, settings)
    scaled = [
        (i, [int(np.floor(1024 * x)) for x in v]) for i, v, *_ in rows
        if v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)
        and sum((1024 * x) ** 2 for x in v) < centroids.LONGEST
    ]
    assigned, means = plain_lloyd(scaled, settings)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found.rows.collect()) == assigned
    assert found.centroids == means
    out = centroids.with_inertia(found).collect()
    sums = collections.Counter()
    for _, c, d in assigned:
        sums[c] += d
    assert {(r.cluster, r.cluster_inertia, r.inertia) for r in out} == {(c, s, sum(sums.values())) for c, s in sums.items() if c in {a[1] for a in assigned}}
    assert {r.centroid_sha256 for r in out} <= {hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("gondola_")]


def test_bounds_spare_vectors_of_far_clusters(spark):
    rows = [(k, [100.0 * (k % 4) + random.Random(k).random() for _ in range(4)], "", 0) for k in range(400)]
    settings = centroids.Settings(k=6, components=4, block_rows=50)
    found = centroids.cluster(centroids.whole_vectors(spark.createDataFrame(rows, VECTORS), settings), settings)
    assert found.scanned[0] == 400 and len(found.scanned) > 1
    assert found.scanned[-1] < 200


def test_one_cluster_and_no_vectors(spark):
    settings = centroids.Settings(k=1, components=4)
    rows = [(k, [float(k)] * 4, "", 0) for k in range(9)]
    found = centroids.cluster(centroids.whole_vectors(spark.createDataFrame(rows, VECTORS), settings), settings)
    assert found.centroids == [[4096] * 4] and {r.cluster for r in found.rows.collect()} == {0}
    none = centroids.whole_vectors(spark.createDataFrame(rows, VECTORS).limit(0), settings)
    assert centroids.with_inertia(centroids.cluster(none, settings)).collect() == []


def test_heap_keys_expire_in_order():
    old = np.array([[0, 0], [100, 0]])
    new = np.array([[3, 4], [100, 0]])
    drift = centroids._drifted([1.0, 1.0], old, new)
    assert drift == pytest.approx([6.0, 6.0], abs=1e-3) and min(drift) >= 6.0
    heap = [(5.0, 1), (6.5, 2), (5.9, 0)]
    heapq.heapify(heap)
    assert [heapq.heappop(heap)[1] for _ in range(2)] == [1, 0] and heap[0][0] > drift[0]


# ---- audit ---------------------------------------------------------------------


def plain_terms(text):
    out, term = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalpha():
            if term:
                out.append(term)
            term = ""
        else:
            term += c.translate(h.CAPITALS)
    return out


def plain_audit(rows, min_docs=3, top=200):
    docs = [(lang or "", source or "", plain_terms(text)) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = collections.Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t, n in held.items() if n >= min_docs), key=lambda t: t.encode())
        counts = {s: collections.Counter(t for d in own if d[1] == s for t in d[2] if held[t] >= min_docs) for s in {d[1] for d in own}}

        def share(c):
            return {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        shares = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), collections.Counter()))
        for s, p in shares.items():
            pair = [(o, sum((p[t] - x[t]) ** 2 // x[t] for t in kept)) for o, x in shares.items() if o != s]
            term = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


AUDIT = "text string, lang string, source string, term string, n long, docs int, id int"


def audit_rows():
    pick = random.Random(4)
    names = ["a", "ab", "Abc", "eightlet", "ninelette", "sixteenlettersab", "seventeenlettersx", "ümläut", "日本語", "z" * 40, "q" * 5000, "É", "k\x1cl"]
    rows = []
    for k in range(150):
        source = "hot" if k % 3 else f"s{k % 5}"
        text = " ".join(pick.choices(names, k=pick.randint(0, 25))) + pick.choice(["", "!", "\n", "1a2b3"])
        rows.append((text, pick.choice(["en", "de", None]), source, "term", 1, 2, 3))
    rows += [(None, "en", "empty source", None, None, None, None), ("", "xx", "alone", None, None, None, None)]
    rows += [("a b", "xx", "other", None, None, None, None), ("only twice", "yy", None, None, None, None, None), ("only twice", "yy", "", None, None, None, None)]
    rows += [(h.LONG, "en", "long", None, None, None, None), ("w" * 300_000, "en", "long", None, None, None, None)]
    return rows + rows[:3]


@pytest.mark.parametrize(("chunk", "pairs", "batch"), [(8 << 20, 1 << 20, 1000), (500, 7, 3)])
def test_audit_equals_plain_counts(spark, chunk, pairs, batch):
    rows = audit_rows()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    settings = source_audit.Settings(top_terms=5, chunk_bytes=chunk, pair_rows=pairs)
    found = source_audit.audit(spark.createDataFrame(rows, AUDIT).repartition(4), settings).collect()
    assert sorted(map(tuple, found)) == plain_audit([r[:3] for r in rows], top=5)


def test_audit_of_nothing(spark):
    assert source_audit.audit(spark.createDataFrame([], AUDIT)).collect() == []


def test_radix_order_is_stable_and_by_bytes():
    pick = random.Random(1)
    terms = [bytes(pick.choices(b"abz\xc3\xa9", k=pick.randint(1, 16))) for _ in range(500)]
    words = [np.array([int.from_bytes(t.ljust(16, b"\0")[s : s + 8], "big") for t in terms], np.uint64) for s in (0, 8)]
    assert source_audit.radix_order(words).tolist() == sorted(range(500), key=lambda k: (terms[k], k))
