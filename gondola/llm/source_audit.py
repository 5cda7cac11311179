"""How the sources of a language differ in their words, by counts that are exact.

Terms are counted where the texts are: cut out of the bytes of many texts at once, packed by length -
up to 8 bytes in one word of 64 bits, up to 16 in two, longer ones in byte-sorted buckets per length -
radix-sorted and run-counted. What leaves a task is one row per language, source and term of a chunk;
Spark adds these up, keeps the terms of enough documents and compares the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.llm.shared import text_bytes
from gondola.operators.ids import assign_ids
from gondola.session import stage

# Bytes of a term, A-Z in lower case; 0 for all others.
FOLD = np.zeros(256, np.uint8)
FOLD[0x80:] = np.arange(0x80, 0x100)
FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
WORD = 8  # bytes in one packed word
WIDE = 4096  # longer terms are sorted as byte strings instead of rows of a matrix
COUNTS = "lang string, source string, term string, n long, docs long"
SCALE = 1_000_000_000


@dataclass(frozen=True)
class Settings:
    """min_docs: documents of a language that must hold a term. top_terms: ranks of the part ``term``.

    chunk_bytes: text counted at once; a longer text is a chunk of its own. pair_rows: pairs of
    sources formed at once from the terms they share.
    """

    min_docs: int = 3
    top_terms: int = 200
    chunk_bytes: int = 8 << 20
    pair_rows: int = 1 << 20


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """Stable order of rows of 64-bit words, the first the most significant: one pass per 16 bits that differ."""
    order = None
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if digit.min() == digit.max():
                continue
            step = np.argsort(digit if order is None else digit[order], kind="stable")  # radix for 16 bits
            order = step if order is None else order[step]
    return np.arange(len(words[0])) if order is None else order


def _runs(new: np.ndarray, docs: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and distinct documents of runs; ``new`` marks rows whose term differs from the one before."""
    first = new | np.concatenate([[True], groups[1:] != groups[:-1]])
    other = first | np.concatenate([[True], docs[1:] != docs[:-1]])
    starts = np.flatnonzero(first)
    return starts, np.diff(np.append(starts, len(new))), np.add.reduceat(other.astype(np.int64), starts)


def _short(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n: int):
    """Terms of at most 8 n bytes as n words each, and a function that turns picked ones into bytes."""
    windows = np.ndarray((len(data) - WORD + 1,), ">u8", data, strides=(1,))
    words = []
    for k in range(n):
        held = np.clip(lengths - WORD * k, 0, WORD)
        word = windows[np.minimum(starts + WORD * k, len(windows) - 1)].astype(np.uint64)
        blank = (8 * (WORD - held)).astype(np.uint64)
        word = np.where(held > 0, (word >> np.minimum(blank, np.uint64(63))) << np.minimum(blank, np.uint64(63)), np.uint64(0))
        words.append(word)

    def text(rows: np.ndarray) -> list[bytes]:
        packed = np.stack([w[rows] for w in words], axis=1).astype(">u8")
        return np.ascontiguousarray(packed).view(f"S{WORD * n}").ravel().tolist()  # drops zeros at the end

    return words, text


def _long(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Order of terms of one length, where a new one begins in it, and the terms in that order."""
    if length <= WIDE:
        terms = np.ascontiguousarray(data[starts[:, None] + np.arange(length)]).view(f"S{length}").ravel()
        order = np.argsort(terms, kind="stable")
        terms = terms[order]
        return order, np.concatenate([[True], terms[1:] != terms[:-1]]), terms.tolist()
    cut = [data[s : s + length].tobytes() for s in starts.tolist()]
    order = sorted(range(len(cut)), key=cut.__getitem__)
    cut = [cut[k] for k in order]
    return np.array(order), np.array([True, *(a != b for a, b in zip(cut, cut[1:], strict=False))]), cut


def count_terms(texts: list[bytes], groups: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """(groups, terms, occurrences, documents) of each length bucket; equal groups must be neighbours."""
    data = np.frombuffer(b"\0".join(texts) + b"\0" * (2 * WORD), np.uint8)
    data = FOLD[data]
    edges = np.flatnonzero(np.diff((data > 0).view(np.int8), prepend=np.int8(0)))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    docs = np.searchsorted(ends, starts, "right")
    for low, high in ((0, WORD), (WORD, 2 * WORD)):
        at = np.flatnonzero((lengths > low) & (lengths <= high))
        if not len(at):
            continue
        words, text = _short(data, starts[at], lengths[at], high // WORD)
        order = radix_order(words)
        new = np.ones(len(at), np.bool_)
        new[1:] = np.any([w[order][1:] != w[order][:-1] for w in words], axis=0)
        doc = docs[at][order]
        first, n, held = _runs(new, doc, groups[doc])
        yield groups[doc[first]], text(order[first]), n, held
    for length in np.unique(lengths[lengths > 2 * WORD]).tolist():
        at = np.flatnonzero(lengths == length)
        order, new, terms = _long(data, starts[at], length)
        doc = docs[at][order]
        first, n, held = _runs(new, doc, groups[doc])
        yield groups[doc[first]], [terms[k] for k in first.tolist()], n, held


def _counter(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            names = sorted({r[0] for r in held})
            number = {name: k for k, name in enumerate(names)}
            held.sort(key=lambda r: number[r[0]])
            groups = np.array([number[r[0]] for r in held], np.int64)

            def batch(group, terms, n, docs):
                lang, source = (pa.array([x[k] for x in names], pa.string()).take(pa.array(group)) for k in (0, 1))
                columns = [lang, source, terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
                return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

            # every group has a row without a term, so that it is known even when it has none
            none = np.zeros(len(names), np.int64)
            yield batch(np.arange(len(names)), pa.nulls(len(names), pa.string()), none, none)
            for group, terms, n, docs in count_terms([r[1] for r in held], groups):
                yield batch(group, pa.array(terms, pa.binary()).cast(pa.string()), n, docs)

        for b in batches:
            langs, sources = b.column("lang").to_pylist(), b.column("source").to_pylist()
            for lang, source, text in zip(langs, sources, text_bytes(b.column("text")), strict=True):
                if held and size + len(text) > settings.chunk_bytes:
                    yield from flush()
                    held, size = [], 0
                held.append(((lang, source), text))
                size += len(text) + 64
        if held:
            yield from flush()

    return run


def term_counts(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, plus a row per group with a null term.

    Null text, lang and source count as ''. Every row of ``docs`` is a document of its own, also when
    ids or rows repeat; other columns are not read.
    """
    settings = settings or Settings()
    blank = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    counted = docs.select(*blank).mapInArrow(_counter(settings), COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), in whole numbers."""
    part = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", part, (total + terms).cast("decimal(20,0)")) + 1


def _gain(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); p and q are at most SCALE + 1, so the square fits in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _kept(counts: DataFrame, settings: Settings) -> DataFrame:
    """Counts of the terms that enough documents of a language hold, with the language's count."""
    by_term = Window.partitionBy("lang", "term")
    found = counts.where(F.col("term").isNotNull()).select(
        "lang",
        "source",
        "term",
        "n",
        F.sum("n").over(by_term).alias("in_lang"),
        F.sum("docs").over(by_term).alias("held"),
        (F.row_number().over(by_term.orderBy("source")) == 1).alias("first"),
    )
    return found.where(F.col("held") >= settings.min_docs).drop("held")


def _groups(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """A row per occurring group: id, kept terms and occurrences there (n_terms, total), and in its language
    (vocabulary, lang_total); p0 is the share of a term that does not occur, null without any kept term."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_terms"))
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("vocabulary"), F.sum("n").alias("lang_total"))
    rows = (
        counts.where(F.col("term").isNull())
        .select("lang", "source")
        .join(own, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .na.fill(0, ["total", "n_terms", "vocabulary", "lang_total"])
    )
    first = F.when(F.col("vocabulary") > 0, _share(F.lit(0), F.col("total"), F.col("vocabulary")))
    none = counts.sparkSession.createDataFrame([], "id long")
    return assign_ids(rows.withColumn("p0", first), none, [F.col("lang"), F.col("source")])


def _shared_terms(settings: Settings):
    """(a, b, value) of pairs of groups that hold a term both, from rows sorted by term.

    For such a term the sums below took each of the two as if the other did not hold it; the value
    replaces that by the true figure. Rows of a term that a batch cuts are carried to the next.
    """

    def pairs(term: np.ndarray, gid: np.ndarray, p: np.ndarray, p0: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        sizes = np.diff(np.append(starts, len(term)))
        start, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)  # of each row's term
        names, code = np.unique(gid, return_inverse=True)
        upto = np.cumsum(size)
        low = 0
        while low < len(term):
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + settings.pair_rows, "right")))
            left = np.repeat(np.arange(low, high), size[low:high])
            within = np.arange(len(left)) - np.repeat(np.cumsum(size[low:high]) - size[low:high], size[low:high])
            right = start[left] + within
            other = left != right
            left, right = left[other], right[other]
            low = high
            if not len(left):
                continue
            gain = lambda x, y: (x - y) * (x - y) // y
            value = gain(p[left], p[right]) - gain(p[left], p0[right]) - gain(p0[left], p[right]) + gain(p0[left], p0[right])
            key = code[left] * len(names) + code[right]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sums = np.add.reduceat(value[order], first)
            columns = [names[key[first] // len(names)], names[key[first] % len(names)], sums]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            names = [table.column(c).to_pylist() for c in ("lang", "term")]
            same = list(zip(*names, strict=True))
            cut = len(same)
            while cut and same[cut - 1] == same[-1]:
                cut -= 1
            rest = table.slice(cut)
            if cut:
                yield from numbered(table.slice(0, cut), same[:cut])
        if rest is not None and rest.num_rows:
            yield from numbered(rest, list(zip(*(rest.column(c).to_pylist() for c in ("lang", "term")), strict=True)))

    def numbered(table: pa.Table, terms: list) -> Iterator[pa.RecordBatch]:
        new = np.array([True, *(a != b for a, b in zip(terms, terms[1:], strict=False))])
        yield from pairs(np.cumsum(new), *(table.column(c).to_numpy() for c in ("gid", "p", "p0")))

    return run


def _pair_part(shares: DataFrame, groups: DataFrame, settings: Settings) -> DataFrame:
    """Sums of gains over all kept terms, for each ordered pair of sources of a language.

    No term is paired with all sources: terms that one of two groups lacks are summed by their
    share (few distinct ones), terms both lack by their number, and only terms both hold one by one.
    """
    names = ["lang", F.col("id").alias("b"), F.col("p0").alias("q0"), F.col("n_terms").alias("other_terms")]
    others = groups.select(*names)
    wide = lambda n, gain: n.cast("decimal(19,0)") * gain.cast("decimal(19,0)")
    neither = (
        groups.select("lang", F.col("id").alias("a"), "p0", "n_terms", "vocabulary")
        .join(others, "lang")
        .where("a <> b")
        .select("a", "b", wide(F.col("vocabulary") - F.col("n_terms") - F.col("other_terms"), _gain(F.col("p0"), F.col("q0"))).alias("value"))
    )
    levels = shares.groupBy("lang", F.col("gid").alias("a"), "p").agg(F.count("*").alias("n"))
    one = (
        levels.join(others, "lang")
        .where("a <> b")
        .select(
            F.inline(
                F.array(
                    F.struct("a", "b", wide(F.col("n"), _gain(F.col("p"), F.col("q0"))).alias("value")),
                    F.struct(F.col("b").alias("a"), F.col("a").alias("b"), wide(F.col("n"), _gain(F.col("q0"), F.col("p"))).alias("value")),
                )
            )
        )
    )
    both = (
        shares.select("lang", "term", "gid", "p", "p0")
        .repartition("lang", "term")
        .sortWithinPartitions("lang", "term")
        .mapInArrow(_shared_terms(settings), "a long, b long, value long")
        .withColumn("value", F.col("value").cast("decimal(38,0)"))
    )
    sums = neither.unionByName(one).unionByName(both).groupBy("a", "b").agg(F.sum("value").alias("value"))
    own = groups.select(F.col("id").alias("a"), "lang", "source")
    item = groups.select(F.col("id").alias("b"), F.col("source").alias("item"))
    return sums.join(own, "a").join(item, "b").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")
    )


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))


def audit(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language.

    Part ``pair``: every other source of the language and the sum over kept terms of
    floor((p - q)^2 / q), p and q being the two sources' smoothed shares of a term in parts of a
    billion; 0 without kept terms. Part ``term``: the ``top_terms`` terms that stand out most against the language.
    The pairs of a language's sources are the result, so it has as many rows. Without documents it
    has none. Nulls, repeated ids and other columns: see ``term_counts``.
    """
    settings = settings or Settings()
    counts = stage(term_counts(docs, settings), "term-counts")
    kept = stage(_kept(counts, settings), "kept-terms")
    groups = stage(_groups(counts, kept), "groups")
    known = groups.select("lang", "source", F.col("id").alias("gid"), "p0", "total", "vocabulary", "lang_total")
    shares = kept.join(known, ["lang", "source"]).select(
        "lang",
        "source",
        "term",
        "gid",
        "p0",
        _share(F.col("n"), F.col("total"), F.col("vocabulary")).alias("p"),
        _share(F.col("in_lang"), F.col("lang_total"), F.col("vocabulary")).alias("q"),
    )
    pairs = _pair_part(shares, groups, settings)
    pairs = pairs.withColumn("rank", _rank().cast("int"))
    terms = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gain(F.col("p"), F.col("q")).alias("value")
    )
    terms = terms.withColumn("rank", _rank().cast("int")).where(F.col("rank") <= settings.top_terms)
    return pairs.unionByName(terms)
