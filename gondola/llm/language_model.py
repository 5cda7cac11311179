"""Bigram language model in a log-frequency Bloom filter.

Counts are quantised to levels of a logarithm; an n-gram of level q is put into the filter as the
keys (n-gram, 1) ... (n-gram, q), so its count is found by probing until a key is missing.
Tasks count their own rows first and send one sorted block per part of the hash space; each part
is merged, quantised and turned into filter bits by one task. The bigrams' filter is broadcast in
shards of at most ``Settings.broadcast_bytes``; a token's bigram lies in one shard, so the sums of
several passes add up. The unigrams' filter and their exact counts, which answer the base score, are
broadcast where each is within the same bound. Beyond it the most frequent types are broadcast, as many
as the bound holds, and texts are written once as numbers of types; what the filter and the counts say
of the rarer words is joined to the documents that hold them. Results are equal.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions.skew import per_key
from gondola.llm.filters import positions
from gondola.llm.shared import (
    WordHashes, as_signed, join_hashes, lower_ascii, release_memory, split_words, text_bytes, worker_cache,
)
from gondola.session import scratch, scratch_path, stage

END, BEGIN = np.uint64(0x5EED0E0D), np.uint64(0x5EEDBE61)  # hashes of the two marks no word is
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Settings:
    bits_per_key: float = 8.0
    unigram_base: float = 1.1  # ratio of neighbouring levels
    bigram_base: float = 1.5
    prior: float = 2.0  # weight of the unigram estimate, in counts
    broadcast_bytes: int = 96 << 20
    part_bytes: int = 32 << 20  # text per part of the hash space
    task_tokens: int = 1_500_000  # tokens a task counts before it sends blocks
    task_words: int = 200_000  # different words a task remembers


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id's digits is divisible by 10; a missing id counts as an empty text, held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    doc_id = F.col(f"`{key}`").cast("long")
    return docs.select(
        F.coalesce(doc_id, F.lit(NO_ID)).alias("id"),
        F.coalesce(F.xxhash64(F.col(f"`{text}`")), F.lit(0)).alias("tag"),
        is_held_out(doc_id).alias("held_out"),
        F.col(f"`{text}`").alias("text"),
    )


def level_of(counts: np.ndarray, base: float) -> np.ndarray:
    """1 for a count of 1, and one more for every factor of ``base``."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(base) + 1e-9).astype(np.int64)


def span_of(levels: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest count of a level; 0 and 0 for level 0."""
    low = np.ceil(base ** (levels - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(base**levels * 1.0 - 1e-9) - 1)
    return np.where(levels > 0, low, 0.0), np.where(levels > 0, high, 0.0)


def level_keys(grams: np.ndarray, level: int) -> np.ndarray:
    return grams + np.uint64(level * 0xD6E8FEB86659FD93 % (1 << 64))


def leveled_bits(grams: np.ndarray, counts: np.ndarray, base: float, bits_per_key: float) -> np.ndarray:
    levels = level_of(counts, base)
    size = max(64, int(levels.sum() * bits_per_key) // 8 * 8 + 8)
    bits = np.zeros(size, np.bool_)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for at in positions(level_keys(grams[levels >= level], level), np.uint64(size)):
            bits[at] = True
    return np.packbits(bits)


class LeveledFilter:
    """Levels of n-grams; parts that are not given hold nothing."""

    def __init__(self, sizes: list[int], part_bits: int, base: float):
        """``sizes`` are the bytes of each part; a part of none gets eight empty ones."""
        self.part_bits, self.base = part_bits, base
        held = np.maximum(np.array(sizes, np.uint64), np.uint64(8))
        self.sizes = held * np.uint64(8)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.uint64)
        self.bytes = np.zeros(int(held.sum()), np.uint8)

    def fill(self, part: int, bits: bytes) -> None:
        start = int(self.starts[part]) // 8
        self.bytes[start : start + len(bits)] = np.frombuffer(bits, np.uint8)

    def part(self, grams: np.ndarray) -> np.ndarray:
        return (grams >> np.uint64(64 - self.part_bits)).astype(np.int64)

    def levels(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams), np.int64)
        left = np.arange(len(grams))
        part = self.part(grams)
        level = 0
        while len(left):
            level += 1
            found = np.ones(len(left), np.bool_)
            size, start = self.sizes[part], self.starts[part]
            for at in positions(level_keys(grams, level), size):
                at += start
                byte = self.bytes[(at >> np.uint64(3)).astype(np.int64)]
                found &= (byte >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
            left, grams, part = left[found], grams[found], part[found]
            out[left] = level
        return out

    def at_least(self, grams: np.ndarray) -> np.ndarray:
        return span_of(self.levels(grams), self.base)[0]


class _OnePart(LeveledFilter):
    """A single part; all n-grams asked for must be of it."""

    def __init__(self, bits: bytes, base: float):
        super().__init__([len(bits)], 1, base)
        self.fill(0, bits)

    def part(self, grams: np.ndarray) -> np.ndarray:
        return np.zeros(len(grams), np.int64)


def _short(grams: np.ndarray, part_bits: int) -> np.ndarray:
    """Keep the part and 32 more bits: enough, as few n-grams of a part agree in them."""
    drop = np.uint64(32 - part_bits)
    return grams >> drop << drop


def _flat(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end among them, and the tokens of each text."""
    words = [split_words(lower_ascii(t)) for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    out = np.empty(int(lengths.sum()), np.uint64)
    ends = np.cumsum(lengths) - 1
    inner = np.ones(len(out), np.bool_)
    inner[ends] = False
    out[inner] = hashes.of([w for ws in words for w in ws])
    out[ends] = END
    return out, lengths


def _contexts(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    before[np.cumsum(lengths) - lengths] = BEGIN
    return before


@dataclass
class Model:
    """What training leaves: the stored parts, and what is known of the whole corpus."""

    parts: DataFrame
    part_bits: int
    tokens: int
    types: int
    documents: int
    unigram_bytes: int  # of the unigrams' filter
    settings: Settings

    def shards(self) -> list[list[int]]:
        """All parts of the hash space, grouped so that the filter bytes of a group stay in the bound."""
        sizes = self.parts.where("kind = 2").select("part", F.octet_length("bits").alias("n"))
        known = {r.part: r.n for r in sizes.collect()}
        out, held = [[]], 0
        for part in range(1 << self.part_bits):
            if out[-1] and held + known.get(part, 0) > self.settings.broadcast_bytes:
                out.append([])
                held = 0
            out[-1].append(part)
            held += known.get(part, 0)
        return out

    def filter(self, kind: int, parts: list[int] | None = None) -> LeveledFilter:
        chosen = self.parts.where(F.col("kind") == kind)
        if parts is not None:
            chosen = chosen.where(F.col("part").isin(parts))
        base = self.settings.unigram_base if kind == 1 else self.settings.bigram_base
        sizes = {r.part: r.n for r in chosen.select("part", F.octet_length("bits").alias("n")).collect()}
        found = LeveledFilter([sizes.get(k, 0) for k in range(1 << self.part_bits)], self.part_bits, base)
        # part by part into one array, within broadcast_bytes; see shards()
        for row in chosen.select("part", "bits").toLocalIterator():
            found.fill(row.part, row.bits)
        return found

    def _count_type(self) -> type:
        """No count is above that of all tokens."""
        return np.uint32 if self.tokens <= 0xFFFFFFFF else np.uint64

    def vocabulary_bytes(self) -> int:
        return self.types * (8 + np.dtype(self._count_type()).itemsize)

    def vocabulary(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of all types and their counts; within broadcast_bytes, see vocabulary_bytes."""
        ones = self.parts.where("kind = 1")
        sizes = {r.part: r.types for r in ones.select("part", "types").collect()}
        ends = np.cumsum([sizes.get(k, 0) for k in range(1 << self.part_bits)])
        grams, counts = np.empty(self.types, np.uint64), np.empty(self.types, self._count_type())
        for row in ones.select("part", "grams", "counts").toLocalIterator():
            place = slice(ends[row.part] - sizes[row.part], ends[row.part])
            grams[place], counts[place] = np.frombuffer(row.grams, np.uint64), np.frombuffer(row.counts, np.uint64)
        return grams, counts

    def frequent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes, levels in the filter and counts of the most frequent types, within broadcast_bytes.

        All types with a count of some level and above: those of the next level do not all fit.
        """
        base, ones = self.settings.unigram_base, self.parts.where("kind = 1").select("part", "bits", "grams", "counts")

        def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    levels, n = np.unique(level_of(np.frombuffer(held, np.uint64), base), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(n), part, np.int32)), pa.array(levels), pa.array(n)], names=["part", "level", "n"]
                    )

        known = ones.select("part", "counts").mapInArrow(sizes, "part int, level long, n long")
        per_type = 8 + 2 + np.dtype(self._count_type()).itemsize
        held, least = 0, None
        for row in sorted(known.groupBy("level").agg(F.sum("n").alias("n")).collect(), reverse=True):
            if (held + row.n) * per_type > self.settings.broadcast_bytes:
                break
            held, least = held + row.n, row.level
        grams, levels, counts = np.empty(held, np.uint64), np.empty(held, np.uint16), np.empty(held, self._count_type())
        if least is None:
            return grams, levels, counts

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, bits, own, n in zip(*(x.to_pylist() for x in batch.columns)):
                    n = np.frombuffer(n, np.uint64)
                    often = level_of(n, base) >= least
                    own = np.frombuffer(own, np.uint64)[often]
                    found = own, _OnePart(bits, base).levels(own).astype(np.uint16), n[often]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in found)],
                        names=["part", "grams", "levels", "counts"],
                    )

        inner = known.where(F.col("level") >= least).groupBy("part").agg(F.sum("n").alias("n"))
        ends, at = {}, 0
        for part, n in sorted(map(tuple, inner.collect())):
            ends[part] = at = at + n
        for row in ones.mapInArrow(chosen, "part int, grams binary, levels binary, counts binary").toLocalIterator():
            n = len(row.grams) // 8
            if n:
                place = slice(ends[row.part] - n, ends[row.part])
                grams[place], levels[place] = np.frombuffer(row.grams, np.uint64), np.frombuffer(row.levels, np.uint16)
                counts[place] = np.frombuffer(row.counts, np.uint64)
        return grams, levels, counts

    def unigrams_of(self, asked: DataFrame) -> DataFrame:
        """gram, level in the filter and exact count for the distinct hashes ``asked`` (column gram), part by part."""
        base = self.settings.unigram_base

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, grams, counts = -1, None, np.empty(0, np.uint64), np.empty(0, np.uint64)
            for batch in batches:
                parts = batch.column(0).to_numpy()
                cuts = np.flatnonzero(np.diff(parts, prepend=-1) | (batch.column(1).to_numpy() == 0))
                for start, end in zip(cuts, [*cuts[1:], len(parts)]):
                    if parts[start] != now:
                        now, held, grams = parts[start], None, np.empty(0, np.uint64)
                    if batch.column(1)[start].as_py() == 0:  # the part itself comes before what is asked of it
                        held = _OnePart(batch.column(3)[start].as_py(), base)
                        grams = np.frombuffer(batch.column(4)[start].as_py(), np.uint64)
                        counts = np.frombuffer(batch.column(5)[start].as_py(), np.uint64)
                        start += 1
                    if start == end:
                        continue
                    own = batch.column(2).slice(start, end - start)
                    hashes = own.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                    levels = held.levels(hashes) if held else np.zeros(len(hashes), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [own, pa.array(levels), pa.array(_looked_up(hashes, grams, counts).astype(np.int64))],
                        names=["gram", "level", "c"],
                    )

        ones = self.parts.where("kind = 1").selectExpr("part", "0 AS ask", "CAST(NULL AS long) AS gram", "bits", "grams", "counts")
        part = F.shiftrightunsigned("gram", 64 - self.part_bits).cast("int").alias("part")
        none = [F.lit(None).cast("binary").alias(c) for c in ("bits", "grams", "counts")]
        return (
            ones.union(asked.select(part, F.lit(1), "gram", *none))
            .repartition(1 << self.part_bits, "part")
            .sortWithinPartitions("part", "ask")
            .mapInArrow(run, "gram long, level long, c long")
        )


def _looked_up(asked: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of what is asked for by the sorted ``grams``; 0 where there is none."""
    if not len(grams):
        return np.zeros(len(asked), counts.dtype)
    at = np.minimum(np.searchsorted(grams, asked), len(grams) - 1)
    return np.where(grams[at] == asked, counts[at], 0)


def _merged(kind: int, part: int, part_bits: int, settings: Settings, grams: list[bytes], counts: list[bytes]) -> list:
    """The row of a part from the blocks of all tasks. Their counts are of 32 bits each, the sums kept of 64."""
    raw = np.frombuffer(b"".join(grams), np.uint64 if kind == 1 else np.uint32)
    values, place = np.unique(raw, return_inverse=True)
    sums = np.zeros(len(values), np.int64)
    np.add.at(sums, place, np.frombuffer(b"".join(counts), np.uint32).astype(np.int64))
    if kind == 1:
        full, base = values, settings.unigram_base
    else:
        high = np.uint64(part) << np.uint64(64 - part_bits)
        full = high | (values.astype(np.uint64) << np.uint64(32 - part_bits))
        base = settings.bigram_base
    bits = leveled_bits(full, sums, base, settings.bits_per_key).tobytes()
    ends = int(sums[full == END].sum()) if kind == 1 else 0
    kept = (full.tobytes(), sums.astype(np.uint64).tobytes()) if kind == 1 else (None, None)
    return [kind, part, *kept, bits, len(values), int(sums.sum()), ends]


def train(docs: DataFrame, settings: Settings | None = None, key: str = "doc_id", text: str = "text") -> Model:
    """Count the tokens and bigrams of all documents that are not held out."""
    settings = settings or Settings()
    rows = _keyed(docs, key, text)
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    part_bits = min(20, max(6, math.ceil(math.log2(max(1, size / settings.part_bytes)))))
    shift = np.uint64(64 - part_bits)

    def block(kind: int, grams: np.ndarray) -> pa.RecordBatch:
        values, counts = np.unique(grams, return_counts=True)
        counts = counts.astype(np.uint32)
        edges = np.searchsorted(values >> shift, np.arange((1 << part_bits) + 1, dtype=np.uint64))
        parts = np.flatnonzero(np.diff(edges))
        stored = values if kind == 1 else (values >> np.uint64(32 - part_bits)).astype(np.uint32)
        spans = [(edges[p], edges[p + 1]) for p in parts]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(parts), kind, np.int32)),
                pa.array(parts.astype(np.int32)),
                pa.array([stored[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary()),
            ],
            names=["kind", "part", "grams", "counts"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("language-model")
        hashes, ones, twos, held = WordHashes(settings.task_words), [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, lengths = _flat(text_bytes(batch.column(0)), hashes)
            ones.append(flat)
            twos.append(_short(join_hashes(_contexts(flat, lengths), flat), part_bits))
            held += len(flat)
            if held >= settings.task_tokens:
                yield block(1, np.concatenate(ones))
                yield block(2, np.concatenate(twos))
                ones, twos, held = [], [], 0
        if held:
            yield block(1, np.concatenate(ones))
            yield block(2, np.concatenate(twos))
        del hashes, ones, twos
        release_memory()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, grams, counts = None, [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(_merged(*now, part_bits, settings, grams, counts), kinds)], schema=kinds
            )

        for batch in batches:
            for kind, part, g, c in zip(*(x.to_pylist() for x in batch.columns)):
                if now != (kind, part):
                    if now:
                        yield out()
                    now, grams, counts = (kind, part), [], []
                grams.append(g)
                counts.append(c)
        if now:
            yield out()
        del grams, counts
        release_memory()

    kinds = pa.schema(
        [("kind", pa.int32()), ("part", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary()),
         ("bits", pa.binary()), ("types", pa.int64()), ("tokens", pa.int64()), ("ends", pa.int64())]
    )
    blocks = rows.where("not held_out").select("text").mapInArrow(count, "kind int, part int, grams binary, counts binary")
    parts = stage(
        blocks.repartition(1 << part_bits, "kind", "part")
        .sortWithinPartitions("kind", "part")
        .mapInArrow(merge, "kind int, part int, grams binary, counts binary, bits binary, types long, tokens long, ends long"),
        "model",
    )
    known = parts.where("kind = 1").agg(F.sum("tokens"), F.sum("types"), F.sum("ends"), F.sum(F.octet_length("bits"))).head()
    return Model(parts, part_bits, *(int(x or 0) for x in known), settings)


class _Lexicon(dict):
    """Numbers of the words met so far by this task, and ``columns``: their hashes and what ``ask`` knows, asked once per word."""

    def __init__(self, ask: Callable, limit: int):
        super().__init__()
        self.ask, self.limit = ask, limit
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.columns: tuple[np.ndarray, ...] = ()
        self.fresh: list[bytes | None] = []
        self[None]  # number 0 is the end

    def __missing__(self, word: bytes | None) -> int:
        self.fresh.append(word)
        number = self[word] = len(self)
        return number

    def numbers(self, words: list[list[bytes]]) -> np.ndarray:
        if len(self) > self.limit:
            self.reset()
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        out = np.zeros(int(lengths.sum()), np.int64)
        inner = np.ones(len(out), np.bool_)
        inner[np.cumsum(lengths) - 1] = False
        out[inner] = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, len(out) - len(words))
        if self.fresh:
            hashes = WordHashes()
            own = np.array([int(END) if w is None else hashes[w] for w in self.fresh], np.uint64)
            found = (own, *self.ask(own))
            self.columns = tuple(map(np.concatenate, zip(self.columns, found))) if self.columns else found
            self.fresh = []
        return out


def _scores(rows: DataFrame, model: Model, twos: Broadcast, shard: list[int], lexicon: Callable, base: bool) -> DataFrame:
    """n_tokens, the model's log10 probability of the tokens in ``shard``, and the base score; without ``base`` the second alone.

    p(word | context) = (pairs + prior * p(word)) / (context + prior), p(word) = (count + 0.1) / (N + 0.1 (V + 1)):
    pairs and count by the smallest of their level, the context by the largest of its level. So the words
    that may follow a context never have more than all probability, but for false hits of the filter.
    ``twos`` is the filter of the shard. ``lexicon()`` gives a function from a batch to its tokens' hashes, the
    number of tokens of each text, and what gives the levels and the exact counts of tokens at some places.
    """
    total, types, documents, part_bits = model.tokens, model.types, model.documents, model.part_bits
    prior, unigram_base = model.settings.prior, model.settings.unigram_base
    below = total + 0.1 * (types + 1)
    owned = np.zeros(1 << part_bits, np.bool_)
    owned[shard] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look_up = lexicon()
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, lengths, levels, counts = look_up(batch)
            firsts = np.cumsum(lengths) - lengths
            first = np.zeros(len(flat), np.bool_)
            first[firsts] = True
            grams = _short(join_hashes(_contexts(flat, lengths), flat), part_bits)
            here = np.flatnonzero(owned[twos.value.part(grams)])
            word, context = levels(here), levels(here - 1)
            low, high = span_of(np.arange(max(word.max(initial=0), context.max(initial=0)) + 1), unigram_base)
            before = np.where(first[here], documents, high[context])
            asked, place = np.unique(grams[here], return_inverse=True)
            pairs = np.minimum(twos.value.at_least(asked)[place], before)
            single = (low[word] + 0.1) / below
            logs = np.zeros(len(flat))
            logs[here] = np.log10((pairs + prior * single) / (before + prior))
            found = {"id": batch.column(0), "tag": batch.column(1), "score": pa.array(np.add.reduceat(logs, firsts))}
            if base:
                known = counts(slice(None))
                found |= {
                    "held_out": batch.column(2), "n_tokens": pa.array(lengths),
                    "n_known": pa.array(np.add.reduceat((known > 0).astype(np.int64), firsts)),
                    "base_score": pa.array(np.add.reduceat(np.log10((known + 0.1) / below), firsts)),
                }
            yield pa.RecordBatch.from_pydict(found)
        del look_up
        release_memory()

    more = ", held_out boolean, n_tokens long, n_known long, base_score double" if base else ""
    return rows.mapInArrow(run, "id long, tag long, score double" + more)


def _by_broadcast(rows: DataFrame, model: Model) -> Callable:
    context = rows.sparkSession.sparkContext
    ones, vocabulary = context.broadcast(model.filter(1)), context.broadcast(model.vocabulary())
    task_words = model.settings.task_words

    def lexicon() -> Callable:
        worker_cache("language-model")
        words_met = _Lexicon(lambda own: (ones.value.levels(own), _looked_up(own, *vocabulary.value)), task_words)

        def look_up(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            words = [split_words(lower_ascii(t)) for t in text_bytes(batch.column(3))]
            numbers = words_met.numbers(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
            hashes, levels, known = words_met.columns
            return hashes[numbers], lengths, lambda at: levels[numbers[at]], lambda at: known[numbers[at]]

        return look_up

    return lexicon


def _packed(numbers: np.ndarray) -> bytes:
    """All lowest bytes, then the second ones, and so on: the numbers of frequent types are small and compress well so."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _numbered(rows: DataFrame, table: Broadcast, frequent: int, task_words: int) -> DataFrame:
    """``tokens`` in place of the text: numbers of frequent types, and from ``frequent`` on places in ``rare``.

    ``rare`` has the hashes of the document's other words, sorted, each once. The end is a token like the words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("language-model")
        grams, ranks = table.value

        def ask(own: np.ndarray) -> tuple[np.ndarray]:
            at = np.minimum(np.searchsorted(grams, own), max(0, frequent - 1))
            return (np.where(grams[at] == own, ranks[at], frequent) if frequent else np.zeros(len(own), np.int64),)

        words_met = _Lexicon(ask, task_words)
        for batch in batches:
            if not batch.num_rows:
                continue
            words = [split_words(lower_ascii(t)) for t in text_bytes(batch.column(3))]
            met = words_met.numbers(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            del words
            hashes, numbers = words_met.columns
            numbers = numbers[met].astype(np.uint32)
            other = np.flatnonzero(numbers == frequent)
            owner, own = np.searchsorted(ends, other, "right"), as_signed(hashes[met[other]])
            order = np.lexsort((own, owner))
            other, owner, own = other[order], owner[order], own[order]
            new = np.ones(len(own), np.bool_)
            new[1:] = (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])
            starts = np.searchsorted(owner[new], np.arange(len(ends) + 1))
            numbers[other] = frequent + np.cumsum(new) - 1 - starts[owner]
            rare = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(own[new]))
            tokens = [_packed(x) for x in np.split(numbers, ends[:-1])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(tokens, pa.binary()), rare],
                names=["id", "tag", "held_out", "tokens", "rare"],
            )
        del words_met, grams, ranks
        release_memory()

    return rows.mapInArrow(run, "id long, tag long, held_out boolean, tokens binary, rare array<long>")


def _with_words(rows: DataFrame, model: Model) -> DataFrame:
    """Rows of _numbered with gram, level and c of their rare words, joined whatever the vocabulary's size."""
    used = rows.select("id", "tag", F.explode("rare").alias("gram"))
    found = model.unigrams_of(used.select("gram").distinct())
    # a set, as repeated rows ask for the same words
    words = (
        used.join(per_key(found, "gram"), "gram")
        .groupBy("id", "tag")
        .agg(F.sort_array(F.collect_set(F.struct("gram", "level", "c"))).alias("words"))
    )
    return rows.join(per_key(words, "id", "tag"), ["id", "tag"], "left").select("id", "tag", "held_out", "tokens", "words")


def _stored(grams: np.ndarray, levels: np.ndarray, counts: np.ndarray) -> Callable:
    """The lexicon of one task for rows of _with_words. The last row of the frequent types stands for all others."""
    worker_cache("language-model")
    frequent = len(grams) - 1

    def look_up(batch: pa.RecordBatch) -> tuple:
        tokens = [_unpacked(x) for x in batch.column(3).to_pylist()]
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        numbers = np.concatenate(tokens)
        del tokens
        other = np.flatnonzero(numbers >= frequent)
        sizes = batch.column(4).value_lengths().fill_null(0).to_numpy()  # null: no rare words
        starts = np.cumsum(sizes) - sizes
        owner = np.searchsorted(np.cumsum(lengths), other, "right")
        # all frequent types come first, then the words of each text
        numbers = numbers.astype(np.int64)
        numbers[other] += starts[owner]
        words = batch.column(4).flatten()

        def of(table: np.ndarray, own: pa.Array, at: np.ndarray | slice) -> np.ndarray:
            asked = numbers[at]
            out = table[np.minimum(asked, frequent)]
            rare = np.flatnonzero(asked >= frequent)
            out[rare] = own.to_numpy()[asked[rare] - frequent].astype(table.dtype)
            return out

        gram, level, count = (words.field(k) for k in range(3))
        return (
            of(grams, gram, slice(None)), lengths,
            lambda at: of(levels, level, at).astype(np.int64), lambda at: of(counts, count, at),
        )

    return look_up


def _by_join(rows: DataFrame, model: Model) -> tuple[DataFrame, Callable]:
    """The rows as numbers, written once, and their lexicon."""
    spark = rows.sparkSession
    context, path = spark.sparkContext, scratch_path(spark, "document-words")
    grams, levels, counts = model.frequent()
    frequent = len(grams)
    order = np.argsort(counts, kind="stable")[::-1].astype(np.uint32)  # the smallest number for the most frequent type
    ranks = np.empty_like(order)
    ranks[order] = np.arange(frequent, dtype=np.uint32)
    table = context.broadcast((grams, ranks))
    del ranks
    # one row more, for the numbers of rare words
    known = [context.broadcast(np.append(x[order], x.dtype.type(0))) for x in (grams, levels, counts)]
    del grams, levels, counts, order
    release_memory()
    with scratch(spark):
        numbered = stage(_numbered(rows, table, frequent, model.settings.task_words), "numbered")
        table.destroy()
        _with_words(numbered, model).write.parquet(path)
    rows = spark.read.schema(
        "id long, tag long, held_out boolean, tokens binary, words array<struct<gram: long, level: long, c: long>>"
    ).parquet(path)

    return rows, lambda: _stored(*(x.value for x in known))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base score by exact unigram counts and the model's score, for every row of ``docs``.

    Null texts are empty: their only token is the end. Without training documents all
    probabilities are equal. Null and repeated ids keep their rows.
    """
    rows = _keyed(docs, key, text)
    if max(model.vocabulary_bytes(), model.unigram_bytes) <= model.settings.broadcast_bytes:
        lexicon = _by_broadcast(rows, model)
    else:
        rows, lexicon = _by_join(rows, model)
    first, *shards = model.shards()
    context, more = rows.sparkSession.sparkContext, None
    for shard in shards:
        twos = context.broadcast(model.filter(2, shard))
        part = stage(_scores(rows, model, twos, shard, lexicon, base=False), "shard-scores")
        twos.destroy()  # each copy of it takes disk on every machine
        more = part if more is None else more.union(part)
    out = _scores(rows, model, context.broadcast(model.filter(2, first)), first, lexicon, base=True)
    if shards:
        more = more.groupBy("id", "tag").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
        # n is the number of equal rows times the number of further shards
        more = more.select("id", "tag", (F.col("s") * len(shards) / F.col("n")).alias("more"))
        out = out.join(more, ["id", "tag"]).withColumn("score", F.col("score") + F.col("more")).drop("more")
    return out.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
