"""Best-fit packing of documents into training sequences under several capacities.

Texts become token ids where they are read; only piece lengths (and ids, if asked for) are
dealt out evenly to packing groups of a fixed size, so neither a hot source nor a long text
makes a large task. Each group leaves at most its last sequences partly filled.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.shared import keyed_text, worker_cache
from gondola.session import stage

# Before a space that a visible character follows, the tokenizer always begins a new piece.
CUT = re.compile(r" (?=\S)")
ODD = re.compile(r" (?:\s|\Z)")  # where a plain split at spaces would cut elsewhere
SPACE = "\u0120"  # how a space is written in the names of byte-level tokens


@dataclass(frozen=True)
class Capacity:
    """Per sequence: tokens, documents, and attention cost (sum of squared lengths)."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.float64)


@dataclass(frozen=True)
class Choice:
    """How a sequence is chosen: ``norm`` of what would be left, or ``dot`` of what is left and what comes."""

    rule: str = "norm"
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4)


class PieceIds:
    """Token ids of texts as little-endian bytes, by what is known of the parts between spaces.

    Only parts that are new reach the tokenizer, those of a text in one call; the store starts afresh when full.
    With ``marks`` the names of special tokens in a text become their ids, as by default in the tokenizer; else they
    are plain text.
    """

    def __init__(self, tokenizer_path: str, limit: int = 1_000_000, marks: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = not marks
        # what the tokenizer takes out of a text before all else changes how spaces beside it are cut
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if marks or not t.special]
        self.taken = re.compile("|".join(re.escape(t.content) for t in added)) if added else None
        vocabulary = self.tokenizer.get_vocab()
        self.with_space = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.with_space[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        self.limit = limit
        self.parts: dict[str, bytes] = {}

    def ids(self, pieces: list[str]) -> Iterator[bytes]:
        encoded = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return (array("I", e.ids).tobytes() for e in encoded)

    def _cut(self, text: str) -> list[str]:
        if self.taken is not None and self.taken.search(text):
            return [text]
        return CUT.split(text) if ODD.search(text) else text.split(" ")

    def _learn(self, fresh: list[str]) -> None:
        """Ids of parts that follow a space. Every part has a token that begins with its space, most have no other."""
        (data,) = self.ids([" " + " ".join(fresh)])
        starts = 4 * np.flatnonzero(self.with_space[np.frombuffer(data, "<u4")])
        if len(starts) == len(fresh):
            ends = [*starts[1:].tolist(), len(data)]
            self.parts.update(zip(fresh, [data[i:j] for i, j in zip(starts.tolist(), ends)]))
        else:  # spaces inside a part: not to be told from those between parts
            self.parts.update(zip(fresh, self.ids([" " + p for p in fresh])))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        firsts = []
        cut = [self._cut(t) for t in texts]
        for c in cut:
            firsts.append(c[0])
            del c[0]
        for first, rest in zip(self.ids(firsts), cut):
            fresh = list(set(filterfalse(self.parts.__contains__, rest)))
            if len(self.parts) + len(fresh) > self.limit:
                self.parts.clear()
                fresh = list(set(rest))
            if fresh:
                self._learn(fresh)
            yield first + b"".join(map(self.parts.__getitem__, rest))


def encoder(path: str) -> PieceIds:
    """One per worker process; tasks of the same worker share what is known."""
    known = worker_cache("packing")
    if path not in known:
        known[path] = PieceIds(path, marks=True)
    return known[path]


def _lists(lengths: list[int], ids: bytes) -> pa.Array:
    """Ids as lists of these lengths, one after the other."""
    ends = pa.array(np.cumsum([0, *lengths]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(ids, "<i4")))


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    size: int = 1024,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Token ids of every text and ``end_id``, cut into pieces of ``size`` (the first may be shorter).

    Ids are those of the tokenizer's plain encode without added tokens: a special token's name is its id.
    Null texts are empty: one piece that holds the end only. Null and repeated ids keep their rows.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<int>" if with_ids else ""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out: list[list] = [[], [], [], [], []]
            all_ids = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), known.encode(texts)):
                ids += end
                n = len(ids) // 4
                at, number = 0, 0
                while at < n:
                    length = n % size or size if at == 0 else size
                    row = (doc_id, number, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]))
                    for column, value in zip(out, row):
                        column.append(value)
                    at, number = at + length, number + 1
                if with_ids:
                    all_ids.append(ids)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(out, kinds)]
            if with_ids:
                columns.append(_lists(out[3], b"".join(all_ids)))
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            yield pa.RecordBatch.from_arrays(columns, names=list(names[: len(columns)]))

    return keyed_text(docs, key, text).mapInArrow(run, schema)


def best_fit(
    lengths: np.ndarray, capacity: Capacity, choice: Choice
) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each item: longest first, each into the best sequence that takes it.

    An item alone always gets a sequence, also when it exceeds a capacity by itself.
    """
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    caps, weights = capacity.vector(), np.array(choice.weights)
    left = [np.empty(n) for _ in caps]
    of_open = np.empty(n, np.int64)
    n_open = made = 0
    for item in np.argsort(-lengths, kind="stable"):
        need = (float(lengths[item]), 1.0, float(lengths[item]) ** 2)
        spot = -1
        if n_open:
            rest = [r[:n_open] - v for r, v in zip(left, need)]
            fits = (rest[0] >= 0) & (rest[1] >= 0) & (rest[2] >= 0)
            if choice.rule == "dot":
                worth = sum(w * r[:n_open] * v / c**2 for w, r, v, c in zip(weights, left, need, caps))
                cost = np.where(fits, -worth, np.inf)
            else:
                cost = np.where(fits, sum(w * (r / c) ** 2 for w, r, c in zip(weights, rest, caps)), np.inf)
            spot = int(cost.argmin())
            spot = spot if fits[spot] else -1
        if spot < 0:
            spot, made = n_open, made + 1
            for r, c in zip(left, caps):
                r[spot] = c
            of_open[spot] = made - 1
            n_open += 1
        bins[item] = of_open[spot]
        offsets[item] = caps[0] - left[0][spot]
        for r, v in zip(left, need):
            r[spot] -= v
        if any(r[spot] <= 0 for r in left):  # full: the last open one takes its place
            n_open -= 1
            for r in left:
                r[spot] = r[n_open]
            of_open[spot] = of_open[n_open]
    return bins, offsets


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: Capacity | None = None,
    choice: Choice | None = None,
    end_id: int = 2,
    group_rows: int = 8192,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    ``group_rows`` pieces are packed together; groups are dealt round, never by a key.
    """
    capacity, choice = capacity or Capacity(), choice or Choice()
    cut = stage(
        pieces(docs, tokenizer_path, end_id, capacity.tokens, key, text, with_ids), "pieces"
    )
    groups = max(1, math.ceil(cut.count() / group_rows))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("best-fit")  # lets go of the parts the encoder knows
        batches = list(batches)  # group_rows rows
        if not batches:
            return
        lengths = np.concatenate([b.column("length").to_numpy() for b in batches])
        bins, offsets = best_fit(lengths, capacity, choice)
        bins += TaskContext.get().partitionId() << 32
        at = 0
        for batch in batches:
            rows = slice(at, at + batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(bins[rows]), pa.array(offsets[rows])],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )
            at += batch.num_rows

    return cut.repartition(groups).mapInArrow(run, schema + ", sequence_id long, offset long")


def summary(packed: DataFrame, capacity: Capacity | None = None) -> DataFrame:
    """Sequences, tokens, and the share of all token places that is filled."""
    tokens = (capacity or Capacity()).tokens
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    return per.agg(
        F.count("*").alias("sequences"),
        F.sum("n").alias("tokens"),
        (F.sum("n") / (F.count("*") * tokens)).alias("filled"),
    )
