"""Substring deduplication by level-wise doubling of repeated windows.

Lengths double from a few words to the full window. At each level every full window that is still a
candidate names one window of the level's length by content (the smallest hash in it, so that all
places of equal text name the same); tasks count the named places, and only full windows whose named
one stands at two or more places stay. These alone are hashed at twice the length. When a level
leaves nothing the search ends. At the full length, windows that follow each other and name the same
place go to one comparison as one row of hashes; what comes back are stretches of words. A task first
settles what repeats within its own rows, so a passage that a third of all documents share
reaches the shuffle once per task. Hashes are shuffled, never texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm.filters import SplitFilter, filter_of
from gondola.llm.shared import (
    WordHashes, as_signed, join_hashes, release_memory, split_words, text_bytes, window_hashes,
)
from gondola.session import stage

WORD = re.compile(rb"[^ \t-\r]+")
TASK_WINDOWS = 1_000_000  # windows a task settles, or compares, at once
ROWS = 100_000  # windows looked into at once
NO_ID = -(1 << 63)  # rows without an id count as the smallest
FIRST_LENGTH = 5  # no level is shorter


def level_lengths(window: int, first: int = FIRST_LENGTH) -> list[int]:
    """Lengths of the levels, each at most twice the one before; the last is the window itself."""
    out = [window]
    while -(-out[0] // 2) >= first:
        out.insert(0, -(-out[0] // 2))
    return out


class Candidates:
    """Full windows of a batch of texts that may repeat, and hashes at the length of the current level.

    Two windows of one level that lie end to end, or overlap, make the window of the next.
    """

    def __init__(self, texts: list[bytes], hashes: WordHashes, lengths: list[int]):
        self.lengths, self.level = lengths, 0
        words = [split_words(t) for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = hashes.of([w for ws in words for w in ws])
        self.text = np.repeat(np.arange(len(words)), sizes)
        self.at = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[self.text]
        n = max(0, len(flat) - lengths[-1] + 1)
        self.alive = np.flatnonzero(self.at[:n] + lengths[-1] <= sizes[self.text[:n]])
        self.hash = window_hashes(flat, lengths[0])

    def named(self) -> tuple[np.ndarray, np.ndarray]:
        """Place and hash of the window that each candidate names; the leftmost of equal ones."""
        wide = self.lengths[-1] - self.lengths[self.level] + 1
        place = self.alive.copy()
        if len(place) and wide > 1:
            choice = np.lib.stride_tricks.sliding_window_view(self.hash, wide)
            for low in range(0, len(place), ROWS):
                part = slice(low, low + ROWS)
                place[part] += choice[self.alive[part]].argmin(axis=1)
        return place, self.hash[place]

    def keep(self, repeated: SplitFilter, names: np.ndarray) -> None:
        """Drop the candidates whose name does not repeat, and hash the others at the next length."""
        if len(names):
            run = np.ones(len(names), np.bool_)
            run[1:] = names[1:] != names[:-1]
            found = repeated.contains(names[np.flatnonzero(run)])
            self.alive = self.alive[found[np.cumsum(run) - 1]]
        short, self.level = self.lengths[self.level], self.level + 1
        length = self.lengths[self.level]
        steps = np.zeros(len(self.hash) + 2, np.int32)
        steps[self.alive] += 1
        steps[self.alive + self.lengths[-1] - length + 1] -= 1
        wanted = np.flatnonzero(np.cumsum(steps[:-2]) > 0)
        longer = np.full(len(self.hash), np.iinfo(np.uint64).max)
        longer[wanted] = join_hashes(self.hash[wanted], self.hash[wanted + length - short])
        self.hash = longer


@dataclass(frozen=True)
class Level:
    """Length, number of different windows named at two or more places, and a filter of them."""

    length: int
    repeated: int
    filter: Broadcast


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(*_keyed_columns(key, text))


def _keyed_columns(key: str, text: str) -> list[Column]:
    """id, tag, text: rows of one id with different texts stay apart by the tag (32 bits)."""
    return [
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_ID)).alias("id"),
        F.hash(F.col(f"`{text}`")).alias("tag"),
        F.col(f"`{text}`").alias("text"),
    ]


def _named_twice(docs: DataFrame, lengths: list[int], known: list[Level], key: str, text: str) -> DataFrame:
    """Hashes of the windows that candidates name at two or more places, at the level after the ``known`` ones."""
    filters = [level.filter for level in known]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            c = Candidates(text_bytes(batch.column(2)), hashes, lengths)
            for level in filters:
                c.keep(level.value, c.named()[1])
            place, names = c.named()
            fresh = np.ones(len(place), np.bool_)  # places never go back, so equal ones are adjacent
            fresh[1:] = place[1:] != place[:-1]
            values, counts = np.unique(names[fresh], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_signed(values)), pa.array(counts.astype(np.int64))], names=["name", "n"]
            )
        release_memory()

    found = _keyed(docs, key, text).mapInArrow(run, "name long, n long")
    return found.groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").select("name")


def repeated_levels(
    docs: DataFrame, window: int, max_filter_bytes: int = 64 << 20, key: str = "doc_id", text: str = "text"
) -> list[Level]:
    """The levels below the full length, up to the first at which nothing repeats.

    A filter only saves work: what it lets through by mistake is found to stand at one place.
    """
    spark, lengths = docs.sparkSession, level_lengths(window)
    found: list[Level] = []
    for length in lengths[:-1]:
        names = stage(_named_twice(docs, lengths, found, key, text), f"repeated-{length}")
        n = names.count()
        found.append(Level(length, n, spark.sparkContext.broadcast(filter_of(names, "name", max_filter_bytes))))
        if not n:
            break
    return found


_RUN = pa.schema(
    [("name", pa.int64()), ("id", pa.int64()), ("tag", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("fulls", pa.binary())]
)


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before in any column."""
    new = np.ones(len(columns[0]), np.bool_)
    for c in columns:
        new[1:] &= c[1:] == c[:-1]
    new[1:] = ~new[1:]
    return new


def _later(full: np.ndarray, name: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which windows stand at a later place than an equal one: larger id, or the same and a larger start."""
    order = np.lexsort((starts, ids, full, name))
    f, m, i, s = (c[order] for c in (full, name, ids, starts))
    lead = np.maximum.accumulate(np.where(_edges(f, m), np.arange(len(f)), 0))
    out = np.zeros(len(full), np.bool_)
    out[order] = (i != i[lead]) | (s != s[lead])
    return out


def _stretches(ids: np.ndarray, tags: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """ids, tags, first starts and lengths of windows whose starts follow each other."""
    order = np.lexsort((starts, tags, ids))
    ids, tags, starts = ids[order], tags[order], starts[order]
    new = _edges(ids, tags, starts.astype(np.int64) - np.arange(len(starts)))
    cut = np.flatnonzero(new)
    return ids[cut], tags[cut], starts[cut], np.diff(np.append(cut, len(starts))).astype(np.int32)


def later_windows(
    docs: DataFrame,
    window: int,
    max_filter_bytes: int = 64 << 20,
    key: str = "doc_id",
    text: str = "text",
    task_windows: int = TASK_WINDOWS,
) -> DataFrame:
    """Per document (id, tag): stretches (start, n) of windows whose words also start earlier.

    Earlier is a smaller id, or the same id and an earlier start. A task holds about ``task_windows``
    windows at once, and of one name as many as tasks found unsettled.
    """
    lengths = level_lengths(window)
    levels = repeated_levels(docs, window, max_filter_bytes, key, text)
    empty = "id long, tag int, stretches array<struct<start:int,n:int>>"
    if levels and not levels[-1].repeated:
        return docs.sparkSession.createDataFrame([], empty)
    filters = [level.filter for level in levels]

    def settle(rows: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        """Of equal windows of a task the earliest goes on, the others are later in any case."""
        full, name, place, ids, tags, starts = (np.concatenate(c) for c in zip(*rows))
        later = _later(full, name, ids, starts)
        if later.any():
            i, t, s, n = _stretches(ids[later], tags[later], starts[later])
            none = pa.nulls(len(i), pa.binary())
            # any spread of keys will do for rows that need no comparison
            spread = i + s.astype(np.int64) * 1_000_003
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (spread, i, t, s, n)] + [none], schema=_RUN)
        full, name, place, ids, tags, starts = (c[~later] for c in (full, name, place, ids, tags, starts))
        cut = np.flatnonzero(_edges(place, starts.astype(np.int64) - np.arange(len(starts))))
        ends = np.append(cut[1:], len(full))
        hashes = [full[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist())]
        columns = [as_signed(name[cut]), ids[cut], tags[cut], starts[cut], (ends - cut).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns] + [pa.array(hashes, pa.binary())], schema=_RUN)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, waiting, held, seen = WordHashes(), [], 0, 0
        for batch in batches:
            c = Candidates(text_bytes(batch.column(2)), hashes, lengths)
            place, names = c.alive, np.empty(0, np.uint64)
            for level in filters:
                before, (place, names) = c.alive, c.named()
                c.keep(level.value, names)
                kept = np.searchsorted(before, c.alive)
                place, names = place[kept], names[kept]
            full = c.hash[c.alive]
            ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            own = c.text[c.alive]
            waiting.append((full, names if filters else full, place + seen, ids[own], tags[own], c.at[c.alive].astype(np.int32)))
            seen += len(c.text) + 1  # so that places of different batches differ
            held += len(full)
            if held >= task_windows:
                yield from settle(waiting)
                waiting, held = [], 0
        if held:
            yield from settle(waiting)
        release_memory()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by name; a name is never cut."""
        schema = pa.schema([("id", pa.int64()), ("tag", pa.int32()), ("start", pa.int32()), ("n", pa.int32())])
        waiting: list[pa.Table] = []
        held, most = 0, task_windows

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            settled = table.filter(table.column("fulls").is_null())
            if settled.num_rows:
                yield from settled.select(schema.names).cast(schema).to_batches()
            open_rows = table.filter(table.column("fulls").is_valid())
            if not open_rows.num_rows:
                return
            name, ids, tags, start, n = (open_rows.column(c).to_numpy() for c in _RUN.names[:5])
            row = np.repeat(np.arange(len(n)), n)
            full = np.frombuffer(b"".join(open_rows.column("fulls").to_pylist()), np.uint64)
            starts = (start[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            later = _later(full, name[row], ids[row], starts)
            if later.any():
                row = row[later]
                found = _stretches(ids[row], tags[row], starts[later])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(pa.Table.from_batches([batch]))
            held += 1 + int(np.sum(batch.column("n").to_numpy()))
            if held < most:
                continue
            table = pa.concat_tables(waiting)
            names = table.column("name").to_numpy()
            cut = int(np.searchsorted(names, names[-1]))
            if cut:
                yield from out(table.slice(0, cut))
            waiting = [table.slice(cut)]
            held = len(waiting[0]) + int(np.sum(waiting[0].column("n").to_numpy()))
            most = max(task_windows, 2 * held)
        if waiting:
            yield from out(pa.concat_tables(waiting))
        release_memory()

    runs = _keyed(docs, key, text).mapInArrow(search, "name long, id long, tag int, start int, n int, fulls binary")
    later = (
        runs.repartition("name")
        .sortWithinPartitions("name")
        .mapInArrow(compare, "id long, tag int, start int, n int")
    )
    return later.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("stretches"))


def _covered(n: int, stretches: list[tuple[int, int]], window: int) -> np.ndarray:
    at = np.array(stretches, np.int64).reshape(-1, 2)
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, at[:, 0], 1)
    np.add.at(steps, at[:, 0] + at[:, 1] - 1 + window, -1)
    return np.cumsum(steps[:n]) > 0


def _kept(text: bytes, stretches: list[tuple[int, int]] | None, window: int) -> tuple[int, list[list[int]], bytes, bytes]:
    """Words, removed spans of words, kept words joined by one space, and the text without the spans."""
    words = split_words(text)
    if not stretches:
        return len(words), [], b" ".join(words), text
    gone = _covered(len(words), stretches, window)
    change = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    spans = change.reshape(-1, 2).tolist()
    places = [m.span() for m in WORD.finditer(text)]
    parts, at = [], 0
    for first, end in spans:
        parts.append(text[at : places[first][0]])
        at = places[end][0] if end < len(places) else len(text)
    parts.append(text[at:])
    return len(words), spans, b" ".join(w for w, g in zip(words, gone) if not g), b"".join(parts)


def remove_repeats(
    docs: DataFrame,
    window: int = 20,
    max_filter_bytes: int = 64 << 20,
    key: str = "doc_id",
    text: str = "text",
    with_text: bool = True,
    task_windows: int = TASK_WINDOWS,
) -> DataFrame:
    """One row per row of ``docs``: words, removed words and their spans, digest of what is kept, new text.

    A word goes when a window of ``window`` words covers it whose words also
    start earlier: in a smaller id, or earlier in the same document; the input is judged, not
    what is left. Null texts have no words and stay null. Rows without id come before all ids;
    rows of one id are told apart by their texts, and of repeated rows none is earlier.
    The new text keeps the white space between kept words as it was.
    """
    removed = later_windows(docs, window, max_filter_bytes, key, text, task_windows)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<int>>"
    schema += ", text string" if with_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw, found = (batch.column(k).to_pylist() for k in range(3))
            rows = [_kept(t or b"", _pairs(s), window) for t, s in zip(map(_utf8, raw), found)]
            columns = [
                pa.array([None if i == NO_ID else i for i in ids], pa.int64()),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([sum(b - a for a, b in r[1]) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows]),
                pa.array([r[1] for r in rows], pa.list_(pa.list_(pa.int32()))),
            ]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"]
            if with_text:
                columns.append(pa.array([None if t is None else r[3].decode() for t, r in zip(raw, rows)], pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    whole = _keyed(docs, key, text).join(removed, ["id", "tag"], "left")
    return whole.select("id", "text", "stretches").mapInArrow(run, schema)


def rewrite(
    docs: DataFrame, window: int = 50, max_filter_bytes: int = 64 << 20, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with all columns, its texts as ``remove_repeats`` leaves them; texts without repeats are unchanged."""

    @F.pandas_udf("string")
    def without(texts: pd.Series, found: pd.Series) -> pd.Series:
        rows = zip(texts, found)
        return pd.Series([t if s is None else _kept(t.encode(), _pairs(list(s)), window)[3].decode() for t, s in rows])

    removed = later_windows(docs, window, max_filter_bytes, key, text)
    rows = docs.select(F.struct("*").alias("doc"), *(F.col(f"`{c}`").alias(n) for c, n in ((key, "k"), (text, "t"))))
    keyed = rows.select("doc", *_keyed_columns("k", "t"))
    whole = keyed.join(removed, ["id", "tag"], "left")
    new = F.when(F.col("stretches").isNull(), F.col("text")).otherwise(without("text", "stretches"))
    return whole.select(*(new.alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def _utf8(text: str | None) -> bytes | None:
    return None if text is None else text.encode()


def _pairs(stretches: list[dict] | None) -> list[tuple[int, int]] | None:
    return None if stretches is None else [(s["start"], s["n"]) for s in stretches]
