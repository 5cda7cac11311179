"""SentencePiece encoding and decoding with a streaming Viterbi search.

The best segmentation by summed piece scores is found left to right. Only positions a piece may
still start from are open; whenever the best paths to all of them share a boundary, the ids up to
it are given out and forgotten, so the window follows the ambiguity of the text, not its length.
A space is such a boundary at once where no piece has a space inside, so what stands between
spaces is encoded once per worker and looked up afterwards.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)  # piece types of the file format
UNKNOWN_PENALTY = 10.0


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 2: 0, 5: 4}[kind] or varint()
        yield key >> 3, raw[at : at + size]
        at += size


class Vocabulary:
    """Pieces, scores and types of a model file, and its normalisation flags.

    Models with a character map are refused: their texts would need normalising first.
    """

    def __init__(self, path: str):
        with open(path, "rb") as file:
            message = list(_fields(file.read()))
        self.texts, self.scores, self.types = [], [], []
        self.dummy_prefix = True
        for number, value in message:
            if number == 1:
                piece = dict(_fields(value))
                self.texts.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif number == 3:
                rules = dict(_fields(value))
                self.dummy_prefix = bool(rules.get(3, 1))
                if rules.get(2) or rules.get(4, 1):
                    raise ValueError("only models that leave their texts as they are can be used")
        self._derive()

    def _derive(self) -> None:
        normal = [s for s, t in zip(self.scores, self.types) if t == NORMAL]
        lowest, highest = min(normal, default=0.0), max(normal, default=0.0)
        self.unknown_score = lowest - UNKNOWN_PENALTY
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = {int(t[3:5], 16): k for k, (t, kind) in enumerate(zip(self.texts, self.types)) if kind == BYTE}
        self.pieces: dict[str, tuple[float, int]] = {}
        for k, (text, score, kind) in enumerate(zip(self.texts, self.scores, self.types)):
            if kind == NORMAL:
                self.pieces[text] = (score, k)
            elif kind == USER_DEFINED:
                self.pieces[text] = (len(text.encode()) * highest - 0.1, k)
        self.longest = max(map(len, self.pieces), default=1)
        # characters lead from node to node; what a node has under None is the piece that ends there
        self.tree: dict = {}
        for text, piece in self.pieces.items():
            node = self.tree
            for character in text:
                node = node.setdefault(character, {})
            node[None] = piece
        # no piece goes over a space that follows another character, or over a line end
        self.breaks = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.line_breaks = not any("\n" in p for p in self.pieces)

    def fallback(self, character: str) -> list[int]:
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in character.encode("utf-8", "surrogatepass")]


class Viterbi:
    """Feed text in any portions; ids come out as soon as they are certain."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = ""  # from the last certain boundary on
        self.best = [0.0]  # of positions in ``text``; None while nothing ends there
        self.back: list[tuple[int, int]] = [(0, -1)]
        self.done = 0  # positions that have been opened

    def feed(self, more: str, last: bool = False) -> list[int]:
        v, out = self.v, []
        self.text += more
        n = len(self.text)
        self.best += [None] * (n + 1 - len(self.best))
        self.back += [(0, -1)] * (n + 1 - len(self.back))
        # without what comes next, a position near the end cannot be opened yet
        stop = n if last else n - v.longest
        at = self.done
        while at < stop:
            self._open(at)
            at += 1
            if at >= 4 * v.longest and at % v.longest == 0:
                gone = self._certain(at)
                if gone:
                    out += self._ids(gone)
                    self._forget(gone)
                    at -= gone
                    stop -= gone
        self.done = at
        if last:
            out += self._ids(len(self.text))
            self.__init__(v)
        return out

    def _open(self, at: int) -> None:
        text, best, back = self.text, self.best, self.back
        base, single, node = best[at], False, self.v.tree
        for end in range(at, len(text)):
            node = node.get(text[end])
            if node is None:
                break
            found = node.get(None)
            if found is not None:
                single = single or end == at
                score, known = base + found[0], best[end + 1]
                if known is None or score > known:
                    best[end + 1], back[end + 1] = score, (at, found[1])
        if not single:
            score = base + self.v.unknown_score
            if best[at + 1] is None or score > best[at + 1]:
                best[at + 1], back[at + 1] = score, (at, -1)

    def _certain(self, at: int) -> int:
        """The last boundary on the best paths to all positions a piece may still reach or start from."""
        paths = {k for k in range(at, min(len(self.text), at + self.v.longest) + 1) if self.best[k] is not None}
        while len(paths) > 1:
            far = max(paths)
            paths.remove(far)
            paths.add(self.back[far][0])
        return paths.pop()

    def _ids(self, end: int) -> list[int]:
        out: list[list[int]] = []
        while end:
            start, piece = self.back[end]
            out.append([piece] if piece >= 0 else self.v.fallback(self.text[start:end]))
            end = start
        return [i for ids in reversed(out) for i in ids]

    def _forget(self, n: int) -> None:
        base = self.best[n]
        self.text = self.text[n:]
        self.best = [None if s is None else s - base for s in self.best[n:]]
        self.back = [(0, -1)] + [(start - n, piece) for start, piece in self.back[n + 1 :]]


class Codec:
    """Encoder and decoder of one worker; what stands between spaces is encoded once."""

    def __init__(self, path: str, limit: int = 1_000_000, portion: int = 4096):
        self.v = Vocabulary(path)
        self.limit, self.portion = limit, portion
        self.known: dict[str, bytes] = {}
        table = []
        for text, kind in zip(self.v.texts, self.v.types):
            if kind == BYTE:
                table.append(bytes([int(text[3:5], 16)]))
            else:
                table.append(b"" if kind == CONTROL else text.replace(SPACE, " ").encode())
        self.table = table

    def stream(self, text: str) -> bytes:
        """Ids of an already escaped text, in portions."""
        viterbi, out = Viterbi(self.v), array("i")
        for at in range(0, len(text), self.portion):
            out.extend(viterbi.feed(text[at : at + self.portion]))
        out.extend(viterbi.feed("", last=True))
        return out.tobytes()

    def chunk(self, text: str) -> bytes:
        if self.v.line_breaks and "\n" in text:
            line = array("i", self.v.fallback("\n")).tobytes()
            return line.join(self.chunk(part) if part else b"" for part in text.split("\n"))
        if len(text) > 256:
            return self.stream(text)
        found = self.known.get(text)
        if found is None:
            if len(self.known) >= self.limit:
                self.known.clear()
            found = self.known[text] = array("i", Viterbi(self.v).feed(text, last=True)).tobytes()
        return found

    def encode(self, text: str) -> bytes:
        """Ids as native 32-bit integers. The empty text has none."""
        if not text:
            return b""
        whole = ((" " + text) if self.v.dummy_prefix else text).replace(" ", SPACE)
        if not self.v.breaks:
            return self.stream(whole)
        return b"".join(map(self._known, RUNS.findall(whole)))

    def _known(self, chunk: str) -> bytes:
        return self.known.get(chunk) or self.chunk(chunk)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids. Bytes that are no UTF-8 become the replacement character; ids out of range are dropped."""
        table = self.table
        raw = b"".join([table[i] for i in ids.tolist() if 0 <= i < len(table)])
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.v.dummy_prefix and text.startswith(" ") else text


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tag (hash of the text) and ids for every row; null texts are empty and have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            parts = [own.encode(t) for t in batch.column(2).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts], dtype=np.int64)])
            ids = pa.ListArray.from_arrays(
                pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), np.int32))
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["doc_id", "tag", "ids"])

    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(whole).alias("tag"), whole.alias("text"))
    return rows.mapInArrow(run, "doc_id long, tag long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """The rows of ``encoded`` (doc_id, tag, ids) with their text; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            column = batch.column(2)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], dtype=np.int64)
            texts = [own.decode(part) for part in np.split(flat, ends[:-1])] if len(ends) else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "tag", "ids", "text"]
            )

    rows = encoded.select("doc_id", "tag", "ids")
    return rows.mapInArrow(run, "doc_id long, tag long, ids array<int>, text string")
