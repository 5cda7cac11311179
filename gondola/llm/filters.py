"""Bloom filters built in parts by Spark tasks and probed as one array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.shared import scramble

PART_BITS = 8  # 256 parts; a key's part is given by its top bits
PROBES = 4


def part_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - PART_BITS)).astype(np.int64)


def positions(keys: np.ndarray, size: np.ndarray | np.uint64) -> Iterator[np.ndarray]:
    """The bits of each key in a part of ``size`` bits."""
    mixed = scramble(keys)
    step = (mixed >> np.uint64(33)) | np.uint64(1)
    for probe in range(PROBES):
        yield (mixed + np.uint64(probe) * step) % size


def build_part(keys: np.ndarray, bits_per_key: float) -> np.ndarray:
    """The bits of one part, packed; never empty."""
    size = max(64, int(len(keys) * bits_per_key) // 8 * 8 + 8)
    bits = np.zeros(size, np.bool_)
    for at in positions(keys, np.uint64(size)):
        bits[at] = True
    return np.packbits(bits)


class SplitFilter:
    """All parts in one byte array. ``contains`` never misses a key that was put in."""

    def __init__(self, parts: dict[int, bytes]):
        arrays = [np.frombuffer(parts.get(k) or bytes(8), np.uint8) for k in range(1 << PART_BITS)]
        self.sizes = np.array([8 * len(a) for a in arrays], np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.uint64)
        self.bytes = np.concatenate(arrays)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        part = part_of(keys)
        size, start = self.sizes[part], self.starts[part]
        found = np.ones(len(keys), np.bool_)
        for at in positions(keys, size):
            at += start
            byte = self.bytes[(at >> np.uint64(3)).astype(np.int64)]
            found &= (byte >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
        return found


def filter_of(keys: DataFrame, column: str, max_bytes: int, bits_per_key: float = 10.0) -> SplitFilter:
    """A filter of the distinct hashes in ``column`` that takes at most about ``max_bytes``.

    Beyond that size a key gets fewer bits: more false alarms, still no misses.
    """
    total = keys.count()
    bits = min(bits_per_key, 8.0 * max_bytes / max(1, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [b.column(0).to_numpy().view(np.uint64) for b in batches]
        if not arrays:
            return
        own = np.sort(np.concatenate(arrays))
        edges = np.flatnonzero(np.diff(part_of(own))) + 1
        groups = [g for g in np.split(own, edges) if len(g)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(part_of(g[:1])[0]) for g in groups], pa.int32()),
                pa.array([build_part(g, bits).tobytes() for g in groups], pa.binary()),
            ],
            names=["part", "bits"],
        )

    part = F.shiftrightunsigned(column, 64 - PART_BITS)
    tasks = max(1, min(1 << PART_BITS, total // 200_000 + 1))
    parts = keys.select(column).repartition(tasks, part).mapInArrow(run, "part int, bits binary")
    return SplitFilter({r.part: bytes(r.bits) for r in parts.collect()})  # max_bytes in all
