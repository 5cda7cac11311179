"""Words, hashes and Arrow batches shared by the text operators."""

from __future__ import annotations

import ctypes
import os
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola import session

# White space of every word rule here: space, tab, line feed, vertical tab, form feed, return.
SPACE_CLASS = r"[ \t-\r]"
# Texts reach Python in batches of so many rows and bytes at most, however long they are.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators; workers that see this folder import from it."""
    session.prepare(spark)
    for key, value in BATCH_SETTINGS.items():
        spark.conf.set(key, value)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    root = str(Path(session.__file__).resolve().parents[1])
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def keyed_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Two columns ``id`` and ``text``; other columns, whatever their names, stay behind."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))


def text_bytes(column: pa.Array) -> list[bytes]:
    """Whole texts in UTF-8; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def lower_ascii(text: bytes) -> bytes:
    """A-Z to a-z; ``bytes.lower`` leaves all other bytes."""
    return text.lower()


class WordHashes(dict):
    """Word -> 64-bit hash. Forgets everything once it holds ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(text: bytes) -> list[bytes]:
    """``bytes.split`` cuts at exactly the six characters of SPACE_CLASS."""
    return text.split()


def scramble(values: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = values ^ (values >> np.uint64(32))
    x = x * MIX
    x ^= x >> np.uint64(29)
    x *= MIX2
    x ^= x >> np.uint64(32)
    return x


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence made of two parts, from the hashes of the parts."""
    return scramble(left * MIX2 + (right ^ (right >> np.uint64(31))) + MIX)


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words, by doubling from the binary digits of the length."""
    if len(words) < length:
        return np.empty(0, np.uint64)
    power, size = words, 1
    out, covered = None, 0
    rest = length
    while rest:
        if rest & 1:
            if out is None:
                out, covered = power, size
            else:
                n = len(words) - covered - size + 1
                out, covered = join_hashes(out[:n], power[covered : covered + n]), covered + size
        rest >>= 1
        if rest:
            n = len(power) - size
            power, size = join_hashes(power[:n], power[size : size + n]), size * 2
    return out


def as_signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def release_memory() -> None:
    """Give freed memory back at the end of a task: idle workers stay, and would hold it beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own ways
        pass


_kept: dict[str, dict] = {}


def worker_cache(operator: str) -> dict:
    """What the tasks of one operator keep in this worker for its next task.

    A worker serves one operator after the other; the first task of another one lets go of the rest.
    """
    if operator not in _kept:
        _kept.clear()
        release_memory()
        _kept[operator] = {}
    return _kept[operator]
