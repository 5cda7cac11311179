"""Exact k-means over integer vectors with heap-ordered bounds.

Vectors are packed once into blocks of at most ``block_rows`` and written in hash buckets of the
block number. Each round's state - the cluster of every vector of a block, and per cluster a heap of
its vectors - is written in the same buckets, so a round joins the two without moving a vector.

A vector's gap is the distance to the second nearest centroid less that to its own, both as bounds.
When a centroid moves by d, the gap of its vectors shrinks by no more than d plus the largest move of
another centroid. That sum is added to the cluster's drift; a vector enters the heap of its cluster
under gap + drift. It may have to change clusters only once drift has reached its key, so a round pops
the keys that have expired, computes those vectors' distances exactly, and pushes them back. All
distances that decide are 64-bit integers; bounds are doubles with a margin beyond their rounding.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.session import scratch_path, stage

# Squared lengths up to this bound (just below 2**60) keep squared distances in 62 bits, components in 30.
LONGEST = 1.1e18
# More than what rounding can add to a bound or to a move (distances stay below 2**31).
MARGIN = 1e-5
STATE = "block long, clusters binary, heap_keys binary, heap_rows binary, heap_sizes array<int>, moved long, sums binary"


@dataclass(frozen=True)
class Settings:
    """k clusters, so many rounds; scale turns components into integers; block_rows bounds a block.

    bucket_blocks: a bucket gets about so many blocks.
    """

    k: int = 8
    rounds: int = 10
    seed: str = "3"
    components: int = 64
    scale: int = 1024
    block_rows: int = 2048
    bucket_blocks: int = 8


def whole_vectors(vectors: DataFrame, settings: Settings, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of the vectors that take part, a row for each such row.

    Vectors that are null, of another length, that hold null or non-finite components, or that are so
    long that a distance might not fit in 64 bits (LONGEST) take no part. Null and repeated ids are rows
    like any other.
    """
    x = F.col(f"`{column}`")
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * settings.scale))
    # null with a null component; neither NaN nor infinity is below the bound
    length = F.aggregate(x, F.lit(0.0), lambda a, c: a + (c.cast("double") * settings.scale) * (c.cast("double") * settings.scale))
    usable = (F.size(x) == settings.components) & (length < LONGEST)
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.when(usable, scaled).alias("v"))
    return rows.where("v is not null")


def first_centroids(vectors: DataFrame, settings: Settings) -> list[list[int]]:
    """The k vectors of the smallest sha256 of ``seed:vec_id``; equal hashes by their components, null ids last."""
    named = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(named.asc_nulls_last(), "v").limit(settings.k).select("v").collect()
    return [list(r.v) for r in rows]


def _pack(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, parts, held = [], [], 0

        def block(n: int) -> pa.RecordBatch:
            nonlocal number, ids, parts, held
            all_ids, matrix = pa.concat_arrays(ids), np.concatenate(parts)
            own, ids, parts = all_ids[:n], [all_ids[n:]], [matrix[n:]]
            held -= n
            number += 1
            row = [pa.array([number]), pa.array([own.to_pylist()], pa.list_(pa.int64())), pa.array([matrix[:n].astype("<i4").tobytes()])]
            return pa.RecordBatch.from_arrays(row, names=["block", "ids", "matrix"])

        for batch in batches:
            ids.append(batch.column(0).cast(pa.int64()))
            parts.append(batch.column(1).flatten().to_numpy().reshape(-1, settings.components))
            held += batch.num_rows
            while held >= settings.block_rows:
                yield block(settings.block_rows)
        if held:
            yield block(held)

    return run


class _Buckets:
    """Tables written in hash buckets of ``block``, under names of their own, dropped by ``close``."""

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n, self.names = spark, n, []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        name = f"gondola_{label}_{uuid.uuid4().hex}"
        self.names.append(name)
        out = df.write.bucketBy(self.n, "block").sortBy("block").option("path", scratch_path(self.spark, label))
        out.saveAsTable(name)
        return self.spark.table(name)

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _matrix(raw: bytes, components: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4").reshape(-1, components).astype(np.int64)


def _squares(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    out = np.empty((len(rows), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        gone = rows - c
        out[:, k] = np.einsum("ij,ij->i", gone, gone)
    return out


def _nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and the gap to the second nearest."""
    squares = _squares(rows, centroids)
    best = squares.argmin(axis=1)
    if len(centroids) == 1:
        return best, np.full(len(rows), np.inf)
    two = np.partition(squares, 1, axis=1)[:, :2].astype(np.float64)
    return best, np.sqrt(two[:, 1]) - np.sqrt(two[:, 0]) - MARGIN


def _changes(rows: np.ndarray, old: np.ndarray | None, new: np.ndarray, k: int) -> np.ndarray:
    """What the rows add to count and component sums of each cluster: k x (1 + components)."""
    out = np.zeros((k, rows.shape[1] + 1), np.int64)
    for clusters, sign in ((new, 1), (old, -1)):
        for c in np.unique(clusters) if clusters is not None else ():
            own = rows[clusters == c]
            out[c, 0] += sign * len(own)
            out[c, 1:] += sign * own.sum(axis=0)
    return out


def _row(block, clusters, heaps, moved, sums) -> pa.RecordBatch:
    entries = [e for h in heaps for e in h]
    values = [
        pa.array([block], pa.int64()),
        pa.array([clusters.astype("<i4").tobytes()], pa.binary()),
        pa.array([np.array([e[0] for e in entries], "<f8").tobytes()], pa.binary()),
        pa.array([np.array([e[1] for e in entries], "<i4").tobytes()], pa.binary()),
        pa.array([[len(h) for h in heaps]], pa.list_(pa.int32())),
        pa.array([moved], pa.int64()),
        pa.array([sums.tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(values, names=["block", "clusters", "heap_keys", "heap_rows", "heap_sizes", "moved", "sums"])


def _first_round(centroids: np.ndarray, components: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("matrix").to_pylist(), strict=True):
                rows = _matrix(raw, components)
                clusters, gaps = _nearest(rows, centroids)
                heaps = [[] for _ in centroids]
                for row, (c, gap) in enumerate(zip(clusters.tolist(), gaps.tolist(), strict=True)):
                    heaps[c].append((gap, row))
                for h in heaps:
                    heapq.heapify(h)
                yield _row(block, clusters, heaps, len(rows), _changes(rows, None, clusters, len(centroids)))

    return run


def _next_round(centroids: np.ndarray, drift: list[float], components: int):
    """Pops what has expired at this ``drift`` per cluster, and only that is compared with centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                keys = np.frombuffer(s["heap_keys"], "<f8").tolist()
                numbers = np.frombuffer(s["heap_rows"], "<i4").tolist()
                entries, heaps, at = list(zip(keys, numbers, strict=True)), [], 0
                for size in s["heap_sizes"]:
                    heaps.append(entries[at : at + size])
                    at += size
                expired = []
                for c, h in enumerate(heaps):
                    while h and h[0][0] <= drift[c]:
                        expired.append(heapq.heappop(h)[1])
                clusters = np.frombuffer(s["clusters"], "<i4").astype(np.int64)
                again = np.array(expired, np.int64)
                rows = np.frombuffer(s["matrix"], "<i4").reshape(-1, components)[again].astype(np.int64)
                best, gaps = _nearest(rows, centroids) if len(again) else (again, np.empty(0))
                for row, c, gap in zip(expired, best.tolist(), gaps.tolist(), strict=True):
                    heapq.heappush(heaps[c], (gap + drift[c], row))
                changed = best != clusters[again]
                sums = _changes(rows[changed], clusters[again][changed], best[changed], len(centroids))
                clusters[again] = best
                yield _row(s["block"], clusters, heaps, len(expired), sums)

    return run


def _add_up(shape: tuple[int, int]):
    """(cluster, component, value) of a task's blocks; component 0 is the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, object)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total = total + np.frombuffer(raw, np.int64).reshape(shape)
        at = [(c, d, int(total[c, d])) for c in range(shape[0]) for d in range(shape[1]) if total[c, d]]
        if at:
            columns = [pa.array([r[0] for r in at], pa.int32()), pa.array([r[1] for r in at], pa.int32())]
            columns.append(pa.array([str(r[2]) for r in at], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "component", "value"])

    return run


def _gather(state: DataFrame, sums: np.ndarray) -> np.ndarray:
    """Adds a round's changes to the sums: at most k x (1 + components) rows come to the driver."""
    parts = state.select("sums").mapInArrow(_add_up(sums.shape), "cluster int, component int, value string")
    totals = parts.groupBy("cluster", "component").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out = sums.copy()
    for r in totals.collect():
        out[r.cluster, r.component] += int(r.value)
    return out


def _moved(centroids: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster; an empty one stays."""
    out = centroids.copy()
    for c, row in enumerate(sums):
        if row[0]:
            out[c] = [int(x) // int(row[0]) for x in row[1:]]
    return out


def _drifted(drift: list[float], old: np.ndarray, new: np.ndarray) -> list[float]:
    """Each cluster's drift after its centroid and the farthest moved other one have moved."""
    moves = np.sqrt(((new - old) ** 2).sum(axis=1).astype(np.float64)) + MARGIN
    moves[(new == old).all(axis=1)] = 0.0
    return [
        d + float(moves[c]) + float(max((moves[o] for o in range(len(moves)) if o != c), default=0.0))
        for c, d in enumerate(drift)
    ]


def _measured(centroids: np.ndarray, components: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw, own in zip(*(batch.column(c).to_pylist() for c in ("ids", "matrix", "clusters")), strict=True):
                clusters = np.frombuffer(own, "<i4")
                gone = _matrix(raw, components) - centroids[clusters]
                columns = [pa.array(ids, pa.int64()), pa.array(clusters, pa.int32()), pa.array(np.einsum("ij,ij->i", gone, gone))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return run


@dataclass(frozen=True)
class Clustering:
    """rows: (vec_id, cluster, distance), one per vector that takes part. scanned: vectors compared per round."""

    rows: DataFrame
    centroids: list[list[int]]
    scanned: list[int]


def cluster(vectors: DataFrame, settings: Settings | None = None) -> Clustering:
    """Lloyd's rounds over (vec_id, v), as ``whole_vectors`` gives them, exact to the last bit.

    ``rounds`` times every vector goes to the nearest centroid (ties: the smaller number) and each
    non-empty centroid becomes the floor of its vectors' mean; then vectors are assigned once more.
    Rounds after one in which no centroid moved change nothing and are left out. With fewer than k
    vectors there are so many centroids; without any there are none and no rows. The driver holds
    centroids and sums only.
    """
    settings = settings or Settings()
    spark = vectors.sparkSession
    vectors = stage(vectors, "vectors")
    centroids = np.array(first_centroids(vectors, settings), np.int64).reshape(-1, settings.components)
    if not len(centroids):
        return Clustering(spark.createDataFrame([], "vec_id long, cluster int, distance long"), [], [])
    blocks = stage(vectors.mapInArrow(_pack(settings), "block long, ids array<long>, matrix binary"), "packed")
    count = blocks.count()
    tables = _Buckets(spark, max(1, -(-count // settings.bucket_blocks)))
    try:
        packed = tables.write(blocks.repartition(tables.n, "block"), "blocks")
        sums = np.zeros((len(centroids), settings.components + 1), object)
        drift, scanned = [0.0] * len(centroids), []
        first = packed.select("block", "matrix").mapInArrow(_first_round(centroids, settings.components), STATE)
        state = tables.write(first, "state")
        for _ in range(settings.rounds):
            scanned.append(state.agg(F.sum("moved")).head()[0])
            sums = _gather(state, sums)
            new = _moved(centroids, sums)
            if (new == centroids).all():
                break
            drift, centroids = _drifted(drift, centroids, new), new
            both = packed.select("block", "matrix").join(state.drop("sums", "moved"), "block")
            state = tables.write(both.mapInArrow(_next_round(centroids, drift, settings.components), STATE), "state")
        else:
            scanned.append(state.agg(F.sum("moved")).head()[0])
        final = packed.join(state.select("block", "clusters"), "block")
        rows = stage(
            final.mapInArrow(_measured(centroids, settings.components), "vec_id long, cluster int, distance long"),
            "clusters",
        )
    finally:
        tables.close()
    return Clustering(rows, centroids.tolist(), scanned)


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def with_inertia(found: Clustering) -> DataFrame:
    """Adds cluster_inertia, inertia (sums of ``distance``) and centroid_sha256."""
    if not found.centroids:
        return found.rows.selectExpr("*", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    spark = found.rows.sparkSession
    per_cluster = {r.cluster: int(r.s) for r in found.rows.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")
    ).collect()}  # k rows
    figures = spark.createDataFrame(
        [(c, per_cluster.get(c, 0), sum(per_cluster.values()), centroid_digest(x)) for c, x in enumerate(found.centroids)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.rows.join(F.broadcast(figures), "cluster").select("vec_id", *found.rows.columns[1:], *figures.columns[1:])
