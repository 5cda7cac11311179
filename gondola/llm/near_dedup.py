"""Near-duplicate groups: MinHash signatures, banding, verification on full sets, components.

Documents of equal shingle sets are one class from the start. Classes that share a band meet in
a bucket. A bucket is first tied to one of its members; what that leaves unconnected is compared
inside tasks, in blocks of a fixed size: by signature, then by sets of 32-bit hashes, each pair in
the first band it shares. Only pairs that tie components together become rows. Every link is
confirmed on the full sets. Components grow by alternating large-star and small-star.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.functions.skew import per_key
from gondola.llm.shared import (
    WordHashes, as_signed, keyed_text, lower_ascii, release_memory, split_words, text_bytes, window_hashes, worker_cache,
)
from gondola.session import stage


@dataclass(frozen=True)
class Settings:
    """40 bands of 5 minima miss a pair of similarity 0.8 once in 7.9 million, the signature test of ``_rest_pairs``
    once in 830,000: a link is lost with a probability of 1.3e-6 at most, a more similar pair's with less.
    """

    shingle_words: int = 5
    similarity_percent: int = 80
    bands: int = 40
    rows: int = 5
    star_rounds: int = 3  # members a bucket is tied to before its rest is compared
    block: int = 1024  # members of a bucket compared with so many others in one group
    broadcast_ids: int = 4_000_000  # ids sent to all workers at most (32 MB), else a join
    task_words: int = 200_000  # different words whose hashes a task remembers

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def _halved(shingles: np.ndarray) -> np.ndarray:
    """The upper 32 bits of each hash, still sorted."""
    return (shingles >> np.uint64(32)).astype(np.uint32)


class MinHash:
    """Minima of ``n`` universal hash functions (a x + b mod 2^32) of 32-bit shingle hashes."""

    def __init__(self, n: int, seed: int = 20240229):
        draw = np.random.default_rng(seed)
        self.a = (draw.integers(0, 1 << 31, n, dtype=np.uint64) * 2 + 1).astype(np.uint32)
        self.b = draw.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)

    def signature(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 2048):
            part = x[None, at : at + 2048] * self.a[:, None]
            part += self.b[:, None]
            np.minimum(out, part.min(axis=1), out=out)
        return out


def shingle_set(text: bytes, hashes: WordHashes, words: int) -> np.ndarray:
    """Sorted distinct hashes; a shorter text is one shingle, a text without words has none."""
    flat = hashes.of(split_words(lower_ascii(text)))
    if len(flat) and len(flat) < words:
        return window_hashes(flat, len(flat))
    return np.unique(window_hashes(flat, words))


def _band_keys(signature: np.ndarray, settings: Settings) -> np.ndarray:
    """A 64-bit key per band, different between bands."""
    raw = signature.reshape(settings.bands, settings.rows)
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes(), seed=k) for k, r in enumerate(raw)], np.uint64)


def sketches(docs: DataFrame, settings: Settings, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, number of shingles, digest of the set (null when empty) and band keys (null when empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("near-dedup")
        hashes, minhash = WordHashes(settings.task_words), MinHash(settings.hashes)
        for batch in batches:
            sizes, digests, bands, seen = [], [], [], {}
            for text in text_bytes(batch.column(1)):
                found = shingle_set(text, hashes, settings.shingle_words)
                digest = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
                if digest and digest not in seen:  # copies in a batch share their minima
                    seen[digest] = as_signed(_band_keys(minhash.signature(_halved(found)), settings))
                sizes.append(len(found))
                digests.append(digest)
                bands.append(seen.get(digest))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["id", "n_shingles", "digest", "bands"],
            )
        del hashes
        release_memory()

    schema = "id long, n_shingles long, digest binary, bands array<long>"
    return keyed_text(docs, key, text).mapInArrow(run, schema)


def _with_sets(docs: DataFrame, ids: DataFrame, settings: Settings, key: str, text: str) -> DataFrame:
    """Sets of the given documents, from their texts: whole hashes, and their upper halves."""
    few = ids.count() <= settings.broadcast_ids
    wanted = keyed_text(docs, key, text).join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("near-dedup")
        hashes = WordHashes(settings.task_words)
        for batch in batches:
            sets = [shingle_set(t, hashes, settings.shingle_words) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                    pa.array([_halved(s).tobytes() for s in sets], pa.binary()),
                ],
                names=["id", "n", "digest", "shingles", "halves"],
            )
        del hashes
        release_memory()

    found = wanted.mapInArrow(run, "id long, n long, digest binary, shingles binary, halves binary")
    return found.where("n > 0").dropDuplicates(["id", "digest"])


def linked(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def confirm(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    percent = settings.similarity_percent
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"))
    near = (
        pairs.join(left, "a")
        .join(right, "b")
        .where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        .select("a", "b")
    )
    full = near.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("s_a")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("s_b")), "b"
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = [linked(x, y, percent) for x, y in zip(f["s_a"], f["s_b"])]
            yield f.loc[keep, ["a", "b"]]
        release_memory()

    return full.mapInPandas(run, "a long, b long").distinct()


def _content(edges: DataFrame) -> tuple:
    """Number and order-free checksum of distinct edges."""
    total = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count("*"), total).head())


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, component) for every id that has a link; the component is its smallest id.

    Large-star: each node ties its larger neighbours to its smallest neighbour (or itself).
    Small-star: each node ties its smaller neighbours to the smallest. Stars are made with
    grouped minima and joins, so no node's neighbours are gathered.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stage(ordered.distinct(), "links")
    before = _content(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = (
            both.where("other > node").join(per_key(least, "node"), "node").select(F.col("other").alias("a"), F.col("m").alias("b"))
        )
        large = stage(large.where("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(per_key(least, "a"), "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        small = stage(small.where("a <> b").distinct(), "small-star")
        edges, now = small, _content(small)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def _current(members: DataFrame, links: DataFrame | None) -> DataFrame:
    """Bucket members with the component that the links so far put them in."""
    if links is None:
        return members.withColumn("component", F.col("id"))
    found = components(links)
    joined = members.join(per_key(found, "id"), "id", "left")
    return joined.withColumn("component", F.coalesce("component", "id")).select(*members.columns, "component")


def _open_buckets(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component."""
    spread = (
        members.groupBy("bucket")
        .agg(F.min("component").alias("x"), F.max("component").alias("y"))
        .where("x <> y")
        .select("bucket")
    )
    return members.join(per_key(spread, "bucket"), "bucket")


def _rest_pairs(members: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Pairs that tie components of a bucket together: all its members against all, in blocks.

    Signatures rule out what lies five standard errors below the similarity asked for. A pair
    that is certain joins its components at once, so a group gives fewer rows than it has
    members, but for pairs so close to the bound that only the full sets can tell.
    """
    goal = settings.similarity_percent / 100
    enough = settings.hashes * (goal - 5 * (goal * (1 - goal) / settings.hashes) ** 0.5)
    block = settings.block
    parts = members.groupBy("bucket", "component").agg(F.count("*").alias("part"))
    sizes = parts.groupBy("bucket").agg(F.sum("part").alias("n"))
    sizes = parts.join(sizes, "bucket").select(
        "bucket",
        "component",
        F.ceil(F.col("part") / block).cast("int").alias("wide"),
        F.ceil(F.col("n") / block).cast("int").alias("blocks"),
    )
    # a component takes as many neighbouring blocks as it fills, so that most blocks hold few components
    own = F.pmod(F.xxhash64("component") + F.pmod(F.xxhash64("id"), F.col("wide")), F.col("blocks"))
    blocks = members.join(per_key(sizes, "bucket", "component"), ["bucket", "component"]).select(
        "bucket", "band", "id", "component", "blocks", own.cast("int").alias("own")
    )
    # block i meets block j once, under (smaller, larger)
    meet = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "bucket", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component"
    )
    mixed = (
        meet.groupBy("bucket", "i", "j")
        .agg(F.min("component").alias("x"), F.max("component").alias("y"))
        .where("x <> y")
        .select("bucket", "i", "j")
    )
    full = meet.join(per_key(mixed, "bucket", "i", "j"), ["bucket", "i", "j"]).join(
        sets.select("id", "halves"), "id"
    )
    shape, percent = (settings.bands, settings.rows), settings.similarity_percent

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "halves"])
        minhash = MinHash(settings.hashes)
        sets = [np.frombuffer(x, np.uint32) for x in frame["halves"]]
        signs = np.stack([minhash.signature(x) for x in sets])
        n = np.array([len(x) for x in sets])
        ids, parts, own = (frame[c].to_numpy() for c in ("id", "component", "own"))
        band, split = frame["band"].iloc[0], frame["i"].iloc[0] != frame["j"].iloc[0]
        _, tree = np.unique(parts, return_inverse=True)
        top = np.arange(tree.max() + 1)
        found = []
        for k in range(len(ids) - 1):
            rest = slice(k + 1, None)
            can = (top[tree[rest]] != top[tree[k]]) & (
                100 * np.minimum(n[rest], n[k]) >= percent * np.maximum(n[rest], n[k]) - 200
            )
            if split:
                can &= own[rest] != own[k]
            at = np.flatnonzero(can) + k + 1
            equal = signs[at] == signs[k]
            at = at[(equal.sum(axis=1) >= enough) & (equal.reshape(len(at), *shape).all(axis=2).argmax(axis=1) == band)]
            for x in at:
                if top[tree[x]] == top[tree[k]]:
                    continue
                common = len(np.intersect1d(sets[k], sets[x], assume_unique=False))
                whole = n[k] + n[x] - common
                # halves of hashes may agree by chance: two more or less decide what is certain here
                if 100 * (common + 2) < percent * (whole - 2):
                    continue
                found.append((ids[k], ids[x]))
                if 100 * (common - 2) >= percent * (whole + 2):
                    top[top == top[tree[x]]] = top[tree[k]]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return full.groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def groups(
    docs: DataFrame, settings: Settings | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, set size, component (smallest id reachable), and whether it is kept.

    Words are split at white space after A-Z become small. Documents without words are linked
    with nothing. Null ids are their own group and kept. Rows that share an id are one document:
    a link of any of their texts links the id.
    """
    settings = settings or Settings()
    known = stage(sketches(docs, settings, key, text), "sketches")
    usable = known.where("id is not null and digest is not null")
    classes = usable.groupBy("digest", "n_shingles").agg(F.min_by("bands", "id").alias("bands"), F.min("id").alias("id"))
    classes = stage(classes, "classes")

    rows = classes.select("id", F.posexplode("bands").alias("band", "bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = stage(rows.join(per_key(shared, "bucket"), "bucket").select("bucket", "band", "id"), "buckets")
    sets = stage(_with_sets(docs, members.select("id").distinct(), settings, key, text), "sets")

    links, open_now = None, members.withColumn("component", F.col("id"))
    for turn in range(settings.star_rounds):
        rank = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
        centre = open_now.groupBy("bucket").agg(
            F.min_by("id", rank).alias("a"), F.min_by("component", rank).alias("c")
        )
        pairs = (
            open_now.join(per_key(centre, "bucket"), "bucket")
            .where("component <> c")
            .select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))
            .distinct()
        )
        found = stage(confirm(pairs, sets, settings), "star-links")
        links = found if links is None else links.union(found)
        open_now = stage(_open_buckets(_current(members, links)), "open-buckets")
        if open_now.isEmpty():
            break
    if not open_now.isEmpty():
        rest = confirm(_rest_pairs(open_now, sets, settings), sets, settings)
        links = links.union(stage(rest, "rest-links"))

    copies = usable.join(per_key(classes.select("digest", F.col("id").alias("class")), "digest"), "digest").select(
        F.col("id").alias("a"), F.col("class").alias("b")
    )
    # ids with several texts tie their classes together
    of_class = stage(components(links.union(copies)), "components")
    return (
        known.join(per_key(of_class, "id"), "id", "left")
        .withColumn("component_id", F.coalesce("component", "id"))
        .select(
            F.col("id").alias("doc_id"),
            "n_shingles",
            "component_id",
            F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )


def keep_one(docs: DataFrame, settings: Settings | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those that ``groups`` does not keep.

    Rows without id stay, and so do all rows that share a kept id.
    """
    settings = settings or Settings()
    gone = stage(
        groups(docs, settings, key, text).where("not kept").select(F.col("doc_id").alias(key)).distinct(), "dropped"
    )
    few = gone.count() <= settings.broadcast_ids
    return docs.join(F.broadcast(gone) if few else gone, key, "left_anti")
