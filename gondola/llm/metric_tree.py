"""Exact top-k search by inner product with M-trees, best first.

Inner products become distances: every vector gets one more coordinate, the root of what its
squared length lacks to the largest one, so that the nearest candidates are those of the highest
score. Rows are dealt to cells by their nearest pivot, and in a cell to trees of a bounded size by their
distance to it: a tree is a ring, known by its smallest and largest distance. A query goes only to rings
that these distances, its own to the cell's pivot, and its k-th best so far do not rule out. A tree is stored as
pages: routing nodes with pivots, covering radii and distances to their own pivot, and leaves with
vectors and distances to the leaf's pivot. A search opens nodes in order of their lower bound and
skips whatever the stored distances already rule out; scores are exact integers.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gondola.session import stage

SLACK = 1e-7  # relative; bounds give way by this much, so rounding never loses a candidate


@dataclass(frozen=True)
class Settings:
    scale: int = 1024
    pivots: int = 32  # cells by nearest pivot
    pivot_sample: int = 4096  # rows the pivots are chosen from
    tree_rows: int = 8192  # a larger cell becomes several trees
    rings: int = 256  # by distance at most; more trees share a ring
    page: int = 64  # entries of a node
    blocks: int = 32  # queries are dealt into so many blocks when they meet the trees


@dataclass
class Node:
    pivot: np.ndarray
    radius: float
    points: np.ndarray | None = None  # leaf: rows of the tree's matrix
    away: np.ndarray | None = None  # distances of points or children to ``pivot``
    children: list[Node] = field(default_factory=list)


def _distances(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - one) ** 2).sum(axis=1), 0))


def build(matrix: np.ndarray, rows: np.ndarray, page: int, draw: np.random.Generator) -> Node:
    """Pages from the top down: pivots far from each other, each point under its nearest."""
    pivot = matrix[rows].mean(axis=0)
    away = _distances(matrix[rows], pivot)
    if len(rows) <= page:
        return Node(pivot, float(away.max(initial=0)), rows, away)
    wanted = min(page, max(2, math.ceil(len(rows) / page)))
    nearest = np.full(len(rows), np.inf)
    owner = np.zeros(len(rows), np.int64)
    at = int(draw.integers(len(rows)))
    for number in range(wanted):
        d = _distances(matrix[rows], matrix[rows[at]])
        closer = d < nearest
        owner[closer], nearest[closer] = number, d[closer]
        at = int(nearest.argmax())
        if nearest[at] == 0:
            break
    groups = [rows[owner == k] for k in np.unique(owner)]
    if len(groups) == 1:  # equal points
        groups = np.array_split(rows, math.ceil(len(rows) / page))
    children = [build(matrix, g, page, draw) for g in groups]
    apart = np.array([_distances(c.pivot[None, :], pivot)[0] for c in children])
    return Node(pivot, float(away.max()), None, apart, children)


def pages_of(root: Node, matrix: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The nodes in depth-first order, each a page of its own."""
    out: list[bytes] = []

    def write(node: Node) -> int:
        number = len(out)
        out.append(b"")
        if node.points is not None:
            arrays = {"pivot": node.pivot, "away": node.away, "ids": ids[node.points], "vectors": matrix[node.points, :-1].astype(np.int64), "points": matrix[node.points]}
        else:
            numbers = [write(c) for c in node.children]
            arrays = {
                "pivot": node.pivot, "away": node.away, "child": np.array(numbers),
                "pivots": np.stack([c.pivot for c in node.children]),
                "radii": np.array([c.radius for c in node.children]),
            }
        sink = io.BytesIO()
        np.savez(sink, **arrays)
        out[number] = sink.getvalue()
        return number

    write(root)
    return out


def load_page(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as stored:
        return {k: stored[k] for k in stored.files}


def search(
    pages: list[dict[str, np.ndarray]], query: np.ndarray, own: int, k: int, limit: float = math.inf
) -> list[tuple[int, int]]:
    """The k best (-score, id) of one tree, ties to the smaller id; none farther than ``limit``.

    Distances of the query to a node's pivot are kept with the node: by them and the stored
    ones most entries are ruled out before any distance to them is computed.
    """
    point = np.append(query.astype(np.float64), 0.0)
    size = float(np.sqrt((point**2).sum())) + 1.0
    best: list[tuple[int, int]] = []  # heap of (score, -id), the worst on top
    reach = limit
    root = pages[0]
    queue = [(0.0, 0, float(_distances(root["pivot"][None, :], point)[0]))]
    while queue:
        bound, number, near = heapq.heappop(queue)
        if bound > reach:
            break
        page = pages[number]
        give = SLACK * (size + near)
        if "child" in page:
            maybe = np.flatnonzero(np.abs(near - page["away"]) - page["radii"] - give <= reach)
            if not len(maybe):
                continue
            d = _distances(page["pivots"][maybe], point)
            lower = np.maximum(d - page["radii"][maybe] - give, 0)
            for x in np.flatnonzero(lower <= reach):
                heapq.heappush(queue, (max(bound, float(lower[x])), int(page["child"][maybe[x]]), float(d[x])))
            continue
        maybe = np.flatnonzero((np.abs(near - page["away"]) - give <= reach) & (page["ids"] != own))
        if not len(maybe):
            continue
        scores = page["vectors"][maybe] @ query
        ids = page["ids"][maybe]
        if len(best) == k:
            good = scores >= best[0][0]
            scores, ids, maybe = scores[good], ids[good], maybe[good]
        changed = False
        for score, vec in zip(scores.tolist(), ids.tolist()):
            if len(best) < k:
                heapq.heappush(best, (score, -vec))
                changed = True
            elif (score, -vec) > best[0]:
                heapq.heapreplace(best, (score, -vec))
                changed = True
        if changed and len(best) == k:
            # |q - x|^2 = |q|^2 + M^2 - 2 score, with M the common length of all points
            whole = float((page["points"][0] ** 2).sum())
            apart = math.sqrt(max(0.0, float((point**2).sum()) + whole - 2 * best[0][0]))
            reach = min(limit, apart + SLACK * (size + apart))
    return [(-score, -minus) for score, minus in sorted(best, reverse=True)]


def whole_vectors(rows: DataFrame, scale: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and integer components floor(scale x); rows with a null id, vector or component, or one not finite, are left out.

    Of rows that share an id the smallest vector stays. Shorter vectors are filled with zeros.
    """
    usable = (
        F.col("v").isNotNull()
        & F.col("id").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    )
    picked = rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    whole = picked.where(usable).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    return whole.groupBy("id").agg(F.min("v").alias("v"))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _lifted(whole: np.ndarray, longest: float) -> np.ndarray:
    points = whole.astype(np.float64)
    return np.column_stack([points, np.sqrt(np.maximum(longest - (points**2).sum(axis=1), 0))])


def _pivots(vectors: DataFrame, settings: Settings, width: int, longest: float) -> np.ndarray:
    """Points of a bounded sample that lie far from each other; they only decide which rows share a tree."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(settings.pivot_sample).toPandas()
    points = _lifted(_matrix(rows["v"], width), longest)
    chosen, nearest = [0], _distances(points, points[0])
    while len(chosen) < min(settings.pivots, len(points)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distances(points, points[chosen[-1]]))
    return points[chosen]


@dataclass
class Index:
    """Stored pages (tree, number, page) and rings (tree, cell, low, high); ``cells`` are the pivots."""

    pages: DataFrame
    rings: DataFrame
    cells: np.ndarray
    width: int
    longest: float
    settings: Settings


def build_index(vectors: DataFrame, settings: Settings | None = None) -> Index | None:
    """Trees over all rows of ``whole_vectors``; None without rows."""
    settings = settings or Settings()
    vectors = stage(vectors, "vectors")
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    known = vectors.agg(F.max(F.size("v")), F.max(length)).head()
    if known[0] is None:
        return None
    width, longest, page = int(known[0]), float(known[1]), settings.page
    cells = _pivots(vectors, settings, width, longest)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            points = _lifted(_matrix(f["v"], width), longest)
            d = (points**2).sum(axis=1)[:, None] + (cells**2).sum(axis=1)[None, :] - 2 * points @ cells.T
            away = np.sqrt(np.maximum(d.min(axis=1), 0))
            yield pd.DataFrame({"id": f["id"], "v": f["v"], "cell": d.argmin(axis=1), "away": away})

    placed = stage(vectors.mapInPandas(place, "id long, v array<long>, cell int, away double"), "cells")
    trees = _dealt_to_trees(placed, settings)

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        matrix = _lifted(_matrix(frame["v"], width), longest)
        root = build(matrix, np.arange(len(frame)), page, np.random.default_rng(0))
        stored = pages_of(root, matrix, frame["id"].to_numpy())
        return pd.DataFrame({"tree": frame["tree"].iloc[0], "number": range(len(stored)), "page": stored})

    grown = trees.drop("away").groupBy("tree").applyInPandas(grow, "tree long, number int, page binary")
    rings = trees.groupBy("tree", "cell").agg(F.min("away").alias("low"), F.max("away").alias("high"))
    return Index(stage(grown, "pages"), stage(rings, "rings"), cells, width, longest, settings)


def _dealt_to_trees(placed: DataFrame, settings: Settings) -> DataFrame:
    """Adds ``tree``: the cell, the ring in it, and where a ring is too large a share of it by hash.

    The rings' bounds are approximate quantiles: at most ``pivots`` times ``rings`` numbers.
    """
    steps = [k / settings.rings for k in range(1, settings.rings)]
    found = placed.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("away", steps, 1000).alias("q")).collect()
    bounds, wide = {}, {}
    for r in found:
        trees = math.ceil(r.n / settings.tree_rows)
        rings = min(trees, settings.rings)
        bounds[r.cell] = [r.q[k * settings.rings // rings - 1] for k in range(1, rings)]
        wide[r.cell] = math.ceil(trees / rings)
    none = F.array().cast("array<double>")
    of_cell = F.create_map(*(x for c, b in bounds.items() for x in (F.lit(c), F.array(*map(F.lit, b)) if b else none)))
    shares = F.create_map(*(F.lit(x) for pair in wide.items() for x in pair))
    ring = F.size(F.filter(of_cell[F.col("cell")], lambda b: b < F.col("away"))).cast("long")
    share = F.pmod(F.xxhash64("id"), shares[F.col("cell")])
    return placed.withColumn("tree", F.col("cell").cast("long") * (1 << 40) + ring * (1 << 24) + share)


def _ring_bounds(index: Index, asked: DataFrame) -> DataFrame:
    """(query_id, cell, other, tree, nearest) for the rings of the cells in ``apart``; queries meet rings in blocks.

    By the triangle inequality no point of a ring is nearer than the query's distance to the pivot less
    the ring's largest one, or the ring's smallest one less that distance.
    """
    blocks = F.sequence(F.lit(0), F.lit(index.settings.blocks - 1))
    rings = index.rings.select("tree", F.col("cell").alias("other"), "low", "high", F.explode(blocks).alias("block"))
    give = F.lit(10 * SLACK) * (F.col("d") + F.lit(math.sqrt(index.longest) + 1))
    nearest = F.greatest(F.col("d") - F.col("high"), F.col("low") - F.col("d")) - give
    block = F.pmod(F.xxhash64("query_id"), F.lit(index.settings.blocks)).cast("int")
    return asked.withColumn("block", block).join(rings, ["other", "block"]).withColumn("nearest", nearest)


def pairs_to_search(index: Index, asked: DataFrame) -> DataFrame:
    """(query_id, tree): the trees a query's ``reach`` touches, by stored distances alone, without its ``home``.

    ``asked`` has query_id, reach, home and apart, the distances to all cells' pivots.
    """
    each = asked.select("query_id", "reach", "home", F.posexplode("apart").alias("other", "d"))
    return _ring_bounds(index, each).where("nearest <= reach and tree <> home").select("query_id", "tree")


def top_k(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query, its own id left out.

    Every query first searches its home, the ring of its nearest cell that its own distance falls in; the
    distance of its k-th best so far limits which others it is sent to, and the search there. ``queries`` has id and v as
    ``whole_vectors`` gives them.
    """
    width, longest, cells = index.width, index.longest, index.cells

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            points = np.column_stack([_matrix(f["v"], width).astype(np.float64), np.zeros(len(f))])
            d = (points**2).sum(axis=1)[:, None] + (cells**2).sum(axis=1)[None, :] - 2 * points @ cells.T
            d = np.sqrt(np.maximum(d, 0))
            yield pd.DataFrame({"query_id": f["id"], "v": f["v"], "cell": d.argmin(axis=1), "apart": list(d)})

    asked = stage(queries.mapInPandas(place, "query_id long, v array<long>, cell int, apart array<double>"), "queries")
    own = asked.select("query_id", F.col("cell").alias("other"), F.get("apart", "cell").alias("d"))
    homes = _ring_bounds(index, own).groupBy("query_id").agg(F.min_by("tree", F.struct("nearest", "tree")).alias("home"))
    asked = stage(asked.join(homes, "query_id"), "homes")
    first = asked.select("query_id", "v", F.lit(math.inf).alias("reach"), F.col("home").alias("tree"))
    near = stage(_search(index, first, k), "near")
    worst = near.groupBy("query_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("score"), False).alias("s"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    reach = F.when(F.col("n") >= k, F.sqrt(F.greatest(length + longest - 2 * F.get("s", F.lit(k - 1)), F.lit(0.0))))
    limited = asked.join(worst, "query_id", "left").select(
        "query_id", "v", "home", "apart", F.coalesce(reach * (1 + 10 * SLACK) + 1e-6, F.lit(math.inf)).alias("reach")
    )
    limited = stage(limited, "limited")
    far = pairs_to_search(index, limited).join(limited.select("query_id", "v", "reach"), "query_id")
    found = near.union(_search(index, far, k))
    place_of = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(place_of)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """Each row of ``asked`` (query_id, v, reach, tree) searched in its tree; up to k rows each."""
    width = index.width

    # pages of a tree come before its queries, in one sorted stream: a task holds one tree
    pages = index.pages.select(
        "tree", F.lit(0).alias("kind"), F.col("number").cast("long").alias("at"), "page",
        F.lit(None).cast("array<long>").alias("v"), F.lit(None).cast("double").alias("reach"),
    )
    rows = asked.select(
        "tree", F.lit(1).alias("kind"), F.col("query_id").alias("at"), F.lit(None).cast("binary").alias("page"), "v", "reach"
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, held = None, []
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if row.tree != tree:
                    tree, held = row.tree, []
                if row.kind == 0:
                    held.append(load_page(row.page))
                    continue
                query = np.zeros(width, np.int64)
                query[: len(row.v)] = row.v
                out += [(row.at, vec, -minus) for minus, vec in search(held, query, row.at, k, row.reach)]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype=np.int64)

    stream = pages.union(rows).repartition("tree").sortWithinPartitions("tree", "kind", "at")
    return stream.mapInPandas(run, "query_id long, vec_id long, score long")
