"""Mixing sources to target weights: each document a whole number of times.

Tokens are summed per source (map-side sums, so a hot source is a handful of rows), the sources'
targets follow from weights, share and ceiling, and a document is emitted floor(rate) times plus
once more when a number drawn from a hash of the document is below the rate's fraction. Everything
is built-in expressions; no document is compared with another one.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions.skew import per_key
from gondola.llm.shared import SPACE_CLASS
from gondola.operators.ids import assign_ids
from gondola.session import stage

_DRAW_DIGITS = 13  # hexadecimal digits of the draw: 52 bits, exact in a double


@dataclass(frozen=True)
class Settings:
    """What the mix should be.

    weights: of the sources in code point order, null last, repeating.
    share: words of the mix, as a part of all words there are.
    ceiling: no source is taken more often than this; must not be below ``share``.
    seed: another seed draws other documents.
    broadcast_bytes: a table of sources beyond this size is joined by shuffle.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    share: Fraction = Fraction(3, 2)
    ceiling: int = 2
    seed: str = "mix"
    broadcast_bytes: int = 16 << 20

    def __post_init__(self):
        if not self.weights or min(self.weights) <= 0:
            raise ValueError("weights must be positive")
        if not 0 <= self.share <= self.ceiling:
            raise ValueError("the share must lie between 0 and the ceiling")


def n_words(text: Column) -> Column:
    """Runs of anything but the six white space characters; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    return F.size(F.filter(parts, lambda x: x != "")).cast("long")


def source_targets(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(source, source_size, weight, target): a row per source, null being one of them.

    A target starts as the source's part, by weight, of ``share`` times all words. Where it is above
    ``ceiling`` times the source's size it stops there, and what is left is shared by the others
    until none is above: one aggregate over the sources a round, of which one row returns to the
    driver. Sums and quotients are exact, a target is the nearest double.
    """
    settings = settings or Settings()
    spark = docs.sparkSession
    sums = docs.select(F.col("source"), n_words(F.col("text")).alias("n")).groupBy("source").agg(
        F.sum("n").alias("source_size")
    )
    ranked = assign_ids(
        sums, spark.createDataFrame([], "id long"), [F.col("source").asc_nulls_last()]
    )
    weights = F.array(*map(F.lit, settings.weights))
    rows = stage(
        ranked.select(
            "source",
            "source_size",
            F.get(weights, ((F.col("id") - 1) % len(settings.weights)).cast("int")).cast("long").alias("weight"),
        ),
        "sources",
    )
    size, weight = F.col("source_size").cast("decimal(38,0)"), F.col("weight").cast("decimal(38,0)")
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("s")).head().s
    # per unit of weight; a source is full when its ceiling is not above its part
    part, full = None, F.lit(False)
    while True:
        free = rows.agg(
            F.coalesce(F.sum(F.when(~full, weight)), F.lit(0)).alias("w"),
            F.coalesce(F.sum(F.when(full, size)), F.lit(0)).alias("s"),
        ).head()
        if not free.w:
            break
        now = (settings.share * int(total) - settings.ceiling * int(free.s)) / int(free.w)
        if now == part:
            break
        part, full = now, _is_full(settings, now)
    shared = F.lit(0.0)
    for w in sorted(set(settings.weights)):
        shared = F.when(F.col("weight") == w, F.lit(float((part or 0) * w))).otherwise(shared)
    at_most = (F.col("source_size") * settings.ceiling).cast("double")
    return rows.withColumn("target", F.when(full, at_most).otherwise(shared))


def _is_full(settings: Settings, part: Fraction) -> Column:
    """ceiling * size <= weight * part, in whole numbers; one threshold per weight."""
    full = F.lit(False)
    for w in sorted(set(settings.weights)):
        most = int(part * w / settings.ceiling)  # size is whole, so the floor decides alike
        full = F.when(F.col("weight") == w, F.col("source_size") <= most).otherwise(full)
    return full


def draw(settings: Settings) -> Column:
    """A number in [0, 1) from the seed, the id and the text: the same on every run.

    Rows alike in id and text share it.
    """
    named = F.concat_ws(
        ":", F.lit(settings.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    )
    digits = F.substring(F.md5(named.cast("binary")), 1, _DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("long").cast("double") / float(1 << (4 * _DRAW_DIGITS))


def repetitions(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(row, size, source_size, target, copies): each row of ``docs`` as a struct, and how often to take it.

    ``docs`` needs ``doc_id``, ``text`` and ``source``; whatever else it has, under any name, stays
    inside ``row``. Null and empty texts have no words; their copies count nothing. A source
    without words has the target 0 and no copies. Null and repeated ids and repeated rows are rows
    like any other. An empty table gives an empty result.
    """
    settings = settings or Settings()
    targets = source_targets(docs, settings).select(
        F.col("source").alias("_source"), "source_size", "target"
    )
    length = F.coalesce(F.octet_length("_source"), F.lit(0)) + 32
    held = targets.agg(F.coalesce(F.sum(length), F.lit(0)).alias("n")).head().n
    side = F.broadcast(targets) if held <= settings.broadcast_bytes else per_key(targets, "_source")
    sized = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("source").alias("_of"),
        n_words(F.col("text")).alias("size"),
        draw(settings).alias("_draw"),
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (F.col("_draw") < rate - F.floor(rate)).cast("long")
    return sized.join(side, F.col("_of").eqNullSafe(F.col("_source"))).select(
        "row", "size", "source_size", "target", copies.alias("copies")
    )


def mix(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as the mix takes it."""
    taken = repetitions(docs, settings).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
