"""Jobs on stored tables: each reads the newest version and commits one new version, or none."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gondola import schemas
from gondola.operators.categories import default_categories
from gondola.operators.dimensions import upsert_stores
from gondola.operators.duplicates import merge_choices, merge_stats, merged_products, move_prices, replacement_ids
from gondola.operators.maintenance import update_flyer_log, update_products
from gondola.plans.ingest import batch_summary, ingest
from gondola.session import prepare, scratch, stage
from gondola.sources.tables import Change, read_rows

INGESTED = ("imagens", "supermercados", "produtos", "precos")


def ingest_into(
    spark: SparkSession,
    base: str,
    answers: DataFrame,
    now: dt.datetime,
    store_override: str | None = None,
    stream: tuple[str, int] | None = None,
    buckets: int | None = None,
) -> Row | None:
    """Ingest answers on top of the stored tables; returns the figures of the batch.

    ``stream``: name and batch number of a stream. A batch that was committed before is not taken
    again (None is returned), so a stream may repeat it after a failure. ``buckets`` is how many
    the product table gets if this is the first version.
    """
    change = Change(prepare(spark), base, **({"buckets": buckets} if buckets else {}))
    if stream and change.streams.get(stream[0], -1) >= stream[1]:
        return None
    with scratch(spark):
        result = ingest(
            answers,
            change.last_id("imagens"),
            change.read("supermercados"),
            read_rows(spark, base, "produtos", change.start),
            change.last_id("precos"),
            default_categories(spark),
            now,
            store_override,
            {name: change.last_id(name) for name in INGESTED},
            change.start.buckets,
        )
        figures = batch_summary(result).head() if stream is None else None
        for name in INGESTED:
            change.append(name, getattr(result, name))
    if stream:
        change.streams[stream[0]] = stream[1]
    change.commit()
    return figures


class Merged(NamedTuple):
    """Number of the new version, the figures of the merge, and how many folders were written anew."""

    version: int
    stats: Row
    rewritten: dict[str, int]


def merge_stored(spark: SparkSession, base: str, now: dt.datetime) -> Merged:
    """Merge all duplicated names in the stored tables.

    Only folders with a product of a merged group, or with a price that moves, are written anew; stores
    and log stay as they are. Prices and products change in one version: a merge that stops before it
    leaves the tables as they were. Without duplicates there is no new version.
    """
    change = Change(prepare(spark), base)
    produtos, precos = change.read("produtos"), change.read("precos")
    with scratch(spark):
        choices = stage(merge_choices(produtos, precos), "grupos")
        moved = stage(replacement_ids(produtos, choices), "trocas")
        stats = merge_stats(choices).head()
        if not stats.grupos_duplicados:
            return Merged(change.start.number, stats, {"precos": 0, "produtos": 0})
        touched = choices.select(F.col("principal_id").alias("id")).union(moved.select("produto_id"))
        rewritten = {
            "precos": change.rewrite(
                "precos", moved.select("produto_id"), lambda rows: move_prices(rows, moved), "produto_id"
            ),
            "produtos": change.rewrite("produtos", touched, lambda rows: merged_products(rows, choices, now)),
        }
        return Merged(change.commit().number, stats, rewritten)


def update_log(spark: SparkSession, base: str, updates: DataFrame, now: dt.datetime) -> int:
    """``maintenance.update_flyer_log`` on the stored log; returns how many folders were written anew."""
    return _update(spark, base, "imagens", updates, lambda rows, new: update_flyer_log(rows, new, now))


def update_stored_products(spark: SparkSession, base: str, updates: DataFrame, now: dt.datetime) -> int:
    """``maintenance.update_products`` on the stored products; a renamed product moves to its new bucket."""
    return _update(spark, base, "produtos", updates, lambda rows, new: update_products(rows, new, now))


def _update(spark, base, name, updates, rule) -> int:
    change = Change(prepare(spark), base)
    with scratch(spark):
        new = stage(updates, "alteracoes")
        written = change.rewrite(name, new.select("id"), lambda rows: rule(rows, new))
        if written:
            change.commit()
    return written


def upsert_stored_stores(spark: SparkSession, base: str, incoming: DataFrame, now: dt.datetime, order: str = "ordem") -> int:
    """``dimensions.upsert_stores`` on the stored stores; returns how many folders were written anew.

    Folders without a store that comes in stay as they are; new stores get a folder of their own, and
    ids that no store ever had.
    """
    change = Change(prepare(spark), base)
    known = change.read("supermercados")
    keys = ["nome", "cidade", "estado"]
    with scratch(spark):
        rows = stage(upsert_stores(known, incoming, now, order, change.last_id("supermercados")), "lojas")
        met = stage(known.join(incoming.select(keys), keys, "left_semi").select("id"), "encontradas")
        written = change.rewrite("supermercados", met, lambda old: rows.join(old.select("id"), "id", "left_semi"))
        new = stage(rows.join(known.select("id"), "id", "left_anti"), "novas")
        if not new.isEmpty():
            change.append("supermercados", new)
        elif not written:
            return 0
        change.commit()
    return written


def delete_rows(spark: SparkSession, base: str, **ids: DataFrame) -> int:
    """Delete products, stores, flyers or prices (table name -> rows with ``id``); prices go with what they name.

    The ids are listed and left out by every reader; ``compact`` drops the rows. Returns the new version.
    """
    change = Change(prepare(spark), base)
    unknown = set(ids) - set(schemas.TABLES)
    if unknown:
        raise ValueError(f"no such table: {', '.join(sorted(unknown))}")
    for name, rows in ids.items():
        change.delete(name, rows)
    return change.commit().number


def compact(spark: SparkSession, base: str) -> int:
    """Write every table into one folder per month or bucket, without deleted rows; returns the new version.

    Ids and streams go on where they were. The old folders stay for whoever reads them, until
    ``versions.expire``.
    """
    change = Change(prepare(spark), base)
    if not change.start.number:
        raise ValueError(f"no tables below {base}")
    for name in change.start.folders:
        change.replace_all(name)
    change.deleted = {}
    return change.commit().number
