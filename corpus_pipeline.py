"""Training corpus from ``documents``: quality rules, near-dedup, substring dedup, packing.

Every stage works on all rows the one before kept and takes effect on them: rejected documents go,
one document of each near-duplicate group stays, words of repeated passages are cut out, and what is
left becomes token sequences.

In every stage but the last the rows keep all their columns, whatever their names (``doc_id`` and
``text`` are read; ``labels`` has columns of its own). An empty table stays empty. No stage limits the
length of a text. A null text counts as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm import near_dedup, packing, quality_rules, substring_dedup
from gondola.llm.queries import read, tokenizer
from gondola.llm.shared import prepare
from gondola.session import stage

# A passage of this many words that already stands elsewhere is cut out.
PASSAGE_WORDS = 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what neither the base rules nor the learned ones reject, row by row.

    Null, empty and short texts (under 20 words) fail the base rules and go. Null and repeated ids and
    repeated rows are judged like any other. Labels without a document, or of null quality, teach nothing.
    """
    rules = quality_rules.fit(docs, read(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group linked by shingles of five words at a similarity of 0.8.

    Rows without id stay, and texts without words, which are linked with nothing. Rows that share
    an id are one document: they stay or go together.
    """
    return near_dedup.keep_one(docs, near_dedup.Settings())


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages whose words also start in a smaller id, or earlier in the same document.

    A document all of whose words stand elsewhere stays with an empty text; a null text stays null. Of
    repeated rows none is earlier, so none is cut for the other. ``n_chars``, where there is such a
    column, follows the text.
    """
    found = substring_dedup.rewrite(docs, PASSAGE_WORDS)
    return found.withColumns({"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {})


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its token ids and its place in a sequence.

    A null or empty text is a piece of its end alone. Null and repeated ids keep their rows.
    """
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = (
    ("quality rules", quality),
    ("near-dedup", near_duplicates),
    ("substring dedup", passages),
    ("packing", sequences),
)
# Learned rules, signatures and packing are beyond SQL; tests compare every stage with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``; every stage but the last is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(prepare(spark), docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
