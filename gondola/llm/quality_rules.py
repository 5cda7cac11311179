"""Quality rules: a decision list learned by sequential covering, applied as Spark conditions.

Statistics, base rules and verdict are built-in expressions only. Learning runs on the
statistics of a bounded sample of labelled documents (``FitSettings.sample_rows``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions.columns import compute_once
from gondola.llm.shared import SPACE_CLASS

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = r"[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Features the rules may test: all are ratios, so that a rule means the same for any length.
FEATURES = ("word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share")


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key and the counts, whole texts, nothing dropped.

    Null and empty texts have counts of 0. Everything is computed inside the row; the only
    size that matters is that of the text itself.
    """
    w = compute_once(
        docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")),
        words=F.filter(F.split("t", SPACE_CLASS + "+"), lambda x: x != ""),
        lines=F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t-\r]")),
        n_symbols=(F.size(F.split("t", SYMBOLS)) - 1).cast("long"),
    ).drop("t")
    counted = compute_once(
        w,
        n_words=F.size("words").cast("long"),
        word_chars=F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + F.length(x)),
        n_distinct=F.size(F.array_distinct("words")).cast("long"),
        n_lines=F.size("lines").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        hashes=F.transform("words", lambda x: F.xxhash64(x)),
    ).drop("words", "lines")
    starts = F.when(
        F.col("n_words") >= WINDOW, F.sequence(F.lit(1), (F.col("n_words") - WINDOW + 1).cast("int"))
    ).otherwise(F.array().cast("array<int>"))
    windows = compute_once(
        counted, windows=F.transform(starts, lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))
    ).drop("hashes")
    # most texts repeat nothing: only the others are sorted
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = compute_once(
        windows,
        ordered=F.when(F.size(F.array_distinct("windows")) < F.size("windows"), pairs).otherwise(
            F.array().cast("array<struct<h:bigint,i:int>>")
        ),
    ).drop("windows")
    same = lambda x, k: F.coalesce(F.get("ordered", k)["h"] == x["h"], F.lit(False))
    found = compute_once(
        ordered,
        at=F.sort_array(
            F.transform(
                F.filter("ordered", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]
            )
        ),
    ).drop("ordered")
    covered = F.transform(
        "at", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - i, F.lit(WINDOW)))
    )
    return found.select(
        "doc_id",
        *COUNTS[:-1],
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        "n_distinct",
        "n_lines",
    )


def features(row: dict[str, Column] | None = None) -> dict[str, Column]:
    c = row or {name: F.col(name) for name in (*COUNTS, "n_distinct", "n_lines")}
    words, lines = F.greatest(c["n_words"], F.lit(1)), F.greatest(c["n_lines"], F.lit(1))
    return {
        "word_length": c["word_chars"] / words,
        "symbol_share": c["n_symbols"] / words,
        "dup_line_share": c["n_dup_lines"] / lines,
        "repeat_share": c["n_repeat_words"] / words,
        "distinct_share": c["n_distinct"] / words,
    }


@dataclass(frozen=True)
class FitSettings:
    """sample_rows bounds the labelled rows that are learned from; the rest are parameters of growth."""

    sample_rows: int = 5000
    thresholds: int = 24
    max_rules: int = 8
    max_conditions: int = 3
    min_precision: float = 0.95
    min_covered: int = 5


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, row: Sequence[float]) -> bool:
        value = row[FEATURES.index(self.feature)]
        return value >= self.threshold if self.at_least else value <= self.threshold

    def column(self, values: dict[str, Column]) -> Column:
        value = values[self.feature]
        return value >= self.threshold if self.at_least else value <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first whose conditions all hold rejects, no rule keeps."""

    rules: tuple[tuple[Condition, ...], ...] = field(default=())

    def rule_number(self) -> Column:
        """1, 2, ... for the rule that fires, else null, as one conditional expression."""
        values, out = features(), None
        for number, rule in enumerate(self.rules, 1):
            test = F.lit(True)
            for condition in rule:
                test = test & condition.column(values)
            out = F.when(test, number) if out is None else out.when(test, number)
        return F.lit(None).cast("int") if out is None else out


def _grow(bad: list, good: list, settings: FitSettings) -> list[Condition]:
    """Add the condition of the largest information gain until no good row is covered."""
    rule: list[Condition] = []
    while good and len(rule) < settings.max_conditions:
        before, best, gain = math.log2(len(bad) / (len(bad) + len(good))), None, 1e-9
        for k, name in enumerate(FEATURES):
            values = sorted({row[k] for row in bad})
            step = max(1, len(values) // settings.thresholds)
            for threshold in values[::step]:
                for at_least in (True, False):
                    test = Condition(name, at_least, threshold)
                    p = sum(map(test.holds, bad))
                    if not p:
                        continue
                    n = sum(map(test.holds, good))
                    gained = p * (math.log2(p / (p + n)) - before)
                    if gained > gain:
                        best, gain = test, gained
        if best is None:
            break
        rule.append(best)
        bad, good = [r for r in bad if best.holds(r)], [r for r in good if best.holds(r)]
    return rule


def _covers(rule: Sequence[Condition], row: Sequence[float]) -> bool:
    return all(c.holds(row) for c in rule)


def _prune(rule: list[Condition], bad: list, good: list) -> list[Condition]:
    """Drop final conditions while the rule gets no worse on rows it was not grown on."""

    def worth(r: list[Condition]) -> float:
        p, n = sum(_covers(r, x) for x in bad), sum(_covers(r, x) for x in good)
        return (p - 4 * n) / max(1, p + n)

    best = rule
    for end in range(len(rule) - 1, 0, -1):
        if worth(rule[:end]) > worth(best):
            best = rule[:end]
    return best


def learn(rows: Sequence[tuple[bool, Sequence[float]]], settings: FitSettings | None = None) -> DecisionList:
    """Sequential covering over (is bad, feature values): grow, prune, accept, remove what is covered.

    Every third row is kept for pruning and acceptance. No rule is made without bad and good
    rows; a rule must reach ``min_precision`` on all rows.
    """
    settings = settings or FitSettings()
    rows = sorted(rows, key=lambda r: (r[0], tuple(r[1])))
    grow = [r for k, r in enumerate(rows) if k % 3]
    hold = [r for k, r in enumerate(rows) if not k % 3]
    split = lambda part: ([x for b, x in part if b], [x for b, x in part if not b])
    (bad, good), (bad2, good2) = split(grow), split(hold)
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < settings.max_rules and bad and good:
        rule = _prune(_grow(bad, good, settings), bad2, good2)
        p = sum(_covers(rule, x) for x in (*bad, *bad2)) if rule else 0
        n = sum(_covers(rule, x) for x in (*good, *good2)) if rule else 0
        if p < settings.min_covered or p < settings.min_precision * (p + n):
            break
        rules.append(tuple(rule))
        bad, bad2 = ([x for x in part if not _covers(rule, x)] for part in (bad, bad2))
    return DecisionList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, settings: FitSettings | None = None) -> DecisionList:
    """Learn from labelled documents; ``labels`` has doc_id and quality (0: bad).

    Labels that are null, or that contradict each other for one document, are not used. The
    sample is the ``sample_rows`` documents of the smallest hash, so it is the same on every run.
    """
    settings = settings or FitSettings()
    sample = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(settings.sample_rows)
        .select("doc_id", (F.col("quality") == 0).alias("bad"))
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    stats = statistics(texts).join(F.broadcast(sample), "doc_id")
    values = features()
    picked = stats.where(~base_failed()).select("doc_id", F.struct("bad", *(values[f].alias(f) for f in FEATURES)).alias("row"))
    # one text of an id, that of the smallest values: at most sample_rows rows of six numbers
    found = [tuple(r.row) for r in picked.groupBy("doc_id").agg(F.min("row").alias("row")).collect()]
    return learn([(row[0], row[1:]) for row in found], settings)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def judge(docs: DataFrame, rules: DecisionList, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, base verdict, number of the learned rule that fired (or null), and ``kept``.

    A row for every row of ``docs``, repeated and null ids included; other columns are not read.
    """
    out = statistics(docs, key, text).withColumn("base_failed", base_failed())
    return compute_once(out, rule=rules.rule_number()).select(
        "doc_id",
        *COUNTS,
        "base_failed",
        (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"),
        "rule",
    )


def keep_good(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; decided inside each row."""
    packed = docs.select(F.struct("*").alias("doc"), F.col("text").alias("text"))
    judged = judge(packed, rules, key="doc")
    return judged.where("kept").select("doc_id.*")
