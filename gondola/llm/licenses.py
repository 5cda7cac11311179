"""License scan: ordered signature rules behind a keyword test, resolved by priority and containment.

All of it is built-in expressions inside the row of a document: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions.columns import compute_once
from gondola.llm.license_rules import BASE_PHRASES, MAX_MATCH_WORDS, TRIGGERS, Rule, rules

def _run_of(characters: str) -> str:
    """A run of ASCII characters, listed one by one: Java then tests a character by one look-up in a table."""
    return "[" + "".join(f"\\x{ord(c):02X}" for c in characters) + "]+"


# Between the words of lower-cased text, and the same with capitals still in it.
NOT_WORD = _run_of("".join(c for c in map(chr, range(128)) if not c.isdigit() and not c.islower()))
ANY_CASE_NOT_WORD = _run_of("".join(c for c in map(chr, range(128)) if not c.isalnum()))
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = "\u0001"  # not a word character, so never in the words themselves
WEIGHTS = {4: 1.0, 3: 0.9, 2: 0.7, 1: 0.4}  # how sure a form of mention is


def _rule_table(found: list[Rule]) -> Column:
    fields = ("number", "label", "form", "priority", "keyword", "regex")
    return F.array(*(F.struct(*(F.lit(getattr(r, f)).alias(f) for f in fields)) for r in found))


def _starts(words: Column | str, regex: Column) -> Column:
    """Word numbers (from 0) at which the matches of ``regex`` begin, in one pass over the text."""
    marked = F.split(F.trim(F.regexp_replace(words, regex, F.lit(f"{MARK}$0"))), " ")
    places = F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit(MARK)), i))
    return F.filter(places, lambda i: i.isNotNull())


def _n_words(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def _detections(rule: Column) -> Column:
    lengths = F.transform(F.regexp_extract_all("words", rule["regex"], F.lit(0)), _n_words)
    return F.zip_with(
        _starts("words", rule["regex"]),
        lengths,
        lambda start, n: F.struct(
            start.alias("start"),
            (-start - n).alias("minus_end"),
            (-rule["priority"]).alias("minus_priority"),
            rule["number"].alias("rule"),
            rule["label"].alias("label"),
        ),
    )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", found: list[Rule] | None = None) -> DataFrame:
    """Per row of ``docs``: words, places of the base phrases, and the detections that remain.

    ``detections`` are structs (start, end in words, label, rule, priority). One is suppressed
    when another of at least its priority covers all of its words; of equal spans the higher
    priority stays, then the earlier rule. ``score`` is the weight of the surest form that
    remains, 0 without any. A null text is empty; null and repeated ids keep their rows.
    """
    table = found if found is not None else rules()
    lower = F.lower("t")
    trigger = F.lit(False)
    for word in TRIGGERS:
        trigger = trigger | F.contains(lower, F.lit(word))
    for word in ("general", "cc"):
        pattern = {"general": "general" + NOT_WORD + "public", "cc": "cc" + NOT_WORD + "by"}[word]
        trigger = trigger | (F.contains(lower, F.lit(word)) & lower.rlike(pattern))
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    rows = compute_once(
        rows,
        # with a space at both ends there is one gap more than words
        n_words=(F.regexp_count(F.concat(F.lit(" "), "t", F.lit(" ")), F.lit(ANY_CASE_NOT_WORD)) - 1).cast("long"),
        # one space before, between and after the words, only where a rule may match
        words=F.when(
            trigger,
            F.concat(
                F.lit(" "),
                F.trim(F.regexp_replace(F.translate("t", CAPITALS, SMALL), NOT_WORD, " ")),
                F.lit(" "),
            ),
        ),
    ).drop("t")
    base = [_starts("words", F.lit(f"(?<= ){phrase}(?= )")) for phrase, _ in BASE_PHRASES]
    likely = F.filter(_rule_table(table), lambda r: F.contains("words", r["keyword"]))
    rows = compute_once(
        rows,
        **{f"base{k}": F.when(F.contains("words", F.lit(p)), b) for (k, b), (p, _) in zip(enumerate(base), BASE_PHRASES)},
        likely=likely,
    )
    rows = compute_once(
        rows, sorted=F.sort_array(F.flatten(F.transform("likely", _detections)))
    ).drop("words", "likely")

    # whatever covers a detection sorts before it, and starts at most a match's length earlier
    reach = MAX_MATCH_WORDS * max(1, len(table))

    def stays(d: Column, k: Column) -> Column:
        first = F.greatest(k - reach, F.lit(0))
        return ~F.exists(
            F.slice("sorted", first + 1, k - first),
            lambda e: (e["minus_end"] <= d["minus_end"]) & (e["minus_priority"] <= d["minus_priority"]),
        )

    rows = compute_once(
        rows,
        detections=F.transform(
            F.filter(F.coalesce("sorted", F.array().cast(dict(rows.dtypes)["sorted"])), stays),
            lambda d: F.struct(
                d["start"].cast("long").alias("start"),
                (-d["minus_end"]).cast("long").alias("end"),
                d["label"].alias("label"),
                d["rule"].alias("rule"),
                (-d["minus_priority"]).alias("priority"),
            ),
        ),
        base=F.flatten(
            F.array(*(F.coalesce(f"base{k}", F.array().cast("array<int>")) for k in range(len(BASE_PHRASES))))
        ),
        base_labels=F.array_sort(
            F.array_compact(
                F.array(*(F.when(F.size(f"base{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE_PHRASES)))
            )
        ),
    )
    weight = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))
    surest = F.array_max(F.transform("detections", lambda d: d["priority"]))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base").cast("long").alias("first_word"),
        F.array_max("base").cast("long").alias("last_word"),
        "base_labels",
        F.array_sort(
            F.array_union("base_labels", F.transform("detections", lambda d: d["label"]))
        ).alias("labels"),
        F.coalesce(F.try_element_at(weight, surest), F.lit(0.0)).alias("score"),
        "detections",
    )
