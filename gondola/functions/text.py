"""Text rules as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ANY_WHITESPACE = r"(?U)\s+"
# Every character with the Unicode White_Space property, and the ASCII separators.
WHITESPACE_CHARACTERS = (
    " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
ALTERNATIVE_WORD = r"(?iU)\s+ou\s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_name(name: Column) -> Column:
    """Whitespace runs to one space, trimmed, lower case. Accents stay."""
    return F.lower(F.trim(F.regexp_replace(name, ANY_WHITESPACE, " ")))


def strip(text: Column) -> Column:
    """Remove every kind of whitespace at both ends (plain ``trim`` removes spaces only)."""
    return F.trim(text, F.lit(WHITESPACE_CHARACTERS))


def format_brl(value: Column) -> Column:
    """1234.5 -> ``R$ 1.234,50``."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(value.cast("double"), 2), ",.", ".,"))


def ellipsis(text: Column, width: int) -> Column:
    """Shorten texts longer than ``width`` so that they end in three dots."""
    return F.when(
        F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))
    ).otherwise(text)


def _like_pattern(fragment: str) -> str:
    """A LIKE pattern for texts that contain ``fragment``.

    In a fragment ``%`` and ``_`` are wildcards, and a backslash takes the character after it
    literally; one at the end stands for itself.
    """
    out, literal = "", False
    for c in fragment:
        if c == "\\" and not literal:
            literal = True
            continue
        out += "\\" + c if literal and c in "%_\\" else c
        literal = False
    return "%" + out + ("\\\\" if literal else "") + "%"


def contains_pattern(text: Column, fragment: str) -> Column:
    """Case-insensitive search for a user's ``fragment``; see ``_like_pattern`` for its special characters."""
    return F.like(F.lower(text), F.lower(F.lit(_like_pattern(fragment))))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def split_alternatives(name: Column) -> Column:
    """``Picanha OU Alcatra`` -> two names; a name without the word stays as it is."""
    parts = let(
        F.split(name, ALTERNATIVE_WORD, -1),
        lambda parts: F.when(
            F.size(parts) > 1, F.filter(F.transform(parts, strip), lambda p: p != "")
        ),
    )
    # the plain search spares most names the pattern
    return F.coalesce(F.when(F.contains(F.lower(name), F.lit("ou")), parts), F.array(name))
