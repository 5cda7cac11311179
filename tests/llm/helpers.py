"""Small tables with everything that may go wrong, and plain Python versions of the operators."""

import re

SCHEMA = "doc_id long, text string, lang string, id long, tag string, words string, t int"
LONG = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows():
    base = " ".join(f"tok{i}" for i in range(40))
    texts = [
        (1, base),
        (2, base),  # a copy
        (3, base.replace("tok7 ", "other ")),  # a near copy
        (4, None),
        (5, ""),
        (6, "   \n\t "),
        (7, "one"),
        (8, f"Start here. {PASSAGE} and this is the end of eight"),
        (9, f"Another beginning\n{PASSAGE}\nwith another end, of nine"),
        (10, LONG),
        (11, "É ümlaut 日本語 a b \x1c c ☃ 🎉 " * 3),
        (None, base),
        (None, None),
        (12, "repeated row of some words"),
        (12, "repeated row of some words"),
        (13, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a"),
        (14, "All rights reserved. Released under the MIT License.\nCC BY-NC 4.0; GNU General Public License, version 3"),
        (15, "### $$$ *** &&& %%% junk! " * 20),
    ]
    return [(i, t, None if k % 2 else "en", k, None, "words", None) for k, (i, t) in enumerate(texts)]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate(CAPITALS)
