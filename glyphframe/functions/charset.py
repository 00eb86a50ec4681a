"""The recognition character set and label columns.

Strings are sequences of code points after NFC normalisation.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 100 characters of the recognizer in class order; class 0 is the blank.
TAMIL_VOWELS = "அஆஇஈஉஊஎஏஐஒஓஔ"
TAMIL_AYTHAM = "ஃ"
TAMIL_CONSONANTS = "கஙசஞடணதநபமயரலவழளறன"
TAMIL_GRANTHA = "ஜஶஷஸஹ"
TAMIL_SIGNS = "ாிீுூெேைொோௌ்ௗ"
TAMIL_DIGITS = "௦௧௨௩௪௫௬௭௮௯"
TAMIL_SYMBOLS = "ௐ௰௱௲௳௴௵௶௷௸௹௺"
ASCII_DIGITS = "0123456789"
PUNCTUATION = ".,;:!?'\"-()[]/%&*+="
CHARSET = (
    TAMIL_VOWELS + TAMIL_AYTHAM + TAMIL_CONSONANTS + TAMIL_GRANTHA + TAMIL_SIGNS + TAMIL_DIGITS + TAMIL_SYMBOLS
    + ASCII_DIGITS + PUNCTUATION
)
BLANK = 0
#: A set for tests and oracles on ASCII text.
ASCII_LETTERS = "abcdefghijklmnopqrstuvwxyz"

# Characters that labels fold. Joiners, byte-order mark and no-break space vanish.
VANISH = "‌‍﻿ "
FOLD_FROM, FOLD_TO = "‘’“”–—−", "''\"\"---"


def _nfc(label: Column) -> Column:
    @F.pandas_udf("string")
    def composed(labels: pd.Series) -> pd.Series:
        return labels.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))

    return composed(label)


@lru_cache(maxsize=1)
def _nfc_classes() -> tuple[str, str]:
    """Characters that NFC changes by themselves or may join to the one before; and the other combining marks."""
    joins = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # Hangul joins by rule
    alone, marks = set(), []
    for point in (*range(0xD800), *range(0xE000, 0x110000)):
        c = chr(point)
        parts = unicodedata.decomposition(c)
        if unicodedata.combining(c):
            marks.append(point)
        if parts and parts[0] != "<":
            joins.add(int(parts.split()[-1], 16))
            if unicodedata.normalize("NFC", c) != c:
                alone.add(point)
    first = {*alone, *(j for j in joins if j >= 0x300)}
    return "".join(map(chr, sorted(first))), "".join(chr(m) for m in marks if m not in first)


def nfc_may_change(label: Column) -> Column:
    """False only if NFC leaves the text as it is: no character of the first class above, and no two marks in a row, which
    may be out of order. Characters below U+0300 are NFC in any order."""
    first, marks = _nfc_classes()
    told = F.translate(label, first + marks, "\x01" * len(first) + "\x02" * len(marks))
    return label.rlike("[^\\x00-\\x{2FF}]") & (told.contains("\x01") | told.rlike("[\x01\x02]{2}"))


def normalize_label(label: Column, composed: bool = False) -> Column:
    """NFC, then the folds above, then white space stripped at both ends.

    Spark has no NFC. Texts that it may change go through an Arrow function, for others the function gets null: characters
    below U+0300 are NFC in any order, and of the rest ``nfc_may_change`` finds what may change. ``composed`` promises NFC
    input and stays in the JVM altogether. Null stays null.
    """
    changes = nfc_may_change(label)
    text = label if composed else F.when(changes, _nfc(F.when(changes, label))).otherwise(label)
    text = F.translate(text, FOLD_FROM + VANISH, FOLD_TO)
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _class_of(charset: str) -> str:
    return "".join(f"\\x{{{ord(c):X}}}" for c in charset)


def is_encodable(label: Column, charset: str = CHARSET) -> Column:
    """Not empty, and every code point in the set (P2). Null is not encodable."""
    return F.coalesce(label.rlike(f"^[{_class_of(charset)}]+$") & ~label.contains("\n"), F.lit(False))


def encode_label(label: Column, charset: str = CHARSET) -> Column:
    """Class ids of the code points, from 1 (P3); 0 for a character outside the set."""
    return F.transform(F.filter(F.split(label, ""), lambda c: c != ""), lambda c: F.instr(F.lit(charset), c))


def decode_ids(ids: Column, charset: str = CHARSET) -> Column:
    """The text of class ids (P3); the blank and unknown ids vanish."""
    known = F.filter(ids, lambda i: (i >= 1) & (i <= len(charset)))
    return F.array_join(F.transform(known, lambda i: F.substring(F.lit(charset), i.cast("int"), F.lit(1))), "")


def script_words(df: DataFrame, text: str, pattern: str = "[\\x{0B80}-\\x{0BFF}]+", least: int = 1, most: int = 40, charset: str = CHARSET) -> DataFrame:
    """One row for each run of the script in the normalised text, within the length bounds and encodable (P5)."""
    words = df.select(F.explode(F.regexp_extract_all(normalize_label(F.col(text)), F.lit(pattern), F.lit(0))).alias("word"))
    return words.where(F.length("word").between(least, most) & is_encodable(F.col("word"), charset))


# The extent of each kind of wiki mark-up, in the order of removal, and what it leaves. Word lists that were
# made from dumps stand for these extents, so another extent would give other words.
WIKI_MARKUP = (
    (r"(?s)\{\{.*?\}\}", " "),
    (r"(?s)\{\|.*?\|\}", " "),
    (r"(?s)<ref[^>]*>.*?</ref>", " "),
    (r"<[^>]+>", " "),
    (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1"),
    (r"\[https?://[^\]]*\]", " "),
)


def strip_wiki_markup(text: Column) -> Column:
    """Templates, tables, references, tags, links and external links out, in this order."""
    for pattern, left in WIKI_MARKUP:
        text = F.regexp_replace(text, pattern, left)
    return text


def unusual_label(label: Column) -> Column:
    """Holds a space or a Latin letter, or is digits and ``.,-`` throughout."""
    digits = _class_of(TAMIL_DIGITS)
    return label.contains(" ") | label.rlike("[A-Za-z]") | label.rlike(f"^[0-9{digits}.,\\-]+$")


def unsupported_chars(df: DataFrame, label: str, top: int = 20, charset: str = CHARSET) -> DataFrame:
    """Code points outside the set in labels that are not encodable: char, code (U+%04X), n; the ``top`` of them.

    Ties go to the smaller code point.
    """
    bad = df.where(~is_encodable(F.col(label), charset)).select(F.explode(F.split(label, "")).alias("char"))
    bad = bad.where((F.col("char") != "") & (F.instr(F.lit(charset), F.col("char")) == 0))
    counted = bad.groupBy("char").agg(F.count("*").alias("n"))
    code = F.conv(F.hex(F.encode("char", "UTF-32")), 16, 10).cast("long")
    return counted.select("char", F.format_string("U+%04X", code).alias("code"), "n").orderBy(F.desc("n"), code).limit(top)
