"""Column-level text helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zero-width characters that split words for the eye of a program only.
ZERO_WIDTH = "[​‌‍⁠﻿­]"
#: Arabic-Indic and extended Arabic-Indic digits and the ASCII digits they stand for.
OTHER_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "01234567890123456789"

#: Entries that only stand for a missing value, compared after ``plain``.
FILLERS = (
    "", "-", "--", "---", ".", "..", "...", "…", "?", "??", "???", "؟", "؟؟", "؟؟؟", "/", "*", "_", "0000",
    "n/a", "na", "n.a.", "n.a", "none", "null", "nil", "nan", "unknown", "tba", "tbd", "tbc", "any", "other",
    "not given", "not specified", "not available", "not applicable", "ask seller", "see photo", "see photos",
    "see pics", "see picture", "as per drawing", "varies", "xx", "xxx", "xxxx", "x", "test", "asdf", "no phone",
    "no description", "description coming soon", "coming soon", "ނެތް", "ނޭނގެ", "undefined", "blank", "empty",
)


def plain(c: Column) -> Column:
    """Lower case, ASCII digits, no zero-width characters, single blanks, trimmed; null stays null."""
    c = F.translate(F.lower(c), OTHER_DIGITS, ASCII_DIGITS)
    c = F.regexp_replace(c, ZERO_WIDTH, "")
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def is_filler(c: Column) -> Column:
    """True for null, blank and filler values, and for values without a letter or digit."""
    p = plain(c)
    return F.coalesce(p.isin(*FILLERS) | ~p.rlike(r"[\p{L}\p{N}]"), F.lit(True))
