"""Language labels as written -> one of the four languages, or none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of the languages' labels in lower case, '_' as '-'.
LABELS = {
    "en": ("en", "eng", "english", "en-gb", "en-us", "en-mv"),
    "dv": ("dv", "div", "dhivehi", "divehi", "dv-mv", "dv-thaa", "maldivian", "thaana", "ދިވެހި"),
    "dv-Latn": ("dv-latn", "div-latn", "dhivehi-latin", "dv-latin", "latin-dhivehi", "dv-mv-latn"),
    "ar": ("ar", "ara", "arabic", "ar-sa", "العربية"),
}
LANGUAGES = tuple(LABELS)


def language_label(c: Column) -> Column:
    """The language a label means; null for missing, unknown and undetermined ones."""
    x = F.regexp_replace(F.lower(F.trim(c)), r"[_\s]+", "-")
    out = F.lit(None).cast("string")
    for lang, spellings in LABELS.items():
        out = F.when(x.isin(*spellings), lang).otherwise(out)
    return out
