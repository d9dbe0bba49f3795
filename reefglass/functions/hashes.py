"""Content-addressed keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reefglass.functions import lang

#: Sources whose records are never grouped as reposts.
NEVER_GROUPED = ("gazette", "archive")


def content_hash(*cols: Column) -> Column:
    return F.sha2(F.concat_ws("", *[F.coalesce(c, F.lit("")) for c in cols]), 256)


def repost_key(source: Column, seller: Column, title: Column, price: Column) -> Column:
    """Hash of source, seller, normal form of the title and price; '' for sources that are never grouped."""
    form = lang.title_key(title)
    form = F.when(form == "", lang.normalize_text(title)).otherwise(form)
    amount = F.coalesce(F.format_string("%.2f", price.cast("double")), F.lit(""))
    amount = F.when(price.isNull(), "").otherwise(amount)
    return F.when(source.isin(*NEVER_GROUPED), "").otherwise(F.sha2(F.concat_ws("|", source, F.lower(F.trim(F.coalesce(seller, F.lit("")))), form, amount), 256))


def path_key(path: Column) -> Column:
    return F.sha2(F.array_join(path, "\x1f"), 256)


def text_key(c: Column) -> Column:
    """Hash of a text without regard to blanks."""
    return F.sha2(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), 256)


def session_key(day: Column, who: Column, salt: str) -> Column:
    """Identity of a visitor that changes every day."""
    return F.substring(F.sha2(F.concat_ws("|", day.cast("string"), who.cast("string"), F.lit(salt)), 256), 1, 32)


def cache_key(provider: str, model: str, prompt: str, payload: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(provider), F.lit(model), F.lit(prompt), F.sha2(payload, 256)), 256)
