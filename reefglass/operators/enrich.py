"""Classification priors, gates and grounding of enriched records."""

from __future__ import annotations

import json
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefglass import config
from reefglass.functions import lang, scoring

DOC_TYPES = ("news", "job", "property", "shopping", "tender")
#: Kind of document by the kind of notice, after ``lang.canonical_slug``.
NOTICE_KINDS = {"job": "job", "job_opportunity": "job", "for_rent": "property", "letting": "property", "need_to_rent": "property", "wanted_to_rent": "property"}


def prior(source: Column, notice_kind: Column) -> Column:
    """What a record is before a model has seen it; news unless a notice's kind says otherwise."""
    slug = lang.canonical_slug(notice_kind)
    out = F.lit("news")
    for k, v in NOTICE_KINDS.items():
        out = F.when(slug == k, v).otherwise(out)
    return F.when(source == "gazette", out).otherwise("news")


def gate(before: Column, model: Column, confidence: Column, floor: float = config.CONFIDENCE_FLOOR) -> Column:
    """struct(doc_type, overridden): the model's type only if it is known, different and sure enough."""
    over = model.isin(*DOC_TYPES) & (model != before) & (confidence >= floor)
    return F.struct(F.when(over, model).otherwise(before).alias("doc_type"), F.coalesce(over, F.lit(False)).alias("overridden"))


def outcomes(records: DataFrame) -> DataFrame:
    """Per status: records, attempts and mean confidence."""
    return records.groupBy("status").agg(F.count(F.lit(1)).alias("records"), F.sum("attempts").cast("long").alias("attempts"), F.round(F.avg("doc_type_confidence"), 6).alias("confidence"))


def merge_answered(base: Column, extra: Column, owned: tuple[str, ...] = ()) -> Column:
    """base (map) with the answered entries of extra: not null or empty, and not owned by the scraper."""
    told = F.map_filter(extra, lambda k, v: v.isNotNull() & (v != "") & ~k.isin(*owned or ("",)))
    return F.map_from_entries(F.concat(F.map_entries(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(told), k))), F.map_entries(told)))


def card(docs: DataFrame) -> Column:
    """The record's card as JSON: title, place, price and picture."""
    return F.to_json(F.struct(
        F.coalesce(F.nullif(F.trim("title_en"), F.lit("")), F.col("title_dv")).alias("title"), F.col("island").alias("place"),
        scoring.rent_display(F.col("price"), F.col("currency"), F.lit("month")).alias("price"), F.get("thumbnails", F.lit(0)).alias("picture"),
    ))


def assembled_input(docs: DataFrame, limit: int = 3500) -> DataFrame:
    """(id, text, chars, thaana, cut): what a model is given of a record: its titles and summaries, one a line, no line twice, the first ``limit`` characters.

    cut tells that the record has more; nothing is computed from the input but the model's answer.
    """
    lines = F.array_distinct(F.filter(F.array(*[F.trim(F.coalesce(c, F.lit(""))) for c in ("title_en", "title_dv", "summary_en", "summary_dv")]), lambda x: x != ""))
    whole = F.array_join(lines, "\n")
    rows = docs.select("id", whole.alias("whole"), F.substring(whole, 1, limit).alias("text"))
    return rows.select("id", "text", F.length("text").alias("chars"), lang.contains_thaana(F.col("text")).alias("thaana"), (F.length("whole") > limit).alias("cut"))


def scraped_wins(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """rows plus, per field f, its value (what was scraped, else what the model says) and needs_review, with the names of the fields on which both differ.

    rows has the columns s_f (scraped) and m_f (model); answers are compared by words, without case and marks.
    """
    said = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    values = [F.when(said(F.col(f"s_{f}")), F.col(f"s_{f}")).otherwise(F.when(said(F.col(f"m_{f}")), F.col(f"m_{f}"))).alias(f) for f in fields]
    clash = F.filter(F.array(*[F.when(said(F.col(f"s_{f}")) & said(F.col(f"m_{f}")) & (lang.normalize_for_match(F.col(f"s_{f}")) != lang.normalize_for_match(F.col(f"m_{f}"))), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return rows.select("*", *values, F.array_join(clash, ",").alias("conflicts"), (F.size(clash) > 0).alias("needs_review"))


def cards(docs: DataFrame, as_of: Column) -> Column:
    """The card of a record by its kind, as JSON without empty entries: jobs with deadline, listings with price and pictures, news with date and summary."""
    from reefglass.functions import dates

    def text(*cols: str) -> Column:
        return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])

    title, place = text("title_en", "title_dv").alias("title"), text("island").alias("place")
    price = F.when(F.col("price").isNotNull(), scoring.rent_display(F.col("price"), F.col("currency"), F.lit("month"))).alias("price")
    day = lambda c, n: F.date_format(c, "yyyy-MM-dd").alias(n)
    pictures = F.nullif(F.coalesce(F.size("thumbnails"), F.lit(0)), F.lit(0)).alias("pictures")
    by_kind = {
        "job": (title, place, day("expires_at", "deadline"), dates.deadline_state(F.col("expires_at"), as_of).alias("state")),
        "property": (title, place, price, pictures), "shopping": (title, text("category_leaf").alias("category"), price, pictures),
    }
    out = F.to_json(F.struct(title, text("summary_en", "summary_dv").alias("summary"), day("published_at", "date")))
    for kind, entries in by_kind.items():
        out = F.when(F.col("doc_type") == kind, F.to_json(F.struct(*entries))).otherwise(out)
    return out


def ground_json(value: str | None, source: str, numbers: set[str]) -> tuple[str, list[str]]:
    """Keeps the leaves of a JSON value that its source supports; returns it with the paths dropped.

    Numbers must be among the numbers of the source in plain or grouped digits, strings must be in it
    or share 0.85 of their words with it; strings under three characters and truth values pass.
    """
    dropped: list[str] = []
    text = " ".join(_norm(source).split())
    have = set(text.split())

    def walk(x, path):
        if isinstance(x, dict):
            kept = {k: walk(v, f"{path}.{k}" if path else k) for k, v in x.items()}
            return {k: v for k, v in kept.items() if v is not None}
        if isinstance(x, list):
            return [y for y in (walk(v, f"{path}[{i}]") for i, v in enumerate(x)) if y is not None and y != {}]
        if isinstance(x, bool) or x is None:
            return x
        if isinstance(x, int | float):
            forms = {f"{x:g}", f"{x:,.0f}", f"{x:.2f}", f"{x:,.2f}"}
            if forms & numbers:
                return x
        else:
            v = _norm(str(x))
            words = set(v.split())
            if len(v) < 3 or v in text or (words and len(words & have) / min(len(words), max(1, len(have))) >= 0.85):
                return x
        dropped.append(path)
        return None

    try:
        parsed = json.loads(value or "{}")
    except ValueError:
        return "{}", ["$"]
    return json.dumps(walk(parsed, ""), ensure_ascii=False, sort_keys=True), dropped


def _norm(s: str) -> str:
    return " ".join("".join(c if c.isalnum() or "ަ" <= c <= "ް" else " " for c in s.lower()).split())


def ground(rows: DataFrame) -> DataFrame:
    """rows (id, value, source) -> (id, grounded, dropped); a walk over free JSON has no column form."""
    import re

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for i, v, s in zip(pdf["id"], pdf["value"], pdf["source"], strict=True):
                s = s or ""
                g, d = ground_json(v, s, set(re.findall(r"\d[\d,]*(?:\.\d+)?", s)))
                out.append((i, g, d))
            yield pd.DataFrame(out, columns=["id", "grounded", "dropped"])

    return rows.select("id", "value", "source").mapInPandas(run, "id long, grounded string, dropped array<string>")


def skeleton_gate(read: str, repaired: str) -> str:
    """The repaired text where its consonant skeletons agree with those that were read, the read words elsewhere."""
    a, b = read.split(), repaired.split()
    bone = lambda w: "".join(c for c in w if not "ަ" <= c <= "ް")
    out: list[str] = []
    for op, i1, i2, j1, j2 in SequenceMatcher(None, [bone(w) for w in a], [bone(w) for w in b], autojunk=False).get_opcodes():
        out += b[j1:j2] if op == "equal" else a[i1:i2]
    return " ".join(out)
