"""Scores, pay arithmetic and other numbers, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from reefglass import config
from reefglass.functions import lang


def age_days(ts: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / 86400e6


def freshness(ts: Column, doc_type: Column, as_of: Column, r: config.Ranking) -> Column:
    """Half-life decay by age; 0 without a date. Dates in the future count above 1, as their age is negative."""
    half = F.lit(r.other_half_life)
    for t, days in r.half_life.items():
        half = F.when(doc_type == t, F.lit(days)).otherwise(half)
    return F.coalesce(F.exp(-math.log(2.0) * age_days(ts, as_of) / half), F.lit(0.0))


def stuffing_penalty(title: Column) -> Column:
    """Share of repeated words in titles of four words and more, if over 0.15."""
    toks = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("[a-z0-9ހ-޿]+"), 0)
    ratio = 1 - F.size(F.array_distinct(toks)) / F.size(toks)
    return F.when((F.size(toks) >= 4) & (ratio > 0.15), ratio).otherwise(F.lit(0.0))


def notice_quality(body_length: Column, translated: Column, has_office: Column, attachments: Column, transcribed: Column) -> Column:
    """0.3 or 0.1 for the body, 0.2 for a translation, 0.15 for an office, 0.2 and 0.15 for attachments; 0.8 of it if transcribed."""
    s = F.when(body_length >= 500, 0.3).otherwise(0.1) + F.when(translated, 0.2).otherwise(0.0) + F.when(has_office, 0.15).otherwise(0.0)
    s = s + F.when(attachments > 0, 0.2).otherwise(0.0) + F.when(attachments > 0, 0.15).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), s * F.when(transcribed, 0.8).otherwise(1.0)), 3)


def char_error_rate(reference: Column, got: Column) -> Column:
    """Edit distance over the length of the reference, blanks removed; 1 for an empty reference."""
    r, g = F.regexp_replace(reference, r"\s+", ""), F.regexp_replace(got, r"\s+", "")
    return F.when(F.length(r) == 0, F.lit(1.0)).otherwise(F.levenshtein(r, g) / F.length(r))


def grounded(value: Column, source: Column) -> Column:
    """True if a string is in the source or shares 0.85 of its words; strings under three characters pass."""
    v, s = lang.normalize_for_match(value), lang.normalize_for_match(source)
    return (F.length(v) < 3) | s.contains(v) | (lang.token_overlap(F.split(v, " "), F.split(s, " ")) >= 0.85)


def number_forms(x: Column) -> Column:
    """The ways a number may be written: plain and with thousands marks."""
    whole = x == F.floor(x)
    plain = F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))
    grouped = F.when(whole, F.format_number(x, 0)).otherwise(F.format_number(x, 2))
    return F.array_distinct(F.array(plain, grouped))


def net_pay(basic: Column, period: Column, allowances: Column, pension: Column, rate: Column, completeness: Column, basic_max: Column, days: int = config.WORKING_DAYS) -> Column:
    """Monthly pay after pension with allowances (array of struct kind, amount, basis); null where no figure can be given."""
    paid = F.filter(allowances, lambda a: a["amount"].isNotNull())

    def monthly(a: Column) -> Column:
        return (
            F.when(a["basis"] == "fixed_monthly", a["amount"]).when(a["basis"] == "per_day", a["amount"] * days)
            .when(a["basis"] == "per_hour", a["amount"] * config.HOURS_PER_DAY * days).when(a["basis"] == "percent_of_basic", basic * a["amount"] / 100).otherwise(F.lit(0.0))
        )

    added = F.aggregate(paid, F.lit(0.0), lambda acc, a: acc + monthly(a))
    kinds = F.transform(paid, lambda a: a["kind"])
    bands = F.coalesce(basic_max, F.lit(0.0)) > 0
    several = bands & (F.size(kinds) != F.size(F.array_distinct(kinds)))
    owed = F.when(pension, basic * F.coalesce(F.nullif(rate, F.lit(0.0)), F.lit(config.PENSION_RATE))).otherwise(F.lit(0.0))
    nothing = (completeness == "basic_only") & (owed == 0) & (added == 0)
    return F.when(basic.isNotNull() & (period == "month") & ~several & ~nothing, basic - owed + added)


def money(x: Column, currency: Column) -> Column:
    return F.concat(currency, F.lit(" "), F.format_number(x, 0))


def salary_display(state: Column, basic: Column, top: Column, currency: Column, period: Column) -> Column:
    """Negotiable, Unlisted, or the amount or band per period."""
    cur = F.coalesce(F.nullif(currency, F.lit("")), F.lit("MVR"))
    band = F.concat(money(basic, cur), F.lit(" - "), F.format_number(top, 0), F.lit(" / "), period)
    one = F.concat(money(basic, cur), F.lit(" / "), period)
    return F.when(state == "negotiable", "Negotiable").when((state != "listed") | basic.isNull() | (basic == 0), "Unlisted").when(top > basic, band).otherwise(one)


def rent_display(price: Column, currency: Column, period: Column) -> Column:
    cur = F.coalesce(F.nullif(currency, F.lit("")), F.lit("MVR"))
    per = F.coalesce(F.nullif(period, F.lit("")), F.lit("month"))
    return F.when(price.isNull(), "Price on request").otherwise(F.concat(cur, F.lit(" "), F.format_number(price.cast("double"), 0), F.lit(" / "), per))


def capacity_display(kind: Column, rooms: Column, total: Column, beds: Column, guests: Column, shared: Column) -> Column:
    """What a rented space holds, in words."""
    s = F.when(shared, ", shared").otherwise("")
    n = lambda c: c.cast("string")
    return (
        F.when((kind == "room") & (rooms > 0) & (total > 0), F.concat(n(rooms), F.lit(" room of "), n(total), s))
        .when((kind == "room") & (rooms > 0), F.concat(n(rooms), F.lit(" room"), s)).when(kind == "room", F.concat(F.lit("Room"), s))
        .when((kind == "bed_space") & (beds > 0), F.concat(F.lit("Bed space, "), n(beds), F.lit(" available"), s)).when(kind == "bed_space", F.concat(F.lit("Bed space"), s))
        .when((kind == "guest_house") & (guests > 0), F.concat(F.lit("Guest house room, up to "), n(guests))).when(kind == "guest_house", "Guest house room")
        .when((kind == "whole_unit") & (total > 0), F.concat(F.lit("Whole unit, "), n(total), F.lit(" rooms")))
        .when(kind == "land", "Land").when(kind == "commercial", "Commercial space").otherwise("Whole unit")
    )


def normalized_entropy(n: Column, total: Column, kinds: Column) -> Column:
    """Aggregate: Shannon entropy of counts over log2 of their number, 0 for one kind; total and kinds are window or group values."""
    p = n / total
    return F.coalesce(F.try_divide(F.sum(F.when(n > 0, -p * F.log2(p)).otherwise(0.0)), F.log2(F.first(kinds))), F.lit(0.0))


def known_overlap(known: Column, found: Column) -> Column:
    """Share of the distinct known words that are among the found ones; 0 without known words."""
    k = F.array_distinct(known)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(k, found)).cast("double"), F.size(k)), F.lit(0.0))
