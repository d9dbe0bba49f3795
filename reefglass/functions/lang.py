"""Script detection, normalisation and transliteration as Column expressions."""

from __future__ import annotations

import functools
import itertools
import math
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin keyboard key -> Thaana letter or sign, in code point order from U+0780.
KEYS = "hSnrbLkwvmfdtlgNsDzTypjcXHKJRCMYZBGQFVaAiIuUeEoOq"
THAANA = "".join(chr(0x780 + i) for i in range(len(KEYS)))
#: The Latin readings of U+0780 .. U+07B0, the primary one first; the sukun has none.
READINGS = {
    "ހ": ("h",), "ށ": ("sh", "s"), "ނ": ("n",), "ރ": ("r",), "ބ": ("b",), "ޅ": ("lh", "l"),
    "ކ": ("k",), "އ": (), "ވ": ("v", "w"), "މ": ("m",), "ފ": ("f",), "ދ": ("dh", "d"),
    "ތ": ("th", "t"), "ލ": ("l",), "ގ": ("g",), "ޏ": ("gn", "n"), "ސ": ("s",), "ޑ": ("d", "dh"),
    "ޒ": ("z",), "ޓ": ("t", "th"), "ޔ": ("y",), "ޕ": ("p",), "ޖ": ("j",), "ޗ": ("ch", "c"),
    "ޘ": ("t",), "ޙ": ("h",), "ޚ": ("kh", "h"), "ޛ": ("z", "dh"), "ޜ": ("z",), "ޝ": ("sh", "s"),
    "ޞ": ("s",), "ޟ": ("z", "d"), "ޠ": ("t",), "ޡ": ("z",), "ޢ": ("a",), "ޣ": ("gh", "g"),
    "ޤ": ("q", "k"), "ޥ": ("w", "v"), "ަ": ("a",), "ާ": ("aa", "a"), "ި": ("i",), "ީ": ("ee", "i"),
    "ު": ("u",), "ޫ": ("oo", "u"), "ެ": ("e",), "ޭ": ("ey", "e"), "ޮ": ("o",), "ޯ": ("oa", "o"),
    "ް": (),
}
#: Words and letter pairs that mark Dhivehi written in Latin letters.
MARKER_WORDS = (
    "beynun beynunvaa vikkan vikkanee vikkaa gannan hoadhan kuyyah hunna huri hifun dhinun dhookuran libey libeyne nulibey "
    "firihen anhen kudhin bahattan bahattaden baithibbaa thibbaa vazeefaa vazeefa masakkaiy mauloomaathu dhennevun "
    "laari rufiyaa mihaaru miadhu adhi noon ge ah aa akah eh ekey thakah kah"
).split()
DIGRAPHS = ("aa", "ee", "oo", "dh", "th", "lh", "gn", "sh", "ey", "oa")
_ZERO_WIDTH = "[​‌‍⁠﻿]"
FILI = "[ަ-ް]"


def literal_map(table: dict[str, str]) -> Column:
    """A map as one literal, folded before a row is read; a map of many literals is slow to plan."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in table.items())), F.lit("\x02"), F.lit("\x01"))


@functools.cache
def _composed() -> dict[str, str]:
    """Latin letter and combining mark -> the composed letter, by the rule of Unicode's canonical composition."""
    letters = [chr(x) for x in (*range(0x41, 0x5B), *range(0x61, 0x7B))]
    pairs = (a + chr(m) for a in letters for m in range(0x300, 0x370))
    return {p: n for p in pairs if len(n := unicodedata.normalize("NFC", p)) == 1}


def compose(c: Column) -> Column:
    """Letters and the combining mark behind them as one letter (NFC of Latin letters with one mark); other text as it is."""
    table = literal_map(_composed())
    pieces = F.regexp_extract_all(c, F.lit("(?s).[\u0300-\u036f]?"), 0)
    whole = F.array_join(F.transform(pieces, lambda p: F.when(F.length(p) == 2, F.coalesce(F.try_element_at(table, p), p)).otherwise(p)), "")
    return F.when(c.rlike("[\u0300-\u036f]"), whole).otherwise(c)


def normalize_text(c: Column) -> Column:
    """Composed, no zero-width characters, ASCII digits, lower case, single blanks, trimmed; '' for null."""
    c = F.regexp_replace(compose(F.coalesce(c, F.lit(""))), _ZERO_WIDTH, "")
    c = F.lower(F.translate(c, "٠١٢٣٤٥٦٧٨٩", "0123456789"))
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def strip_fili(c: Column) -> Column:
    """Consonant skeleton: without vowel signs."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), FILI, "")


def contains_thaana(c: Column) -> Column:
    return F.coalesce(c.rlike("[ހ-޿]"), F.lit(False))


#: Named entities of HTML; the ampersand comes last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def strip_html(c: Column) -> Column:
    """Text without tags, named entities decoded, blanks collapsed."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", " ")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Words (letters, digits and signs) of a normalised text."""
    return F.filter(F.split(normalize_text(c), r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != "")


def raw_tokens(c: Column) -> Column:
    """The words of ``tokens`` in the case they were typed in."""
    c = F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), _ZERO_WIDTH, ""), "٠١٢٣٤٥٦٧٨٩", "0123456789")
    return F.filter(F.split(c, r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != "")


def words_of(text: str) -> list[str]:
    """``tokens`` of a Python string."""
    import regex

    return [w.lower() for w in regex.split(r"[^\p{L}\p{M}\p{N}]+", regex.sub(_ZERO_WIDTH, "", text)) if w]


def decode_keys(c: Column) -> Column:
    """Text typed on the Latin layout in Thaana; null if a character has no key or none was mapped."""
    ok = c.rlike(rf"^[{KEYS}\s0-9\-/.,()]+$") & c.rlike(f"[{KEYS}]")
    return F.when(ok, F.translate(c, KEYS, THAANA))


def encode_keys(c: Column) -> Column:
    return F.translate(c, THAANA, KEYS)


def looks_like_keys(c: Column) -> Column:
    """True if the decoded text is well formed: every consonant carries exactly one sign."""
    return F.coalesce(decode_keys(c).rlike(r"^(?:[ހ-ޥ][ަ-ް]|[\s0-9\-/.,()])+$"), F.lit(False))


def phonetic_score(c: Column) -> Column:
    """1 for a marker word, else twice the letter pairs found over the length, at most 1."""
    hits = F.lit(0)
    for d in DIGRAPHS:
        hits = hits + (F.length(c) - F.length(F.replace(c, F.lit(d), F.lit("")))) / 2
    return F.when(c.isin(*MARKER_WORDS), F.lit(1.0)).otherwise(F.least(F.lit(1.0), hits * 2.0 / F.greatest(F.length(c), F.lit(1))))


def detect_script(c: Column) -> Column:
    """dv, en, keys or dv-Latn for one token."""
    t = normalize_text(c)
    return (
        F.when(t == "", "en").when(contains_thaana(t), "dv").when(t.rlike("^[0-9]+$"), "en").when(looks_like_keys(t), "keys")
        .when(phonetic_score(t) >= 0.5, "dv-Latn").otherwise("en")
    )


def _count_of(values: Column, x: str) -> Column:
    return F.size(F.filter(values, lambda t: t == x))


def query_script(c: Column) -> Column:
    """Dominant label of a query: any Thaana wins, else the commonest label, not English on ties."""
    labels = F.transform(tokens(c), detect_script)
    n = {x: _count_of(labels, x) for x in ("dv", "keys", "dv-Latn", "en")}
    return F.when(n["dv"] > 0, "dv").when((n["keys"] > 0) & (n["keys"] >= n["dv-Latn"]) & (n["keys"] >= n["en"]), "keys").when((n["dv-Latn"] > 0) & (n["dv-Latn"] >= n["en"]), "dv-Latn").otherwise("en")


def translit_dv_to_latin(c: Column) -> Column:
    """Primary Latin reading of every Thaana letter, other characters as they are."""
    table = literal_map({ch: r[0] if r else "" for ch, r in READINGS.items()})
    return F.array_join(F.transform(F.split(F.coalesce(c, F.lit("")), ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")


def route_bilingual(*cols: Column) -> Column:
    """struct(en, dv): first non-empty Latin-script value and first non-empty Thaana value."""
    filled = F.filter(F.array(*[F.coalesce(c, F.lit("")) for c in cols]), lambda x: F.trim(x) != "")
    en = F.try_element_at(F.filter(filled, lambda x: ~contains_thaana(x)), F.lit(1))
    dv = F.try_element_at(F.filter(filled, contains_thaana), F.lit(1))
    return F.struct(F.coalesce(en, F.lit("")).alias("en"), F.coalesce(dv, F.lit("")).alias("dv"))


def canonical_slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9ހ-޿]+", "_"), "^_+|_+$", "")


def slugify_key(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 64)


def title_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9ހ-޿]+", " "))


def summarize(c: Column, limit: int = 240) -> Column:
    """At most limit characters, cut at the last blank, with '...' if cut."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    head = F.substring(t, 1, limit)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit("...")))


def split_multivalue(c: Column) -> Column:
    """Values between commas, slashes, bars and the words or, and."""
    parts = F.split(F.coalesce(c, F.lit("")), r"(?i)\s*(?:,|/|\||\bor\b|\band\b)\s*")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def normalize_for_match(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))


def trigrams(c: Column) -> Column:
    """Distinct three-character windows of the words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams of two texts, 0 if there are none."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both), F.lit(0.0))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared distinct words over the smaller number of distinct words."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.least(F.size(x), F.size(y))), F.lit(0.0))


#: Labels of announcement types in English -> their Dhivehi name.
ANNOUNCEMENT_TYPES = {
    "Job Opportunity": "ވަޒީފާގެ ފުރުޞަތު",
    "For Rent": "ކުއްޔަށް ދިނުން",
    "Letting": "ކުއްޔަށް ދިނުން",
    "Need to Rent": "ކުއްޔަށް ހިފުން",
    "Wanted to Rent": "ކުއްޔަށް ހިފުން",
    "Public Information": "ޢާންމު މަޢުލޫމާތު",
    "Auction": "ނީލަން",
    "Tender": "ބީލަން",
    "Bids": "ބީލަން",
    "Work": "މަސައްކަތް",
    "Works": "މަސައްކަތް",
    "Items wanted": "ގަންނަން ބޭނުންވާ ތަކެތި",
    "Items to buy": "ގަންނަން ބޭނުންވާ ތަކެތި",
    "Training": "ތަމްރީނު",
}


def announcement_type(c: Column) -> Column:
    """The Dhivehi name of an announcement type, other names trimmed."""
    name = F.trim(F.coalesce(c, F.lit("")))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ANNOUNCEMENT_TYPES.items() for x in kv]), name), name)


def vocabulary_label(c: Column, labels: dict[str, str]) -> Column:
    """The label of a value's slug, the value itself without one."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(table, canonical_slug(c)), c)


def clean_text(c: Column, limit: int = 20_000) -> Column:
    """Single blanks, at most one empty line, at most ``limit`` characters (the width of the stored column)."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t]+", " ")
    return F.substring(F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n")), 1, limit)


def normalize_values(c: Column, aliases: dict[str, str], longest: int = 128) -> Column:
    """Values of a multi-value text: split, aliases replaced, overlong ones dropped, distinct."""
    table = F.create_map(*[F.lit(x) for kv in (aliases or {"": ""}).items() for x in kv])
    parts = F.transform(split_multivalue(c), lambda p: F.coalesce(F.try_element_at(table, p), p))
    return F.array_distinct(F.filter(parts, lambda p: F.length(p) <= longest))


def numbered_lines(c: Column, n: int) -> Column:
    """The n texts of '1. first' lines in order; null if one is missing; of equal numbers the last counts."""
    t = F.coalesce(c, F.lit(""))
    p = r"(?m)^\s*(\d+)[.)]\s*(.+?)\s*$"
    pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(p), 1).alias("i"), F.regexp_extract_all(t, F.lit(p), 2).alias("v"))
    picked = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.try_element_at(F.filter(pairs, lambda x: x["i"].cast("int") == k), F.lit(-1))["v"])
    return F.when(~F.exists(picked, lambda v: v.isNull()), picked)


def is_clean_translation(c: Column, target: str) -> Column:
    """A translation into en has no Thaana; one into dv has some and no Latin words of four letters and more."""
    return ~contains_thaana(c) if target == "en" else contains_thaana(c) & ~c.rlike("[A-Za-z]{4,}")


#: Where a text may be cut, the best place first.
BOUNDARIES = ("\n", ".", "،", ",", "۔", " ")


def boundary(c: Column, size: int) -> Column:
    """Where a piece of at most ``size`` characters ends: behind the last of the best separator found past its half, else at ``size``."""
    head = F.substring(c, 1, size)
    end = F.lit(size)
    for sep in reversed(BOUNDARIES):
        back = F.instr(F.reverse(head), sep)  # 1 for the last character
        at = F.length(head) - back  # counted from 0
        end = F.when((back > 0) & (at > size * 0.5), at + 1).otherwise(end)
    return F.when(F.length(c) <= size, F.length(c)).otherwise(end)


def chunks(c: Column, size: int = 3500) -> Column:
    """Pieces of at most ``size`` characters, cut at ``boundary``; nothing is lost. '' gives none."""
    text = F.coalesce(c, F.lit(""))
    start = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        end = boundary(rest, size)
        parts = F.when(rest == "", acc["parts"]).otherwise(F.concat(acc["parts"], F.array(F.substring(rest, F.lit(1), end))))
        return F.struct(F.substring(rest, end + 1, F.length(rest)).alias("rest"), parts.alias("parts"))

    rounds = F.sequence(F.lit(1), F.ceil(F.length(text) / (size * 0.5)).cast("int") + 1)
    return F.aggregate(rounds, start, step, lambda acc: acc["parts"])


MAX_VARIANTS, MAX_TOKEN = 24, 24


def thaana_variants(token: str) -> list[str]:
    """Thaana spellings of a word in Latin letters, all of them if they are at most 24, otherwise that of the first letters only.

    The longest readings go first; a word with a letter that is no reading has none.
    """
    word = (token or "").lower()
    if not word or len(word) > MAX_TOKEN:
        return []
    letters: dict[str, list[str]] = {}
    for ch, readings in READINGS.items():
        for r in readings:
            letters.setdefault(r, []).append(ch)
    choices, i = [], 0
    while i < len(word):
        n = next((n for n in (2, 1) if word[i : i + n] in letters and i + n <= len(word)), 0)
        if not n:
            return []
        choices.append(letters[word[i : i + n]])
        i += n
    return _spellings(choices)


def latin_variants(text: str) -> list[str]:
    """Latin spellings of a Thaana text, all of them if they are at most 24, otherwise the primary one only."""
    return _spellings([list(READINGS[ch]) or [""] if ch in READINGS else [ch] for ch in text]) if text else []


def _spellings(choices: list[list[str]]) -> list[str]:
    if math.prod(len(c) for c in choices) > MAX_VARIANTS:
        choices = [c[:1] for c in choices]
    return ["".join(c) for c in itertools.product(*choices)]
