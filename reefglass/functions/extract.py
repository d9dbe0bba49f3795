"""Contacts, amounts, units, dates and identifiers found in text, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes of local phone numbers, addresses and amounts.
PHONE = r"(?<!\d)(?:\+?960[\s-]?)?([79]\d{6}|[36]\d{6})(?!\d)"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
URL = r"https?://[^\s<>\"')\]]+"
AMOUNT = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
#: How amounts are marked with their currency.
MARKED = (
    ("USD", rf"(?i)(?:USD|\$)\s*({AMOUNT})"), ("USD", rf"(?i)({AMOUNT})\s*(?:USD|dollars?)"), ("MVR", rf"(?i)(?:MVR|Rf\.?|ރުފިޔާ|ރ\.?)\s*({AMOUNT})"),
    ("MVR", rf"(?i)({AMOUNT})\s*(?:MVR|rufiyaa|ރުފިޔާ)"), ("MVR", rf"-/\s*({AMOUNT})"), ("MVR", rf"({AMOUNT})\s*/-"),
)
BARE = rf"(?<![\d,.])({AMOUNT})(?![,\d]|\.\d)"
UNIT = r"(?i)(?<![A-Za-z\d])(\d+(?:\.\d+)?)\s*(kwh|mah|ghz|mhz|sqft|inch|kw|gb|tb|mb|kg|ml|cm|mm|v|a|w|l)(?![A-Za-z])"
_QUANTITY = UNIT.replace(r"(\d+", r"(?!20\d\d(?![\d.]))(\d+", 1)  # without years
ISO_DATE = r"(20\d{2})[-/](\d{1,2})[-/](\d{1,2})"
DMY_DATE = r"(\d{1,2})[-/](\d{1,2})[-/](20\d{2})"
TEXT_DATE = r"(\d{1,2})\s+([A-Za-z]{3,9})\s+(20\d{2})"
DV_DATE, DV_YEAR_FIRST = r"(\d{1,2})\s+([ހ-޿]+)\s+(20\d{2})", r"(20\d{2})\s+([ހ-޿]+)\s+(\d{1,2})"
_WITH_DIGIT = r"[^\s\d]*+\d\S*+"
_NEAR_DIGITS = rf"\s*+([^\s\d]++\s++)*+({_WITH_DIGIT}(?:\s++(?:[^\s\d]++\s++)?{_WITH_DIGIT})*+(?:\s++[^\s\d]++)?)|[\s\S]++"  # or the rest, which has no digit
IDENTIFIER = r"\([A-Za-z]+\)|[A-Za-z0-9][A-Za-z0-9()/.\-:]*"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
#: Stems of Thaana month names.
DV_MONTHS = (
    ("ޖެނު", 1), ("ފެބް", 2), ("މާރ", 3), ("އޭޕް", 4), ("އެޕް", 4), ("މެއި", 5), ("މޭ", 5), ("ޖޫން", 6), ("ޖުލަ", 7), ("އޮގަ", 8), ("އޯގަ", 8),
    ("ސެޕް", 9), ("އޮކް", 10), ("ނޮވ", 11), ("ޑިސ", 12),
)
#: Words in the labels of attachments, and suffixes of files.
FORM_LABEL = "(?i)form|foam|ފޯމ|އެދޭ|application|apply"
MAIN_LABEL = "(?i)iulaan|iulan|announcement|notice|އިޢުލާން|އިއުލާން|ނޯޓިސް"
ANNEX_LABEL = "(?i)annex|attachment|sheet|schedule|appendix|a\\d\\b|ޖަދުވަލު"
MIME = (
    (".pdf", "application/pdf"),
    (".docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    (".doc", "application/msword"),
    (".xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def primary_phone(*cols: Column) -> Column:
    """First local number in the texts, in their order, '' if none."""
    found = F.filter(F.array(*[F.regexp_extract(_text(c), PHONE, 1) for c in cols]), lambda x: x != "")
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))


def all_phones(*cols: Column) -> Column:
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(_text(c), F.lit(PHONE), 1) for c in cols])))


def strip_phones(c: Column) -> Column:
    """Text for display without phone numbers and the separators they leave."""
    t = F.regexp_replace(F.regexp_replace(_text(c), PHONE, ""), r"[ \t]{2,}", " ")
    return F.regexp_replace(t, r"^[\s,|/:&-]+|[\s,|/:&-]+$", "")


def emails(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_text(c), F.lit(EMAIL), 0))


def urls(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_text(c), F.lit(URL), 0))


def _number(x: Column) -> Column:
    return F.replace(x, F.lit(","), F.lit("")).try_cast("double")


def marked_amounts(c: Column) -> Column:
    """Distinct struct(currency, amount) of the amounts that are marked with a currency."""

    def marked(currency: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(_text(c), F.lit(pattern), 1), lambda x: F.struct(F.lit(currency).alias("currency"), _number(x).alias("amount")))

    return F.array_distinct(F.concat(*[marked(*m) for m in MARKED]))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is computed once: an expression that stands in a lambda is computed for each of its elements."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def near_digits(c: Column) -> Column:
    """The words with digits and their neighbours, as they stand; a mark takes the place of the rest.

    No phone, amount, quantity or date has two words without digits in a row, or looks further than the space around its words, so each is found here as in the text.
    """
    return F.regexp_replace(_text(c), _NEAR_DIGITS, "$1$2 # ")


def candidates(c: Column) -> Column:
    """struct(phones, emails, urls, money, units, dates) of a text: what a reader of it may state as a fact.

    money: the marked amounts, then, as MVR, the other numbers that are no phone, no quantity, no year and no part of a date.
    """
    t = _text(c)
    none = F.array().cast("array<string>")
    currencies = list(dict.fromkeys([cur for cur, _ in MARKED] + ["MVR"]))

    def found(near: Column) -> Column:
        marked = [F.flatten(F.array(*[F.regexp_extract_all(near, F.lit(p), 1) for x, p in MARKED if x == cur])).alias(cur) for cur in currencies]
        numbers = F.regexp_extract_all(F.regexp_replace(near, _QUANTITY, " "), F.lit(BARE), 1)
        return F.struct(all_phones(near).alias("phones"), units(near).alias("units"), dates(near).alias("dates"), numbers.alias("numbers"), *marked)

    def facts(x: Column) -> Column:
        parts = F.flatten(F.transform(x["dates"], lambda d: F.split(d, "-")))
        bare = F.array_except(F.filter(x["numbers"], lambda n: ~n.rlike(r"^20\d\d$")), F.concat(x["phones"], parts, *[x[cur] for cur in currencies]))

        def amounts(cur: str) -> Column:
            values = F.array_distinct(F.transform(F.concat(x[cur], bare) if cur == "MVR" else x[cur], _number))
            return F.transform(values, lambda v: F.struct(F.lit(cur).alias("currency"), v.alias("amount")))

        money = F.concat(*[amounts(cur) for cur in currencies])
        mail = F.when(t.contains("@"), emails(t)).otherwise(none)
        links = F.when(t.contains("http"), urls(t)).otherwise(none)
        return F.struct(x["phones"].alias("phones"), mail.alias("emails"), links.alias("urls"), money.alias("money"), x["units"].alias("units"), x["dates"].alias("dates"))

    return _let(near_digits(t), lambda near: _let(found(near), facts))


def units(c: Column) -> Column:
    """'value unit' of quantities with a known unit; years (20xx) are none."""
    num = F.regexp_extract_all(_text(c), F.lit(UNIT), 1)
    unit = F.regexp_extract_all(_text(c), F.lit(UNIT), 2)
    pairs = F.arrays_zip(num.alias("n"), unit.alias("u"))
    return F.transform(F.filter(pairs, lambda p: ~p["n"].rlike(r"^20\d\d$")), lambda p: F.concat(p["n"], F.lit(" "), F.lower(p["u"])))


def _iso(y: Column, m: Column, d: Column) -> Column:
    m, d = m.try_cast("int"), d.try_cast("int")
    return F.when(m.between(1, 12) & d.between(1, 31), F.format_string("%s-%02d-%02d", y, m, d))


def month_number(c: Column) -> Column:
    """Month of a name or its beginning, in English or Thaana; null if none."""
    low = F.lower(F.trim(_text(c)))
    out = F.lit(None).cast("int")
    for i, stem in enumerate(MONTHS, 1):
        out = F.when(low.startswith(stem), F.lit(i)).otherwise(out)
    for stem, i in DV_MONTHS:
        out = F.when(F.trim(_text(c)).startswith(stem), F.lit(i)).otherwise(out)
    return out


def dates(c: Column) -> Column:
    """Distinct ISO dates: year first, day first, and day with a month's name, in Thaana also year, month, day."""
    t = _text(c)

    def parts(pattern: str, between: str) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), 0), lambda x: F.split(x, between))

    iso = F.transform(parts(ISO_DATE, "[-/]"), lambda p: _iso(p[0], p[1], p[2]))
    dmy = F.transform(parts(DMY_DATE, "[-/]"), lambda p: _iso(p[2], p[1], p[0]))
    latin = F.array(*[F.lit(x) for x in MONTHS])
    named = [(TEXT_DATE, 2, 0, lambda m: F.array_position(latin, F.substring(F.lower(m), 1, 3))), (DV_DATE, 2, 0, month_number), (DV_YEAR_FIRST, 0, 2, month_number)]
    months = [F.transform(parts(x, r"\s+"), lambda p: F.struct(p[y].alias("y"), f(p[1]).cast("string").alias("m"), p[d].alias("d"))) for x, y, d, f in named]  # so that a month is looked up once
    txt, dv, year_first = [F.transform(x, lambda p: _iso(p["y"], p["m"], p["d"])) for x in months]
    return F.array_distinct(F.filter(F.concat(iso, dmy, txt, dv, year_first), lambda d: d.isNotNull()))


def identifier_key(c: Column) -> Column:
    """Digit groups in order, then the letters sorted: the same number spelt differently has one key."""
    up = F.regexp_replace(F.upper(_text(c)), r"^[.,);:'\"]+|[.,);:'\"]+$", "")
    letters = F.array_join(F.array_sort(F.split(F.regexp_replace(up, "[^A-Z]", ""), "")), "")
    return F.concat(F.array_join(F.regexp_extract_all(up, F.lit("[0-9]+"), 0), "-"), F.lit("|"), letters)


def is_identifier(c: Column) -> Column:
    """Seven characters and more, a slash and a digit, neither address nor pair of phone numbers."""
    return (F.length(c) >= 7) & c.contains("/") & c.rlike(r"\d") & ~c.rlike(r"(?i)www\.|https?:") & ~c.rlike(r"^(?:[79]\d{6}|[36]\d{6})(?:\s*/\s*(?:[79]\d{6}|[36]\d{6}))+$")


def identifiers(c: Column) -> Column:
    """Distinct keys of the identifiers in a text."""
    found = F.transform(F.regexp_extract_all(_text(c), F.lit(IDENTIFIER), 0), lambda x: F.regexp_replace(x, r"[.,);:'\"]+$", ""))
    return F.array_distinct(F.transform(F.filter(found, is_identifier), identifier_key))


#: What is counted in the texts of ``parse_count``.
COUNTED = ("", "room", "rooms", "bedroom", "bedrooms", "bath", "baths", "bathroom", "bathrooms")


def parse_count(c: Column) -> Column:
    """struct(n, or_more) of texts such as '4 Rooms and More': a number, then at most a counted noun and 'and more'; else null."""
    t = F.trim(F.regexp_replace(F.lower(_text(c)), r"\s+", " "))
    more = t.endswith("and more")
    rest = F.trim(F.when(more, F.substring(t, F.lit(1), F.length(t) - 8)).otherwise(t))
    n = F.regexp_extract(rest, r"^\d+", 0)
    noun = F.trim(F.substring(rest, F.length(n) + 1, F.length(rest)))
    return F.when((n != "") & noun.isin(*COUNTED), F.struct(n.try_cast("int").alias("n"), more.alias("or_more")))


def attachment_role(label: Column, url: Column) -> Column:
    t = F.concat(_text(label), F.lit(" "), _text(url))
    return F.when(t.rlike(FORM_LABEL), "application_form").when(t.rlike(MAIN_LABEL), "main").when(t.rlike(ANNEX_LABEL), "annex").otherwise("unknown")


def guess_mime(c: Column) -> Column:
    out = F.lit("")
    for suffix, mime in reversed(MIME):
        out = F.when(F.lower(_text(c)).endswith(suffix), mime).otherwise(out)
    return out


def quoted_phrases(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(_text(c), F.lit('"([^"]+)"'), 1), lambda x: F.trim(x) != "")


LONGEST_LABEL = 120


def table_pairs(html: Column) -> Column:
    """'label: value' of table rows with two cells and more: the first cell is the label, the items of a list in the second are joined by bars.

    Rows without label or value, and with labels over LONGEST_LABEL characters, are left out.
    """

    def clean(x: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " "))

    def pair(row: Column) -> Column:
        cells = F.regexp_extract_all(row, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1)
        label = F.regexp_replace(clean(F.get(cells, F.lit(0))), r"[\s:]+$", "")
        second = F.get(cells, F.lit(1))
        items = F.filter(F.transform(F.regexp_extract_all(second, F.lit(r"(?is)<li[^>]*>(.*?)</li>"), 1), clean), lambda x: x != "")
        value = F.when(F.size(items) > 0, F.array_join(items, " | ")).otherwise(clean(second))
        return F.when((F.size(cells) > 1) & (label != "") & (value != "") & (F.length(label) <= LONGEST_LABEL), F.concat(label, F.lit(": "), value))

    rows = F.regexp_extract_all(_text(html), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    return F.filter(F.transform(rows, pair), lambda x: x.isNotNull())
