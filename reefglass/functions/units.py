"""Unit spellings, number reading and conversion to common units as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reefglass.functions.text import ASCII_DIGITS, OTHER_DIGITS, ZERO_WIDTH, plain

#: Spellings of the units, after ``unit_key`` (lower case, letters, marks, digits and degree signs only).
UNIT_SPELLINGS = {
    "kg": ("kg", "kgs", "kilo", "kilos", "kilogram", "kilograms", "kilogramme", "kilogrammes", "ކިލޯ", "ކިލޯގްރާމް"),
    "g": ("g", "gm", "gms", "gr", "gram", "grams", "gramme", "grammes", "ގްރާމް"),
    "lb": ("lb", "lbs", "pound", "pounds", "ޕައުންޑް"),
    "oz": ("oz", "ozs", "ounce", "ounces", "އައުންސް"),
    "cm": ("cm", "cms", "centimeter", "centimeters", "centimetre", "centimetres", "ސެންޓިމީޓަރު"),
    "mm": ("mm", "mms", "millimeter", "millimeters", "millimetre", "millimetres", "މިލިމީޓަރު"),
    "m": ("m", "mtr", "mtrs", "meter", "meters", "metre", "metres", "މީޓަރު"),
    "in": ("in", "ins", "inch", "inches", '"', "”", "″", "އިންޗި"),
    "ft": ("ft", "foot", "feet", "'", "′", "ފޫޓު"),
    "l": ("l", "lt", "ltr", "ltrs", "liter", "liters", "litre", "litres", "ލީޓަރު"),
    "ml": ("ml", "mls", "milliliter", "milliliters", "millilitre", "millilitres", "މިލިލީޓަރު"),
    "gal_us": ("gal", "gals", "gallon", "gallons", "gallonus", "gallonsus", "usgal", "usgallon", "usgallons", "galus", "ގެލަން"),
    "m3": ("m3", "m³", "cbm", "cubicmeter", "cubicmeters", "cubicmetre", "cubicmetres", "cum"),
    "w": ("w", "watt", "watts", "ވޮޓް"),
    "kw": ("kw", "kws", "kilowatt", "kilowatts", "ކިލޯވޮޓް"),
    "hp": ("hp", "bhp", "horsepower"),
    "m2": ("m2", "m²", "sqm", "sqmtr", "sqmeter", "sqmetre", "sqmetres", "squaremeter", "squaremeters", "squaremetre", "squaremetres", "އަކަމީޓަރު"),
    "sqft": ("sqft", "sft", "ft2", "ft²", "sqfeet", "sqfoot", "squarefeet", "squarefoot", "އަކަފޫޓު"),
    "mah": ("mah", "mahs", "milliamphour", "milliamphours", "milliamperehours"),
    "ah": ("ah", "ahs", "amphour", "amphours", "amperehours"),
    "gb": ("gb", "gbs", "gig", "gigs", "gigabyte", "gigabytes", "ޖީބީ"),
    "mb": ("mb", "mbs", "meg", "megs", "megabyte", "megabytes"),
    "tb": ("tb", "tbs", "terabyte", "terabytes"),
    "degc": ("c", "°c", "℃", "degc", "degreec", "degreesc", "celsius", "celcius", "centigrade", "degreescelsius"),
    "degf": ("f", "°f", "℉", "degf", "degreef", "degreesf", "fahr", "fahrenheit", "degreesfahrenheit"),
    "kelvin": ("k", "kelvin", "kelvins", "degk", "°k"),
    "month": ("month", "months", "mth", "mths", "mo", "mos", "މަސް", "މަސްދުވަސް"),
    "year": ("year", "years", "yr", "yrs", "y", "އަހަރު"),
}
#: Number words.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20, "އެކެއް": 1, "ދޭއް": 2, "ތިނެއް": 3, "ހަތަރެއް": 4, "ފަހެއް": 5, "ހައެއް": 6, "ހަތެއް": 7, "އަށެއް": 8, "ނުވައެއް": 9, "ދިހައެއް": 10,
}
#: Words for yes and no.
YES = ("yes", "y", "true", "t", "1", "available", "on", "އާނ", "އާން", "އާނއެކޭ")
NO = ("no", "n", "false", "f", "0", "not available", "unavailable", "off", "ނޫން", "ނޫނެކޭ")

_NUMBER = r"(?<![\p{L}\p{M}\d.,])([-−]?\d+(?:[.,٫٬]\d+)*)"


def unit_key(c: Column) -> Column:
    """The form in which unit spellings are compared."""
    c = F.regexp_replace(F.lower(c), ZERO_WIDTH, "")
    return F.regexp_replace(c, r"""[^\p{L}\p{M}\p{N}°℃℉"'”″′]+""", "")


def unit_form(text: str) -> str:
    """``unit_key`` of a Python string."""
    return "".join(ch for ch in text.lower() if ch.isalnum() or "\u07a6" <= ch <= "\u07b0" or ch in "°℃℉'\"’”″′²³")


def spelling_codes(attributes: list) -> dict[str, set[str]]:
    """unit key -> unit codes: the fixed spellings, and the registry's aliases of its common units."""
    found: dict[str, set[str]] = {}
    for code, spellings in UNIT_SPELLINGS.items():
        for s in spellings:
            found.setdefault(s, set()).add(code)
    for a in attributes:
        if a.unit_code:
            for s in (*(a.unit_aliases or ()), a.unit):
                if s and unit_form(s):
                    found.setdefault(unit_form(s), set()).add(a.unit_code)
    return found


def number_text(c: Column) -> Column:
    """The first number of a text as it stands there, '' if none. Digits inside a word (m2) are no number."""
    return F.regexp_extract(F.translate(c, OTHER_DIGITS, ASCII_DIGITS), _NUMBER, 1)


def read_number(c: Column) -> Column:
    """First number of a text, in digits of any script or as a word; null if there is none.

    Commas before groups of three digits are thousands marks, any other single comma is a decimal one.
    """
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(number_text(c), "−", "-"), "٫", "."), "٬", ",")
    grouped = t.rlike(r"^-?[1-9]\d{0,2}(,\d{3})+(\.\d+)?$")
    dotted = t.rlike(r"^-?[1-9]\d{0,2}(\.\d{3}){2,}(,\d+)?$")
    t = F.when(grouped, F.replace(t, F.lit(","), F.lit(""))).when(dotted, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit(".")))
    return F.coalesce(t.try_cast("double"), _word_number(c))


def _word_number(c: Column) -> Column:
    word = F.regexp_extract(F.lower(c), r"(?<![\p{L}\p{M}])(" + "|".join(NUMBER_WORDS) + r")(?![\p{L}\p{M}])", 1)
    out = F.lit(None).cast("double")
    for w, n in NUMBER_WORDS.items():
        out = F.when(word == w, F.lit(float(n))).otherwise(out)
    return F.when(word != "", out)


def text_unit_key(c: Column) -> Column:
    """What is left of a quantity's text without the number and words such as about or only, as a unit key."""
    t = F.regexp_replace(F.translate(c, OTHER_DIGITS, ASCII_DIGITS), _NUMBER, " ")
    t = F.regexp_replace(F.lower(t), r"(?<!\p{L})(approx|approximately|about|around|only|ca|circa|each|nos|max|min)(?!\p{L})", " ")
    return unit_key(t)


def finite(c: Column) -> Column:
    """The value if it is a finite number, else null."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def read_bool(num: Column, text: Column) -> Column:
    """1.0 or 0.0 for a readable yes or no in either column, else null."""
    t = plain(text)
    return F.when(num.isin(0.0, 1.0), num).when(t.isin(*YES), F.lit(1.0)).when(t.isin(*NO), F.lit(0.0))
