"""Problem 9: per-document text statistics, and prose told from lists, tables and junk.

1. One Arrow-batched pass reads each whole text once and writes its statistics (``STATS``): word
   count, mean word length, symbol ratio, lines ending in punctuation, share of common words, share of
   well-formed tokens and of Latin words that can be spoken (a vowel, no five consonants running), shares
   of the characters in list and table lines, repetition. What a token is, is found out once per
   distinct token of a batch; the rest is counting in arrays. The language is that of most letters,
   in Latin letters that of most function words; the label is not used.
2. Per language, every statistic goes into a mergeable KLL quantile sketch (partial sketches are
   built per partition and merged, nothing is gathered); the sketches give percentiles and robust
   z-scores (median, quartiles). Percentiles are among all documents, z-scores are measured against
   the plain ones: those that pass no floor, so that many lists or much junk of a language do not
   become its norm. There is one sketch row per language, a fixed set.
3. A document is flagged where a statistic lies in the tail that speaks against prose; the kind is
   decided from the flagged statistics, each with an absolute floor. Where no document is plain, the
   floors decide alone.

Defined results: rows without an id give nothing; null, empty and blank texts have zero statistics and are junk ("empty"); repeated
rows give one row; very long texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reefglass.checkpoints import cut
from reefglass.llm.batches import sliced
from reefglass.sources.tables import read_table

STATS = (
    "n_chars", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "digit_ratio", "line_end_ratio", "common_ratio",
    "well_formed_ratio", "spoken_ratio", "list_ratio", "table_ratio", "repeat_ratio",
)
#: Function words of the languages.
COMMON = {
    "en": frozenset(
        """the of and to in a is for on at by with from be will are that this it as an or has have not can may must which who when
        where before after between each any all per was were been its their our your his her than under within without upon until""".split()
    ),
    "dv-Latn": frozenset("mi eve vey ge ah gai in ai emme kuraa kurumah huri dhen adhi nuvatha mihaaru aharu dhuvahu iru akah kuran jehey".split()),
    "dv": frozenset("މި އެ އެވެ ވެ ގެ އަދި ނުވަތަ ހުރި އާ އާއި އެކު އަށް ގައި އިން އަހަރު މަހު ދުވަހު އިރު ޖެހޭ ވޭ މީހުން އަންނަ".split()),
    "ar": frozenset("في من على إلى عن مع هذا هذه التي الذي أن إن كان كانت بعد قبل كل أو ثم لا ما لم قد يتم سوف حتى عند".split()),
}
LANGUAGES = tuple(COMMON)
_VOWEL = re.compile(r"[aeiouyáàâäéèêëíîïóôöúûü]")
_CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}")
_TOKEN = re.compile(
    r"""^["'“”‘’(«\[]*(?:[^\W\d_ހ-޿]+(?:['’\-/.&][^\W\d_]+)*|[ހ-޿]+(?:[-/'][ހ-޿]+)*|[ -]?[\d٠-٩]+(?:[.,:/\-٫٬][\d٠-٩]+)*(?:%|st|nd|rd|th|[a-zA-Z°²³]{1,3})?|[–—\-&]|&amp;|&nbsp;|&quot;|&\#39;)['’]?[)»\]"”’.,;:!?،؛؟…]*$""",
    re.VERBOSE,
)
_EMAIL = re.compile(r"^[\w.+-]+@[\w-]+\.[\w.]+[.,;]?$|^(?:https?://|www\.)\S+$")
_BULLET = re.compile(r"^\s*(?:[-*+•◦▪·●○■□▢►–—»>]+\s+|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4}|[ހ-ޥ])[).]\s+|\[[ xX]?\]\s+)\S")
#: Where a run of letters begins only, so that long runs are read once.
_SENTENCE = re.compile(r"(?<![^\W\d_ހ-޿])[^\W\d_ހ-޿]{2,}+[.!?؟]['\")\]]*+(?:\s|$)|(?<![ހ-޿])[ހ-޿]{2,}+[.!?؟](?:\s|$)|[\d)]\.(?:\s|$)")


def _cells(line: str) -> tuple[str, int] | None:
    """(delimiter, number of cells) if the line looks like a table row."""
    s = line.strip()
    if s.count("|") >= 2:
        return "|", s.strip("|").count("|") + 1
    if "\t" in line:
        return "\t", line.count("\t") + 1
    for d in ("  ", ";", ","):
        if d in s and not (d in ";," and re.search(rf"{d} ", s)):
            parts = re.split(r" {2,}", s) if d == "  " else s.split(d)
            if len(parts) >= 2 and max(len(c.split()) for c in parts) <= 8:
                return d, len(parts)
    return None


def _bare_items(lines: list[str], sizes: list[int], free: list[bool]) -> int:
    """Characters in runs of four and more neighbouring short lines, none of which holds or ends a sentence."""
    found = run = length = 0
    for line, size, ok in zip([*lines, ""], [*sizes, 0], [*free, False], strict=True):
        if ok and len(line.split()) <= 6 and line.rstrip()[-1:] not in ".!?؟۔" and not _SENTENCE.search(line[:-1]):
            run, length = run + size, length + 1
        else:
            found += run if length >= 4 else 0
            run = length = 0
    return found


def line_shares(text: str) -> tuple[float, float, float, int]:
    """(list share, table share, share of lines ending in punctuation, number of lines), shares by characters.

    A table needs two neighbouring lines with the same delimiter; a list two bullets, one line of at
    least four short items between the same separators, or four neighbouring short lines without a sentence.
    """
    lines = [x for x in re.split(r"[\r\n\u2028]+", text) if x.strip()]
    if not lines:
        return 0.0, 0.0, 0.0, 0
    cells = [_cells(x) for x in lines]
    bullets = [bool(_BULLET.match(x)) for x in lines]
    sizes = [len(x.strip()) for x in lines]
    total = sum(sizes)
    table = lst = 0
    n_bullets = sum(bullets)
    ends = sum(x.rstrip().rstrip("'\")]”’»")[-1:] in _LINE_ENDS for x in lines)
    free = [False] * len(lines)
    for i, x in enumerate(lines):
        c = cells[i]
        near = [cells[j] for j in (i - 1, i + 1) if 0 <= j < len(lines)] if c else []
        if c and any(n and n[0] == c[0] and (c[0] in "|\t" or (abs(n[1] - c[1]) <= 2 and max(n[1], c[1]) >= 3) or (c[0] == "  " and n[1] == c[1])) for n in near) and not (bullets[i] and c[0] not in "|\t"):
            table += sizes[i]
            continue
        if bullets[i] and n_bullets >= 2:
            lst += sizes[i]
            continue
        listed = False
        if not _SENTENCE.search(x[:-1]):
            for sep in (" / ", " | ", " • ", " · ", "; ", " – ", " - ", ", "):
                items = x.split(sep) if sep in x else ()
                if len(items) >= 4:
                    words = sorted(len(t.split()) for t in items)
                    if words[len(words) // 2] <= 5 and words[-1] <= 9 and len(items) * len(sep) * 12 > len(x) * 0.2:
                        lst += sizes[i]
                        listed = True
                        break
        free[i] = not listed
    lst += _bare_items(lines, sizes, free)
    return lst / total, table / total, ends / len(lines), len(lines)


_LINE_ENDS = frozenset(".!?؟۔…:")
_MARKS = frozenset("|-•*/+□–◦▪")
_WORD_EDGE = ".,;:!?()[]\"'،؛؟“”"


def one_unit(text: str) -> bool:
    """True if the text, blanks aside, is one unit three times and more, up to one character in twenty.

    A period is where the first characters, or those of the middle, come again; it is tried on 64 places
    before the whole text is compared, so any length of unit and text is looked at.
    """
    x = re.sub(r"\s+", "", text)
    if len(x) < 8:
        return False
    same = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(same)
    tried = set()
    for start in (0, n // 3):
        block = x[start : start + 4]
        at = x.find(block, start + 1)
        while at != -1 and at - start <= n // 3:
            p = at - start
            if p not in tried:
                tried.add(p)
                places = np.linspace(0, n - p - 1, 64).astype(np.int64)
                if float(np.mean(same[places + p] == same[places])) > 0.85 and float(np.mean(same[p:] == same[:-p])) > 0.95:
                    return True
            at = x.find(block, at + 1)
    return False


def _word_facts(words: list[str]) -> np.ndarray:
    """Per distinct token: well formed, letters, speakable, has Latin letters, a function word of any and of each language."""
    out = np.zeros((len(words), 5 + len(LANGUAGES)))
    for i, t in enumerate(words):
        w = t.strip(_WORD_EDGE).lower()
        latin = any("a" <= c <= "z" for c in w)
        out[i, 0] = bool(_TOKEN.match(t) or _EMAIL.match(t))
        out[i, 1] = len(w)
        out[i, 2] = not latin or len(w) < 4 or "@" in w or bool(_VOWEL.search(w) and not _CONSONANTS.search(w))
        out[i, 3] = latin
        out[i, 5:] = [w in COMMON[x] for x in LANGUAGES]
        out[i, 4] = out[i, 5:].any()
    return out


class _Kinds:
    """Code points -> the class that counts: 0 other, 1 symbol or mark, 2 number, 3 separator; scripts as bits above."""

    def __init__(self) -> None:
        self.table = np.full(0x110000, 255, np.uint8)

    def of(self, points: np.ndarray) -> np.ndarray:
        found = self.table[points]
        if not (found == 255).any():
            return found
        for p in np.unique(points[found == 255]):
            c = unicodedata.category(chr(p))[0] if not 0xD800 <= p < 0xE000 else "C"
            kind = {"S": 1, "P": 1, "N": 2, "Z": 3}.get(c, 3 if p in (9, 10, 13) else 0)
            script = 1 if 0x780 <= p <= 0x7BF else 2 if 0x600 <= p <= 0x6FF and c == "L" else 3 if c == "L" else 0
            self.table[p] = kind | script << 2
        return self.table[points]


def _char_counts(text: str, kinds: _Kinds, piece: int = 1_000_000) -> np.ndarray:
    out = np.zeros(16, dtype=np.int64)
    for i in range(0, len(text), piece):
        out += np.bincount(kinds.of(np.frombuffer(text[i : i + piece].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)), minlength=16)
    return out


def batch_statistics(texts: list[str | None], kinds: _Kinds) -> tuple[np.ndarray, list[str]]:
    """(the values of ``STATS``, the language each text is written in or 'und').

    What a token is, is found out once per distinct token of the batch; counts are array operations.
    """
    texts = ["" if t is None else t for t in texts]
    split = [t.split() for t in texts]
    size = np.array([len(x) for x in split], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    n = np.maximum(size, 1)
    if len(owner):
        code, words = pd.factorize(np.array([w for ws in split for w in ws], dtype=object))
        facts = _word_facts(list(words))
        keys = [w if any(c.isalnum() for c in w) else t for t in words for w in (t.strip(_WORD_EDGE).lower(),)]
        key_code, key_names = pd.factorize(np.array(keys, dtype=object))
        totals = np.stack([np.bincount(owner, facts[code, j], len(texts)) for j in range(facts.shape[1])], 1)
        pair, times = np.unique(owner * len(key_names) + key_code[code], return_counts=True)
        of, key = pair // len(key_names), pair % len(key_names)
        distinct = np.bincount(of, minlength=len(texts))
        mark = np.array([k in _MARKS for k in key_names], dtype=bool)
        most = np.zeros(len(texts))
        np.maximum.at(most, of[~mark[key]], times[~mark[key]])
    else:
        totals, distinct, most = np.zeros((len(texts), 5 + len(LANGUAGES))), np.zeros(len(texts)), np.zeros(len(texts))
    repeat = np.where(size >= 4, np.maximum(most / n, np.where((size >= 12) & (distinct <= 6), 1 - distinct / n, 0.0)), 0.0)
    length = np.array([len(t) for t in texts], dtype=np.int64)
    count = np.stack([_char_counts(t, kinds) for t in texts]).reshape(-1, 4, 4) if texts else np.zeros((0, 4, 4))  # text x script x kind
    by_kind, by_script = count.sum(1), count.sum(2)
    visible = np.maximum(1, length - by_kind[:, 3])
    lines = np.array([line_shares(t) for t in texts]).reshape(-1, 4)
    repeat = np.where((size > 0) & np.array([one_unit(t) for t in texts], dtype=bool), 1.0, repeat)
    latin = np.where(totals[:, 6] > totals[:, 5], 1, 0)
    lang = np.where(by_script[:, 1:].sum(1) == 0, -1, np.array([2, 3, -2])[by_script[:, 1:].argmax(1)])
    lang = np.where(lang == -2, latin, lang)
    table = np.stack([
        length, size, lines[:, 3], totals[:, 1] / n, by_kind[:, 1] / visible, by_kind[:, 2] / visible, lines[:, 2], totals[:, 4] / n,
        totals[:, 0] / n, np.where(totals[:, 3] > 0, 1 - (size - totals[:, 2]) / np.maximum(totals[:, 3], 1), 1.0), lines[:, 0], lines[:, 1], repeat,
    ], 1).astype(float)
    table[size == 0, 1:] = 0.0
    return table, ["und" if x < 0 else LANGUAGES[x] for x in lang]


def text_statistics(text: str | None) -> tuple[float, ...]:
    """The values of ``STATS`` for one text."""
    return tuple(batch_statistics([text], _Kinds())[0][0].tolist())


def statistics(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, lang, *STATS); lang is the language the text is written in, or 'und'; one row per doc_id."""
    names = list(STATS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = _Kinds()
        for pdf in sliced(batches):
            values, lang = batch_statistics(pdf["text"].tolist(), kinds)
            out = pd.DataFrame(values, columns=names, dtype=float)
            out.insert(0, "lang", lang)
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    schema = "doc_id long, lang string, " + ", ".join(f"{x} double" for x in names)
    return docs.where("doc_id is not null").select("doc_id", "text").mapInPandas(run, schema).dropDuplicates(["doc_id"])


def sketches(stats: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """KLL sketches of the statistics: per language, and of all languages by merging those. A row per language, one row."""
    own = stats.groupBy("lang").agg(*[F.kll_sketch_agg_double(x).alias(f"k_{x}") for x in names])
    return own, own.agg(*[F.kll_merge_agg_double(f"k_{x}").alias(f"k_{x}") for x in names])


def _quantile(sketch: str, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(q))


def _percentile(grid: str, x: str) -> Column:
    value = F.col(x)
    return F.size(F.filter(F.col(grid), lambda q: q <= value)) / 101.0


#: Smallest spread (as a standard deviation) that a statistic is measured against.
SPREAD = {"well_formed_ratio": 0.05, "spoken_ratio": 0.05, "list_ratio": 0.05, "table_ratio": 0.05, "repeat_ratio": 0.05, "symbol_ratio": 0.02, "common_ratio": 0.05, "mean_word_length": 0.5, "line_end_ratio": 0.1}
TAIL = 3.5
#: Values that speak against prose.
MIXED, BROKEN, GARBLED, REPEATED, UNSPOKEN = 0.5, 0.6, 0.36, 0.45, 0.6


def _structured() -> Column:
    return F.col("list_ratio") + F.col("table_ratio") > MIXED


def plain(names: tuple[str, ...] = tuple(SPREAD)) -> Column:
    """True for the documents that pass no floor of the named statistics."""
    floors = {"list_ratio": _structured, "well_formed_ratio": lambda: F.col("well_formed_ratio") < BROKEN, "spoken_ratio": lambda: F.col("spoken_ratio") < UNSPOKEN, "repeat_ratio": lambda: F.col("repeat_ratio") > REPEATED}
    return reduce(lambda a, x: a & ~floors[x](), [x for x in floors if x in names], F.lit(True))


def scored(stats: DataFrame, names: tuple[str, ...] = tuple(SPREAD)) -> DataFrame:
    """stats plus, per statistic x, its percentile pct_x and robust z-score z_x in its language, and za_x among all documents."""
    own, _ = sketches(stats, names)
    usual, merged = sketches(stats.where(plain(names)), names)

    def centre(df: DataFrame, prefix: str, keep: list) -> DataFrame:
        cols = []
        for x in names:
            some = F.kll_sketch_get_n_double(f"k_{x}") > 0
            spread = F.greatest((_quantile(f"k_{x}", 0.75) - _quantile(f"k_{x}", 0.25)) / 1.349, F.lit(SPREAD[x]))
            cols += [F.when(some, _quantile(f"k_{x}", 0.5)).alias(f"{prefix}m_{x}"), F.when(some, spread).alias(f"{prefix}s_{x}")]
        return df.select(*keep, *cols)

    grid = F.array(*[F.lit(i / 100) for i in range(101)])
    grids = own.select("lang", *[F.kll_sketch_get_quantile_double(F.col(f"k_{x}"), grid).alias(f"q_{x}") for x in names])
    per_lang = grids.join(F.broadcast(centre(usual, "o", ["lang"])), "lang", "left")  # one row per language
    every = centre(merged, "a", [])  # one row
    out = stats.join(F.broadcast(per_lang), "lang").join(F.broadcast(every.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one"))
    return out.select(
        *stats.columns,
        *[_percentile(f"q_{x}", x).alias(f"pct_{x}") for x in names],
        *[((F.col(x) - F.col(f"om_{x}")) / F.col(f"os_{x}")).alias(f"z_{x}") for x in names],
        *[((F.col(x) - F.col(f"am_{x}")) / F.col(f"as_{x}")).alias(f"za_{x}") for x in names],
    )


def _high(x: str) -> Column:
    return F.greatest(F.col(f"z_{x}"), F.col(f"za_{x}")) > TAIL


def _low(x: str) -> Column:
    return F.least(F.col(f"z_{x}"), F.col(f"za_{x}")) < -TAIL


def kind() -> Column:
    """prose, list, table or junk, from the flagged tails and their floors; without plain documents the floors decide."""

    def tail(flag: Column) -> Column:
        return F.coalesce(flag, F.lit(True))

    broken = tail(_low("well_formed_ratio"))
    garbled = broken & (F.col("well_formed_ratio") < GARBLED)
    repeated = tail(_high("repeat_ratio")) & (F.col("repeat_ratio") > REPEATED)
    # words that cannot be spoken, among which no more function words than are usual
    unspoken = tail(_low("spoken_ratio")) & (F.col("spoken_ratio") < UNSPOKEN) & tail(F.least("z_common_ratio", "za_common_ratio") < 0)
    return (
        F.when((F.col("n_words") == 0) | garbled | unspoken | (F.col("repeat_ratio") == 1.0), "junk")
        .when(_structured() & tail(_high("table_ratio")) & (F.col("table_ratio") > F.col("list_ratio")), "table")
        .when(_structured() & tail(_high("list_ratio")), "list")
        .when(repeated | (broken & (F.col("well_formed_ratio") < BROKEN)), "junk")
        .otherwise("prose")
    )


def judged(spark: SparkSession, data_dir: str) -> DataFrame:
    """Statistics, percentiles, z-scores and text_kind of every document."""
    stats = cut(statistics(read_table(spark, data_dir, "documents", "doc_id", "text")))
    return scored(stats).withColumn("text_kind", kind())


def p9_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """(doc_id, text_kind) of the documents that are mainly not natural prose."""
    return judged(spark, data_dir).where("text_kind <> 'prose'").select("doc_id", "text_kind")


def p9_statistics(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every document's statistics with percentiles, z-scores, kind and the names of the flagged statistics."""
    rows = judged(spark, data_dir)
    flags = F.filter(F.array(*[F.when(_high(x) | _low(x), F.lit(x)) for x in SPREAD]), lambda f: f.isNotNull())
    return rows.select("doc_id", "lang", *STATS, *[F.round(f"pct_{x}", 4).alias(f"pct_{x}") for x in SPREAD], *[F.round(f"z_{x}", 4).alias(f"z_{x}") for x in SPREAD], F.array_join(flags, ",").alias("flags"), "text_kind")
