"""Problem 1: values typed freely -> the entry of the attribute's reference list, or 0.

The distinct values of an attribute are normalised and looked up, each once, in an inverted index of
character n-grams of the list. Candidates are scored by the cosine of their idf-weighted n-gram vectors
and accepted above ``threshold`` with ``margin`` to the next entry. What lies below either is checked
exactly against the candidates: word order, edit distance, a unique prefix.

Scale: the reference lists are a table of fixed size (checked against ``MAX_ENTRIES`` before it is
gathered), so they travel with the task. The values are counted with map-side combine, so a value that
holds a third of all rows is matched once; the join back to the rows spreads the values and documents
found hot.

Defined results: null or blank values are no case; fillers, values of other lists and unlisted
values give 0; an empty list maps every value to 0; repeated rows give one row.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefglass.checkpoints import cut
from reefglass.functions.text import ASCII_DIGITS, FILLERS, OTHER_DIGITS, plain
from reefglass.operators.skew import hot_join, hot_keys
from reefglass.operators.spec_keys import Registry, hot_documents, of_live_documents, resolve_keys
from reefglass.sources.tables import fixed_rows, read_table

MAX_ENTRIES = 100_000
THRESHOLD, MARGIN = 0.65, 0.12

#: Letters of other scripts that look like Latin ones, and digits typed for letters.
_LOOKALIKES = str.maketrans("аеорсухкмтвніјѕԁɡαο", "aeopcyxkmtbhijsdgao")
_DIGIT_LETTERS = str.maketrans("01345", "oleas")
_DIGITS = str.maketrans(OTHER_DIGITS, ASCII_DIGITS)
#: Words that decorate a value without changing what is meant.
DECORATION = frozenset(
    "by original genuine official brand at in on k island maldives post posts of the temporary colour color finish matt "
    "glossy pure made imported cond condition see pics pic photo atoll vacancy permanent".split()
)
#: Abbreviations of words in titles, colours and materials.
ABBREVIATIONS = {
    "sr": "senior", "snr": "senior", "jr": "junior", "acct": "accounts", "acc": "accounts", "accts": "accounts", "acs": "accounts",
    "engr": "engineer", "eng": "engineer", "lab": "laboratory", "tech": "technician", "admin": "administrative", "asst": "assistant",
    "mgr": "manager", "hr": "human resources", "elec": "electrical", "med": "medical", "proc": "procurement", "dk": "dark",
    "lt": "light", "gray": "grey", "pale": "light", "galv": "galvanised", "galvanized": "galvanised", "sup": "supervisor",
    "supv": "supervisor", "opr": "operator", "mech": "mechanic", "recep": "receptionist", "exec": "executive", "dev": "developer",
    "gently": "lightly", "reg": "registered", "sw": "software", "hw": "hardware", "rn": "registered nurse", "ss": "stainless steel", "alu": "aluminium", "alum": "aluminium", "gi": "galvanised iron",
}
#: Everyday names of an entry, used where the list has that entry.
SYNONYMS = {
    "jet black": "black", "pure white": "white", "snow white": "white", "solid teak": "teak wood", "dark navy": "navy blue",
    "navy": "navy blue", "gunmetal": "dark grey", "off white": "ivory", "sealed": "brand new", "mint": "like new", "as new": "like new",
    "reconditioned": "refurbished", "refurb": "refurbished", "inox": "stainless steel", "grp": "fibreglass", "fiberglass": "fibreglass",
    "lightly used": "lightly used", "slightly used": "lightly used", "for parts": "spare parts only", "parts only": "spare parts only",
}
_SEPARATORS = re.compile(r"[^a-z0-9ހ-޿؀-ۿ]+")


def normalise(value: str) -> str:
    """Case, width, accents, look-alike letters, zero-width and odd blanks evened out."""
    v = re.sub(r"(?<=[a-z])I(?=[a-z]|\b)", "l", unicodedata.normalize("NFKC", value).translate(_DIGITS)).casefold()
    v = "".join(c for c in unicodedata.normalize("NFD", v) if not "̀" <= c <= "ͯ" and unicodedata.category(c) != "Cf")
    return v.translate(_LOOKALIKES).strip()


def words(value: str) -> list[str]:
    """Words of a normalised value; dots and slashes inside abbreviations join (a/cs, g.i.)."""
    v = re.sub(r"\b([a-z])[./](?=[a-z]{1,2}\b)", r"\1", value)
    out = []
    for w in _SEPARATORS.split(v):
        if w and not w.isdigit():
            out.append(w.translate(_DIGIT_LETTERS) if any(c.isalpha() for c in w) else w)
    return out


def compact(ws: list[str]) -> str:
    return "".join(ws)


def variants(value: str, vocabulary: set[str] | frozenset[str] = frozenset()) -> list[list[str]]:
    """Readings of a value, plainest first: as typed, undecorated, with abbreviations written out, singular.

    Words of the list's own vocabulary are no decoration.
    """
    ws = words(normalise(value))
    out = [ws]
    bare = [w for w in ws if w in vocabulary or w not in DECORATION] or ws
    full = [x for w in bare for x in ABBREVIATIONS.get(w, w).split()]
    joined = " ".join(full)
    for alt in (bare, full, SYNONYMS.get(joined, joined).split(), full[:-1] + [full[-1].removesuffix("s")] if full else full):
        if alt and alt not in out:
            out.append(alt)
    return out


def osa(a: str, b: str, limit: int) -> int:
    """Edit distance with swaps of neighbours, cut off above limit."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > limit:
            return limit + 1
        before, row = row, new
    return row[-1]


def edit_limit(form: str) -> int:
    """Edits that leave a form recognisable: about one letter in three, at most three."""
    return 1 if len(form) <= 4 else 2 if len(form) <= 7 else 3


class ListIndex:
    """Inverted index of character n-grams over one attribute's list."""

    def __init__(self, entries: list[tuple[int, str, str | None]], aliases: dict[str, str], threshold: float, margin: float):
        self.threshold, self.margin = threshold, margin
        self.forms: dict[str, int] = {}
        self.sorted_forms: dict[str, int] = {}
        self.by_id: dict[int, list[str]] = defaultdict(list)
        self.vocabulary: set[str] = set()
        for ref_id, en, dv in sorted(entries, key=lambda e: e[0]):
            for name in (en, dv):
                if name and (ws := words(normalise(name))):
                    self._add(ws, ref_id)
        known = dict(self.forms)
        for typed, meant in aliases.items():
            target = known.get(compact(words(normalise(meant or ""))))
            if target is not None and (ws := words(normalise(typed))):
                self._add(ws, target)
        df: dict[str, int] = defaultdict(int)
        grams = {(i, f): self._grams(f) for i, fs in self.by_id.items() for f in fs}
        for g in grams.values():
            for x in set(g):
                df[x] += 1
        n = max(1, len(grams))
        self.idf = {x: math.log(1 + n / c) for x, c in df.items()}
        self.unseen = math.log(1 + n)
        self.postings: dict[str, list[tuple[tuple[int, str], float]]] = defaultdict(list)
        for key, g in grams.items():
            vector = self._vector(g)
            for x, w in vector.items():
                self.postings[x].append((key, w))

    def _add(self, ws: list[str], ref_id: int) -> None:
        f = compact(ws)
        self.vocabulary.update(ws)
        if f not in self.forms:
            self.forms[f] = ref_id
            self.by_id[ref_id].append(f)
        self.sorted_forms.setdefault("".join(sorted(ws)), ref_id)

    @staticmethod
    def _grams(form: str) -> list[str]:
        p = f"^{form}$"
        return [p[i : i + n] for n in (2, 3) for i in range(len(p) - n + 1)]

    def _vector(self, grams: list[str]) -> dict[str, float]:
        v: dict[str, float] = defaultdict(float)
        for g in grams:
            v[g] += self.idf.get(g, self.unseen) if hasattr(self, "unseen") else 1.0
        norm = math.sqrt(sum(w * w for w in v.values())) or 1.0
        return {g: w / norm for g, w in v.items()}

    def candidates(self, form: str) -> list[tuple[float, int, str]]:
        """(cosine, ref_id, form) of every form sharing an n-gram, best first."""
        scores: dict[tuple[int, str], float] = defaultdict(float)
        for g, w in self._vector(self._grams(form)).items():
            for key, x in self.postings.get(g, ()):
                scores[key] += w * x
        return sorted(((s, i, f) for (i, f), s in scores.items()), key=lambda c: (-c[0], c[1], c[2]))

    def match(self, value: str) -> tuple[int, float, str]:
        """(ref_id or 0, score, what decided it): exact, cosine, edit, prefix or none."""
        plainly = normalise(value)
        if plainly in FILLERS or re.sub(r"[\s.]+$", "", plainly) in FILLERS:
            return 0, 0.0, "none"
        readings = [r for r in variants(value, self.vocabulary) if r]
        if not readings:
            return 0, 0.0, "none"
        if (i := self.forms.get(compact(readings[0]))) is not None:
            return i, 1.0, "exact"
        found = [(compact(r), self.candidates(compact(r))) for r in readings]
        found = [(form, c) for form, c in found if c]
        if not found:
            return 0, 0.0, "none"
        best = (0, 0.0, "none")
        for _, c in found:  # the cosine decides where an entry is near and the next one is not
            gap = c[0][0] - next((s for s, i, _ in c if i != c[0][1]), 0.0)
            if c[0][0] >= self.threshold and gap >= self.margin and c[0][0] > best[1]:
                best = (c[0][1], c[0][0], "cosine")
        if best[0]:
            return best
        for r in readings:  # the same words in another order
            if (i := self.sorted_forms.get("".join(sorted(r)))) is not None:
                return i, 1.0, "exact"
        for form, c in found[1:] or found:  # an exact check of the candidates in between
            limit = edit_limit(form)
            nearest: dict[int, tuple[int, float]] = {}
            for s, i, f in c:  # every entry that shares an n-gram
                d = (osa(form, f, limit), -s)
                nearest[i] = min(d, nearest.get(i, d))
            near = sorted((d, s, i) for i, (d, s) in nearest.items())
            if near[0][0] <= limit and (len(near) < 2 or near[0][0] < near[1][0] or near[1][1] - near[0][1] >= self.margin):
                score = 1 - near[0][0] / max(len(form), 1)
                if score > best[1]:
                    best = (near[0][2], score, "edit")
            elif len(form) >= 5:
                ids = {i for f, i in self.forms.items() if f.startswith(form)}
                if len(ids) == 1 and best[1] < 0.6:
                    best = (ids.pop(), 0.6, "prefix")
        return best


def free_values(spark: SparkSession, data_dir: str, registry: Registry, listed: set[str]) -> DataFrame:
    """(spec_id, document_id, spec_key, value_text) of the rows whose attribute has a list and whose value is not blank."""
    specs = read_table(spark, data_dir, "document_spec", "spec_id", "document_id", "key_id", "key_raw", "value_text")
    rows = resolve_keys(spark, specs, registry).where(F.col("spec_key").isin(*listed))
    return rows.where(plain(F.col("value_text")) != "").select("spec_id", "document_id", "spec_key", "value_text")


def map_values(rows: DataFrame, entries: list[tuple[str, int, str, str | None]], aliases: dict[str, dict[str, str]], threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """The distinct values of rows (spec_key, value_text), each once -> (spec_key, value_text, n, ref_id, score, decided_by); n rows hold it.

    entries: (spec_key, ref_id, value_en, value_dv); aliases: spec_key -> {typed value: list value}.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        per_key: dict[str, list] = defaultdict(list)
        for key, ref_id, en, dv in entries:
            per_key[key].append((ref_id, en, dv))
        index = {k: ListIndex(v, aliases.get(k, {}), threshold, margin) for k, v in per_key.items()}
        for pdf in batches:
            found = [index[k].match(v) if k in index and v is not None else (0, 0.0, "none") for k, v in zip(pdf["spec_key"], pdf["value_text"], strict=True)]
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(found, columns=["ref_id", "score", "decided_by"])], axis=1)

    values = rows.groupBy("spec_key", "value_text").agg(F.count(F.lit(1)).alias("n"))
    return values.mapInPandas(run, "spec_key string, value_text string, n long, ref_id long, score double, decided_by string")


def reference_lists(spark: SparkSession, data_dir: str) -> list[tuple[str, int, str, str | None]]:
    """The entries of all lists, on the driver. The table is fixed; more than ``MAX_ENTRIES`` rows are refused, not gathered."""
    table = read_table(spark, data_dir, "ref_value", "spec_key", "ref_id", "value_en", "value_dv")
    return [tuple(r) for r in fixed_rows(table.where("spec_key is not null and ref_id is not null"), MAX_ENTRIES)]


def matched_values(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame]:
    """(the free values of listed attributes, row by row; their distinct values with the entry)."""
    entries = reference_lists(spark, data_dir)
    aliases = {}
    registry = Registry.load(spark, data_dir)
    for r in registry.attributes:
        try:
            aliases[r.spec_key] = {str(k): str(v) for k, v in json.loads(r.value_aliases or "{}").items()}
        except ValueError:
            aliases[r.spec_key] = {}
    rows = free_values(spark, data_dir, registry, {e[0] for e in entries})
    return rows, cut(map_values(rows, entries, aliases))


def mapped(spark: SparkSession, data_dir: str) -> DataFrame:
    """(spec_id, document_id, spec_key, value_text, ref_id, score, decided_by): every free value of a listed attribute of a live document with its entry."""
    rows, values = matched_values(spark, data_dir)
    key = ["spec_key", "value_text"]
    rows = of_live_documents(rows, read_table(spark, data_dir, "search_document", "id"), hot=hot_documents(read_table(spark, data_dir, "document_spec", "document_id")))
    return hot_join(rows, values.drop("n"), key, hot_keys(values, key), F.col("spec_id"))


def p1_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """(spec_id, ref_id): the entry meant, 0 for none."""
    return mapped(spark, data_dir).select("spec_id", "ref_id").distinct()


def p1_unmatched(spark: SparkSession, data_dir: str) -> DataFrame:
    """The values without an entry, with their number of rows."""
    live = mapped(spark, data_dir).where("ref_id = 0").select("spec_id", "spec_key", plain(F.col("value_text")).alias("value")).distinct()
    return live.groupBy("spec_key", "value").agg(F.count(F.lit(1)).alias("rows"))
