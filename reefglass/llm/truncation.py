"""Problem 4: values that lost their end, and how often each source cuts.

1. Near-copies (five-word shingles, similarity 0.8 and more). A text is looked up among the beginnings
   of the others: a longer text offers every beginning that is long enough to be 0.8 of it, by its
   min-hash bands and its last two words; where a beginning has fewer than nine shingles, 0.8 leaves no
   room for a difference, and one key of its words finds all. Only hashes of keys and texts are moved;
   per key two texts that go on inside the phrase and two that go on after it stay as representatives,
   so nothing is paired within a key. The representatives' texts are aligned word by word in a band. What
   they leave open is looked up among all texts of the field by its rarest shingles, of which two texts
   at 0.8 share one at least: every near-copy is met, and what the sizes do not rule out is aligned. An
   unmarked text whose near-copy goes on inside the phrase (or inside the word) is cut; where a copy
   shows a sentence or an item of a list to end there, the closing words decide.
2. Terminality. All other texts are scored by how often their closing words close a text of the
   field: counts of word contexts over the whole corpus (partial counts per task, merged by sum), from
   the longest context with support ``SUPPORT`` down to the single word. Fields whose texts mostly end
   in a stop count sentence ends, others count text ends, where a word that is the beginning of a much
   commoner one is a fragment.
3. Marks of a cut (an ellipsis, half an entity, an open bracket, a letter without its vowel sign, a
   comma) decide at once; so do a final stop and a remark added after the end. Lengths at which
   values pile up are field limits: there the closing words must speak clearly for an end.

Defined results: null, blank and filler values are no case and do not count; repeated rows count
once; texts of any length are read whole; empty tables give no rows and an empty report.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import ne

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reefglass.checkpoints import cut
from reefglass.functions.text import is_filler
from reefglass.llm.batches import sliced
from reefglass.operators.skew import hot_join, hot_keys
from reefglass.sources.tables import read_table

SHINGLE, BANDS, BAND, SIMILARITY = 5, 3, 2, 0.8
EXACT = 12  #: beginnings of up to so many words have under nine shingles
SUPPORT, STATE_SUPPORT = 6, 30
#: Least share of closing uses: cuts strike any word, about one occurrence in 200, so a title word needs little more.
CLEAR_PROSE, CLEAR_TITLE, CLEAR_AT_LIMIT, CLEAR_TITLE_AT_LIMIT = 0.04, 0.015, 0.6, 0.3
_STOPS = frozenset(".!?؟。۔")
_MARK = re.compile(r"(?:…|\.\.\.|\[\.{2,}\]|\[…\]|\((?:cont|contd|more|ctd)\.?\)?|&#?[A-Za-z0-9]{0,7}|�|[-–,،;:(\[{/&+])$")
_REMARK = re.compile(r"\s(?:\((?:[^()]{0,24}\d[^()]{0,12}|[^()]{1,16})\)|\[[^\[\]]{0,24}\d[^\[\]]{0,6}\]|#\w{1,12}|(?:call|tel|phone|ref|id|contact|fax)\b[.: ]*(?:no\.? ?)?\+?[\d\- ]{3,16})$", re.IGNORECASE)
_ADDITION = re.compile(r"[\"'”’)\]]*(?:[.,](?!\d)|[!?؟۔،؛;:…])|\s(?:[-–—(\[/&|#]|(?:and|or|އަދި)\b)")
_BARE_CONSONANT = re.compile(r"[ހ-ޥ]$")
_NUMBER = re.compile(r"[\d٠-٩]+")
_ENDS = ".!?؟۔"


def fold(token: str) -> str:
    """The form in which words are counted: lower case, numbers alike, no marks around."""
    return _NUMBER.sub("#", token.strip("\"'“”‘’()[]«»*").lower())


def _closes(token: str) -> bool:
    """True if a sentence ends with the token; an ellipsis is no end."""
    t = token.rstrip("\"'”’)]»")
    return t[-1:] in _ENDS and not t.endswith("..") if t else False


def _bare(w: str) -> str:
    return w.rstrip(".,;:!?؟،؛۔…")


def contexts(words: list[str], i: int, title: bool, state: str) -> tuple[str, str, str]:
    """Keys of word i with growing context: the words before it, in titles the state of the list it is in."""
    w = _bare(words[i])
    p = words[i - 1] if i else "^"
    if title:
        return f"1 {w}", f"2 {p} {w}", f"3 {state} {',' if p.endswith((',', '،')) else '-'} {w}"
    pp = words[i - 2] if i > 1 else "^"
    return f"1 {w}", f"2 {p} {w}", f"3 {pp} {p} {w}"


def walk(words: list[str]) -> list[str]:
    """Per word of a title: no list yet, an open list (commas, no closing and), or a closed one."""
    out, state = [], "none"
    for w in words:
        if w == "and" and state != "none":
            state = "closed"
        elif w == "and":
            state = "pair"
        out.append(state)
        if w.endswith((",", "،")):
            state = "after" if state in ("closed", "pair") else "open"
    return out


def stopped(t: str) -> bool:
    """True if the text, without blanks behind it, ends in a stop and what may close it."""
    return t.rstrip("\"'”’)]»")[-1:] in _STOPS if t else False


def verdict(text: str) -> str:
    """cut, whole or open (left to the closing words). Only the end is read, where the patterns can match."""
    t = text.rstrip()
    last = t[-1:]
    # a remark ends in a bracket, a digit, a dash or a word behind a hash; a mark is short unless it is dots in brackets
    remark = (last in ")]-" or last.isdigit() or "#" in t[-13:]) and _REMARK.search(t)
    marked = _MARK.search(t if last == "]" else t[-16:])
    if remark and not marked:
        return "whole"
    if marked or t.count("(") > t.count(")"):
        return "cut"
    if stopped(t):
        return "whole"
    return "cut" if _BARE_CONSONANT.search(t[-1:]) else "open"


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    """One 64-bit hash of several."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * _M1
            h = (h ^ (h >> np.uint64(29))) * _M2
            h = h ^ (h >> np.uint64(32))
    return h


def _hashes(strings: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(strings, dtype=object), categorize=False) if strings else np.zeros(0, np.uint64)


def text_id(field: Column, text: Column) -> Column:
    return F.xxhash64(field, text)


class Tokens:
    """The words of a batch of texts as one array, with what is known of each distinct word."""

    def __init__(self, texts: list[str]):
        split = [t.split() for t in texts]
        self.size = np.array([len(w) for w in split], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.code, words = pd.factorize(np.array([w for ws in split for w in ws], dtype=object)) if self.start[-1] else (np.zeros(0, np.int64), np.zeros(0, object))
        self.words = list(words)

    def each(self, values: list | np.ndarray) -> np.ndarray:
        """Values of the distinct words, spread over all words."""
        return np.asarray(values)[self.code] if len(self.words) else np.zeros(0, np.uint64)


def closing_contexts(t: Tokens, field_no: np.ndarray, title: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(three context hashes of every word, whether the folded word is not empty), as ``contexts`` defines them."""
    folded = [fold(w) for w in t.words]
    bare, full = t.each(_hashes([_bare(w) for w in folded])), t.each(_hashes(folded))
    comma = t.each(np.array([w.endswith((",", "،")) for w in folded], dtype=np.uint64))
    first = np.zeros(len(bare), bool)
    first[t.start[:-1][t.size > 0]] = True
    owner = np.repeat(np.arange(len(t.size)), t.size)
    f, is_title = field_no[owner].astype(np.uint64), title[owner]
    none = np.uint64(1)
    p = np.where(first, none, np.roll(full, 1))
    second = first | np.roll(first, 1)
    pp = np.where(second, none, np.roll(full, 2))
    before_comma = np.where(first, np.uint64(0), np.roll(comma, 1))
    state = np.zeros(len(bare), np.uint64)
    for i in np.nonzero(title)[0]:
        a, b = t.start[i], t.start[i + 1]
        state[a:b] = [_STATES[x] for x in walk([folded[c] for c in t.code[a:b]])]
    keys = np.stack([_mix(f, 1, bare), _mix(f, 2, p, bare), np.where(is_title, _mix(f, 4, state, before_comma, bare), _mix(f, 3, pp, p, bare))]) if len(bare) else np.zeros((3, 0), np.uint64)
    return keys, t.each(np.array([w != "" for w in folded], dtype=bool))


_STATES = {"none": 0, "pair": 1, "open": 2, "closed": 3, "after": 4}


def _count(pdfs: Iterator[pd.DataFrame], titles: set[int], limits: dict[int, set[int]]) -> Iterator[pd.DataFrame]:
    """Partial counts (ctx, n, ends) of the word contexts of all texts, merged within the task up to a million at a time."""
    held: list[pd.DataFrame] = []

    def merged() -> pd.DataFrame:
        return pd.concat(held).groupby("ctx", as_index=False, sort=False).sum() if held else pd.DataFrame({"ctx": [], "n": [], "ends": []}, dtype="int64")

    for pdf in sliced(pdfs):
        texts, field_no = pdf["text"].tolist(), pdf["field_no"].to_numpy()
        t = Tokens(texts)
        title = np.isin(field_no, list(titles))
        keys, some = closing_contexts(t, field_no, title)
        owner = np.repeat(np.arange(len(texts)), t.size)
        ends = t.each(np.array([_closes(w) for w in t.words], dtype=bool)).astype(bool) & ~title[owner]
        for i in np.nonzero(title & (t.size > 0))[0]:
            ends[t.start[i + 1] - 1] = len(texts[i]) not in limits.get(int(field_no[i]), ()) and verdict(texts[i]) != "cut"
        ends = np.tile(ends & some.astype(bool), 3).astype(np.int64)
        ctx, inverse = np.unique(keys.ravel(), return_inverse=True)
        held.append(pd.DataFrame({"ctx": ctx.astype(np.int64), "n": np.bincount(inverse, minlength=len(ctx)), "ends": np.bincount(inverse, ends, len(ctx)).astype(np.int64)}))
        if sum(map(len, held)) > 1_000_000:
            held = [merged()]
            if len(held[0]) > 500_000:
                yield held.pop()
    yield merged()


def word_counts(texts: DataFrame, titles: set[int], limits: dict[int, set[int]]) -> DataFrame:
    """(ctx, n, ends): how often a word in its context occurs and how often it closes."""
    parts = texts.select("field_no", "text").mapInPandas(lambda it: _count(it, titles, limits), "ctx long, n long, ends long")
    return parts.groupBy("ctx").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


def _title_words(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        total: Counter = Counter()
        for field, text in zip(pdf["field_no"], pdf["text"], strict=True):
            words = [fold(w) for w in text.split()]
            for i, w in enumerate(words):
                total[field, "", _bare(w)] += 1
                total[field, words[i - 1] if i else "^", _bare(w)] += 1
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["field_no", "before", "w", "n"])


def commoner(texts: DataFrame, titles: set[int]) -> DataFrame:
    """(field_no, before, start, longer): for the beginning of a title's word, alone (before is '') or after its neighbour, the count of the commonest word that starts so."""
    words = texts.where(F.col("field_no").isin(*titles)).select("field_no", "text").mapInPandas(_title_words, "field_no int, before string, w string, n long")
    words = words.groupBy("field_no", "before", "w").agg(F.sum("n").alias("n")).where(F.length("w") > 1)
    starts = words.select("field_no", "before", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), F.lit(1), i))).alias("start"))
    return starts.groupBy("field_no", "before", "start").agg(F.max("n").alias("longer"))


def after_end(rest: str) -> bool:
    """True if what a longer copy goes on with is an addition: a sentence, a remark or a further item begins there."""
    return bool(_ADDITION.match(rest) or _REMARK.fullmatch(rest))


_EDGE = "\"'“”‘’()[]«»*.,;:!?،؛؟۔…-–—/&|#<>"
OWN, FRAGMENT, INSIDE, AFTER, STOPPED = range(5)


def plain_words(text: str) -> list[str]:
    """The words of a text as near-copies are compared: lower case, no marks around them, marks alone left out."""
    return [w for x in text.split() if (w := x.lower().strip(_EDGE))]


def _prefix_keys(words: np.ndarray, field: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes (texts x places) -> keys (texts x places x BANDS) of the beginnings that end at each place, and which are used."""
    rows, width = words.shape
    keys = np.zeros((rows, width, BANDS), np.uint64)
    used = np.zeros((width, BANDS), bool)
    head = _mix(field)
    for p in range(min(width, EXACT)):
        head = _mix(head, words[:, p])
        keys[:, p, 0] = _mix(head, 7, p)
        used[p, 0] = p + 1 >= SHINGLE
    if width > EXACT:
        used[EXACT:] = True
        grams = _mix(*[words[:, i : width - SHINGLE + 1 + i] for i in range(SHINGLE)])
        tail = _mix(field[:, None], words[:, EXACT - 2 : width - 2], words[:, EXACT - 1 : width - 1], words[:, EXACT:])
        for b in range(BANDS):
            key = _mix(tail, b)
            for h in range(BAND):
                low = np.minimum.accumulate(_mix(grams, 101 + b * BAND + h), axis=1)
                key = _mix(key, low[:, EXACT - SHINGLE + 1 :])
            keys[:, EXACT:, b] = key
    return keys, used


def beginnings(pdfs: Iterator[pd.DataFrame], own_only: bool) -> Iterator[pd.DataFrame]:
    """(key, role, tid): what each text looks up (OWN, FRAGMENT, STOPPED) and offers (INSIDE, AFTER)."""
    for pdf in sliced(pdfs):
        if own_only:
            pdf = pdf[[verdict(x) == "open" for x in pdf["text"]]]
        texts, field, tid = pdf["text"].tolist(), pdf["field_no"].to_numpy().astype(np.uint64), pdf["tid"].to_numpy()
        t = Tokens(texts)
        stripped = [w.lower().strip(_EDGE) for w in t.words]
        blank = t.each(np.array([not w for w in stripped], dtype=bool)).astype(bool)
        hashed = t.each(_hashes(stripped))
        two = t.each(_hashes([w[:2] for w in stripped]))
        size1 = t.each(np.array([len(w) for w in stripped], dtype=np.int64))
        # an addition begins after the word: marks behind it, or a mark or a joining word in front of the next one
        behind = t.each(np.array([bool(re.search(r"[.,!?؟۔،؛;:…][\"'”’)\]]*$", w)) for w in t.words], dtype=bool)).astype(bool)
        front = t.each(np.array([w[:1] in "-–—([/&|#" or w.lower() in ("and", "or", "އަދި") for w in t.words], dtype=bool)).astype(bool)
        follows = behind.copy()
        if len(follows):
            follows[:-1] |= front[1:]
        stop = np.array([stopped(x.rstrip()) and not x.rstrip().endswith("..") for x in texts], dtype=bool)
        asks = np.array([not s and verdict(x) == "open" for s, x in zip(stop, texts, strict=True)], dtype=bool)  # of the others the marks decide
        owner = np.repeat(np.arange(len(texts)), t.size)[~blank]
        size = np.bincount(owner, minlength=len(texts))
        start = np.concatenate([[0], np.cumsum(size)])
        hashed, two, size1, follows = hashed[~blank], two[~blank], size1[~blank], follows[~blank]
        out = []

        def emit(key: np.ndarray, role: int | np.ndarray, of: np.ndarray) -> None:
            out.append(pd.DataFrame({"key": key.astype(np.int64), "role": np.broadcast_to(np.asarray(role, dtype=np.int8), key.shape), "tid": tid[of]}))

        for width in {1 << int(n - 1).bit_length() for n in np.unique(size[size >= SHINGLE])}:  # texts of like length share a table
            mine = np.nonzero((size >= SHINGLE) & (size > width // 2) & (size <= width))[0]
            step = max(1, 1_000_000 // width)
            for part in (mine[i : i + step] for i in range(0, len(mine), step)):
                n = size[part]
                place = np.arange(width)
                at = np.minimum(start[part][:, None] + place, len(hashed) - 1)
                keys, used = _prefix_keys(hashed[at], field[part])
                least = np.maximum(SHINGLE, np.ceil(SIMILARITY * (n - SHINGLE + 1)).astype(int) + SHINGLE - 2)  # a shingle to spare: half a word may add one
                last = n - 1
                for b in range(BANDS):
                    rows = np.nonzero(used[last, b] & (asks | stop)[part])[0]
                    emit(keys[rows, last[rows], b], np.where(stop[part[rows]], STOPPED, OWN), part[rows])
                    cut_in = np.nonzero((n > SHINGLE) & used[last - 1, b] & asks[part])[0]
                    begun, before = at[cut_in, last[cut_in]], keys[cut_in, last[cut_in] - 1, b]
                    emit(np.where(size1[begun] < 2, before, _mix(before, two[begun])), FRAGMENT, part[cut_in])
                    if own_only:
                        continue
                    r, p = np.nonzero((place[None, :] + 1 >= least[:, None]) & (place[None, :] < last[:, None]) & used[None, :, b])
                    emit(keys[r, p, b], np.where(follows[at[r, p]], AFTER, INSIDE), part[r])
                    long = size1[at[r, p + 1]] > 2  # half a word is known by its first two letters
                    emit(_mix(keys[r[long], p[long], b], two[at[r[long], p[long] + 1]]), INSIDE, part[r[long]])
        yield pd.concat(out).drop_duplicates() if out else pd.DataFrame({"key": [], "role": [], "tid": []}, dtype="int64")


def align(cut_off: list[str], whole: list[str]) -> tuple[int, int]:
    """(edits, words of whole that are used): cut_off aligned with a beginning of whole, in a band around the diagonal."""
    n, m, reach = len(cut_off), len(whole), 1 + len(cut_off) // 8
    if n <= m and (changed := sum(map(ne, cut_off, whole))) <= 1:  # no other end is nearer
        return changed, n
    far = n + m
    row = {j: j for j in range(min(m, reach) + 1)}
    for i in range(1, n + 1):
        new = {}
        for j in range(max(0, i - reach), min(m, i + reach) + 1):
            d = row.get(j, far) + 1
            if j:
                d = min(d, row.get(j - 1, far) + (cut_off[i - 1] != whole[j - 1]), new.get(j - 1, far) + 1)
            new[j] = d
        row = new
    if not row:
        return far, 0
    j = min(row, key=lambda j: (row[j], abs(j - n), j))
    return row[j], j


def _shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


@lru_cache(maxsize=64)
def _compared(text: str) -> tuple[list[str], set[tuple[str, ...]]]:
    words = plain_words(text)
    return words, _shingles(words)


def goes_on(text: str, other: str) -> str | None:
    """inside, after or None: where other, if it is a near-copy of text, goes on when text ends.

    A near-copy shares SIMILARITY of the shingles; a last word that other finishes does not count against it.
    """
    (a, s), (b, u) = _compared(text), _compared(other)
    if len(a) < SHINGLE or a == b:
        return None
    near = [len(s & u) >= SIMILARITY * len(s | u), False]
    if any(w != a[-1] and w.startswith(a[-1]) for w in b):  # else it begins no word
        s = _shingles(a[:-1])
        near[True] = bool(s) and len(s & u) + 1 >= SIMILARITY * len(s | u)
    if not any(near):
        return None
    _, j = align(a, b)
    begun = 0 < j <= len(b) and b[j - 1] != a[-1] and b[j - 1].startswith(a[-1])
    if not near[begun]:
        return None
    if begun:
        return "inside"
    if j >= len(b):
        return None
    raw = [m for m in re.finditer(r"\S+", other) if m.group().lower().strip(_EDGE)][j - 1] if j else None
    if raw is None:
        return None
    inner = raw.group().rstrip(_EDGE)
    return "after" if after_end(other[raw.start() + len(inner) :].rstrip()) else "inside"


def _aligned(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        found = [goes_on(a, b) for a, b in zip(pdf["text"], pdf["other"], strict=True)]
        yield pd.DataFrame({"tid": pdf["tid"], "inside": [f == "inside" for f in found], "after": [f == "after" for f in found]})


MAX_BROADCAST_IDS = 1_000_000
#: One text in so many is read for the counts of shingles, and so many of the commonest are known. They only set the order, in which any choice is exact.
COUNTED, MAX_COMMON = 16, 65_536
PARTNER, ENTIRE, BEGUN = range(3)


def _grams(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, whether it is the row's last) of the shingles of the texts of a frame, as ``plain_words`` gives their words."""
    t = Tokens(pdf["text"].tolist())
    stripped = [w.lower().strip(_EDGE) for w in t.words]
    some = t.each(np.array([w != "" for w in stripped], dtype=bool)).astype(bool)
    hashed, row = t.each(_hashes(stripped))[some], np.repeat(np.arange(len(pdf)), t.size)[some]
    n = max(0, len(row) - SHINGLE + 1)
    whole = row[:n] == row[SHINGLE - 1 :]
    row = row[:n]
    gram = _mix(pdf["field_no"].to_numpy().astype(np.uint64)[row], *[hashed[k : k + n] for k in range(SHINGLE)]) if n else np.zeros(0, np.uint64)
    row, gram = row[whole], gram[whole]
    return row, gram, np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)


def _rarest(row: np.ndarray, gram: np.ndarray, common: tuple[np.ndarray, np.ndarray], kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, size of the row's set, place in it) of the rarest shingles: so many that a near-copy, which lacks a fifth of the union at most, has one of them."""
    if not len(row):
        return row, gram, row, row
    known, n = common
    at = np.minimum(np.searchsorted(known, gram), max(len(known) - 1, 0))
    count = np.where(known[at] == gram, n[at], 0) if len(known) else np.zeros(len(gram), np.int64)
    order = np.lexsort((gram, count, row))
    row, gram = row[order], gram[order]
    once = np.append(True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]))
    row, gram = row[once], gram[once]
    size = np.bincount(row)
    place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
    shared = np.ceil(SIMILARITY * size).astype(int)
    if kind != ENTIRE:  # a last word that the other finishes counts as one shared
        shared = np.maximum(1, shared - 1)
    used = place <= (size - shared)[row]
    return row[used], gram[used], size[row][used], place[used]


def rare_shingles(pdfs: Iterator[pd.DataFrame], common: tuple[np.ndarray, np.ndarray], own_only: bool) -> Iterator[pd.DataFrame]:
    """(key, kind, tid, size, place): the rarest shingles of what each text offers (PARTNER) or looks up (ENTIRE, and BEGUN without its last word)."""
    for pdf in sliced(pdfs):
        pdf = pdf.drop_duplicates("tid")
        if own_only:
            pdf = pdf[[verdict(x) == "open" for x in pdf["text"]]]
        row, gram, last = _grams(pdf)
        tid = pdf["tid"].to_numpy()
        for kind in (ENTIRE, BEGUN) if own_only else (PARTNER,):
            inner = ~last if kind == BEGUN else slice(None)
            r, g, size, place = _rarest(row[inner], gram[inner], common, kind)
            yield pd.DataFrame({"key": g.astype(np.int64), "kind": np.full(len(r), kind, np.int8), "tid": tid[r], "size": size.astype(np.int32), "place": place.astype(np.int32)})


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of the commonest shingles of a sample, MAX_COMMON at most."""

    def count(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(pdfs):
            key, n = np.unique(_grams(pdf)[1], return_counts=True)
            yield pd.DataFrame({"key": key.astype(np.int64), "n": n})

    some = texts.where(F.pmod("tid", F.lit(COUNTED)) == 0).select("field_no", "tid", "text").mapInPandas(count, "key long, n long")
    rows = some.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "key").limit(MAX_COMMON).collect()
    known, n = np.array([r.key for r in rows], np.int64).astype(np.uint64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(known)
    return known[order], n[order]


def all_near(texts: DataFrame, settled: DataFrame) -> DataFrame:
    """(tid, uid): for every text that looks up and is not settled, all texts that may be a near-copy of it by its rarest shingles and the sizes.

    Two sets that share c shingles have one among the rarest size - c + 1 of each in any common order, and from the
    places of the first they share there are no more than the rest of either.
    """
    schema = "key long, kind byte, tid long, size int, place int"
    common = common_shingles(texts)
    read = lambda own_only: texts.select("field_no", "tid", "text").mapInPandas(lambda it: rare_shingles(it, common, own_only), schema)
    own = cut(read(True).join(settled, "tid", "left_anti").distinct())
    offered = read(False).select("key", F.col("tid").alias("uid"), F.col("size").alias("usize"), F.col("place").alias("uplace")).repartition("key").distinct()
    hot = hot_keys(own.groupBy("key").agg(F.count(F.lit(1)).alias("n")), ["key"])
    met = hot_join(own, offered, ["key"], hot, F.col("tid")).where("tid <> uid")
    begun = (F.col("kind") == BEGUN).cast("int")
    met = met.where(F.least("size", "usize") + begun >= SIMILARITY * F.greatest("size", "usize") - 1e-6)
    met = met.groupBy("tid", "uid", "kind", "size", "usize").agg(F.min("place").alias("place"), F.min("uplace").alias("uplace"))
    most = F.least(F.col("size") - F.col("place"), F.col("usize") - F.col("uplace"))
    return met.where(most + begun >= SIMILARITY * (F.col("size") + F.col("usize") - most) - 1e-6).select("tid", "uid").distinct()


def aligned(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tid, inside, after) of the texts of stored pairs (tid, uid): whether a near-copy goes on inside the phrase, whether one after it."""
    needed = pairs.select(F.explode(F.array("tid", "uid")).alias("tid")).distinct()
    if needed.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS:
        needed = F.broadcast(needed)
    fetched = cut(texts.select("tid", "text").join(needed, "tid", "left_semi").distinct())
    other = fetched.select(F.col("tid").alias("uid"), F.col("text").alias("other"))
    hot = {k: hot_keys(pairs.groupBy(k).agg(F.count(F.lit(1)).alias("n")), [k]) for k in ("tid", "uid")}
    both = hot_join(hot_join(pairs, fetched, ["tid"], hot["tid"], F.col("uid")), other, ["uid"], hot["uid"], F.col("tid"))
    found = both.select("tid", "text", "other").mapInPandas(_aligned, "tid long, inside boolean, after boolean")
    return found.groupBy("tid").agg(F.max("inside").alias("inside"), F.max("after").alias("after")).where("inside or after")


def early_ends(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """(tid, early) of the texts with a near-copy that goes on where they end.

    early: the near-copies go on inside the phrase, and none shows that a sentence or an item of a list ends there.
    The representatives settle a text that one of them shows to be whole; for all others every near-copy is read.
    """
    schema = "key long, role byte, tid long"
    rows = texts.select("field_no", "tid", "text").mapInPandas(lambda it: beginnings(it, False), schema)
    role = F.col("role")
    ids = [f(F.when(role == r, F.col("tid"))).alias(f"{n}{k}") for r, k in ((INSIDE, "in"), (AFTER, "af")) for f, n in ((F.max, "hi_"), (F.min, "lo_"))]
    met = rows.groupBy("key").agg(F.count_if(role.isin(OWN, FRAGMENT)).alias("n"), F.max(role == STOPPED).alias("stopped"), *ids)
    met = cut(met.where("n > 0 and (hi_in is not null or hi_af is not null or stopped)"))
    own = texts.select("field_no", "tid", "text").mapInPandas(lambda it: beginnings(it, True), schema).where(role.isin(OWN, FRAGMENT))
    keyed = hot_join(own, met, ["key"], hot_keys(met, ["key"]), F.col("tid"))
    keyed = keyed.select("tid", F.col("stopped") & (role == OWN), F.explode(F.array_distinct(F.array("hi_in", "lo_in", "hi_af", "lo_af"))).alias("uid")).toDF("tid", "stopped", "uid")
    keyed = keyed.withColumn("uid", F.when(F.col("uid") != F.col("tid"), F.col("uid"))).where("uid is not null or stopped")
    keyed = cut(keyed.groupBy("tid", "uid").agg(F.max("stopped").alias("stopped")))
    stops = keyed.where("stopped").select("tid", F.lit(True).alias("stopped")).distinct()
    pairs = keyed.where("uid is not null").select("tid", "uid")
    first = cut(aligned(texts, pairs))
    settled = first.join(stops, "tid", "left").where("after or stopped").select("tid")
    rest = cut(all_near(texts, settled).join(pairs, ["tid", "uid"], "left_anti"))
    found = first.unionByName(aligned(texts, rest)).groupBy("tid").agg(F.max("inside").alias("inside"), F.max("after").alias("after"))
    return found.join(stops, "tid", "left").select("tid", (F.col("inside") & ~F.col("after") & F.col("stopped").isNull()).alias("early"))


FIELD_NAMES = ("translated_title", "summary_en", "summary_dv")


def field_profile(texts: DataFrame) -> tuple[set[int], dict[int, set[int]]]:
    """(fields whose texts mostly end without a stop, lengths at which a field's values pile up).

    A pile has eight distinct texts and more, most without a stop, and four times as many of those as
    the median of the sixteen lengths around it has texts. What is gathered is a row per field and pile.
    """
    t = F.rtrim("text")
    stop = t.rlike(r"[.!?؟۔][\"'”’)\]]*$")
    once = texts.select("field_no", "tid", F.length("text").alias("len"), stop.alias("stop")).distinct()  # copies of one text are no pile
    lengths = cut(once.groupBy("field_no", "len").agg(F.count(F.lit(1)).alias("n"), F.count_if("stop").alias("stops")))
    shares = lengths.groupBy("field_no").agg((F.sum("stops") / F.sum("n")).alias("p")).collect()
    steps = F.array(*[F.lit(d) for d in (*range(-8, 0), *range(1, 9))])
    around = lengths.select("field_no", "n", F.explode(F.transform(steps, lambda d: F.col("len") + d)).alias("len"))
    around = around.groupBy("field_no", "len").agg(F.sort_array(F.collect_list("n")).alias("ns"))  # at most sixteen numbers
    median = F.coalesce(F.try_element_at("ns", F.size("ns") - 7), F.lit(0))  # lengths without texts count as 0
    median = F.when(F.size("ns") >= 8, median).otherwise(F.lit(0))
    cut_off = F.col("n") - F.col("stops")
    piles = lengths.join(around, ["field_no", "len"], "left").where(
        (F.col("len") >= 20) & (F.col("n") >= 8) & (cut_off >= 4 * F.greatest(F.lit(1), F.coalesce(median, F.lit(0)))) & (F.col("stops") <= 0.5 * F.col("n"))
    )
    limits: dict[int, set[int]] = {}
    for r in piles.select("field_no", "len").collect():
        limits.setdefault(r.field_no, set()).add(r.len)
    return {r.field_no for r in shares if r.p < 0.3}, limits


def values(spark: SparkSession, data_dir: str) -> DataFrame:
    """(record_key, field_no, origin, text, tid): the usable values; titles, whose ends are counted, once each."""
    i = read_table(spark, data_dir, "iulaan", "iulaan_id", "office_id", "translated_title")
    i = i.select(F.col("iulaan_id").alias("record_key"), F.lit(0).alias("field_no"), F.coalesce(F.col("office_id").cast("string"), F.lit("")).alias("origin"), F.col("translated_title").alias("text"))
    e = read_table(spark, data_dir, "enriched_record", "record_id", "source", "summary_en", "summary_dv")
    fields = F.array(*[F.struct(F.lit(n).alias("field_no"), F.col(FIELD_NAMES[n]).alias("text")) for n in (1, 2)])
    e = e.select(F.col("record_id").cast("string").alias("record_key"), F.coalesce("source", F.lit("")).alias("origin"), F.inline(fields)).select("record_key", "field_no", "origin", "text")
    usable = ((F.length(F.trim("text")) > 64) & F.col("text").rlike(r"[\p{L}\p{N}]")) | ~is_filler(F.col("text"))  # no filler is so long
    return cut(i.where(usable).distinct()).unionByName(e.where(usable)).withColumn("tid", text_id(F.col("field_no"), F.col("text")))


def closings(texts: DataFrame, titles: set[int], limits: dict[int, set[int]]) -> DataFrame:
    """A row per value without its text: verdict, at_limit, title, the hashes k0..k2 of its closing contexts, a title's last words."""

    def close(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(pdfs):
            texts, field_no = pdf["text"].tolist(), pdf["field_no"].to_numpy()
            t = Tokens(texts)
            title = np.isin(field_no, list(titles))
            keys, _ = closing_contexts(t, field_no, title)
            ends = keys[:, np.maximum(t.start[1:] - 1, 0)].astype(np.int64) if keys.shape[1] else np.zeros((3, len(texts)), np.int64)
            out = pdf[["record_key", "field_no", "origin", "tid"]].reset_index(drop=True)
            out["verdict"] = [verdict(x) for x in texts]
            out["at_limit"] = [len(x) in (at := limits.get(int(f), ())) or len(x.rstrip()) in at for x, f in zip(texts, field_no, strict=True)]
            out["title"] = title
            out["k0"], out["k1"], out["k2"] = ends
            last = [[fold(w) for w in x.split()[-2:]] if is_title else [] for x, is_title in zip(texts, title, strict=True)]
            out["w"] = [_bare(x[-1]) if x else None for x in last]
            out["p"] = [None if not x else x[0] if len(x) > 1 else "^" for x in last]
            yield out

    schema = "record_key string, field_no int, origin string, tid long, verdict string, at_limit boolean, title boolean, k0 long, k1 long, k2 long, w string, p string"
    rows = texts.mapInPandas(close, schema)
    return rows.dropDuplicates(["record_key", "field_no"])


def judged(spark: SparkSession, data_dir: str) -> DataFrame:
    """(record_kind, record_key, field_name, origin, tid, verdict, at_limit, terminality, early, is_cut): every usable value once."""
    texts = values(spark, data_dir)
    titles, limits = field_profile(texts)
    rows = cut(closings(texts, titles, limits))
    counts = cut(word_counts(texts, titles, limits))
    # what closes: each distinct triple of contexts once
    triple = ["field_no", "title", "k0", "k1", "k2"]
    triples = cut(rows.where("verdict = 'open'").groupBy(*triple).agg(F.count(F.lit(1)).alias("uses"), F.any_value("w").alias("w"), F.any_value("p").alias("p")))
    long = triples.select(*triple, F.posexplode(F.array("k0", "k1", "k2")).alias("level", "ctx"))
    supported = F.when((F.col("level") == 0) | (F.col("n") >= F.when(F.col("title") & (F.col("level") == 2), STATE_SUPPORT).otherwise(SUPPORT)), F.col("level"))
    found = hot_join(long, counts, ["ctx"], hot_keys(counts, ["ctx"]), F.xxhash64("k1", "k2"), "left").groupBy(*triple).agg(
        F.max_by(F.struct("n", "ends"), supported).alias("best"),
        F.max(F.when(F.col("level") == 0, F.col("n"))).alias("n_word"), F.max(F.when(F.col("level") == 0, F.col("ends"))).alias("ends_word"),
        F.max(F.when(F.col("level") == 1, F.col("n"))).alias("n_pair"),
    )
    starts = cut(commoner(texts, titles))
    last = triples.where("title").select(*triple, "w", "p")
    alone = last.join(starts.where("before = ''").select("field_no", F.col("start").alias("w"), F.col("longer").alias("longer")), ["field_no", "w"], "left")
    pair = last.join(starts.where("before <> ''").select("field_no", F.col("before").alias("p"), F.col("start").alias("w"), F.col("longer").alias("longer_pair")), ["field_no", "p", "w"], "left")
    found = found.join(alone.select(*triple, "longer"), triple, "left").join(pair.select(*triple, "longer_pair"), triple, "left")
    rows = hot_join(rows, found, triple, hot_keys(triples, triple, "uses"), F.col("record_key"), "left")
    rows = hot_join(rows, early_ends(spark, texts), ["tid"], hot_keys(rows.groupBy("tid").agg(F.count(F.lit(1)).alias("n")), ["tid"]), F.col("record_key"), "left")
    own = (F.col("title") & ~F.col("at_limit")).cast("int")  # a title's own end is in the counts: leave it out
    word = F.coalesce(F.try_divide(F.greatest(F.col("ends_word") - own, F.lit(0)), F.col("n_word") - own), F.lit(0.0))
    smooth = F.when(F.col("title"), 4.0).otherwise(0.0)  # short of evidence, a title's context leans on its last word
    terminality = F.coalesce(F.try_divide(F.greatest(F.col("best.ends") - own, F.lit(0)) + smooth * word, F.col("best.n") - own + smooth), F.lit(0.0))
    clear = (
        F.when(F.col("at_limit"), F.when(F.col("title"), CLEAR_TITLE_AT_LIMIT).otherwise(CLEAR_AT_LIMIT)).when(F.col("title"), CLEAR_TITLE).otherwise(CLEAR_PROSE)
    )
    early = F.coalesce("early", F.lit(False))
    longer = F.coalesce("longer", F.lit(0))
    begins = F.coalesce(F.col("longer_pair") >= 3 * F.col("n_pair"), F.lit(False))
    fragment = F.col("title") & (begins | (longer >= 20 * F.coalesce("n_word", F.lit(1))))
    alone = F.col("title") & ~F.col("at_limit") & (F.coalesce("n_word", F.lit(1)) <= 1) & (longer == 0)  # a word of its own
    closes = (alone | (terminality >= clear)) & ~fragment & ~early
    kind = F.when(F.col("field_no") == 0, "iulaan").otherwise("enriched_record")
    name = F.element_at(F.array(*[F.lit(n) for n in FIELD_NAMES]), F.col("field_no") + 1)
    return rows.select(
        kind.alias("record_kind"), "record_key", name.alias("field_name"), "origin", "tid", "verdict", "at_limit", terminality.alias("terminality"), early.alias("early"),
        ((F.col("verdict") == "cut") | ((F.col("verdict") == "open") & ~closes)).alias("is_cut"),
    )


def p4_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """(record_kind, record_key, field_name) of the values that lost their end."""
    return judged(spark, data_dir).where("is_cut").select("record_kind", "record_key", "field_name")


def p4_cut_share(spark: SparkSession, data_dir: str) -> DataFrame:
    """Per field and office or source: values, cut ones and their share."""
    return judged(spark, data_dir).groupBy("field_name", "origin").agg(F.count(F.lit(1)).alias("n_values"), F.count_if("is_cut").alias("n_cut"), F.round(F.avg(F.col("is_cut").cast("double")), 6).alias("share"))
