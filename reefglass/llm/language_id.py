"""Problem 3: the language of each text and of each of its segments, with a confidence.

A byte convolutional network (embedding, filters of several widths, max pooling, softmax) is trained
in numpy on the words of a bounded sample of labelled documents (``SAMPLE_DOCS``, by a hash of the
id): every distinct word is a fixed-length window of bytes, its target the share of each label among
the word's occurrences. On the executors the network is applied, in batches, to the windows of all
distinct words of a record batch (a bounded cache carries words from batch to batch); words longer
than a window take several, whose outputs are averaged. Letters decide which languages a word can be
in at all (an exact check on the network's output).

Words are joined to segments: runs of fewer than ``MIN_RUN`` words, names, numbers and unsure words
belong to the segment around them. All texts are read whole; no row is shuffled before the result.

Defined results: null, blank, filler and unreadable texts give no segment; a repeated row gives its
rows once; without labelled documents no word can be told apart beyond its letters, then Latin text
counts as English with confidence 0.5; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefglass.functions.text import is_filler
from reefglass.llm.batches import sliced
from reefglass.llm.labels import LANGUAGES, language_label
from reefglass.sources.tables import read_table

SAMPLE_DOCS = 4000
WINDOW = 28
EMBED, FILTERS, WIDTHS = 8, 12, (2, 3, 4)
MIN_RUN = 3
SURE = 0.6
CACHE = 300_000
NEUTRAL, BROKEN = -1, -2

_STRIP = ".,;:!?\"'“”‘’«»()[]{}<>|/\\-–—*_•…،؛؟#+=~`"
_LATIN = re.compile(r"[a-z]+(?:['’.\-/&][a-z]+)*$")
_THAANA = re.compile(r"[ހ-޿]+(?:['’.\-/][ހ-޿]+)*$")
_ARABIC = re.compile(r"[ء-ٟٮ-ۓۺ-ۿ]+(?:['’.\-/][ء-ٟٮ-ۓۺ-ۿ]+)*$")
_NUMBERISH = re.compile(r"[\W\d_]*+$|\W*+[\d٠-٩][\d٠-٩.,:/\-%]*+[a-z]{0,3}\W*$|&[a-z#0-9]+;$|\S+@\S+\.\S+$|https?:\S+$|www\.\S+$")
_ALLOWED = {"latin": np.array([1, 0, 1, 0], bool), "thaana": np.array([0, 1, 0, 0], bool), "arabic": np.array([0, 0, 0, 1], bool)}


def word_of(token: str) -> tuple[str, str]:
    """(word, kind): kind is latin, thaana, arabic, neutral (numbers, marks, addresses) or broken."""
    t = token.strip(_STRIP).lower()
    if len(t) > 5 and len(set(t)) <= 2:
        return t, "broken"
    if _LATIN.match(t):
        return t, "latin" if len(t) > 1 or t in "ai" else "neutral"
    if _THAANA.match(t):
        return t, "thaana"
    if _ARABIC.match(t):
        return t, "arabic"
    return t, "neutral" if _NUMBERISH.match(token.lower()) else "broken"


def _parts(token: str) -> list[str]:
    """The words between the separators in a token, [] unless every one is clean."""
    parts = [p for p in re.split(r"[,;|/\t:]+", token) if p]
    kinds = [word_of(p) for p in parts]
    return parts if len(parts) > 1 and all(k in _ALLOWED and len(w) > 1 or k == "neutral" for w, k in kinds) else []


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-length byte windows of the words (1 marks the ends, 0 fills up) and the word each belongs to."""
    rows, owner = [], []
    for i, w in enumerate(words):
        b = b"\x01" + w.encode("utf-8", "replace") + b"\x01"
        for s in range(0, max(1, len(b) - 4), WINDOW - 4):
            part = b[s : s + WINDOW]
            rows.append(part + bytes(WINDOW - len(part)))
            owner.append(i)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WINDOW), np.array(owner, dtype=np.int64)


class ByteCNN:
    """embedding -> filters of several widths -> max pooling -> softmax."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.5, (256, EMBED)).astype(np.float32), "d": r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(LANGUAGES))).astype(np.float32), "c": np.zeros(len(LANGUAGES), np.float32)}
        for k in WIDTHS:
            self.p[f"w{k}"] = r.normal(0, (2 / (k * EMBED)) ** 0.5, (k * EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{k}"] = np.zeros(FILTERS, np.float32)

    def _columns(self, x: np.ndarray, k: int) -> np.ndarray:
        n = x.shape[1] - k + 1
        return np.concatenate([x[:, i : i + n] for i in range(k)], axis=2)

    def forward(self, b: np.ndarray) -> tuple[np.ndarray, list]:
        x = self.p["e"][b]
        pooled, kept = [], []
        for k in WIDTHS:
            cols = self._columns(x, k)
            z = cols @ self.p[f"w{k}"] + self.p[f"b{k}"]
            at = z.argmax(1)
            m = np.take_along_axis(z, at[:, None, :], 1)[:, 0]
            pooled.append(np.maximum(m, 0))
            kept.append((cols, at, m))
        h = np.concatenate(pooled, 1)
        logits = h @ self.p["d"] + self.p["c"]
        logits -= logits.max(1, keepdims=True)
        q = np.exp(logits)
        return q / q.sum(1, keepdims=True), [h, kept]

    def predict(self, b: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(b[i : i + 4096])[0] for i in range(0, len(b), 4096)]) if len(b) else np.zeros((0, len(LANGUAGES)), np.float32)

    def train(self, b: np.ndarray, target: np.ndarray, weight: np.ndarray, epochs: int = 40, rate: float = 0.015, seed: int = 11) -> ByteCNN:
        r = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(b))
            for s in range(0, len(b), 256):
                i = order[s : s + 256]
                q, (h, kept) = self.forward(b[i])
                g = ((q - target[i]) * weight[i, None] / len(i)).astype(np.float32)
                grad = {"d": h.T @ g, "c": g.sum(0), "e": np.zeros_like(self.p["e"])}
                back = g @ self.p["d"].T
                for j, k in enumerate(WIDTHS):
                    cols, at, top = kept[j]
                    gh = back[:, j * FILTERS : (j + 1) * FILTERS] * (top > 0)
                    picked = np.take_along_axis(cols[:, :, None, :], at[:, None, :, None], 1)[:, 0]  # rows x filters x k*EMBED
                    grad[f"w{k}"] = (gh[:, :, None] * picked).sum(0).T
                    grad[f"b{k}"] = gh.sum(0)
                    gx = gh[:, :, None] * self.p[f"w{k}"].T[None]
                    for t in range(k):
                        byte = np.take_along_axis(b[i], at + t, 1)
                        flat, part = byte.ravel(), gx[:, :, t * EMBED : (t + 1) * EMBED].reshape(-1, EMBED)
                        for d in range(EMBED):
                            grad["e"][:, d] += np.bincount(flat, part[:, d], 256)
                step += 1
                lr = rate * (1 - epoch / epochs * 0.9)
                for k, gr in grad.items():
                    m1[k] += 0.1 * (gr - m1[k])
                    m2[k] += 0.01 * (gr * gr - m2[k])
                    self.p[k] -= lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)
        return self


def fit(labelled: list[tuple[str, str]]) -> dict[str, np.ndarray] | None:
    """The network's parameters, from (text, language) pairs; None if there are none."""
    kinds = {"en": "latin", "dv-Latn": "latin", "dv": "thaana", "ar": "arabic"}
    counts: dict[str, Counter] = defaultdict(Counter)
    total: Counter = Counter()
    for text, lang in labelled:
        for tok, n in Counter(text.split()).items():
            w, kind = word_of(tok)
            if kind == kinds[lang]:
                counts[w][lang] += n
                total[lang] += n
    if not counts:
        return None
    words = sorted(counts)
    target = np.array([[counts[w][x] / max(1, total[x]) for x in LANGUAGES] for w in words], np.float32)
    target = (target / target.sum(1, keepdims=True)) ** 2  # labels are noisy: lean to the commoner one
    target /= target.sum(1, keepdims=True)
    weight = np.array([min(4.0, 0.5 + sum(counts[w].values()) ** 0.5 / 4) for w in words], np.float32)
    b, owner = windows(words)
    return ByteCNN().train(b, target[owner], weight[owner]).p


class Words:
    """token -> (language index, NEUTRAL or BROKEN; confidence), by the network, cached."""

    def __init__(self, params: dict[str, np.ndarray] | None):
        self.net = ByteCNN()
        self.fitted = params is not None
        if params is not None:
            self.net.p = params
        self.code: dict[str, int] = {}
        self.sure: dict[str, float] = {}

    def learn(self, tokens: set[str]) -> None:
        """Makes every token known. The cache is emptied only here, before a batch, never within one."""
        if len(self.code) > CACHE:
            self.code.clear()
            self.sure.clear()
        joined: dict[str, list[str]] = {}  # cells of a table row, items without blanks between
        todo: dict[str, tuple[str, str]] = {}
        for t in tokens:
            if t not in self.code:
                w, kind = word_of(t)
                if kind == "broken" and (parts := _parts(t)):
                    joined[t] = parts
                    todo.update((p, word_of(p)) for p in parts if p not in self.code)
                else:
                    todo[t] = (w, kind)
        self._score({t: x for t, x in todo.items() if x[1] in _ALLOWED})
        for t, (_, kind) in todo.items():
            if kind not in _ALLOWED:
                self.code[t], self.sure[t] = (NEUTRAL if kind == "neutral" else BROKEN), 0.0
        for t, parts in joined.items():
            main = Counter(c for p in parts if (c := self.code[p]) >= 0).most_common(1)
            self.code[t] = main[0][0] if main else NEUTRAL
            self.sure[t] = _mean([self.sure[p] for p in parts if main and self.code[p] == main[0][0]])

    def _score(self, todo: dict[str, tuple[str, str]]) -> None:
        if not todo:
            return
        if self.fitted:
            b, owner = windows([w for w, _ in todo.values()])
            q = self.net.predict(b)
            probs = np.zeros((len(todo), len(LANGUAGES)))
            np.add.at(probs, owner, q)
        else:
            probs = np.tile(np.array([0.75, 1.0, 0.25, 1.0]), (len(todo), 1))
        probs = np.where(np.array([_ALLOWED[k] for _, k in todo.values()]), probs + 1e-9, 0.0)
        probs /= probs.sum(1, keepdims=True)
        best = probs.argmax(1)
        top = probs.max(1)
        for t, i, p in zip(todo, best.tolist(), top.tolist(), strict=True):
            self.code[t] = i if p >= SURE else NEUTRAL
            self.sure[t] = p


def segments(codes: list[int], sure: list[float] | None = None, min_run: int = MIN_RUN) -> list[tuple[int, int, float]]:
    """(language index, words, confidence) of the segments of one text."""
    kinds = set(codes)
    broken = codes.count(BROKEN) if BROKEN in kinds else 0
    kinds -= {NEUTRAL, BROKEN}
    if not kinds:
        return []
    known = len(codes) - codes.count(NEUTRAL)
    garbled = broken * 2 > known
    if len(kinds) == 1 and not garbled:
        n = known - broken
        i = next(iter(kinds))
        return [(i, n, _mean([s for c, s in zip(codes, sure, strict=True) if c == i]) if sure else 1.0)] if n >= min_run else []
    runs: list[list] = []
    for j, c in enumerate(codes):
        if c == NEUTRAL or (c == BROKEN and not garbled):
            continue
        if runs and runs[-1][0] == c:
            runs[-1][1] += 1
            runs[-1][2] += sure[j] if sure else 1.0
        else:
            runs.append([c, 1, sure[j] if sure else 1.0])
    if garbled:  # only long clean stretches count as readable
        runs = [r for r in runs if r[0] != BROKEN and r[1] >= 8]
    return [(c, n, x / n) for c, n, x in _absorb(runs, min_run)]


def _absorb(runs: list[list], min_run: int) -> list[list]:
    """Takes out the runs under min_run, shortest first (of equals, that of the rarer language, then the first).

    What a run separated grows together. The runs are a linked list and the short ones wait in one heap
    per length and language, so the work is in proportion to their number.
    """
    total = Counter()
    waiting: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, (c, n, _) in enumerate(runs):
        total[c] += n
        if n < min_run:
            waiting[n, c].append(i)
    before = [i - 1 for i in range(len(runs))]
    after = [*range(1, len(runs)), -1]
    alive = [True] * len(runs)
    while True:
        for key, queue in waiting.items():
            while queue and not (alive[queue[0]] and runs[queue[0]][1] == key[0]):
                heapq.heappop(queue)
        heads = [(n, total[c], queue[0]) for (n, c), queue in waiting.items() if queue]
        if not heads:
            return [r for r, a in zip(runs, alive, strict=True) if a]
        k = min(heads)[2]
        alive[k] = False
        total[runs[k][0]] -= runs[k][1]
        left, right = before[k], after[k]
        if left >= 0:
            after[left] = right
        if right >= 0:
            before[right] = left
        if left >= 0 and right >= 0 and runs[left][0] == runs[right][0]:
            runs[left][1] += runs[right][1]
            runs[left][2] += runs[right][2]
            alive[right] = False
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            if runs[left][1] < min_run:
                heapq.heappush(waiting[runs[left][1], runs[left][0]], left)


def _mean(x: list[float]) -> float:
    return sum(x) / len(x) if x else 0.0


def identify(texts: DataFrame, params: dict[str, np.ndarray] | None, only_cases: bool) -> DataFrame:
    """texts (record_kind, record_id, field_name, label, text) -> a row per segment, with label and confidence.

    With only_cases, rows only for texts whose label is missing or differs from a segment's language.
    """
    params = None if params is None else {k: np.asarray(v, np.float32) for k, v in params.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(params)
        names = list(LANGUAGES)
        for pdf in sliced(batches):
            split = [t.split() for t in pdf["text"]]
            words.learn(set(chain.from_iterable(split)))
            code, sure = words.code, words.sure
            out = []
            for kind, rid, field, label, toks in zip(pdf["record_kind"], pdf["record_id"], pdf["field_name"], pdf["label"], split, strict=True):
                codes = [code[t] for t in toks]
                found = segments(codes)
                if only_cases and (not found or (label and all(names[c] == label for c, _, _ in found))):
                    continue
                found = segments(codes, [sure[t] for t in toks])
                out += [(kind, rid, field, i, names[c], n, s, label) for i, (c, n, s) in enumerate(found, 1)]
            yield pd.DataFrame(out, columns=["record_kind", "record_id", "field_name", "seg_no", "lang", "words", "confidence", "label"])

    schema = "record_kind string, record_id long, field_name string, seg_no int, lang string, words int, confidence double, label string"
    return texts.mapInPandas(run, schema)


def labelled_sample(docs: DataFrame, rows: int, bound: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """At most ``bound`` labelled documents out of ``rows``: those with the least hashes of their id and text.

    The share of hashes that is looked at gives about twice the bound, so that no whole column is sorted.
    """
    drawn = F.xxhash64("doc_id", "text", F.lit(5))
    near = F.pmod(drawn, F.lit(1 << 40)) < F.lit(int(min(1.0, 2 * bound / max(1, rows)) * (1 << 40)))
    got = docs.select("text", language_label(F.col("lang")).alias("lang"), drawn.alias("drawn")).where(near & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return sorted((r.text, r.lang) for r in got.distinct().orderBy("drawn").limit(bound).select("text", "lang").collect())


def labelled_texts(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every text with the label it comes with: documents.text and three fields of search_document."""
    docs = read_table(spark, data_dir, "documents", "doc_id", "text", "lang").select(
        F.lit("documents").alias("record_kind"), F.col("doc_id").alias("record_id"), F.lit("text").alias("field_name"), language_label(F.col("lang")).alias("label"), "text"
    )
    fields = (("title_en", "en"), ("title_dv", "dv"), ("summary_dv", "dv"))
    sd = read_table(spark, data_dir, "search_document", "id", *[f for f, _ in fields])
    entries = F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(lang).alias("label"), F.col(f).alias("text")) for f, lang in fields])
    sd = sd.select(F.lit("search_document").alias("record_kind"), F.col("id").alias("record_id"), F.inline(entries))
    return docs.unionByName(sd.select(*docs.columns)).where(~is_filler(F.col("text")))


def _identified(spark: SparkSession, data_dir: str, only_cases: bool) -> DataFrame:
    docs = read_table(spark, data_dir, "documents", "doc_id", "text", "lang")
    params = fit(labelled_sample(docs, spark.read.parquet(f"{data_dir}/documents.parquet").count()))
    return identify(labelled_texts(spark, data_dir), params, only_cases)


def p3_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """(record_kind, record_id, field_name, seg_no, lang) of the texts whose label is missing or wrong."""
    return _identified(spark, data_dir, True).select("record_kind", "record_id", "field_name", "seg_no", "lang").distinct()


def p3_segments(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every segment of every text with its number of words and confidence."""
    rows = _identified(spark, data_dir, False)
    return rows.select("record_kind", "record_id", "field_name", "seg_no", "lang", "words", F.round("confidence", 4).alias("confidence"), "label").distinct()
