"""The dealt operators against brute force, round trips and held-out cases."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reefglass.llm import language_id as li
from reefglass.llm import mixing, packing, survivors, text_stats, tokens, truncation
from reefglass.llm import value_mapping as vm

ENTRIES = [(1, "Teak Wood", None), (2, "Marine Plywood", None), (3, "Brand New", None), (4, "Accounts Officer", None), (5, "Senior Accounts Officer", None), (6, "Naruthoovaru", "ނަރުތޫވަރު"), (7, "Rattan", None), (8, "Light Grey", None), (9, "Dark Grey", None), (10, "Genuine Leather", None)]


@pytest.fixture(scope="module")
def index():
    return vm.ListIndex(ENTRIES, {"Teak": "TEAK WOOD ", "BNIB": "Brand New", "Nowhere": "not in the list"}, vm.THRESHOLD, vm.MARGIN)


@pytest.mark.parametrize(
    ("typed", "ref"),
    [
        ("Teak Wood", 1), ("tEAK wOOD", 1), ("TeakWood", 1), ("Te​ak Wood", 1), ("Tеak Wood", 1), ("T3ak Wood", 1), ("Tek Wond", 1), ("100% Teak Wood", 1), ("Solid Teak", 1), ("  bnib ", 3),
        ("Brand New condition", 3), ("cond: Brand New", 3), ("Brand-New.", 3), ("Sr Acct Officer", 5), ("A/cs Officer", 4), ("Accounts Officers", 4), ("Officer, Accounts", 4), ("K. Naruthoovaru", 6), ("ނަރުތޫވަރު", 6),
        ("Naruthooavru", 6), ("Naruthoo", 6), ("Lt Gray", 8), ("pure Genuine Leather", 10), ("attan", 7), ("Peat", 0), ("Whalebone", 0), ("n/a", 0), ("?", 0), ("ނޭނގެ", 0), ("Lake Tolmby", 0), ("Nowhere", 0), ("word " * 3000, 0),
    ],
)
def test_mapping(index, typed, ref):
    assert index.match(typed)[0] == ref


def test_inverted_index_equals_brute_force(index):
    rng = random.Random(1)
    for _ in range(200):
        w = "".join(rng.choice("abdeghilnorstuw") for _ in range(rng.randint(2, 12)))
        v = index._vector(index._grams(w))
        brute = {}
        for i, forms in index.by_id.items():
            for f in forms:
                u = index._vector(index._grams(f))
                if s := sum(x * u.get(g, 0) for g, x in v.items()):
                    brute[i, f] = s
        got = {(i, f): s for s, i, f in index.candidates(w)}
        assert got.keys() == brute.keys()
        assert all(math.isclose(got[k], brute[k], rel_tol=1e-9) for k in got)


def test_cosine_decides_and_repeats_count_once(spark, index):
    """Misspellings are decided by the cosine; a value is matched once, however many rows hold it."""
    assert [index.match(v)[2] for v in ("Teak Wood", "Marine Plywod", "Sr Accts Oficer", "Naruthooavru", "Peat")] == ["exact", "cosine", "cosine", "cosine", "none"]
    rows = spark.createDataFrame([("material", "Marine Plywod")] * 500 + [("material", None), ("other", "Marine Plywod")], "spec_key string, value_text string")
    got = {(r.spec_key, r.value_text): (r.n, r.ref_id) for r in vm.map_values(rows, [("material", *e) for e in ENTRIES], {}).collect()}
    assert got == {("material", "Marine Plywod"): (500, 2), ("material", None): (1, 0), ("other", "Marine Plywod"): (1, 0)}


def test_osa_is_the_edit_distance_with_swaps():
    def brute(a, b):
        if not a or not b:
            return len(a) + len(b)
        d = min(brute(a[1:], b) + 1, brute(a, b[1:]) + 1, brute(a[1:], b[1:]) + (a[0] != b[0]))
        return min(d, brute(a[2:], b[2:]) + 1) if len(a) > 1 < len(b) and a[0] == b[1] and a[1] == b[0] else d

    for a, b in itertools.product(["", "ab", "ba", "abc", "acbd", "xyz"], repeat=2):
        assert vm.osa(a, b, 9) == brute(a, b)


def _docs(spark, rows):
    schema = "id long, source string, dedupe_key string, published_at timestamp, indexed_at timestamp, contact_phone string, title_dv string, summary_en string, island string"
    return spark.createDataFrame(rows, schema)


def test_survivors_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    t = lambda n: None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    phones, words = ["5551234", "+960 555 1234", "1234567", "-", None, "0", "7771111", "7777777"], ["Real text", "n/a", "", None, "ok text", "..."]
    rows = []
    for i in range(400):
        pub, idx = rng.choice([None, 1, 2, 3, 9]), rng.choice([2, 5])
        rows.append((i, rng.choice(["gazette", "reefhomes", None]), rng.choice(["a", "b", "c", "d", "", None, f"single{i}"]), t(pub), t(idx), rng.choice(phones), rng.choice(words), rng.choice(words), rng.choice(["Male", "any", "?", None])))
    _docs(spark, rows + rows[:50]).write.parquet(str(tmp_path / "search_document.parquet"))
    spark.createDataFrame([("gazette",), ("reefhomes",)], "source string").write.parquet(str(tmp_path / "doc_source.parquet"))
    want = set()
    for key in "abcd":
        group = sorted((r for r in rows if r[2] == key), key=lambda r: (r[3] is not None and r[3] <= r[4], r[3] if r[3] and r[3] <= r[4] else dt.datetime.min, r[0]), reverse=True)
        want.add((key, "record", group[0][0]))
        good = {"contact_phone": lambda v: v in phones[:2] + ["7771111"], "title_dv": lambda v: v in ("Real text", "ok text"), "summary_en": lambda v: v in ("Real text", "ok text"), "island": lambda v: v == "Male"}
        for j, f in enumerate(good, 5):
            best = next((r[0] for r in group if good[f](r[j])), None)
            if best is not None:
                want.add((key, f, best))
    assert {tuple(r) for r in survivors.p2_found(spark, str(tmp_path)).collect()} == want
    kept = survivors.p2_kept_values(spark, str(tmp_path)).collect()
    assert all(0.5 <= r.posterior <= 1 for r in kept)


def _rival_sources(spark, tmp_path):
    """Groups in which source c, the latest, states what a and b contradict, and fillers besides."""
    t = dt.datetime(2024, 1, 1)
    rows = []
    for g in range(60):
        for i, src in enumerate("abc"):
            island = "Male" if src != "c" else "n/a" if g % 3 else "Hulhumale"
            rows.append((10 * g + i, src, f"g{g}", t + dt.timedelta(days=i), t + dt.timedelta(days=9), "5551234", "text", "text", island))
    _docs(spark, rows).write.parquet(str(tmp_path / "search_document.parquet"))
    spark.createDataFrame([("a",), ("b",), ("c",)], "source string").write.parquet(str(tmp_path / "doc_source.parquet"))
    return survivors.judged_claims(spark, str(tmp_path))


def test_parameters_decide_found_rows(spark, tmp_path):
    shared, judged = _rival_sources(spark, tmp_path)
    islands = lambda j: {(r.dedupe_key, r.id) for r in survivors.survivors(shared, j).where("field_name = 'island'").collect()}
    assert islands(judged) == {(f"g{g}", 10 * g + 1) for g in range(60)}  # c states fillers, and Hulhumale against two
    empty = {3: (0.5, np.full((4, 2), 0.5))}
    assert islands(judged.withColumn("posterior", survivors.posterior(empty))) == {(f"g{g}", 10 * g + 2) for g in range(60)}  # fillers pass
    trusted = {3: (0.5, np.array([[0.5, 0.5], [0.5, 0.5], [0.9, 0.1], survivors.FORM]))}
    assert islands(judged.withColumn("posterior", survivors.posterior(trusted))) == {(f"g{g}", 10 * g + (1 if g % 3 else 2)) for g in range(60)}  # c is believed, fillers are not


def test_column_and_array_posteriors_agree(spark, tmp_path):
    _, judged = _rival_sources(spark, tmp_path)
    for r in judged.where("field_no = 3").limit(50).collect():
        models = survivors.fit_models(judged, 4)
        one = lambda x: np.array([x], dtype=np.int64)
        assert math.isclose(r.posterior, survivors.posteriors(one(r.states), one(r.fills), one(int(r.fit)), *models[3])[0], rel_tol=1e-6)
        break


def test_em_finds_the_sources_that_plant_false_values():
    """Source 1 states nine false values of ten, source 0 hardly any: EM finds it, and stands still."""
    rng = np.random.default_rng(2)
    true = rng.random(20_000) < 0.5
    said = np.stack([rng.random(20_000) < np.where(true, 0.9, 0.1), rng.random(20_000) < np.where(true, 0.3, 0.9)], 1)
    fit = rng.random(20_000) < np.where(true, 0.98, 0.02)
    patterns = pd.DataFrame({"s": said[:, 0] + 2 * said[:, 1], "c": 3, "f": fit.astype(int)}).groupby(["s", "c", "f"]).size().reset_index().to_numpy().astype(np.int64)
    prior, params, rounds = survivors.fit_witnesses(patterns, 2)
    assert rounds < survivors.ROUNDS
    assert abs(prior - 0.5) < 0.02 and np.allclose(params[:2], [[0.9, 0.1], [0.3, 0.9]], atol=0.03)


EN = "the price was lowered as the storm damaged the old structure and forms are available from the council office during office hours".split()
DV = "mi aharu kaunsilu beynunvaa faraaiythakun biid forumge thakethi kuriah gendhaane eve skoolu masakkaiy hushahelhumah edheme".split()
TH = "މި އަހަރު ކައުންސިލު ބޭނުންވާ ފަރާއިޔްތަކުން ބިއިޑް ތަކެތި ކުރިއަށް ގެންދާނެ އެވެ".split()
AR = "مجلس الجزيرة تعلن عن فتح باب تسجيل القوارب الصغيرة في قاعة السوق القديم".split()


def _sentences(words, n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(words) for _ in range(12)) for _ in range(n)]


@pytest.fixture(scope="module")
def params():
    return li.fit([(t, lang) for lang, w, s in (("en", EN, 1), ("dv-Latn", DV, 2), ("dv", TH, 3), ("ar", AR, 4)) for t in _sentences(w, 60, s)])


def test_network_on_held_out_sentences(params):
    w = li.Words(params)
    right = total = 0
    for lang, words, seed in (("en", EN, 11), ("dv-Latn", DV, 12), ("dv", TH, 13), ("ar", AR, 14)):
        for t in _sentences(words, 50, seed):
            toks = t.split()
            w.learn(set(toks))
            found = li.segments([w.code[x] for x in toks])
            right += [li.LANGUAGES[c] for c, _, _ in found] == [lang]
            total += 1
    assert right / total >= 0.97


def test_gradient_is_right():
    """Back propagation against finite differences."""
    net = li.ByteCNN(3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    b, _ = li.windows(["apple", "މަރު"])
    target, h = np.array([[1.0, 0, 0, 0], [0, 1.0, 0, 0]]), 1e-5
    loss = lambda: -float((target * np.log(net.forward(b)[0])).sum() / 2)
    before = {k: v.copy() for k, v in net.p.items()}
    base = loss()
    net.train(b, target, np.ones(2), epochs=1, rate=1e-9)  # a step so small that it is the sign of the gradient
    steps = {key: before[key] - net.p[key] for key in ("d", "w3", "e")}
    for key, step in steps.items():
        at = np.unravel_index(np.abs(step).argmax(), step.shape)
        net.p = {k: v.copy() for k, v in before.items()}
        net.p[key][at] += h
        assert (loss() - base) * step[at] > 0


@pytest.mark.parametrize(
    ("codes", "want"),
    [
        ([0, 0, 0], [0]), ([0, 0], []), ([0, 0, 0, 2, 0, 0], [0]), ([0] * 4 + [1] * 3, [0, 1]), ([0] * 4 + [1] * 2, [0]), ([0, 0, 0, -1, 1, 1, 1, -1, 0, 0, 0], [0, 1, 0]), ([], []), ([-1, -1], []),
        ([0, 2, 0, 2, 0], [0]), ([-2] * 10 + [0, 0, 0], []), ([-2] * 10 + [0] * 8, [0]), ([0, 0, 1, 0, 0], [0]),
    ],
)
def test_segments(codes, want):
    assert [c for c, _, _ in li.segments(codes)] == want


def _absorb_plainly(runs, min_run):
    runs = [list(r) for r in runs]
    total = {}
    for c, n, _ in runs:
        total[c] = total.get(c, 0) + n
    while any(r[1] < min_run for r in runs):
        k = min(range(len(runs)), key=lambda i: (runs[i][1], total[runs[i][0]], i))
        total[runs[k][0]] -= runs[k][1]
        runs.pop(k)
        if 0 < k < len(runs) and runs[k - 1][0] == runs[k][0]:
            runs[k - 1][1] += runs[k][1]
            runs[k - 1][2] += runs[k][2]
            runs.pop(k)
    return runs


def test_short_runs_are_absorbed_as_one_by_one():
    rng = random.Random(5)
    for _ in range(500):
        runs = []
        for _ in range(rng.randint(0, 30)):
            c = rng.choice([x for x in range(4) if not runs or x != runs[-1][0]])
            runs.append([c, rng.choice((1, 1, 2, 2, 3, 5)), 1.0])
        assert li._absorb([list(r) for r in runs], 3) == _absorb_plainly(runs, 3)
    assert li._absorb([[i % 2, 1, 1.0] for i in range(200_000)], 3)[0][0] == 1


def test_words_outlive_a_full_cache(monkeypatch, spark, data_dir):
    """Every token of a batch is known after it was learnt, however small the cache."""
    texts = [r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").where("text is not null").select("text").collect()]
    texts += ["a,b,c;d", "one|two|three", "name:value;name2:value2", "ކ,ހ|ށ"]
    whole = li.Words(None)
    whole.learn({t for x in texts for t in x.split()})
    monkeypatch.setattr(li, "CACHE", 50)
    small = li.Words(None)
    for x in texts:
        small.learn(set(x.split()))
        assert [small.code[t] for t in x.split()] == [whole.code[t] for t in x.split()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A whole sentence.", "whole"), ("A whole sentence. ", "whole"), ("A whole sentence. Call 5550123", "whole"), ("A whole sentence (MVR 120)", "whole"), ("A whole one #A17", "whole"), ("Cut…", "cut"), ("Cut [...]", "cut"),
        ("Cut (cont", "cut"), ("Cut by&nb", "cut"), ("Cut in the m�", "cut"), ("Cut here,", "cut"), ("ކުރިއަށ", "cut"), ("Left open", "open"), ("Notice (Announcement No. 2/2022)", "whole"), ("Notice (Announcement No. 2", "cut"),
    ],
)
def test_verdicts(text, want):
    assert truncation.verdict(text) == want


def _early(spark, texts):
    """text -> whether its near-copies go on inside the phrase, of the texts that have one."""
    df = spark.createDataFrame([(1, t) for t in texts], "field_no int, text string").withColumn("tid", truncation.text_id(F.col("field_no"), F.col("text")))
    of = {r.tid: r.text for r in df.collect()}
    return {of[r.tid]: r.early for r in truncation.early_ends(spark, df).collect()}


def test_verdicts_read_the_end_as_the_whole(spark, data_dir):
    """The shortened look at the end gives what the patterns give on the whole text."""
    import re

    stop = re.compile(r"[.!?؟。۔][\"'”’)\]»]*$")

    def plain(text):
        t = text.rstrip()
        if truncation._REMARK.search(t) and not truncation._MARK.search(t):
            return "whole"
        if truncation._MARK.search(t) or t.count("(") > t.count(")"):
            return "cut"
        return "whole" if stop.search(t) else "cut" if truncation._BARE_CONSONANT.search(t) else "open"

    texts = [r.text for r in truncation.values(spark, data_dir).select("text").collect()]
    ends = ["", ".", "..", "...", " [....]", " [" + "." * 40 + "]", "(cont", " (more)", "&nbsp", "&#39", "-", " call 555-0123", " #A17", " #toolongtobearemark", " (MVR 120)", ".\"", "?)", "]", ")", "5", " ref no. 12-34-", "ކ", "ކަ", ",", "…", " tel +960 7771234"]
    texts += [t + e for t in ("One two", "ކުރި", "", "a (b", "#x 12") for e in ends]
    assert [truncation.verdict(t) for t in texts] == [plain(t) for t in texts]


def test_near_copies_equal_brute_force(spark):
    """Texts cut at a word or in one, some with a word changed as well: what aligning all pairs finds is found, and nothing else."""
    rng = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{i}x" for i in range(400)]
    full = [rng.choices(words, k=rng.choice([8, 12, 20, 90, 150, 150])) for _ in range(160)]
    texts = [" ".join(t) for t in full] + [f"{' '.join(t)}." for t in full[:5]]
    for t in full:
        cut = list(t[: rng.randint(max(6, len(t) * (90 if len(t) > 50 else 75) // 100), len(t) - 1)])
        if len(cut) > 50 and rng.random() < 0.7:
            cut[rng.randint(3, len(cut) - 4)] = "changed"
        if rng.random() < 0.3:
            cut[-1] = cut[-1][:-1]
        texts.append(" ".join(cut))
    got = _early(spark, texts)
    want = {t for t in set(texts) for u in texts if truncation.goes_on(t, u)}
    changed = {t for t in want if "changed" in t}
    assert set(got) <= want and len(changed) > 20
    assert len(got) >= 0.97 * len(want) and len(changed & set(got)) >= 0.9 * len(changed)


def test_vectorised_contexts_are_the_plain_ones():
    """The hashed contexts of a batch fall together exactly where the plain ones do."""
    texts = ["Supply of nails, paint and 12 boards", "supply of nails, paint and 99 boards", "nails", "", "of nails, paint", "(Supply of) nails, paint, tiles and x and y"]
    for title in (True, False):
        t = truncation.Tokens(texts)
        keys, _ = truncation.closing_contexts(t, np.zeros(len(texts), np.int64), np.full(len(texts), title))
        plain = []
        for x in texts:
            words = [truncation.fold(w) for w in x.split()]
            states = truncation.walk(words)
            plain += [truncation.contexts(words, i, title, states[i]) for i in range(len(words))]
        for level in range(3):
            pairs = {(p[level], k) for p, k in zip(plain, keys[level].tolist(), strict=True)}
            assert len(pairs) == len({p for p, _ in pairs}) == len({k for _, k in pairs})


def test_alignment_stays_in_its_band():
    assert truncation.align("a b c d".split(), "a b c d e f".split()) == (0, 4)
    assert truncation.align("a x c d".split(), "a b c d e f".split()) == (1, 4)
    assert truncation.align("a c d e f g h i".split(), "a b c d e f g h i j".split()) == (1, 9)
    assert truncation.goes_on("the shop is open on all days of the wee", "the shop is open on all days of the week") == "inside"
    assert truncation.goes_on("the shop is open on all days of the week", "the shop is open on all days of the week") is None
    assert truncation.goes_on("the shop is open on all days of the week", "The shop is open on all days of the week - call") == "after"


def test_near_copies_of_every_text_of_a_form(spark):
    """Texts that differ in closing marks share their continuations, and one too long hides none behind it."""
    x = "the old pier on the north side of the island was closed for repairs and will stay so until the end of the month"
    y = "visitors of the library are asked to hand in their cards at the desk before they go into the reading room upstairs"
    texts = [x, f"{x}.", f"{x} ", f"{x} of may", y, f"{y} and then {' '.join(f'a{i}' for i in range(40))}", f"{y} today"]
    got = _early(spark, texts)
    assert got[y] is True
    assert {t for t in got if t != f"{x}."} == {x, f"{x} ", y} and not got[x]  # the stopped copy shows that a sentence ends there


def _early_plainly(texts):
    """The same by aligning all pairs, where no text ends in a stop."""
    kinds = {t: {truncation.goes_on(t, u) for u in texts} - {None} for t in texts if truncation.verdict(t) == "open"}
    return {t: "after" not in k for t, k in kinds.items() if k}


def test_near_copies_behind_many_others(spark):
    """Of very many texts that share a key, the one that is a near-copy is found, wherever it sorts."""
    texts = []
    for place in ("north", "south", "east", "west", "old", "new", "upper", "lower"):
        begun = f"tenders are invited for the work at the {place} end of the"
        texts += [f"{begun} pa{w} today" for w in ("ck", "ge", "il", "in", "ir", "le", "lm", "nel", "per", "st", "th", "tio", "ve", "wn")]
        texts += [f"{begun} park today", f"{begun} par"]
    for pay in range(300, 308):
        post = "the post carries a basic salary of mvr {} and a monthly allowance of"
        texts += [f"{post.format(pay)} mvr {pay}", f"{post.format(pay)}", f"{post.format(pay)} - call"][: 2 + pay % 2]
    texts += [f"{post.format(n)} mvr {n}" for n in range(400, 440)] + [f"{post.format(n)} - call" for n in range(500, 540)]
    want = _early_plainly(texts)
    assert len(want) >= 16 and set(want.values()) == {True, False}
    assert _early(spark, texts) == want


def test_every_near_copy_is_found(spark):
    """Texts with words changed, left out or added anywhere, the last ones too: exactly what aligning all pairs finds."""
    rng = random.Random(11)
    words = [f"w{chr(97 + i % 26)}{i}x" for i in range(60)]
    texts = []
    for _ in range(260):
        full = rng.choices(words, k=rng.choice([6, 9, 13, 14, 30, 60]))
        cut = full[: rng.randint(max(5, len(full) * 8 // 10), len(full))]
        for _ in range(rng.randint(0, 2) if len(cut) > 12 else 0):
            i = rng.choice([0, rng.randrange(len(cut)), len(cut) - 2])
            cut[i : i + rng.randint(0, 1)] = rng.choices(words, k=rng.randint(0, 1))
        if rng.random() < 0.3:
            cut[-1] = cut[-1][: rng.randint(1, 3)]
        texts += [" ".join(full), " ".join(cut)]
    want = _early_plainly(texts)
    assert len(want) > 60 and _early(spark, texts) == want


def test_one_text_in_very_many_rows(spark):
    t = "notice of the sale of an old boat that lies in the inner harbour"
    assert _early(spark, [t] * 3000 + [f"{t} of Male"] * 2000) == {t: True}


def test_copies_make_no_limit(spark):
    profile = lambda rows: truncation.field_profile(spark.createDataFrame(rows, "field_no int, text string").withColumn("tid", truncation.text_id(F.col("field_no"), F.col("text"))))
    rows = [(1, f"Text number {i} is whole and ends with a stop here.") for i in range(300)] + [(1, "The same text without a stop in very many rows")] * 200
    _, limits = profile(rows)
    assert not limits
    cut_at_40 = [(1, f"{i:03d} this text goes on until its field ends and more"[:40]) for i in range(60)]
    _, limits = profile(rows + cut_at_40)
    assert limits == {1: {40}}


def test_terminality_finds_cuts(spark, tmp_path):
    rng = random.Random(8)
    ends = ["before any payment is released", "once the deposit has been received", "when all documents are complete"]
    rows, cuts = [], set()
    for i in range(600):
        t = f"Payment can be made by transfer or in cash {rng.choice(ends)}"
        if i % 6 == 0:
            t = t[: rng.randint(25, len(t) - 4)].rstrip()
            cuts.add(str(i))
        elif i % 5:
            t += "."
        rows.append((i, "a", t, None))
    spark.createDataFrame(rows, "record_id long, source string, summary_en string, summary_dv string").write.parquet(str(tmp_path / "enriched_record.parquet"))
    spark.createDataFrame([], "iulaan_id string, office_id int, translated_title string").write.parquet(str(tmp_path / "iulaan.parquet"))
    got = {r.record_key for r in truncation.p4_found(spark, str(tmp_path)).collect()}
    assert len(got & cuts) >= 0.97 * len(cuts)
    assert len(got - cuts) <= 3
    share = truncation.p4_cut_share(spark, str(tmp_path)).first()
    assert share.n_values == 600 and abs(share.share - 1 / 6) < 0.02


def test_a_verified_early_end_is_a_cut(spark, tmp_path):
    """Whatever the closing word: a text that a near-copy goes on from is cut, unless a sentence ends there."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, "a", " ".join([*rng.choices(words, k=12), "released"]) + "." * (i % 4 > 0), None) for i in range(300)]
    x, y, z = (" ".join([*rng.choices(words, k=30), "released"]) for _ in range(3))
    more = [("cut", x), ("", f"{x} to the winner."), ("", y), ("", f"{y}. Ref. 25"), ("", z), ("", f"{z}."), ("", f"{z} to the winner.")]
    rows += [(1000 + i, "a", t, None) for i, (_, t) in enumerate(more)]
    spark.createDataFrame(rows, "record_id long, source string, summary_en string, summary_dv string").write.parquet(str(tmp_path / "enriched_record.parquet"))
    spark.createDataFrame([], "iulaan_id string, office_id int, translated_title string").write.parquet(str(tmp_path / "iulaan.parquet"))
    assert {r.record_key for r in truncation.p4_found(spark, str(tmp_path)).collect()} == {"1000"}


@pytest.mark.parametrize(
    ("rest", "addition"),
    [(" to the winner", False), ("nges", False), (".50", False), (",000", False), (". Ref. 25", True), (" (id 4471)", True), (", Fenelidhoo", True), (" and paint", True), ("؟ ދެން", True), (" android", False), ("-kept flat", False)],
)
def test_additions_after_an_end(rest, addition):
    assert truncation.after_end(rest) == addition


def test_lower_bound_never_exceeds_the_optimum():
    """Against exhaustive packing of small instances."""

    def best(sizes, capacity, bins=()):
        if not sizes:
            return len(bins)
        out = 99
        for i, room in enumerate(bins):
            if room >= sizes[0] and room not in bins[:i]:
                out = min(out, best(sizes[1:], capacity, (*bins[:i], room - sizes[0], *bins[i + 1 :])))
        return min(out, best(sizes[1:], capacity, (*bins, capacity - sizes[0])))

    rng = random.Random(2)
    tight = 0
    for _ in range(60):
        sizes = sorted((rng.randint(1, 20) for _ in range(7)), reverse=True)
        bound, opt = packing.lower_bound(np.array(sizes), 20), best(tuple(sizes), 20)
        assert bound <= opt
        tight += bound == opt
    assert tight >= 45


def test_packing_keeps_every_item_whole(spark):
    rng = random.Random(4)
    sizes = {i: rng.choice([rng.randint(1, 60), 100, 250, 0]) for i in range(500)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, tokens long")
    caps = spark.createDataFrame([(1, 100), (2, 64), (3, None), (1, 100)], "pack_id int, capacity_tokens int")
    p = packing.pack(df, caps, per_part=60).toPandas()
    for pack_id, capacity in ((1, 100), (2, 64)):
        mine = p[p.pack_id == pack_id]
        assert mine.groupby("container_id").tokens.sum().max() <= capacity
        assert mine.groupby("doc_id").tokens.sum().to_dict() == {i: s for i, s in sizes.items() if s}
        pieces = mine.groupby("doc_id").size()
        assert all(pieces[i] == -(-s // capacity) for i, s in sizes.items() if s)
        packed = mine[mine["round"] >= 0].drop_duplicates(["round", "part"])
        assert mine[mine["round"] >= 0].container_id.nunique() <= 1.05 * packed.bound.sum() + 2


def test_mix_reaches_targets(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c"]), rng.randint(20, 200), 1.0 if i % 2 else 0.05) for i in range(6000)]
    sizes = spark.createDataFrame([*rows, (9999, None, 50, 1.0)], "doc_id long, source string, tokens long, weight double")
    targets = spark.createDataFrame([(1, "a", 0.3, 1), (1, "b", 0.5, 3), (1, "c", 0.2, 2), (2, "a", 0.5, 1), (2, "none", 0.5, 4)], "mix_id int, source string, target_share double, max_repeats int")
    plan = mixing.budgets(sizes, targets)
    got = mixing.select_mix(sizes, plan, 6000).toPandas()
    assert (got.groupby(["mix_id", "source"]).copies.max() <= pd.Series({(1, "a"): 1, (1, "b"): 3, (1, "c"): 2, (2, "a"): 1})).all()
    t = got.assign(t=got.tokens * got.copies).groupby(["mix_id", "source"]).t.sum()
    assert abs(t[1, "a"] / t[1].sum() - 0.3) < 0.002 and abs(t[1, "b"] / t[1].sum() - 0.5) < 0.002
    assert set(got[got.mix_id == 2].source) == {"a"}
    full = got[(got.mix_id == 1) & (got.source == "b")]
    assert full.copies.min() >= plan[1]["epochs"] >= 1  # epochs are complete before some are taken once more
    some = got[(got.mix_id == 1) & (got.source == "a")]
    assert some.doc_id.mod(2).mean() > 0.6  # the heavier documents come first


def test_quality_is_the_same_for_long_and_short_texts():
    """A text repeated to any length keeps its weight; repetition within a stretch lowers it."""
    rng = random.Random(6)
    words = [f"word{chr(97 + i % 26)}{'abcdefghij'[i // 26]}" for i in range(100)]
    base = " ".join(rng.sample(words, 100))
    a, b, c, junk, none = mixing.text_quality([base, " ".join([base] * 4), " ".join([base] * 40), "buy now " * 50, None])
    assert a == b == c and junk < 0.5 * a and none == 0.01
    assert mixing.text_quality([]).size == 0 and list(mixing.text_quality(["", None])) == [0.01, 0.01]


def test_bound_of_counted_sizes_is_that_of_the_items():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 500, 3000)
    values, counts = np.unique(sizes, return_counts=True)
    assert packing.lower_bound(sizes, 512) == packing.lower_bound(values, 512, counts)


def test_running_sums_equal_a_sorted_scan(spark):
    rng = random.Random(9)
    rows = [(1 + i % 2, "hot" if i % 3 else "b", i, rng.randint(1, 9), rng.choice([0.1, 0.2, rng.random()])) for i in range(3000)]
    df = spark.createDataFrame(rows, "mix_id int, source string, doc_id long, tokens long, key double")
    got = {(r.mix_id, r.source, r.doc_id): r.before for r in mixing.running_sums(df, 7).collect()}
    total: dict = {}
    for m, s, d, t, _ in sorted(rows, key=lambda r: (r[0], r[1], r[4], r[2])):
        assert got[m, s, d] == total.get((m, s), 0)
        total[m, s] = total.get((m, s), 0) + t


def test_source_names(spark):
    from pyspark.sql import functions as F

    known = ["gazette", "jobkashi", "archive"]
    df = spark.createDataFrame([(x,) for x in ("gazette", " Gazette ", "gazete", "GAZETTE", "jobkahsi", "radio", None, "")], "s string")
    assert [r.m for r in df.select(mixing.source_name(F.col("s"), known).alias("m")).collect()] == ["gazette"] * 4 + ["jobkashi", None, None, None]


def test_token_counts_of_long_texts_are_whole():
    enc = tokens.encoder()
    text = "Forms are available from the office. " * 20_000
    assert abs(tokens.count_tokens(enc, text) - len(enc.encode_ordinary(text))) <= 5
    assert tokens.count_tokens(enc, None) == tokens.count_tokens(enc, "") == 0
    assert enc.decode(enc.encode_ordinary("ނަރުތޫވަރު text")) == "ނަރުތޫވަރު text"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("The price was lowered because the lease ends soon. Forms are available during office hours from the council.", "prose"), ("An item\n- steel rods\n- paint drums\n- two keys", "list"), ("1) copper cable\n2) wall fans\n3) street lamps", "list"),
        ("a police report / hospital linen / street lamps / garden hoses / steel rods", "list"), ("Item name\tQuantity\nsteel rods\t3\npaint drums\t12.50", "table"), ("Item name,Quantity,Unit price\nwater pumps,47,259.14\nwall fans,3,14", "table"),
        ("| Item | Price |\n|---|---|\n| rods | 3 |", "table"), ("Item name        Quantity\nwall fans        3\nwater pumps      44", "table"), ("¤■9%}/4\\>{}@■*$}^#75 >+■%§+@\\&@388", "junk"), ("click here now! " * 30, "junk"), ("", "junk"), (None, "junk"),
        ("qdlvgf fdzghwvdgfkj jkzqxjdvlf hxxdpffkjdap gvcz qjjlaszlsajkjq vlzjpwcdq fksjdjfhfcdp ajwhkc", "junk"), ("Steel rods\npaint drums 12\ntwo keys\nwall fans 3\nhospital linen", "list"), ("ބޮކްކުރާ 2\nއާރު ފަން\nގާޑިޔާ 50\nއޮފީސް މޭޒު", "list"),
        ("this unit of more than ninety characters comes again and again, and there is not one other thing to be read in it at all; " * 4, "junk"),
        ("Bids must reach the office\nLate bids will not be opened, and they will be returned\nThe fee of MVR 45,249 and 8,169 is paid at the counter", "prose"),
    ],
)
def test_kinds(spark, text, kind):
    prose = [(i, "The price was lowered because the lease ends soon. Forms are available during office hours.", "en") for i in range(200)]
    stats = text_stats.statistics(spark.createDataFrame([*prose, (999, text, "en")], "doc_id long, text string, lang string"))
    got = text_stats.scored(stats).withColumn("k", text_stats.kind()).where("doc_id = 999").first()
    assert got.k == kind


@pytest.mark.parametrize("share", [1 / 3, 0.6, 1.0])
@pytest.mark.parametrize(
    ("text", "kind"),
    [("An item\n- steel rods\n- paint drums\n- two keys", "list"), ("Item name\tQuantity\nsteel rods\t3\npaint drums\t12.50", "table"), ("¤■9%}/4\\>{}@■*$}^#75 >+■%§+@\\&@388", "junk"), ("office §x9 #4k }q2 *z1 council hours =%a", "junk")],
)
def test_many_of_a_kind_are_no_norm(spark, text, kind, share):
    """A kind is told however many of a language's documents are of it, and the prose beside it stays prose."""
    prose = "The price was lowered because the lease ends soon. Forms are available during office hours."
    n = round(60 * share)
    stats = text_stats.statistics(spark.createDataFrame([(i, text if i < n else prose, "en") for i in range(60)], "doc_id long, text string, lang string"))
    got = text_stats.scored(stats).select("doc_id", text_stats.kind().alias("k")).collect()
    assert all(r.k == (kind if r.doc_id < n else "prose") for r in got)


def test_batches_are_cut_by_their_texts():
    from reefglass.llm.batches import sliced

    texts = ["a" * 30, None, "", "b" * 500, "c" * 10, "d" * 10, "e" * 95]
    frames = list(sliced(iter([pd.DataFrame({"i": range(7), "text": texts}), pd.DataFrame({"i": [], "text": []})]), most=100))
    assert [i for f in frames for i in f["i"]] == list(range(7)) and len(frames) > 3
    assert all(sum(len(t or "") for t in f["text"]) <= 200 or len(f) <= 3 for f in frames)


@pytest.mark.parametrize("text", ["x" * 500_000, "ކ" * 300_000, "1" + "," * 300_000 + "xxxxx", "." * 500_000, "a." * 200_000, "@." * 200_000, "- " * 200_000, "a,b;" * 100_000, "(" * 300_000, "\"'" * 200_000])
def test_long_runs_take_linear_time(text):
    import time

    start = time.time()
    text_stats.batch_statistics([text], text_stats._Kinds())
    w = li.Words(None)
    w.learn(set(text.split()))
    truncation.verdict(text)
    list(truncation.beginnings(iter([pd.DataFrame({"text": [text], "field_no": [1], "tid": [1]})]), False))
    mixing.text_quality([text])
    assert time.time() - start < 20


def test_statistics_do_not_depend_on_the_batch(spark, data_dir):
    texts = [r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("text").collect()] + [None, "", " ", "\ud7ff 😀" * 10, "x" * 1_200_000]
    whole, lang = text_stats.batch_statistics(texts, text_stats._Kinds())
    for i in [*range(0, len(texts), 7), len(texts) - 1]:
        one, own = text_stats.batch_statistics([texts[i]], text_stats._Kinds())
        assert np.allclose(whole[i], one[0]) and lang[i] == own[0], texts[i]
    assert text_stats.batch_statistics([], text_stats._Kinds())[0].shape == (0, len(text_stats.STATS))


def test_sketches_give_quantiles(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(5, 2, 20_000)
    df = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(x)), "lang": np.where(np.arange(len(x)) % 3, "en", "dv"), "symbol_ratio": x}))
    out = text_stats.scored(df, ("symbol_ratio",)).toPandas()
    true = out.groupby("lang").symbol_ratio.rank(pct=True)
    assert (out.pct_symbol_ratio - true).abs().max() < 0.04
    assert abs(out.z_symbol_ratio.std() - 1) < 0.1
