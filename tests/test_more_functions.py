"""Stemming, translation, pipelines, files: small cases with known results."""

from __future__ import annotations

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from reefglass.functions import lang
from reefglass.functions.stem import porter, porter_stem
from reefglass.operators import pipeline, translate
from reefglass.sources import files


@pytest.mark.parametrize(
    ("word", "stem"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"),
        ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopeful", "hope"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"),
        ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("apartments", "apart"), ("sky", "sky"), ("ރަށު", "ރަށު"), ("a1", "a1"),
    ],
)
def test_porter(word, stem):
    assert porter(word) == stem


def test_stems_in_batches(spark):
    df = spark.createDataFrame([("cats",), ("cat",), (None,)], "w string")
    assert [r.s for r in df.select(porter_stem("w").alias("s")).collect()] == ["cat", "cat", None]


def test_lang_extras(spark):
    one = lambda v, f: spark.createDataFrame([(v,)], "x string").select(f(F.col("x")).alias("y")).first().y
    assert one("Tender", lang.announcement_type) == "ބީލަން" and one(" odd ", lang.announcement_type) == "odd"
    assert one("Full-time", lambda c: lang.vocabulary_label(c, {"full_time": "Full-time work"})) == "Full-time work"
    assert one("2) b\n1. a\n1. aa", lambda c: lang.numbered_lines(c, 2)) == ["aa", "b"]
    assert one("1. a", lambda c: lang.numbered_lines(c, 2)) is None
    assert one("AC, Fans / AC or TV", lambda c: lang.normalize_values(c, {"AC": "Air con"})) == ["Air con", "Fans", "TV"]
    assert "".join(one("One. Two two. Three.", lambda c: lang.chunks(c, 9))) == "One. Two two. Three."
    assert len(one("One. Two two. Three.", lambda c: lang.chunks(c, 9))) == 3
    assert one("a  b\n\n\n\nc", lang.clean_text) == "a b\n\nc"
    assert lang.thaana_variants("ba") == ["ބޢ", "ބަ", "ބާ"] and lang.thaana_variants("b1") == [] and lang.latin_variants("ބާ") == ["baa", "ba"]
    assert len(lang.thaana_variants("dhinun")) <= lang.MAX_VARIANTS and lang.thaana_variants("x" * 30) == []


def test_translation_is_cached_and_checked(spark):
    texts = spark.createDataFrame([("ފެން",), ("ފެން",), ("ގެ",), ("",), (None,)], "text string")
    cache = spark.createDataFrame([], "source_hash string, translation string")

    def provider(batch):
        return [{"ފެން": "water", "ގެ": "ގެ"}.get(t) for t in batch]

    full = translate.translate(texts, cache, "en", provider)
    assert [r.translation for r in full.collect()] == ["water"]
    assert translate.missing(texts, full).count() == 1
    assert translate.translate(texts, cache, "en").count() == 0
    docs = spark.createDataFrame([(1, "ފެން", ""), (2, "ފެން", "kept")], "id int, dv string, en string")
    assert {r.id: r.en for r in translate.fill(docs, "dv", "en", full).collect()} == {1: "water", 2: "kept"}


def test_pipeline(spark):
    rows = [(1, "shop", "ގެ", "Room for rent 7776828", "", None, 0.5, None, None), (2, "shop", "Room for rent 7776828", "ގެ", "", None, 0.5, None, None)]
    df = spark.createDataFrame(rows, "id long, source string, title_en string, title_dv string, summary_en string, contact_phone string, quality double, price decimal(12,2), published_at timestamp")
    out, done = pipeline.index_build().run(df)
    got = {r.id: r for r in out.collect()}
    assert got[1].title_en == "Room for rent 7776828" and got[1].contact_phone == "7776828"
    assert got[1].dedupe_key == got[2].dedupe_key and got[1].is_duplicate and not got[2].is_duplicate and got[2].duplicate_count == 2
    assert done == ["route", "contacts", "quality", "key", "reposts"]
    assert pipeline.index_build().run(df, skip=("key",), dry=True)[1] == ["route", "contacts", "quality", "reposts"]


def test_promotion(spark):
    specs = spark.createDataFrame([(1, None, "Engine Size", 5.0, "cc"), (2, None, "engine-size", 6.0, "cc"), (3, 9, "brand", None, "")], "spec_id int, key_id long, key_raw string, value_num double, unit string")
    reg = spark.createDataFrame([(9, "brand", "enum", "")], "key_id long, spec_key string, datatype string, unit string")
    given, registry = pipeline.promote_key(specs, reg, "engine_size", 10)
    assert {r.spec_id: r.key_id for r in given.collect()} == {1: 10, 2: 10, 3: 9}
    assert ("engine_size", "numeric", "cc") in {(r.spec_key, r.datatype, r.unit) for r in registry.collect()}


def test_docx_and_bytes(spark, tmp_path):
    xml = '<w:document><w:p><w:t>First &amp; last</w:t></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t xml:space="preserve">b </w:t></w:p></w:tc></w:tr></w:tbl></w:document>'
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_docx(spark, str(tmp_path)).collect()}
    assert got == {"x.docx": "First & last\na | b", "bad.docx": None}
    pages = spark.createDataFrame([("a", 5000, 2, "ok"), ("b", 100, 2, "ok"), ("c", 0, 0, "failed")], "path string, chars int, pages int, status string")
    assert {r.path: r.needs_ocr for r in files.scanned(pages).collect()} == {"a": False, "b": True, "c": True}


def test_corpus_is_skewed_and_repeatable(spark):
    a, b = files.zipf_corpus(spark, 200), files.zipf_corpus(spark, 200)
    assert a.collect() == b.collect()
    top = a.select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").count().orderBy(F.desc("count")).first()
    assert top.w == "word1" and top["count"] > 200 * 60 * 0.4


def test_quantities_of_every_key(spark, data_dir):
    """extract_units against a plain loop over all rows, those without a key included."""
    import re

    from reefglass.plans import catalog

    unit = re.compile(r"(?<![A-Za-z0-9])([0-9]+(?:\.[0-9]+)?)\s*(kwh|mah|ghz|mhz|sqft|inch|kw|gb|tb|mb|kg|ml|cm|mm|v|a|w|l)(?![A-Za-z])", re.IGNORECASE | re.ASCII)
    rows = {r.spec_id: r for r in spark.read.parquet(f"{data_dir}/document_spec.parquet").select("spec_id", "key_id", "value_text").collect()}
    want = sorted((r.spec_id, f"{n} {u.lower()}") for r in rows.values() for n, u in unit.findall(r.value_text or "") if not re.fullmatch(r"20\d\d", n))
    got = sorted(tuple(r) for r in catalog.queries()["extract_units"](spark, data_dir).collect())
    assert got == want
    assert any(rows[i].key_id is None for i, _ in got)


def test_search_over_all_sides_equals_brute_force(spark, data_dir):
    """Ranks of every match on the three sides, its totals and its pages, by plain loops over the documents."""
    import re
    import unicodedata
    from collections import defaultdict

    from reefglass.functions import lang
    from reefglass.operators import search
    from reefglass.plans import catalog
    from reefglass.plans.registry import AS_OF
    from reefglass.plans.search_queries import QUERIES, plain_plan

    def words(x):
        x = "".join(" " if unicodedata.category(c)[0] not in "LMN" else c for c in re.sub("[\u200b\u200c\u200d\u2060\ufeff]", "", x or "").translate({0x660 + i: str(i) for i in range(10)}).lower())
        return x.split()

    read = {c: (r[0] if r else "") for c, r in lang.READINGS.items()}
    bare = lambda w: re.sub("[\u07a6-\u07b0]", "", w)
    every = search.documents(spark, data_dir)
    hidden = {r.id for r in search.reposts(every).collect()}
    groups = defaultdict(list)
    for r in every.where("dedupe_key <> ''").collect():
        groups[r.dedupe_key].append((r.published_at is None, r.published_at or 0, r.id))
    assert hidden == {x[2] for g in groups.values() for x in g} - {max(g)[2] for g in groups.values()} and hidden
    docs = {r.id: r for r in every.where("is_active").collect() if r.id not in hidden}
    terms = defaultdict(set)
    for r in search.query_terms(spark, QUERIES).collect():
        terms[r.qid].add((r.side, r.lex))
    assert {(q, *t) for q, own in terms.items() for t in own} == set(plain_plan(QUERIES))
    want = {}
    for i, r in docs.items():
        latin = r.title_latin if (r.title_latin or "").strip(" ") else "".join(read.get(c, c) for c in r.title_dv or "")
        post = [("en", w, 1.0) for w in words(r.title_en)] + [("en", w, 0.4) for w in words(r.summary_en)] + [("latin", w, 1.0) for w in words(latin)]
        post += [("dv", w, 1.0) for w in words(r.title_dv)] + [("dv", w, 0.4) for w in words(r.summary_dv)] + [("dv", bare(w), 0.2) for w in words(r.title_dv) + words(r.summary_dv) if bare(w)]
        for q, own in terms.items():
            hits = [(side, w) for side, lex, w in post if (side, lex) in own]
            if hits:
                want[q, i] = tuple(round(sum(w for x, w in hits if x == side), 6) for side in ("en", "dv", "latin"))
    run = lambda name: catalog.queries()[name](spark, data_dir).collect()
    parts = search.scored_candidates(spark, data_dir, QUERIES, AS_OF, english=False).collect()
    assert {(r.qid, r.id): (round(r.r_en, 6), round(r.r_dv, 6), round(r.r_latin, 6)) for r in parts} == want
    assert any(r.r_dv for r in parts) and any(r.r_latin and not r.r_en for r in parts)
    assert {r.qid: r.matches for r in run("search_totals")} == {q: sum(k[0] == q for k in want) for q in {k[0] for k in want}}
    score = {(r.qid, r.id): r.score for r in parts}
    best = {q: sorted((k for k in score if k[0] == q), key=lambda k: (-score[k], -k[1])) for q in terms}
    newest = {q: sorted((k for k in score if k[0] == q), key=lambda k: (docs[k[1]].published_at is not None, docs[k[1]].published_at, k[1]) if docs[k[1]].published_at else (False, 0, k[1]), reverse=True) for q in terms}
    for name, order, start in (("search_relevance", best, 0), ("search_indexed", best, 0), ("search_page_two", best, 20), ("search_newest", newest, 0)):
        assert {(r.qid, r.id): r.pos for r in run(name)} == {k: p for ks in order.values() for p, k in enumerate(ks, 1) if start < p <= start + 20}, name
    assert {r.qid for r in run("interleave_by_type")} == {k[0] for k in want}


def test_sketched_discovery_is_near_the_exact_one(spark, data_dir):
    from reefglass.operators import facets
    from reefglass.plans import catalog, filter_queries

    q = catalog.queries()
    exact = {r.spec_key: r for r in facets.discover(filter_queries.cells(spark, data_dir), filter_queries._kinds(spark, data_dir), spark.read.parquet(f"{data_dir}/search_document.parquet").select("id").distinct().count(), {**facets.config.DISCOVERY, "facets": 100, "min_coverage": 0.0}).collect()}
    for r in q["facet_discovery_sketched"](spark, data_dir).collect():
        assert abs(r.documents - exact[r.spec_key].documents) <= 1 + 3 * facets.SKETCH_ERROR * exact[r.spec_key].documents
        assert abs(r.entropy - exact[r.spec_key].entropy) < 0.05


def test_snapshots_merge_each_batch_once(spark, tmp_path):
    """Batches and streams into one table: later rows replace earlier ones, a repeated batch changes nothing, marks are cleared."""
    from reefglass.sources.sinks import SnapshotTable, cleared

    schema = "k long, v string, stale_marked_at timestamp"
    t = SnapshotTable(spark, str(tmp_path / "table"))
    assert t.read() is None
    t.replace(spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1)), (2, "b", None)], schema))
    (tmp_path / "in").mkdir()
    for i, rows in enumerate([[(1, "c", dt.datetime(2024, 2, 1))], [(3, "d", None), (1, "e", None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    merge = t.merge_batches(["k"], F.col("v"), cleared)
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    want = {(1, "e", None), (2, "b", None), (3, "d", None)}
    assert {tuple(r) for r in t.read().collect()} == want
    before = t.pointer()
    merge(spark.createDataFrame([(9, "x", None)], schema), 0)  # delivered again after a failure
    assert t.pointer() == before and {tuple(r) for r in t.read().collect()} == want
    t.upsert(spark.createDataFrame([(2, "z", None), (2, "y", None)], schema), ["k"], F.col("v"))
    assert {tuple(r) for r in t.read().collect()} == want - {(2, "b", None)} | {(2, "z", None)}


def test_pieces_lose_nothing(spark):
    from reefglass.functions import lang

    texts = ["", None, "short", "x" * 25, "one two three four five, six. seven\neight nine ten eleven", "no boundary" * 9, "a. " * 40]

    def plain(t, size):
        out = []
        while t:
            end = len(t) if len(t) <= size else next((p + 1 for s in lang.BOUNDARIES if (p := t[:size].rfind(s)) > size * 0.5), size)
            out.append(t[:end])
            t = t[end:]
        return out

    got = spark.createDataFrame([(x,) for x in texts], "t string").select("t", lang.chunks(F.col("t"), 10).alias("p")).collect()
    assert [r.p for r in got] == [plain(r.t or "", 10) for r in got]


def test_table_rows_give_pairs(spark):
    from reefglass.functions import extract

    html = "<table><tr><td>Post :</td><td><ul><li>Cook</li><li> <b>Driver</b></li></ul></td><td>x</td></tr><tr><td>Pay</td><td>5 <i>a</i></td></tr><tr><td>one</td></tr><tr><td></td><td>v</td></tr><tr><td>" + "l" * 121 + "</td><td>v</td></tr></table>"
    got = spark.createDataFrame([(html,), (None,)], "h string").select(extract.table_pairs(F.col("h")).alias("p")).collect()
    assert [r.p for r in got] == [["Post: Cook | Driver", "Pay: 5 a"], []]


def test_documents_rows_are_replaced_together(spark):
    from reefglass.operators import eav_project

    schema = "document_id long, key_raw string, value_num double, value_text string, unit string, provenance string"
    old = spark.createDataFrame([(1, "a", 1.0, "", "", ""), (2, "a", 2.0, "", "", ""), (3, "a", 3.0, "", "", "")], schema)
    new = spark.createDataFrame([(1, "b", 9.0, "", "", ""), (3, "c", 9.0, "", "", "")], schema)
    ids = spark.createDataFrame([(1,), (2,), (2,)], "document_id long")
    assert {(r.document_id, r.key_raw) for r in eav_project.replace_by_document(old, new, ids).collect()} == {(1, "b"), (3, "a")}
    docs = spark.createDataFrame([(7, "12V fan and 5 kg", '{"Colour": "red / blue", "price": "4", "deep": [1]}')], "id long, t string, attrs string")
    reg = spark.createDataFrame([(1, "v"), (2, "colour")], "key_id long, spec_key string")
    rows = eav_project.project([eav_project.of_text(docs, F.col("t")), eav_project.of_map(docs, F.col("attrs")), eav_project.of_text(docs, F.col("t"))], reg).collect()
    assert {(r.key_id, r.key_raw, r.value_num, r.value_text, r.provenance) for r in rows} == {(1, "v", 12.0, "", "extracted"), (None, "kg", 5.0, "", "extracted"), (2, "colour", None, "red", "scraped"), (2, "colour", None, "blue", "scraped")}


def test_trees_of_any_depth(spark):
    from reefglass.operators import catalog_ops

    tree = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(20)], "node string, parent string")
    got = catalog_ops.ancestors(tree)
    assert got.count() == 190 and got.where("node = '19' and ancestor = '0'").first().distance == 19
    assert catalog_ops.ancestors(tree.limit(0)).count() == 0


def test_candidates_equal_plain_python(spark, data_dir):
    """Amounts of every document against plain regular expressions over positions."""
    import re

    from reefglass.functions import extract as ex
    from reefglass.plans import catalog

    py = lambda p: re.compile(p.removeprefix("(?i)"), re.IGNORECASE if p.startswith("(?i)") else 0)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()}
    got, dates = {}, {}
    for r in catalog.queries()["extract_candidates"](spark, data_dir).collect():
        (got if r.kind == "money" else dates if r.kind == "dates" else {}).setdefault(r.doc_id, set()).add(r.value)
    bare = 0
    for i, t in docs.items():
        want, used = set(), set()
        for cur, p in ex.MARKED:
            for raw in py(p).findall(t):
                want.add(f"{cur} {float(raw.replace(',', '')):.2f}")
                used.add(raw)
        spans = [m.span() for m in py(ex.UNIT).finditer(t) if not re.fullmatch(r"20\d\d", m[1])]
        parts = {x for d in dates.get(i, ()) for x in d.split("-")}
        for m in re.finditer(ex.BARE, t, re.ASCII):
            raw = m[1]
            if raw in used or re.fullmatch(r"20\d\d", raw) or raw in parts or raw in set(re.findall(ex.PHONE, t)) or any(a <= m.start() < b for a, b in spans):
                continue
            want.add(f"MVR {float(raw.replace(',', '')):.2f}")
            bare += 1
        assert got.get(i, set()) == want, i
    assert bare > 20


def test_candidates_of_a_text_full_of_numbers(spark):
    """A text is read once, not once for each of its numbers."""
    import time

    from reefglass.functions import extract as ex

    n = 8_000
    t = " ".join(f"item {i} has {i + n} left" for i in range(3000, 3000 + n)) + " since 5 May 2024, 12 kg, call 7771234"
    docs = spark.createDataFrame([(t,)], "t string").repartition(1)
    began = time.time()
    c = docs.select(ex.candidates(F.col("t")).alias("c")).first().c
    assert time.time() - began < 15
    assert c.phones == ["7771234"] and c.dates == ["2024-05-05"] and c.units == ["12 kg"]
    assert [m.amount for m in c.money] == [float(x) for i in range(3000, 3000 + n) for x in (i, i + n)] + [5.0]


def test_candidates_are_found_near_digits_as_in_the_text(spark):
    """Every neighbourhood of two words that a pattern can span, beside words that are left out, spaces of all kinds, and marks that touch."""
    import itertools
    import random

    from reefglass.functions import extract as ex

    bits = ["5", "12", "2024", "7771234", "+960", "1,234.50", "USD", "$", "Rf.", "MVR", "ރުފިޔާ", "ރ", "/-", "-/", "dollars", "kg", "V", "May", "word", "މާރިޗު", "2024-05-06", "6/7/2023", "a.b@c.org", "http://x.y/1", "\u00a0", "#"]
    draw = random.Random(5)
    texts = ["".join(p) for p in itertools.product(bits[:16], ("", " "), bits[:20], ("", "\n "), bits[:5])]
    texts += ["".join(draw.choice(bits) + draw.choice(["", " ", "  ", "\n", "\t"]) for _ in range(draw.randint(0, 40))) for _ in range(1000)] + [None, "", " ", "no digit at all", " 5"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = docs.select("t", ex.candidates(t).alias("c"), ex.all_phones(t).alias("phones"), ex.emails(t).alias("emails"), ex.urls(t).alias("urls"), ex.units(t).alias("units"), ex.dates(t).alias("dates"), ex.marked_amounts(t).alias("marked"), F.regexp_extract_all(F.regexp_replace(t, ex._QUANTITY, " "), F.lit(ex.BARE), 1).alias("numbers"), F.concat(*[F.regexp_extract_all(t, F.lit(p), 1) for _, p in ex.MARKED]).alias("raw"))
    bare = 0
    for r in got.collect():
        assert [r.c[k] for k in ("phones", "emails", "urls", "units", "dates")] == [r[k] for k in ("phones", "emails", "urls", "units", "dates")], r.t
        no = {*(r.raw or ()), *r.phones, *(x for d in r.dates for x in d.split("-"))}
        more = [float(x.replace(",", "")) for x in r.numbers or () if x not in no and not (len(x) == 4 and x.startswith("20"))]
        assert [tuple(m) for m in r.c.money] == list(dict.fromkeys([*map(tuple, r.marked), *(("MVR", x) for x in more)])), r.t
        bare += len(more)
    assert bare > 1000


def test_words_meet_by_their_stems(spark, tmp_path):
    """English words meet by stems, stop words are left out; rows delivered twice and reposts count once, stored or not."""
    import datetime as dt

    from reefglass.operators import search

    t = dt.datetime(2024, 5, 1)
    row = lambda i, title, key="": (i, "shop", f"k{i}", "shopping", "", title, "", "", "", "", None, "MVR", "", "", t, None, True, "{}", [], "", key, 0.5)
    schema = (
        "id long, source string, source_key string, doc_type string, url string, title_en string, title_dv string, title_latin string, summary_en string, summary_dv string, price double, currency string, "
        "island string, atoll string, published_at timestamp, expires_at timestamp, is_active boolean, attrs string, thumbnails array<string>, category_leaf string, dedupe_key string, quality double"
    )
    rows = [row(1, "Water pump"), row(2, "the pumping of water"), row(3, "the of and"), row(4, "Two PUMPS", "same"), row(5, "Two PUMPS", "same"), row(1, "Water pump")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "search_document.parquet"))
    docs = search.read_table(spark, str(tmp_path), "search_document")
    search.Index.write(docs, str(tmp_path / "index"))
    stored = search.Index.read(spark, str(tmp_path / "index"))
    find = lambda q, english: (
        {r.id: r.r_en for r in search.scored_candidates(spark, str(tmp_path), [(1, q)], "2025-01-01", english=english).collect()},
        {r.id: r.r_en for r in search.candidates(spark, stored, [(1, q)], "2025-01-01", english=english).collect()},
    )
    assert find("the pumps", True) == ({1: 1.0, 2: 1.0, 5: 1.0},) * 2
    assert find("the pumps", False) == ({2: 1.0, 3: 1.0, 5: 1.0},) * 2
    assert find("the", True) == ({}, {})


def test_query_plan_widens_by_aliases_and_translations(spark):
    from reefglass.functions import hashes
    from reefglass.operators import search

    plan = lambda q, **kw: {(r.side, r.lex) for r in search.query_plan(spark, [(1, q)], **kw).collect()}
    assert plan("vazIfA") == {("dv", "ވަޒީފާ"), ("dv", "ވޒފ"), ("latin", "vazeefaa")}  # the case of the keys counts
    assert {("en", "goathi"), ("latin", "goathi")} < plan("goathi") and any(s == "dv" for s, _ in plan("goathi"))
    aliases = spark.createDataFrame([("ac", ["air conditioner", "އޭސީ"])], "term string, expands_to array<string>")
    assert plan("AC fan", aliases=aliases) == {("en", w) for w in ("ac", "fan", "air", "conditioner")} | {("latin", w) for w in ("ac", "fan", "air", "conditioner")} | {("dv", "އޭސީ"), ("dv", "އސ")}
    cache = spark.createDataFrame([("public auction", "ނީލަން")], "q string, translation string").select(hashes.text_key(F.col("q")).alias("source_hash"), "translation")
    assert plan("public auction", translations=cache) == {("en", "public"), ("en", "auction"), ("latin", "public"), ("latin", "auction"), ("dv", "ނީލަން"), ("dv", "ނލނ")}
    assert plan('"all quoted"') == set() and plan("") == set()
    assert len(plan(" ".join(f"w{i}" for i in range(90)))) == 64


def test_streaks_end_at_the_first_failed_page(spark, tmp_path):
    from reefglass.plans import catalog

    rows = [(1, 7, "view", 5.0), (2, 7, "click", 5.0), (3, 7, "view", 1.0), *[(i, 7, "view", 5.0) for i in range(4, 9)], (9, 8, "view", 0.0), (10, 8, "view", 5.0), (11, 9, "error", 5.0), (12, 9, "view", 5.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.user_id: r.streak for r in catalog.queries()["seen_page_streak"](spark, str(tmp_path)).collect()}
    assert got == {7: 2, 9: 1}
