"""Functions and operators on small cases with known results."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from reefglass.functions import dates, extract, lang, scoring
from reefglass.operators import catalog_ops, enrich, filters, search
from reefglass.sources import html, registry
from reefglass.streaming import logs


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("token", "want"), [("ރަށް", "dv"), ("123", "en"), ("vazeefaa", "dv-Latn"), ("kuyyah", "dv-Latn"), ("apartment", "en"), ("beynun", "dv-Latn"), ("", "en"), (None, "en")])
def test_script(spark, token, want):
    assert one(spark, token, lang.detect_script) == want


def test_keyboard_round_trip(spark):
    assert one(spark, "raSu", lang.decode_keys) == "ރަށު"
    assert one(spark, "ރަށު", lang.encode_keys) == "raSu"
    assert one(spark, "raSu", lang.looks_like_keys) is True
    assert one(spark, "rrr", lang.looks_like_keys) is False
    assert one(spark, "ra#", lang.decode_keys) is None
    assert one(spark, "މާލެ", lang.translit_dv_to_latin) == "maale"


@pytest.mark.parametrize(("q", "want"), [("iphone ރަށު case", "dv"), ("kuyyah dhinun house", "dv-Latn"), ("house", "en"), ("", "en")])
def test_query_script(spark, q, want):
    assert one(spark, q, lang.query_script) == want


def test_trigram_of_a_typo(spark):
    got = spark.range(1).select(lang.trigram_similarity(lang.trigrams(F.lit("ihpone")), lang.trigrams(F.lit("iphone"))).alias("s")).first().s
    assert got == pytest.approx(3 / 11)


@pytest.mark.parametrize(
    ("text", "phones"),
    [("Call 7776828 or 9991234", ["7776828", "9991234"]), ("+960 7776828", ["7776828"]), ("17776828", []), ("77768281", []), ("960-3315555/7776828", ["3315555", "7776828"]), (None, [])],
)
def test_phones(spark, text, phones):
    assert one(spark, text, extract.all_phones) == phones


def test_contacts_and_amounts(spark):
    assert one(spark, "FREE DELIVERY | &7776828", extract.strip_phones) == "FREE DELIVERY"
    assert one(spark, "write a.b@c.mv and a.b@c.mv", extract.emails) == ["a.b@c.mv"]
    assert one(spark, "see https://x.mv/a?b=1) now", extract.urls) == ["https://x.mv/a?b=1"]
    money = lambda t: {(m.currency, m.amount) for m in one(spark, t, extract.marked_amounts)}
    assert money("MVR 5,000 and Rf. 7") == {("MVR", 5000.0), ("MVR", 7.0)}
    assert money("USD 450 or $ 3.5, 12 dollars") == {("USD", 450.0), ("USD", 3.5), ("USD", 12.0)}
    assert money("10,750 ރުފިޔާ -/32,632 7000/-") == {("MVR", 10750.0), ("MVR", 32632.0), ("MVR", 7000.0)}
    c = one(spark, "Call 7771234 or a@b.mv. 4,400. A 12V fan of 2019, MVR 60, on 2024-03-05 and 7 މާރޗް 2025; 88 left. https://x.mv/y", extract.candidates)
    assert c.phones == ["7771234"] and c.emails == ["a@b.mv"] and c.units == ["12 v"] and c.urls == ["https://x.mv/y"] and set(c.dates) == {"2024-03-05", "2025-03-07"}
    assert {("MVR", 60.0), ("MVR", 4400.0), ("MVR", 88.0)} <= {(m.currency, m.amount) for m in c.money} and not {12.0, 2019.0, 2024.0, 7771234.0} & {m.amount for m in c.money}
    assert one(spark, "4 Rooms and More", extract.parse_count) == (4, True) and one(spark, " 12 ", extract.parse_count) == (12, False) and one(spark, "4 cats", extract.parse_count) is None
    assert one(spark, "cafe\u0301 A\u030angstro\u0308m e\u0310", lang.compose) == "café Ångström e\u0310"
    assert one(spark, "<p>a&amp;b&nbsp;&lt;c&gt;</p>", lang.strip_html) == "a&b <c>"
    assert one(spark, "24V-5A-120W / 128 GB 2019 W", extract.units) == ["24 v", "5 a", "120 w", "128 gb"]
    assert one(spark, "2024-3-5, 05/03/2024, 7 March 2025, 99/99/2024", extract.dates) == ["2024-03-05", "2025-03-07"]
    assert tuple(one(spark, "4 Rooms and More", extract.parse_count)) == (4, True)
    assert one(spark, "BC-171/2026/094", extract.identifier_key) == "171-2026-094|BC"
    assert one(spark, "(IUL)22-A/2026/5 and 7924894/3315555 and www.x/1234567", extract.identifiers) == ["22-2026-5|A"]
    assert one(spark, 'a "b c" d', extract.quoted_phrases) == ["b c"]


@pytest.mark.parametrize(("label", "want"), [("vazeefa ah edhey form", "application_form"), ("Iulaan", "main"), ("Annex 1", "annex"), ("x", "unknown"), (None, "unknown")])
def test_roles(spark, label, want):
    assert one(spark, label, lambda c: extract.attachment_role(c, F.lit(""))) == want


def test_html(spark):
    page = '<a class="iulaan-title" href="/iulaan/77">t</a><li class="page-item"><a href="?p">3</a></li><li class="page-item"><a>12</a></li><a href="/f/a.PDF">f</a>'
    assert one(spark, page, html.notice_ids) == ["77"]
    assert one(spark, page, html.last_page) == 12
    assert one(spark, page, html.file_links) == ["/f/a.PDF"]
    assert one(spark, "A: 1\nB: x:y\nA: 2\nnone", html.info_map) == {"A": "1", "B": "x:y"}
    assert one(spark, "<table><tr><td>Kind</td><td> <b>Job</b></td></tr></table>", extract.table_pairs) == ["Kind: Job"]
    assert one(spark, None, lang.strip_html) == ""


@pytest.mark.parametrize(
    ("text", "want"),
    [("5 March 2024 10:30", dt.datetime(2024, 3, 5, 10, 30)), ("5 މާރޗް 2024", dt.datetime(2024, 3, 5, 23, 59)), ("31 February 2024", None), ("5 March 1980", None), ("soon", None), (None, None)],
)
def test_text_dates(spark, text, want):
    assert one(spark, text, dates.parse_text_datetime) == want


def test_net_pay_example(spark):
    a = "array<struct<kind:string,amount:double,basis:string>>"
    row = spark.createDataFrame([(10750.0, [("attendance", 4400.0, "fixed_monthly")], 0.07)], f"b double, a {a}, r double")

    def net(**kw):
        args = {"basic": F.col("b"), "period": F.lit("month"), "allowances": F.col("a"), "pension": F.lit(True), "rate": F.col("r"), "completeness": F.lit("full"), "basic_max": F.lit(None).cast("double")} | kw
        return row.select(scoring.net_pay(**args).alias("n")).first().n

    assert net() == pytest.approx(14397.5)
    assert net(period=F.lit("day")) is None
    assert net(pension=F.lit(False), allowances=F.array().cast(a), completeness=F.lit("basic_only")) is None
    twice = F.concat("a", "a")
    assert net(allowances=twice, basic_max=F.lit(12000.0)) is None
    assert net(allowances=F.array(F.struct(F.lit("x").alias("kind"), F.lit(10.0).alias("amount"), F.lit("per_hour").alias("basis")))) == pytest.approx(10750 * 0.93 + 1600)


def test_error_rate(spark):
    f = lambda c: scoring.char_error_rate(F.lit("ab cd"), c)
    assert one(spark, "abcd", f) == 0 and one(spark, "abxd", f) == 0.25
    assert one(spark, "", lambda c: scoring.char_error_rate(c, F.lit("x"))) == 1.0


def test_filter_grammar():
    p = filters.parse("property", ["price:9..1", "price:5..", "island:A", "island:B:C", "has_images:Yes"])
    assert p["price"][1] == (5.0, None) and p["island"][1] == ["A", "B:C"] and p["has_images"][1] is True
    assert filters.parse_range("9..1") == (1.0, 9.0)
    assert filters.parse("all", ["brand:x"], {"brand": "enum"})["brand"][0].store == "spec"
    for bad in (["nope:1"], ["price"], ["price:a..b"], ["price:5"], ["has_images:maybe"]):
        with pytest.raises(filters.FilterError):
            filters.parse("property", bad)
    assert filters.default_filters("job", []) == (["deadline:open"], ["deadline:open"])
    assert filters.default_filters("job", ["deadline:closed"])[1] == []


def test_interleave(spark):
    rows = [(1, i, "news" if i < 20 else "job", 1.0 / (i + 1), i + 1) for i in range(24)]
    got = search.interleave(spark.createDataFrame(rows, "qid int, id long, doc_type string, score double, pos int"), "doc_type").orderBy("slot").collect()
    kinds = [r.doc_type for r in got]
    assert len(got) == 24 and kinds[:8] == ["news"] * 3 + ["job"] + ["news"] * 3 + ["job"]
    assert [r.id for r in got if r.doc_type == "news"] == list(range(20))


def test_tiers(spark):
    cases = {("Electronics",): "family", ("E", "Mobile Phones & Accessories", "Mobile Phones"): "primary", ("E", "Mobile Phones & Accessories", "Parts", "Battery"): "part", ("E", "Computers", "Laptop Accessories", "Charger"): "accessory", ("Services", "Home", "Aircon Repair"): "service"}
    for path, want in cases.items():
        assert one(spark, list(path), catalog_ops.infer_tier, "array<string>") == want
    assert one(spark, ["E", "Laptop Accessories", "Charger"], catalog_ops.category_key, "array<string>") == "laptop-accessories-charger"


def test_upsert_and_seed(spark):
    cur = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 1), (None, "m", 1)], "k int, v string, o int")
    got = {(r.k, r.v) for r in catalog_ops.upsert(cur, new, ["k"], F.col("o")).collect()}
    assert got == {(1, "c"), (2, "d"), (None, "m")}
    assert {(r.k, r.v) for r in catalog_ops.add_missing(cur, new.select("k", "v").where("k = 2 or v = 'b'"), ["k"]).collect()} == {(1, "a"), (None, "n"), (2, "d")}


def test_streak(spark):
    pages = [("g", p, s) for p, s in ((1, True), (2, True), (3, False), (4, True), (6, True))] + [("h", 2, True)]
    got = {r.group: r.streak for r in catalog_ops.longest_seen_run(spark.createDataFrame(pages, "group string, page long, seen boolean")).collect()}
    assert got == {"g": 2}


def test_gates_and_grounding(spark):
    g = lambda m, c: spark.range(1).select(enrich.gate(F.lit("news"), F.lit(m), F.lit(c)).alias("g")).first().g
    assert tuple(g("job", 0.9)) == ("job", True) and tuple(g("job", 0.7)) == ("news", False) and tuple(g("planet", 1.0)) == ("news", False)
    kept, dropped = enrich.ground_json('{"a": 10750, "b": 99, "c": "Male City", "d": ["gone away far"], "e": true}', "Pay 10,750 in Male City", {"10,750"})
    assert kept == '{"a": 10750, "c": "Male City", "d": [], "e": true}' and dropped == ["b", "d[0]"]
    assert enrich.ground_json("no json", "", set()) == ("{}", ["$"])
    assert enrich.skeleton_gate("ރަށު xx", "ރަށި yy") == "ރަށި xx"


def test_registry():
    @registry.register("test-reader")
    def read(spark, d):
        return None

    assert registry.reader("test-reader") is read and "test-reader" in registry.readers()
    with pytest.raises(ValueError):
        registry.register("test-reader")(read)
    with pytest.raises(KeyError):
        registry.reader("absent")


def test_streams(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=m), u, "view", 1.0) for i, (m, u) in enumerate([(0, 1), (10, 1), (50, 1), (55, 2), (200, 2), (200, 2)])]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    stream = logs.read_events(spark, str(tmp_path / "in"), df.schema, "*.parquet")
    assert stream.isStreaming
    logs.once(stream, ["user_id", "ts"]).writeStream.format("memory").queryName("once_t").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("once_t").count() == 5
    logs.clicks_of_queries(stream, stream).writeStream.format("memory").queryName("join_t").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("join_t").count() == logs.clicks_of_queries(df, df).count()
    # the latest events first: a replay in one batch, and one file a batch under a watermark as wide as the disorder
    for i, part in enumerate((df.where("ts >= '2024-01-01 03:00:00'"), df.where("ts < '2024-01-01 00:20:00'"), df.where("ts between '2024-01-01 00:20:00' and '2024-01-01 02:00:00'"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "worst"))
        for f in (tmp_path / "worst").glob("part-*.parquet"):
            if not f.name.startswith("part-0000x"):
                os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
                f.rename(f.with_name(f"part-0000x{i}.parquet"))
    for name, files, late in (("whole_t", None, "1 hour"), ("each_t", 1, "1 day")):
        worst = logs.read_events(spark, str(tmp_path / "worst"), df.schema, "*.parquet", files)
        logs.clicks_of_queries(worst, worst, late=late).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
        assert spark.table(name).count() == logs.clicks_of_queries(df, df).count(), name
    assert {(r.user_id, r.n) for r in logs.sessions(df).collect()} == {(1, 2), (1, 1), (2, 1), (2, 2)}
    logs.append_log(df, str(tmp_path / "log"))
    assert logs.expired_months(spark, str(tmp_path / "log"), "2024-06-10") == ["2024-01"]
    assert logs.expired_months(spark, str(tmp_path / "log"), "2024-02-10") == []


def test_engine(spark, data_dir):
    from reefglass.engine import Engine

    e = Engine(spark, data_dir, "2025-01-01 00:00:00")
    p = e.search_page("apartment for rent", "property", filters=["price:..100000"])
    assert 0 < p.results.count() <= 20 and p.facets.count() > 0 and p.applied_defaults == []
    assert e.search_page("  ", "all").results.count() == 0
    assert e.search_page("post", "job").applied_defaults == ["deadline:open"]
    assert e.meta()["sources"] and e.suggest("for").count() > 0
    r = spark.createDataFrame([(1, "spam", "x")], "document_id long, reason string, reporter string")
    assert e.report(r, r.union(spark.createDataFrame([(1, "spam", "y"), (1, "spam", "y")], r.schema))).count() == 2
    e.add_overlay(lambda d: d.where("id < 0"))
    assert e.detail(1).count() == 0
