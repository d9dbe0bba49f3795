"""Search, ranking, sorting and suggesting over search_document."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefglass.checkpoints import ensure_checkpoint_dir
from reefglass.functions import lang, scoring
from reefglass.operators import filters as flt
from reefglass.operators import search as s
from reefglass.plans.registry import AS_OF, AS_OF_US, query
from reefglass.sources.tables import read_table

#: The batch that the named queries ask: English, Thaana, Dhivehi in Latin letters, keys of the Thaana keyboard, and a quoted phrase beside a word.
QUERIES = [(1, "apartment for rent"), (2, "housekeeping supervisor"), (3, "reliable water pumps"), (4, "މަރްކަޒު އާރު ފަން"), (5, "goathi kuyyah"), (6, "wAru fanq"), (7, '"not looked for" Kurieegai')]

_TOK = r"list_filter(regexp_split_to_array(trim(regexp_replace(lower(translate(regexp_replace(coalesce({0}, ''), '[​‌‍⁠﻿]', '', 'g'), '٠١٢٣٤٥٦٧٨٩', '0123456789')), '\s+', ' ', 'g')), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda t: t <> '')"


def tok(c: str) -> str:
    return _TOK.format(c)


def grams(c: str) -> str:
    words = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda t: t <> '')".format(c)
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def sim(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b}))::double / nullif(len({a}) + len({b}) - len(list_intersect({a}, {b})), 0), 0.0)"


def plain_plan(queries: list[tuple[int, str]]) -> list[tuple[int, str, str]]:
    """The terms of queries by plain Python: the other way to ``search.query_plan``, for its SQL and its tests."""
    skeleton = lambda t: re.sub("[ަ-ް]", "", t)
    latin = lambda t: "".join((lang.READINGS[c][:1] or ("",))[0] if c in lang.READINGS else c for c in t)
    out = []
    for qid, text in queries:
        sides: dict[str, list[str]] = {"en": [], "dv": [], "latin": []}
        for raw in re.findall(r"(?:[^\W_]|[ަ-ް])+", re.sub('"[^"]*"', " ", text)):
            t = raw.lower()
            label = plain_label(t)
            if label in ("dv", "keys"):
                th = t if label == "dv" else raw.translate(str.maketrans(lang.KEYS, lang.THAANA))
                sides["dv"] += [th, skeleton(th)]
                sides["latin"].append(latin(th))
            else:
                sides["en"].append(t)
                sides["latin"].append(t)
                sides["dv"] += lang.thaana_variants(t) if label == "dv-Latn" else []
        out += [(qid, side, lex) for side, words in sides.items() for lex in list(dict.fromkeys(w for w in words if w))[:32]]
    return out


def plain_label(t: str) -> str:
    """dv, en, keys or dv-Latn for a word in lower case."""
    if re.search("[ހ-޿]", t):
        return "dv"
    typed = t.translate(str.maketrans(lang.KEYS, lang.THAANA))
    if not t.isdigit() and all(c in lang.KEYS or c.isdigit() for c in t) and re.fullmatch("(?:[ހ-ޥ][ަ-ް]|[0-9])+", typed):
        return "keys"
    hits = 1.0 if t in lang.MARKER_WORDS else min(1.0, 2 * sum(t.count(d) for d in lang.DIGRAPHS) / max(1, len(t)))
    return "en" if t.isdigit() or hits < 0.5 else "dv-Latn"


def plain_scripts(queries: list[tuple[int, str]]) -> list[tuple[int, str, str, str]]:
    """(qid, text, dominant script, labels of the words)."""
    out = []
    for qid, text in queries:
        labels = [plain_label(w.lower()) for w in re.findall(r"(?:[^\W_]|[ަ-ް])+", text)]
        n = {x: labels.count(x) for x in ("dv", "keys", "dv-Latn", "en")}
        best = "dv" if n["dv"] else max(("keys", "dv-Latn", "en"), key=lambda x: n[x]) if labels else "en"
        out.append((qid, text, best, ",".join(labels)))
    return out


def plain_response(text: str) -> str:
    labels = [plain_label(w.lower()) for w in re.findall(r"(?:[^\W_]|[ަ-ް])+", re.sub('"[^"]*"', " ", text))]
    n = {x: labels.count(x) for x in ("dv", "keys", "dv-Latn", "en")}
    return "en" if not n["dv"] and n["en"] > max(n["keys"], n["dv-Latn"]) or not labels else "dv"


_READ = " ".join(f"when '{ch}' then '{r[0] if r else ''}'" for ch, r in lang.READINGS.items())
_LATIN = f"case when trim(coalesce(title_latin, '')) <> '' then title_latin else array_to_string(list_transform(string_split(coalesce(title_dv, ''), ''), lambda c: case c {_READ} else c end), '') end"
_REPOSTS = "dup as (select id from (select id, row_number() over (partition by dedupe_key order by published_at is null desc, published_at desc, id desc) as rn from (select distinct id, dedupe_key, published_at from search_document) where coalesce(dedupe_key, '') <> '') where rn > 1)"
_DOCS = f"{_REPOSTS}, d as (select distinct id, source, doc_type, title_en, title_dv, title_latin, summary_en, summary_dv, price, island, published_at, expires_at, is_active, category_leaf, attrs, quality from search_document where is_active and id not in (select id from dup))"
_Q = "q(qid, q, resp) as (values " + ", ".join(f"({i}, '{t}', '{plain_response(t)}')" for i, t in QUERIES) + ")"
_TERM = ", ".join(f"({i}, '{side}', '{lex}')" for i, side, lex in plain_plan(QUERIES))
_BARE = "regexp_replace({0}, '[ަ-ް]', '', 'g')"
#: Postings of the three sides: titles 1.0, summaries 0.4, Thaana skeletons 0.2.
_RANK = f"""
p as (select id, 'en' as side, unnest({tok('title_en')}) as lex, 1.0 as w from d union all
      select id, 'en', unnest({tok('summary_en')}), 0.4 from d union all
      select id, 'dv', unnest({tok('title_dv')}), 1.0 from d union all select id, 'dv', unnest({tok('summary_dv')}), 0.4 from d union all
      select id, 'dv', {_BARE.format(f"unnest({tok('title_dv')})")}, 0.2 from d union all select id, 'dv', {_BARE.format(f"unnest({tok('summary_dv')})")}, 0.2 from d union all
      select id, 'latin', unnest({tok(_LATIN)}), 1.0 from d),
t(qid, side, lex) as (values {_TERM}),
r as (select qid, id, {", ".join(f"round(coalesce(sum(case when side = '{x}' then w end), 0.0)::double, 9) as r_{x}" for x in ("en", "dv", "latin"))} from p join t using (side, lex) group by all)
"""
_FRESH = f"coalesce(exp(-ln(2.0) * (({AS_OF_US} - epoch_us(published_at)) / 86400e6) / case doc_type when 'news' then 7.0 when 'job' then 14.0 when 'property' then 45.0 else 30.0 end), 0.0)"
_CAND = f"""
c as (select r.*, d.* exclude (id), resp, greatest({sim('g1', 'g0')}, {sim('g2', 'g0')}, {sim('g3', 'g0')}) as trg from r join
      (select *, {grams('title_en')} as g1, {grams('title_dv')} as g2, {grams('title_latin')} as g3 from d) d using (id) join (select qid, resp, {grams('q')} as g0 from q) using (qid)),
f as (select *, round(r_en + r_dv + 0.6 * r_latin + 0.4 * trg + 0.5 * (case when resp = 'dv' and r_dv > 0 or resp = 'en' and r_en > 0 then 1 else 0 end) + 0.3 * {_FRESH} + 0.2 * coalesce(quality, 0.0)
      - 0.5 * (case when epoch_us(expires_at) < {AS_OF_US} then 1 else 0 end), 6) as score from c)
"""
_BASE = f"with {_DOCS}, {_Q}, {_RANK}, {_CAND}"


def _matches(spark: SparkSession, d: str, where=None, english: bool = False) -> DataFrame:
    """Matches of the batch on all three sides; their words meet as they are, as the SQL has no stemmer, or by stems."""
    cand = s.scored_candidates(spark, d, QUERIES, AS_OF, where, english=english)
    return cand.withColumn("views", flt.json_scalar("views").try_cast("double"))


def _ordered(order: str) -> str:
    return f"{_BASE} select qid, id, score, pos, least(total, 500) as total from (select *, row_number() over (partition by qid order by {order}) as pos, count(*) over (partition by qid) as total from (select *, try_cast(json_extract_string(attrs, '$.views') as double) as views from f)) where pos <= 20"


def _top(spark: SparkSession, d: str, sort: str, where=None) -> DataFrame:
    top = s.page(s.top_candidates(_matches(spark, d, where), sort), 1, 20)
    return top.select("qid", "id", "score", F.col("pos").cast("long").alias("pos"), F.col("total").cast("long").alias("total"))


@query("search_relevance", _ordered("score desc, id desc"))
def search_relevance(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, "relevance")


@query("search_newest", _ordered("published_at desc nulls last, id desc"))
def search_newest(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, "newest")


@query("search_price_asc", _ordered("price asc nulls last, score desc, id desc"))
def search_price_asc(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, "price_asc")


@query("search_price_desc", _ordered("price desc nulls last, score desc, id desc"))
def search_price_desc(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, "price_desc")


@query("search_json_number_desc", _ordered("views desc nulls last, score desc, id desc"))
def search_json_number_desc(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, "views_desc")


@query("search_unknown_sort", _ordered("score desc, id desc"))
def search_unknown_sort(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, "no such order")


@query("search_doc_type_filter", _ordered("score desc, id desc").replace("where is_active and", "where is_active and doc_type = 'shopping' and"))
def search_doc_type_filter(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, "relevance", F.col("doc_type") == "shopping")


@query("search_page_two", f"{_BASE} select qid, id, pos from (select qid, id, row_number() over (partition by qid order by score desc, id desc) as pos from f) where pos between 21 and 40")
def search_page_two(spark: SparkSession, d: str) -> DataFrame:
    return s.page(s.top_candidates(_matches(spark, d)), 2, 20).select("qid", "id", F.col("pos").cast("long").alias("pos"))


@query("search_totals", f"{_BASE} select qid, least(count(*), 500)::bigint as total, count(*)::bigint as matches from f group by qid")
def search_totals(spark: SparkSession, d: str) -> DataFrame:
    return _totals(_matches(spark, d))


@query("search_empty", "select 1::integer as qid, 1::bigint as id where false")
def search_empty(spark: SparkSession, d: str) -> DataFrame:
    """A query without words matches nothing, never the whole table."""
    terms = s.query_terms(spark, [(1, "  !! ")])
    return s.ranks(s.postings(s.documents(spark, d)), terms).select("qid", "id")


@query("score_breakdown", f"{_BASE} select qid, id, round(r_en, 6) as r_en, round(r_dv, 6) as r_dv, round(r_latin, 6) as r_latin, round(trg, 6) as trg, round(log10(nullif({_FRESH}, 0.0)), 6) as log_fresh, case when epoch_us(expires_at) < {AS_OF_US} then true else false end as expired, round(sign(score) * ln(1 + abs(score)), 6) as log_score from f")
def score_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """The parts of every match's score; freshness and score as logarithms, as dates far in the future make them huge."""
    from reefglass import config

    as_of = F.lit(AS_OF).cast("timestamp")
    fresh = scoring.freshness(F.col("published_at"), F.col("doc_type"), as_of, config.Ranking())
    sides = [F.round(r, 6).alias(r) for r in ("r_en", "r_dv", "r_latin")]
    return _matches(spark, d).select("qid", "id", *sides, F.round("trg", 6).alias("trg"), F.round(F.log10(F.nullif(fresh, F.lit(0.0))), 6).alias("log_fresh"), F.coalesce(F.col("expires_at") < as_of, F.lit(False)).alias("expired"), F.round(F.signum("score") * F.log1p(F.abs("score")), 6).alias("log_score"))


def _totals(cand: DataFrame) -> DataFrame:
    return cand.groupBy("qid").agg(F.least(F.count(F.lit(1)), F.lit(500)).cast("long").alias("total"), F.count(F.lit(1)).alias("matches"))


@query("query_plan_terms", f"select * from (values {_TERM}) t(qid, side, lex)")
def query_plan_terms(spark: SparkSession, d: str) -> DataFrame:
    """What the batch looks for on each side: skeletons, decoded keys, Latin readings and Thaana spellings."""
    return s.query_plan(spark, QUERIES)


@query("search_stemmed")
def search_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """The best 20 of each query where English words meet by their stems and stop words are left out; SQL has no stemmer."""
    top = s.page(s.top_candidates(_matches(spark, d, english=True)), 1, 20)
    return top.select("qid", "id", "score", F.col("pos").cast("long").alias("pos"), F.col("total").cast("long").alias("total"))


@query("search_indexed", _ordered("score desc, id desc"))
def search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """search_relevance out of a stored index, which is written to the checkpoint folder first."""
    path = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    s.Index.write(read_table(spark, d, "search_document", *s.COLUMNS), path)
    top = s.page(s.top_candidates(s.candidates(spark, s.Index.read(spark, path), QUERIES, AS_OF, english=False)), 1, 20)
    return top.select("qid", "id", "score", F.col("pos").cast("long").alias("pos"), F.col("total").cast("long").alias("total"))


@query("search_all_sides", f"""{_BASE} select qid, id, pos, total, score, matched_lang, title from (select *, row_number() over (partition by qid order by score desc, id desc)::integer as pos, least(count(*) over (partition by qid), 500) as total,
case when r_dv >= r_en and r_dv >= r_latin then 'dv' when r_latin >= r_en then 'dv-Latn' else 'en' end as matched_lang,
case when resp = 'dv' then coalesce(nullif(title_dv, ''), title_en) else coalesce(nullif(title_en, ''), title_dv) end as title from f) where pos <= 20""")
def search_all_sides(spark: SparkSession, d: str) -> DataFrame:
    """The best 20 of each query with the side that matched best and the title in the language of the response."""
    top = s.page(s.top_candidates(_matches(spark, d)), 1, 20)
    matched = F.when((F.col("r_dv") >= F.col("r_en")) & (F.col("r_dv") >= F.col("r_latin")), "dv").when(F.col("r_latin") >= F.col("r_en"), "dv-Latn").otherwise("en")
    title = F.when(F.col("resp") == "dv", F.coalesce(F.nullif("title_dv", F.lit("")), F.col("title_en"))).otherwise(F.coalesce(F.nullif("title_en", F.lit("")), F.col("title_dv")))
    return top.select("qid", "id", "pos", "total", "score", matched.alias("matched_lang"), title.alias("title"))


@query("interleave_by_type")
def interleave_by_type(spark: SparkSession, d: str) -> DataFrame:
    """The best 100 of each query with no kind running longer than three; greedy, so without SQL form."""
    top = s.top_candidates(_matches(spark, d), cap=100)
    return s.interleave(top.select("qid", "id", "doc_type", "score", "pos"), "doc_type").select("qid", "id", "doc_type", "slot")


_MODE = {
    "dual": f"select id, unnest({tok('title_dv')}) as lex, 1.0 as w from d union all select id, unnest({tok('summary_dv')}), 0.4 from d union all select id, regexp_replace(unnest({tok('title_dv')}), '[ަ-ް]', '', 'g'), 0.2 from d union all select id, regexp_replace(unnest({tok('summary_dv')}), '[ަ-ް]', '', 'g'), 0.2 from d",
    "fili": f"select id, unnest({tok('title_dv')}) as lex, 1.0 as w from d union all select id, unnest({tok('summary_dv')}), 0.4 from d",
    "skeleton": f"select id, regexp_replace(unnest({tok('title_dv')}), '[ަ-ް]', '', 'g') as lex, 1.0 as w from d union all select id, regexp_replace(unnest({tok('summary_dv')}), '[ަ-ް]', '', 'g'), 0.4 from d",
}
_MODE_SQL = "with d as (select distinct id, title_dv, summary_dv from search_document) " + " union all ".join(
    f"select '{m}' as mode, lex, count(*)::bigint as n, round(sum(w), 4)::double as weight from ({q}) where lex <> '' group by lex" for m, q in _MODE.items()
)


@query("vector_modes", _MODE_SQL)
def vector_modes(spark: SparkSession, d: str) -> DataFrame:
    """Weights of all Thaana postings in the three modes."""
    docs = s.documents(spark, d, "id", "title_en", "title_dv", "title_latin", "summary_en", "summary_dv")
    parts = [s.postings(docs, m).where("side = 'dv'").withColumn("mode", F.lit(m)) for m in ("dual", "fili", "skeleton")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("mode", "lex").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 4).alias("weight"))


_TERMS = f"""with d as (select distinct id, doc_type, title_en, title_dv, title_latin from search_document),
w as (select doc_type, unnest(list_distinct({tok("concat_ws(' ', title_en, title_dv, title_latin)")})) as term from d),
n as (select term, doc_type, count(*) as n from w where length(term) >= 3 and not regexp_matches(term, '^[0-9]+$') group by all)
select term, case when regexp_matches(term, '[ހ-޿]') then 'thaana' else 'latin' end as script, sum(n)::bigint as freq, max_by(doc_type, row(n, doc_type)) as doc_type from n group by term order by freq desc, term limit 20000"""


@query("suggest_terms_build", _TERMS)
def suggest_terms_build(spark: SparkSession, d: str) -> DataFrame:
    return s.suggest_terms(s.documents(spark, d, "id", "doc_type", "title_en", "title_dv", "title_latin"))


def _suggest_sql(q: str, limit: int) -> str:
    return f"""with terms as ({_TERMS}), s as (select term, starts_with(term, '{q}') as is_prefix, round({sim(grams('term'), grams(f"'{q}'"))}, 6) as sim, freq from terms)
    select * from s where is_prefix or sim > 0.2 order by is_prefix desc, sim desc, freq desc, term limit {limit}"""


def _suggest(spark: SparkSession, d: str, q: str, limit: int) -> DataFrame:
    terms = s.suggest_terms(s.documents(spark, d, "id", "doc_type", "title_en", "title_dv", "title_latin"))
    return s.suggest(terms, q, limit)


@query("suggest_prefix", _suggest_sql("wat", 10))
def suggest_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _suggest(spark, d, "wat", 10)


@query("suggest_trigram_typo", _suggest_sql("apratment", 10))
def suggest_trigram_typo(spark: SparkSession, d: str) -> DataFrame:
    return _suggest(spark, d, "apratment", 10)


@query("trigram_similarity", f"with p as (select p_partkey, {grams('p_name')} as g, {grams('p_type')} as h from part) select p_partkey, round({sim('g', 'h')}, 6) as sim from p")
def trigram_similarity(spark: SparkSession, d: str) -> DataFrame:
    p = s.read_table(spark, d, "part", "p_partkey", "p_name", "p_type")
    return p.select("p_partkey", F.round(lang.trigram_similarity(lang.trigrams(F.col("p_name")), lang.trigrams(F.col("p_type"))), 6).alias("sim"))


@query("stuffing_penalty", r"""with d as (select distinct id, title_en, quality from search_document), t as (select *, regexp_extract_all(lower(coalesce(title_en, '')), '[a-z0-9ހ-޿]+') as w from d),
p as (select *, case when len(w) >= 4 and 1 - len(list_distinct(w))::double / len(w) > 0.15 then 1 - len(list_distinct(w))::double / len(w) else 0.0 end as pen from t)
select id, round(pen, 6) as penalty, round(greatest(0.0, coalesce(quality, 0.0) - pen), 6) as quality from p""")
def stuffing_penalty(spark: SparkSession, d: str) -> DataFrame:
    docs = s.documents(spark, d, "id", "title_en", "quality")
    pen = scoring.stuffing_penalty(F.col("title_en"))
    return docs.select("id", F.round(pen, 6).alias("penalty"), F.round(F.greatest(F.lit(0.0), F.coalesce("quality", F.lit(0.0)) - pen), 6).alias("quality"))


#: Cases of the evaluation: a query and the word that the titles or summaries of its right answers hold, on one side.
CASES = ((1, "en", "apartment"), (2, "en", "housekeeping"), (3, "en", "pumps"), (4, "dv", "ފަން"), (5, "latin", "goathi"), (6, "dv", "އާރު"), (7, "latin", "kurieegai"))
_CASES = ", ".join(f"({i}, '{side}', '{w}')" for i, side, w in CASES)


@query("recall_at_k", f"""{_BASE}, m as (select *, row_number() over (partition by qid order by score desc, id desc) as pos from f),
e(qid, side, word) as (values {_CASES}), right_ids as (select distinct qid, side, id from p join e using (side) where lex = word and w >= 0.4),
n as (select qid, side, count(*) as n from right_ids group by all), h as (select qid, count(*) as hits from right_ids join m using (qid, id) where pos <= 5 group by qid)
select qid, side, least(n, 5)::bigint as wanted, coalesce(hits, 0)::bigint as hits, round(coalesce(hits, 0) / least(n, 5)::double, 6) as recall from n left join h using (qid)""")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Per case: how many of the first five results are right answers (documents that hold the case's word in a title or summary), of the five there could be."""
    cases = s.local_table(spark, [tuple(c) for c in CASES], qid="int32", side="string", lex="string")
    live = s.read_table(spark, d, "search_document", *s.COLUMNS).where("is_active")
    right = s.postings(live).where("w >= 0.4").join(F.broadcast(cases), ["side", "lex"]).select("qid", "side", "id").distinct()
    right = right.join(s.reposts(s.read_table(spark, d, "search_document", "id", "dedupe_key", "published_at")), "id", "left_anti")
    top = s.top_candidates(_matches(spark, d), cap=5).select("qid", "id")
    hits = right.join(top.withColumn("hit", F.lit(1)), ["qid", "id"], "left").groupBy("qid", "side").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))
    wanted = F.least(F.col("n"), F.lit(5)).cast("long")
    return hits.select("qid", "side", wanted.alias("wanted"), F.col("hits").cast("long").alias("hits"), F.round(F.col("hits") / wanted, 6).alias("recall"))


@query("query_scripts", f"select * from (values " + ", ".join(f"({i}, '{_s}', '{plain_response(t)}', '{_l}')" for i, t, _s, _l in plain_scripts(QUERIES)) + ") t(qid, script, response, labels)")
def query_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Script of every query and its words."""
    q = s.local_table(spark, QUERIES, qid="int32", q="string")
    return q.select("qid", lang.query_script(F.col("q")).alias("script"), s.response_language(F.col("q")).alias("response"), F.array_join(F.transform(lang.tokens(F.col("q")), lang.detect_script), ",").alias("labels"))
