"""Text, extraction, date and hash functions over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefglass.functions import dates as dt
from reefglass.functions import extract as ex
from reefglass.functions import hashes, lang, scoring
from reefglass.operators.search import documents
from reefglass.plans.registry import AS_OF, AS_OF_US, query
from reefglass.plans.search_queries import tok
from reefglass.sources import html
from reefglass.sources.tables import read_table

_T = "d as (select distinct id, title_en, title_dv, title_latin, summary_en, summary_dv, contact_phone, source, price, currency, attrs from search_document)"
_I = "i as (select distinct iulaan_id, title, translated_title, office_id, iulaan_type, additional_info, attachments, body from iulaan)"
_NORM = r"trim(regexp_replace(lower(translate(regexp_replace(nfc_normalize(coalesce({0}, '')), '[​‌‍⁠﻿]', '', 'g'), '٠١٢٣٤٥٦٧٨٩', '0123456789')), '[\s ]+', ' ', 'g'))"
_CLEAN = "regexp_replace(coalesce({0}, ''), '<[^>]*>', ' ', 'g')"
for _name, _char in lang.ENTITIES:
    _CLEAN = f"replace({_CLEAN}, '{_name}', '{_char.replace(chr(39), chr(39) * 2)}')"
_CLEAN = rf"trim(regexp_replace({_CLEAN}, '\s+', ' ', 'g'))"


def _docs(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return documents(spark, d, "id", *cols)


def _notices(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "iulaan", "iulaan_id", "title", "translated_title", "office_id", "iulaan_type", "additional_info", "attachments", "body").dropDuplicates(["iulaan_id"])


@query("normalize_text", f"with {_T} select id, {_NORM.format('title_en')} as en, {_NORM.format('title_dv')} as dv from d")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d, "title_en", "title_dv").select("id", lang.normalize_text(F.col("title_en")).alias("en"), lang.normalize_text(F.col("title_dv")).alias("dv"))


@query("strip_html_text", f"with {_I} select iulaan_id, {_CLEAN.format('body')} as body from i")
def strip_html_text(spark: SparkSession, d: str) -> DataFrame:
    return _notices(spark, d).select("iulaan_id", lang.strip_html(F.col("body")).alias("body"))


@query("consonant_skeleton", f"with {_T} select id, regexp_replace(coalesce(title_dv, ''), '[ަ-ް]', '', 'g') as skeleton, regexp_matches(coalesce(title_dv, ''), '[ހ-޿]') as thaana from d")
def consonant_skeleton(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d, "title_dv").select("id", lang.strip_fili(F.col("title_dv")).alias("skeleton"), lang.contains_thaana(F.col("title_dv")).alias("thaana"))


@query("token_counts", f"with {_T}, t as (select unnest({tok('title_en')}) as token from d) select token, count(*)::bigint as n from t group by token")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d, "title_en").select(F.explode(lang.tokens(F.col("title_en"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


_READ = " ".join(f"when '{ch}' then '{r[0] if r else ''}'" for ch, r in lang.READINGS.items())


@query("translit_latin", f"with {_T} select id, array_to_string(list_transform(string_split(coalesce(title_dv, ''), ''), lambda c: case c {_READ} else c end), '') as latin from d where title_dv is not null and title_dv <> ''")
def translit_latin(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d, "title_dv").where("title_dv <> ''").select("id", lang.translit_dv_to_latin(F.col("title_dv")).alias("latin"))


@query("key_decode", f"with {_T}, t as (select distinct unnest({tok('title_latin')}) as token from d) select token, case when regexp_matches(token, '^[{lang.KEYS}\\s0-9/.,()-]+$') and regexp_matches(token, '[{lang.KEYS}]') then translate(token, '{lang.KEYS}', '{lang.THAANA}') end as decoded from t")
def key_decode(spark: SparkSession, d: str) -> DataFrame:
    t = _docs(spark, d, "title_latin").select(F.explode(lang.tokens(F.col("title_latin"))).alias("token")).distinct()
    return t.select("token", lang.decode_keys(F.col("token")).alias("decoded"))


_PAIRS = " + ".join(f"(length(token) - length(replace(token, '{p}', ''))) / 2" for p in lang.DIGRAPHS)
_MARK = ", ".join(f"'{w}'" for w in lang.MARKER_WORDS)


@query("script_label", f"""with {_T}, t as (select distinct unnest({tok("concat_ws(' ', title_en, title_latin, title_dv)")}) as token from d),
s as (select token, case when token in ({_MARK}) then 1.0 else least(1.0, ({_PAIRS}) * 2.0 / greatest(length(token), 1)) end as score,
coalesce(regexp_matches(translate(token, '{lang.KEYS}', '{lang.THAANA}'), '^(?:[ހ-ޥ][ަ-ް]|[\\s0-9/.,()-])+$') and regexp_matches(token, '[{lang.KEYS}]') and regexp_matches(token, '^[{lang.KEYS}\\s0-9/.,()-]+$'), false) as keys from t)
select token, case when regexp_matches(token, '[ހ-޿]') then 'dv' when regexp_matches(token, '^[0-9]+$') then 'en' when keys then 'keys' when score >= 0.5 then 'dv-Latn' else 'en' end as label from s""")
def script_label(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d, "title_en", "title_latin", "title_dv")
    t = docs.select(F.explode(lang.tokens(F.concat_ws(" ", "title_en", "title_latin", "title_dv"))).alias("token")).distinct()
    return t.select("token", lang.detect_script(F.col("token")).alias("label"))


@query("canonical_slug", f"with {_I} select iulaan_id, regexp_replace(regexp_replace(lower(trim(coalesce(iulaan_type, ''))), '[^a-z0-9ހ-޿]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from i")
def canonical_slug(spark: SparkSession, d: str) -> DataFrame:
    return _notices(spark, d).select("iulaan_id", lang.canonical_slug(F.col("iulaan_type")).alias("slug"))


@query("summarize_240", """with t as (select distinct doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) as t from documents)
select doc_id, case when length(t) <= 240 then t else regexp_replace(substr(t, 1, 240), ' [^ ]*$', '') || '...' end as summary from t""")
def summarize_240(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents", "doc_id", "text").dropDuplicates(["doc_id"]).select("doc_id", lang.summarize(F.col("text")).alias("summary"))


@query("split_multivalue", r"""with s as (select distinct spec_id, value_text from document_spec where value_text is not null)
select spec_id, array_to_string(list_filter(list_transform(regexp_split_to_array(value_text, '(?i)\s*(?:,|/|\||\bor\b|\band\b)\s*'), lambda p: trim(p, ' ')), lambda p: p <> ''), '; ') as parts from s""")
def split_multivalue(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "document_spec", "spec_id", "value_text").where("value_text is not null").dropDuplicates(["spec_id"])
    return s.select("spec_id", F.array_join(lang.split_multivalue(F.col("value_text")), "; ").alias("parts"))


@query("route_bilingual", f"""with {_T}, l as (select id, list_filter([coalesce(title_dv, ''), coalesce(title_en, ''), coalesce(title_latin, '')], lambda x: trim(x) <> '') as t from d)
select id, coalesce(list_filter(t, lambda x: not regexp_matches(x, '[ހ-޿]'))[1], '') as en, coalesce(list_filter(t, lambda x: regexp_matches(x, '[ހ-޿]'))[1], '') as dv from l""")
def route_bilingual(spark: SparkSession, d: str) -> DataFrame:
    r = lang.route_bilingual(F.col("title_dv"), F.col("title_en"), F.col("title_latin"))
    return _docs(spark, d, "title_en", "title_dv", "title_latin").select("id", r["en"].alias("en"), r["dv"].alias("dv"))


@query("token_set_overlap", f"""with {_T}, t as (select id, list_distinct({tok('title_en')}) as a, list_distinct({tok('summary_en')}) as b from d)
select id, round(coalesce(len(list_intersect(a, b))::double / nullif(least(len(a), len(b)), 0), 0.0), 6) as overlap from t""")
def token_set_overlap(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d, "title_en", "summary_en")
    return docs.select("id", F.round(lang.token_overlap(lang.tokens(F.col("title_en")), lang.tokens(F.col("summary_en"))), 6).alias("overlap"))


# look-arounds are written as consumed neighbours in SQL
@query("extract_phones", r"""with d as (select distinct doc_id, text from documents), p as (select doc_id, unnest(regexp_extract_all(' ' || regexp_replace(coalesce(text, ''), '([^0-9])', '\1\1', 'g') || '  ', '[^0-9](?:\+?960[\s-]?[\s-]?)?([79][0-9]{6}|[36][0-9]{6})[^0-9]', 1)) as phone from d)
select doc_id, array_to_string(list_sort(list(distinct phone)), ',') as phones from p group by doc_id""")
def extract_phones(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents", "doc_id", "text").dropDuplicates(["doc_id"])
    return docs.select("doc_id", F.array_join(F.array_sort(ex.all_phones(F.col("text"))), ",").alias("phones")).where("phones <> ''")


@query("extract_emails", rf"""with d as (select distinct doc_id, text from documents), e as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{ex.EMAIL}')) as email from d) select doc_id, email from e group by all""")
def extract_emails(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents", "doc_id", "text").dropDuplicates(["doc_id"])
    return docs.select("doc_id", F.explode(ex.emails(F.col("text"))).alias("email"))


_MARKED = " union all ".join(f"select doc_id, '{cur}' as currency, unnest(regexp_extract_all(coalesce(text, ''), '{p}', 1)) as a from d" for cur, p in ex.MARKED)


@query("extract_money", f"with d as (select distinct doc_id, text from documents), m as ({_MARKED}) select distinct doc_id, currency, replace(a, ',', '')::double as amount from m")
def extract_money(spark: SparkSession, d: str) -> DataFrame:
    """Amounts that any of the six marks gives a currency."""
    docs = read_table(spark, d, "documents", "doc_id", "text").dropDuplicates(["doc_id"])
    return docs.select("doc_id", F.inline(ex.marked_amounts(F.col("text")))).distinct()


@query("extract_urls", rf"""with d as (select distinct doc_id, text from documents), u as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{ex.URL.replace("'", "''")}')) as url from d) select distinct doc_id, url from u""")
def extract_urls(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents", "doc_id", "text").dropDuplicates(["doc_id"])
    return docs.select("doc_id", F.explode(ex.urls(F.col("text"))).alias("url"))


@query("extract_candidates")
def extract_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All facts of a text together; bare amounts stand back behind phones, quantities, years and dates. Tested against plain Python: the SQL has no lookaround."""
    docs = read_table(spark, d, "documents", "doc_id", "text").dropDuplicates(["doc_id"])
    x = docs.select("doc_id", ex.candidates(F.col("text")).alias("c"))
    kinds = {k: F.transform(F.col(f"c.{k}"), lambda v: v) for k in ("phones", "emails", "urls", "units", "dates")}
    kinds["money"] = F.transform(F.col("c.money"), lambda m: F.concat(m["currency"], F.lit(" "), F.format_string("%.2f", m["amount"])))

    def named(kind: str, values):
        return F.transform(values, lambda e: F.struct(F.lit(kind).alias("kind"), e.alias("value")))

    entries = F.concat(*[named(k, v) for k, v in kinds.items()])
    return x.select("doc_id", F.inline(entries))


_DV_MONTH = "coalesce(case " + " ".join(f"when starts_with({{0}}, '{stem}') then '{i}'" for stem, i in reversed(ex.DV_MONTHS)) + " end, '0')"
_DV_DATES = "".join(
    f" union all select doc_id, unnest(list_zip(regexp_extract_all(t, '{p}', {y}), list_transform(regexp_extract_all(t, '{p}', 2), lambda m: {_DV_MONTH.format('m')}), regexp_extract_all(t, '{p}', {dd}))) from d" for p, y, dd in ((ex.DV_DATE, 3, 1), (ex.DV_YEAR_FIRST, 1, 3))
)


@query("extract_dates", r"""with d as (select distinct doc_id, coalesce(text, '') as t from documents),
r as (select doc_id, unnest(list_zip(regexp_extract_all(t, '(20[0-9]{2})[-/]([0-9]{1,2})[-/]([0-9]{1,2})', 1), regexp_extract_all(t, '(20[0-9]{2})[-/]([0-9]{1,2})[-/]([0-9]{1,2})', 2), regexp_extract_all(t, '(20[0-9]{2})[-/]([0-9]{1,2})[-/]([0-9]{1,2})', 3))) as z from d
union all select doc_id, unnest(list_zip(regexp_extract_all(t, '([0-9]{1,2})[-/]([0-9]{1,2})[-/](20[0-9]{2})', 3), regexp_extract_all(t, '([0-9]{1,2})[-/]([0-9]{1,2})[-/](20[0-9]{2})', 2), regexp_extract_all(t, '([0-9]{1,2})[-/]([0-9]{1,2})[-/](20[0-9]{2})', 1))) from d
union all select doc_id, unnest(list_zip(regexp_extract_all(t, '([0-9]{1,2})\s+([A-Za-z]{3,9})\s+(20[0-9]{2})', 3), list_transform(regexp_extract_all(t, '([0-9]{1,2})\s+([A-Za-z]{3,9})\s+(20[0-9]{2})', 2), lambda m: coalesce(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], substr(lower(m), 1, 3)), 0)::varchar), regexp_extract_all(t, '([0-9]{1,2})\s+([A-Za-z]{3,9})\s+(20[0-9]{2})', 1))) from d""" + _DV_DATES + """)
select distinct doc_id, printf('%s-%02d-%02d', z[1], z[2]::integer, z[3]::integer) as iso from r where z[2]::integer between 1 and 12 and z[3]::integer between 1 and 31""")
def extract_dates(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents", "doc_id", "text").dropDuplicates(["doc_id"])
    return docs.select("doc_id", F.explode(ex.dates(F.col("text"))).alias("iso"))


@query("extract_units", r"""with s as (select distinct spec_id, regexp_replace(coalesce(value_text, ''), '([^A-Za-z0-9.])', '\1\1', 'g') as t from document_spec),
u as (select spec_id, regexp_extract_all(' ' || t || ' ', '(?i)[^A-Za-z0-9]([0-9]+(?:\.[0-9]+)?)\s*(?:kwh|mah|ghz|mhz|sqft|inch|kw|gb|tb|mb|kg|ml|cm|mm|v|a|w|l)[^A-Za-z]', 1) as n,
regexp_extract_all(' ' || t || ' ', '(?i)[^A-Za-z0-9][0-9]+(?:\.[0-9]+)?\s*(kwh|mah|ghz|mhz|sqft|inch|kw|gb|tb|mb|kg|ml|cm|mm|v|a|w|l)[^A-Za-z]', 1) as u from s)
select spec_id, unnest(list_filter(list_transform(list_zip(n, u), lambda z: case when regexp_matches(z[1], '^20[0-9][0-9]$') then '' else z[1] || ' ' || lower(z[2]) end), lambda x: x <> '')) as quantity from u""")
def extract_units(spark: SparkSession, d: str) -> DataFrame:
    """Quantities of every value_text, whatever its key. (The SQL has no lookaround: it doubles what may stand between two quantities.)"""
    s = read_table(spark, d, "document_spec", "spec_id", "value_text").dropDuplicates(["spec_id"])
    return s.select("spec_id", F.explode(ex.units(F.col("value_text"))).alias("quantity"))


@query("strip_phones", rf"""with {_T} select id, regexp_replace(regexp_replace(regexp_replace(coalesce(summary_en, ''), '(^|[^0-9])(?:\+?960[\s-]?)?(?:[79][0-9]{{6}}|[36][0-9]{{6}})([^0-9]|$)', '\1\2', 'g'), '[ \t]{{2,}}', ' ', 'g'), '^[\s,|/:&-]+|[\s,|/:&-]+$', '', 'g') as shown from d""")
def strip_phones(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d, "summary_en").select("id", ex.strip_phones(F.col("summary_en")).alias("shown"))


@query("identifier_keys", rf"""with {_I}, n as (select iulaan_id, upper(coalesce(json_extract_string(additional_info, '$.Number'), '')) as t from i where json_extract_string(additional_info, '$.Number') is not null)
select iulaan_id, array_to_string(regexp_extract_all(t, '[0-9]+'), '-') || '|' || array_to_string(list_sort(string_split(regexp_replace(t, '[^A-Z]', '', 'g'), '')), '') as key from n""")
def identifier_keys(spark: SparkSession, d: str) -> DataFrame:
    number = F.get_json_object("additional_info", "$.Number")
    return _notices(spark, d).where(number.isNotNull()).select("iulaan_id", ex.identifier_key(number).alias("key"))


_TRIM = "[.,);:''\"]+$"
_IDS = r"""list_distinct(list_transform(list_filter(list_transform(regexp_extract_all({0}, '\([A-Za-z]+\)|[A-Za-z0-9][A-Za-z0-9()/.\-:]*'), lambda x: regexp_replace(x, '{trim}', '')),
lambda x: length(x) >= 7 and contains(x, '/') and regexp_matches(x, '[0-9]') and not regexp_matches(x, 'www\.|https?:', 'i') and not regexp_matches(x, '^(?:[79][0-9]{{6}}|[36][0-9]{{6}})(?:\s*/\s*(?:[79][0-9]{{6}}|[36][0-9]{{6}}))+$')),
lambda x: array_to_string(regexp_extract_all(upper(x), '[0-9]+'), '-') || '|' || array_to_string(list_sort(string_split(regexp_replace(upper(x), '[^A-Z]', '', 'g'), '')), '')))"""


def _ids(c: str) -> str:
    return _IDS.format(c, trim=_TRIM)


@query("identifier_intersection", f"""with {_I}, n as (select iulaan_id, {_ids("coalesce(json_extract_string(additional_info, '$.Number'), '')")} as a, {_ids("coalesce(iulaan_id, '') || '/' || coalesce(office_id::varchar, '')")} as b from i)
select iulaan_id, unnest(list_intersect(a, b)) as key from n""")
def identifier_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that a notice's facts and its id share."""
    i = _notices(spark, d)
    a, b = ex.identifiers(F.get_json_object("additional_info", "$.Number")), ex.identifiers(F.concat(F.col("iulaan_id"), F.lit("/"), F.coalesce(F.col("office_id").cast("string"), F.lit(""))))
    return i.select("iulaan_id", F.explode(F.array_intersect(a, b)).alias("key"))


@query("attachment_role", rf"""with {_I}, a as (select iulaan_id, unnest(json_keys(attachments)) as label, attachments from i where attachments is not null), u as (select iulaan_id, label, json_extract_string(attachments, '$."' || label || '"') as url from a)
select iulaan_id, label, url, case when regexp_matches(label || ' ' || url, 'form|foam|ފޯމ|އެދޭ|application|apply', 'i') then 'application_form' when regexp_matches(label || ' ' || url, 'iulaan|iulan|announcement|notice|އިޢުލާން|އިއުލާން|ނޯޓިސް', 'i') then 'main'
when regexp_matches(label || ' ' || url, 'annex|attachment|sheet|schedule|appendix|a\d\b|ޖަދުވަލު', 'i') then 'annex' else 'unknown' end as role,
case when lower(url) like '%.pdf' then 'application/pdf' when lower(url) like '%.docx' then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' when lower(url) like '%.doc' then 'application/msword' when lower(url) like '%.xlsx' then 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' else '' end as mime from u""")
def attachment_role(spark: SparkSession, d: str) -> DataFrame:
    i = _notices(spark, d).select("iulaan_id", F.explode(F.from_json("attachments", "map<string,string>")).alias("label", "url"))
    return i.select("iulaan_id", "label", "url", ex.attachment_role(F.col("label"), F.col("url")).alias("role"), ex.guess_mime(F.col("url")).alias("mime"))


@query("html_links", rf"""with {_I} select iulaan_id, regexp_extract(body, '(?is)^\s*<([a-z]+)', 1) as first_tag, len(regexp_extract_all(body, '<[^>]*>'))::integer as tags from i""")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    tags = F.regexp_extract_all("body", F.lit("<[^>]*>"), 0)
    return _notices(spark, d).select("iulaan_id", F.regexp_extract("body", r"(?is)^\s*<([a-z]+)", 1).alias("first_tag"), F.size(tags).alias("tags"))


@query("html_pages", f"with {_I} select iulaan_id, iulaan_id as found, 7 as pages, len(list_distinct(regexp_extract_all(coalesce(body, ''), '(?i)href=\"([^\"]+\\.(?:pdf|docx?|xlsx?))\"', 1)))::integer as files from i where iulaan_id is not null")
def html_pages(spark: SparkSession, d: str) -> DataFrame:
    """Index and detail pages out of HTML made from the notices; parsing is covered by tests."""
    page = F.concat(F.lit('<a class="iulaan-title" href="/iulaan/'), F.col("iulaan_id"), F.lit('">x</a><li class="page-item"><a href="?page=7">7</a></li>'), F.col("body"))
    return _notices(spark, d).select("iulaan_id", F.element_at(html.notice_ids(page), 1).alias("found"), html.last_page(page).alias("pages"), F.size(html.file_links(page)).alias("files"))


@query("parse_datetime_text", rf"""with {_I}, n as (select iulaan_id, json_extract_string(additional_info, '$.Published') as t from i), p as (select iulaan_id, regexp_extract(t, '(\d{{1,2}})\s+([^\s\d]+)\s+(\d{{4}})', 1) as dd,
list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], substr(lower(regexp_extract(t, '(\d{{1,2}})\s+([^\s\d]+)\s+(\d{{4}})', 2)), 1, 3)) as mm, regexp_extract(t, '(\d{{1,2}})\s+([^\s\d]+)\s+(\d{{4}})', 3) as yy from n)
select iulaan_id, try(epoch_us(make_timestamp(yy::bigint, mm::bigint, dd::bigint, 23, 59, 0.0))) as us from p where dd <> '' and mm > 0 and yy::integer between 1990 and 2100""")
def parse_datetime_text(spark: SparkSession, d: str) -> DataFrame:
    t = dt.parse_text_datetime(F.get_json_object("additional_info", "$.Published"))
    return _notices(spark, d).select("iulaan_id", F.unix_micros(t).alias("us")).where("us is not null")


@query("deadline_state_by_date", """with d as (select distinct o_orderkey, o_orderdate from orders)
select o_orderkey, case when date_diff('day', date '1995-06-01', o_orderdate::date) < 0 then 'closed' when date_diff('day', date '1995-06-01', o_orderdate::date) <= 7 then 'closing_soon' else 'open' end as state from d""")
def deadline_state_by_date(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_orderkey", "o_orderdate")
    return o.select("o_orderkey", dt.deadline_state(F.col("o_orderdate"), F.lit("1995-06-01").cast("date")).alias("state"))


@query("month_bounds", "select distinct strftime(date_trunc('month', o_orderdate), '%Y_%m') as suffix, date_trunc('month', o_orderdate)::date as first, (date_trunc('month', o_orderdate) + interval 1 month)::date as next_first from orders")
def month_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = dt.month_bounds(F.col("o_orderdate").cast("date"))
    return read_table(spark, d, "orders", "o_orderdate").select(b.alias("b")).select("b.suffix", "b.first", "b.next_first").distinct()


@query("date_sane", f"with d as (select distinct id, published_at from search_document) select id, extract(year from to_timestamp(epoch_us(published_at) / 1e6) at time zone 'UTC')::integer between 2000 and 2035 as sane from d where published_at is not null")
def date_sane(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d, "published_at").where("published_at is not null").select("id", dt.is_sane(F.col("published_at"), F.lit(AS_OF).cast("timestamp")).alias("sane"))


@query("retention_cutoff", "select count(*) filter (ts < date_trunc('month', date '2024-04-20' - 90))::bigint as dropped, count(*) filter (ts >= date_trunc('month', date '2024-04-20' - 90))::bigint as kept from events")
def retention_cutoff(spark: SparkSession, d: str) -> DataFrame:
    cut = dt.retention_cutoff(F.lit("2024-04-20").cast("date"))
    return read_table(spark, d, "events", "ts").agg(F.count_if(F.col("ts").cast("date") < cut).alias("dropped"), F.count_if(F.col("ts").cast("date") >= cut).alias("kept"))


@query("freshness", f"with d as (select distinct id, doc_type, published_at from search_document) select id, round(log10(nullif(coalesce(exp(-ln(2.0) * (({AS_OF_US} - epoch_us(published_at)) / 86400e6) / case doc_type when 'news' then 7.0 when 'job' then 14.0 when 'property' then 45.0 else 30.0 end), 0.0), 0.0)), 6) as log_freshness from d")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    from reefglass import config

    as_of = F.lit(AS_OF).cast("timestamp")
    docs = _docs(spark, d, "doc_type", "published_at")
    return docs.select("id", F.round(F.log10(F.nullif(scoring.freshness(F.col("published_at"), F.col("doc_type"), as_of, config.Ranking()), F.lit(0.0))), 6).alias("log_freshness"))


@query("content_hash", f"with {_I} select iulaan_id, sha256(coalesce(title, '') || coalesce(body, '')) as hash from i")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _notices(spark, d).select("iulaan_id", hashes.content_hash(F.col("title"), F.col("body")).alias("hash"))


@query("source_text_hash", f"with {_T} select id, sha256(trim(regexp_replace(coalesce(title_dv, ''), '\\s+', ' ', 'g'))) as hash from d")
def source_text_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d, "title_dv").select("id", hashes.text_key(F.col("title_dv")).alias("hash"))


_TK = "trim(regexp_replace(lower(coalesce(title_en, '')), '[^a-z0-9ހ-޿]+', ' ', 'g'))"


@query("dedupe_key", f"""with {_T} select id, case when source in ('gazette', 'archive') then '' else sha256(source || '|' || lower(trim(coalesce(contact_phone, ''), ' ')) || '|' || case when {_TK} = '' then {_NORM.format('title_en')} else {_TK} end || '|' || case when price is null then '' else printf('%.2f', price::double) end) end as key from d""")
def dedupe_key(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d, "source", "contact_phone", "title_en", "price").select("id", hashes.repost_key(F.col("source"), F.col("contact_phone"), F.col("title_en"), F.col("price")).alias("key"))


@query("session_hash", "select event_id, substr(sha256(strftime(ts, '%Y-%m-%d') || '|' || user_id::varchar || '|salt'), 1, 32) as session from events")
def session_hash(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events", "event_id", "ts", "user_id")
    return e.select("event_id", hashes.session_key(F.col("ts").cast("date"), F.col("user_id"), "salt").alias("session"))


@query("cache_key", "with d as (select distinct doc_id, text from documents) select doc_id, sha256('local|small|v1|' || sha256(text)) as key from d")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents", "doc_id", "text").dropDuplicates(["doc_id"])
    return docs.select("doc_id", hashes.cache_key("local", "small", "v1", F.col("text")).alias("key"))


@query("path_key", f"with {_T} select distinct sha256(array_to_string(json_extract_string(attrs, '$.category_path[*]'), chr(31))) as key, array_to_string(json_extract_string(attrs, '$.category_path[*]'), ' > ') as path from d")
def path_key(spark: SparkSession, d: str) -> DataFrame:
    from reefglass.operators.filters import json_array

    p = json_array("category_path")
    return _docs(spark, d, "attrs").select(hashes.path_key(p).alias("key"), F.array_join(p, " > ").alias("path")).distinct()


@query("char_error_rate")
def char_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """Error rate of every title against its summary; the SQL engine measures distances in bytes, so tests prove it."""
    e = read_table(spark, d, "enriched_record", "record_id", "summary_en", "canonical_title_en").dropDuplicates(["record_id"]).where("summary_en is not null and canonical_title_en is not null")
    cer = scoring.char_error_rate(F.col("summary_en"), F.col("canonical_title_en"))
    return e.select("record_id", F.round(cer, 6).alias("cer"), (cer <= 0.15).alias("passes"))


@query("error_rate_distribution", """with x as (select value, row_number() over (order by value) - 1 as i, count(*) over () as n from events)
select round(avg(value), 6) as mean, max(case when i = n // 2 then value end) as median, max(case when i = floor(0.9 * n) then value end) as p90, max(value) as top from x""")
def error_rate_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Mean, and the values at the positions n/2 and 0.9 n of the sorted list; positions come from ranked counts per value, not from one sorted task."""
    from pyspark.sql import Window

    e = read_table(spark, d, "events", "value").groupBy("value").agg(F.count(F.lit(1)).alias("k"))
    part = F.floor(F.col("value") / 10)
    e = e.withColumn("b", part)
    sums = e.groupBy("b").agg(F.sum("k").alias("s"))  # one row per ten units of value
    starts = sums.withColumn("start", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    e = e.join(starts.select("b", "start"), "b").withColumn("upto", F.col("start") + F.sum("k").over(Window.partitionBy("b").orderBy("value")))
    total = read_table(spark, d, "events", "value").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("top"))
    at = e.join(F.broadcast(total))  # one row
    hit = lambda i: F.max(F.when((F.col("upto") > i) & (F.col("upto") - F.col("k") <= i), F.col("value")))
    return at.groupBy("mean", "top").agg(hit(F.floor(F.col("n") / 2)).alias("median"), hit(F.floor(F.col("n") * 0.9)).alias("p90")).select("mean", "median", "p90", "top")
