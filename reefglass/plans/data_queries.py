"""More named queries over notices, attributes and cards, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reefglass.functions import dates, extract, lang, scoring
from reefglass.operators import catalog_ops, eav_project, enrich, facets
from reefglass.operators.filters import json_array
from reefglass.operators.search import documents
from reefglass.plans.filter_queries import _CELLS, cells
from reefglass.plans.registry import AS_OF, query
from reefglass.plans.search_queries import tok
from reefglass.sources.tables import fixed_rows, read_table

_I = "i as (select distinct iulaan_id, title, translated_title, office_id, iulaan_type, attachments, body from iulaan)"
_A = f"""{_I}, m as (select iulaan_id, title, office_id, iulaan_type, unnest(json_keys(attachments)) as label, attachments from i where attachments is not null),
a as (select iulaan_id, label, json_extract_string(attachments, '$."' || label || '"') as url from m)"""


def _notices(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "iulaan", "iulaan_id", "title", "translated_title", "office_id", "iulaan_type", "attachments", "body").dropDuplicates(["iulaan_id"])


@query("facet_enum_values", f"""with {_CELLS}, v as (select spec_key, lower(trim(text, ' ')) as value, document_id from cells where datatype = 'enum'),
c as (select spec_key, value, count(distinct document_id)::bigint as n from v where coalesce(value, '') <> '' group by all)
select * from (select *, row_number() over (partition by spec_key order by n desc, value)::integer as rank from c) where rank <= 12""")
def facet_enum_values(spark: SparkSession, d: str) -> DataFrame:
    """The twelve commonest values of every listed attribute, by documents."""
    v = cells(spark, d).where("datatype = 'enum'").select("spec_key", F.lower(F.trim("text")).alias("value"), "document_id").where("value <> ''")
    n = v.groupBy("spec_key", "value").agg(F.countDistinct("document_id").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("spec_key").orderBy(F.desc("n"), "value"))).where("rank <= 12")


@query("facet_discovery_sketched")
def facet_discovery_sketched(spark: SparkSession, d: str) -> DataFrame:
    """facet_discovery by mergeable sketches, as a page needs it; tested to stay within three times the sketches' error."""
    kinds = {r.spec_key: r.datatype for r in fixed_rows(read_table(spark, d, "spec_key", "spec_key", "datatype"))}
    return facets.discover(cells(spark, d), kinds, documents(spark, d, "id").count(), exact=False)


@query("facet_numeric_ends", f"with {_CELLS} select spec_key, min(num) as lo, max(num) as hi, count(distinct document_id)::bigint as documents from cells where datatype = 'numeric' and num is not null group by spec_key")
def facet_numeric_ends(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).where("datatype = 'numeric' and num is not null").groupBy("spec_key").agg(F.min("num").alias("lo"), F.max("num").alias("hi"), F.countDistinct("document_id").alias("documents"))


@query("facet_bool_offered", f"""with {_CELLS}, b as (select spec_key, count(distinct document_id) filter (lower(trim(text, ' ')) in ('true', 'yes', '1') or num = 1)::bigint as n_true, count(distinct document_id)::bigint as documents from cells where datatype = 'bool' group by spec_key)
select * from b where n_true > 0 and n_true < documents""")
def facet_bool_offered(spark: SparkSession, d: str) -> DataFrame:
    """Yes-or-no attributes that tell documents apart: neither none nor all say yes."""
    yes = F.lower(F.trim("text")).isin("true", "yes", "1") | (F.col("num") == 1)
    b = cells(spark, d).where("datatype = 'bool'").groupBy("spec_key").agg(F.countDistinct(F.when(yes, F.col("document_id"))).alias("n_true"), F.countDistinct("document_id").alias("documents"))
    return b.where("n_true > 0 and n_true < documents")


@query("any_inferred", "select document_id, bool_or(provenance = 'inferred') as inferred from document_spec group by document_id")
def any_inferred(spark: SparkSession, d: str) -> DataFrame:
    """Whether any attribute of a document was inferred."""
    return read_table(spark, d, "document_spec", "document_id", "provenance").groupBy("document_id").agg(F.bool_or(F.col("provenance") == "inferred").alias("inferred"))


@query("notice_source_keys", "select distinct iulaan_id as source_key from iulaan where iulaan_id is not null")
def notice_source_keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys of a source, on two columns less than the rows."""
    return read_table(spark, d, "iulaan", "iulaan_id").where("iulaan_id is not null").select(F.col("iulaan_id").alias("source_key")).distinct()


@query("notice_with_dims", f"""with {_A}, f as (select iulaan_id, string_agg(url, chr(10) order by url) as texts, count(*)::bigint as n from a where not regexp_matches(label || ' ' || url, 'form|foam|ފޯމ|އެދޭ|application|apply', 'i') and coalesce(url, '') <> '' group by iulaan_id)
select i.iulaan_id, coalesce(o.name_dv, '') as office, coalesce(i.iulaan_type, '') as kind, coalesce(f.n, 0)::bigint as attachments, coalesce(f.texts, '') as texts from i left join (select distinct office_id, name_dv from office) o using (office_id) left join f using (iulaan_id)""")
def notice_with_dims(spark: SparkSession, d: str) -> DataFrame:
    """Notices with their office, kind, and their attachments that are no forms, joined in order; a notice's attachments are few."""
    i = _notices(spark, d)
    a = i.select("iulaan_id", F.explode(F.from_json("attachments", "map<string,string>")).alias("label", "url"))
    a = a.where((extract.attachment_role(F.col("label"), F.col("url")) != "application_form") & (F.coalesce("url", F.lit("")) != ""))
    f = a.groupBy("iulaan_id").agg(F.array_join(F.sort_array(F.collect_list("url")), "\n").alias("texts"), F.count(F.lit(1)).alias("n"))
    office = read_table(spark, d, "office", "office_id", "name_dv").dropDuplicates(["office_id"])  # a table of fixed size
    out = i.join(F.broadcast(office), "office_id", "left").join(f, "iulaan_id", "left")
    return out.select("iulaan_id", F.coalesce("name_dv", F.lit("")).alias("office"), F.coalesce("iulaan_type", F.lit("")).alias("kind"), F.coalesce("n", F.lit(0)).cast("long").alias("attachments"), F.coalesce("texts", F.lit("")).alias("texts"))


@query("attachments_any_main", f"""with {_A} select iulaan_id, bool_or(regexp_matches(label || ' ' || url, 'iulaan|iulan|announcement|notice|އިޢުލާން|އިއުލާން|ނޯޓިސް', 'i')) as any_main, string_agg(label, chr(10) order by label) as labels from a group by iulaan_id""")
def attachments_any_main(spark: SparkSession, d: str) -> DataFrame:
    """Per notice: whether any attachment is the announcement itself, and all labels, one a line."""
    a = _notices(spark, d).select("iulaan_id", F.explode(F.from_json("attachments", "map<string,string>")).alias("label", "url"))
    main = F.concat_ws(" ", "label", "url").rlike(extract.MAIN_LABEL)
    return a.groupBy("iulaan_id").agg(F.bool_or(main).alias("any_main"), F.array_join(F.sort_array(F.collect_list("label")), "\n").alias("labels"))


@query("attachment_discovery", f"""with {_A}, u as (select iulaan_id as notice, min(label) as label, url from a group by all),
k as (select * from u where label like 'A%' or label like 'F%') select notice, url, 'known' as status from k union all select notice, url, 'pending' from u where not exists (select 1 from k where k.notice = u.notice and k.url = u.url)""")
def attachment_discovery(spark: SparkSession, d: str) -> DataFrame:
    """A second discovery run: attachments that are known stay as they are, the others come in as pending."""
    i = _notices(spark, d).withColumnRenamed("iulaan_id", "notice")
    none = catalog_ops.discover_attachments(i.limit(0), spark.createDataFrame([], "notice string, label string, url string, role string, status string"))
    found = catalog_ops.discover_attachments(i, none)
    known = found.where("label like 'A%' or label like 'F%'").withColumn("status", F.lit("known"))
    return catalog_ops.discover_attachments(i, known).select("notice", "url", "status")


@query("canonical_url", "select distinct iulaan_id, 'https://notices.example/iulaan/' || iulaan_id as url from iulaan")
def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return _notices(spark, d).select("iulaan_id", F.concat(F.lit("https://notices.example/iulaan/"), F.col("iulaan_id")).alias("url"))


@query("anchor_overlap", f"""with {_I}, o as (select distinct office_id, name_dv from office), n as (select iulaan_id, list_distinct(list_concat({tok('title')}, {tok('name_dv')})) as known, list_distinct({tok("regexp_replace(coalesce(body, ''), '<[^>]*>', ' ', 'g')")}) as seen from i left join o using (office_id))
select iulaan_id, round(case when len(known) = 0 then 0.0 else len(list_intersect(known, seen))::double / len(known) end, 6) as overlap from n""")
def anchor_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How much of a notice's own words (title and office) its text holds."""
    office = read_table(spark, d, "office", "office_id", "name_dv").dropDuplicates(["office_id"])
    i = _notices(spark, d).join(F.broadcast(office), "office_id", "left")
    body = F.regexp_replace(F.coalesce("body", F.lit("")), "<[^>]*>", " ")
    return i.select("iulaan_id", F.round(scoring.known_overlap(F.concat(lang.tokens(F.col("title")), lang.tokens(F.col("name_dv"))), lang.tokens(body)), 6).alias("overlap"))


@query("annotate_deadline", """with d as (select distinct id, doc_type, expires_at from search_document), s as (select id, doc_type, date_diff('day', date '2025-01-01', expires_at::date) as left_ from d)
select id, case when doc_type = 'job' and left_ is not null then case when left_ < 0 then 'closed' when left_ <= 7 then 'closing_soon' else 'open' end end as state from s""")
def annotate_deadline(spark: SparkSession, d: str) -> DataFrame:
    """The state of a deadline, which depends on the day, on jobs only."""
    state = dates.deadline_state(F.col("expires_at"), F.lit(AS_OF).cast("timestamp"))
    return documents(spark, d, "id", "doc_type", "expires_at").select("id", F.when(F.col("doc_type") == "job", state).alias("state"))


@query("bankers_rounding", "select p_partkey, round_even(p_retailprice::decimal(18, 4), 1)::double as tenth, round_even(p_size / 20.0, 1)::double as twentieth from part")
def bankers_rounding(spark: SparkSession, d: str) -> DataFrame:
    """Halves go to the even digit."""
    return read_table(spark, d, "part", "p_partkey", "p_retailprice", "p_size").select("p_partkey", F.bround(F.col("p_retailprice").cast("decimal(18,4)"), 1).cast("double").alias("tenth"), F.bround((F.col("p_size") / 20.0).cast("decimal(18,4)"), 1).cast("double").alias("twentieth"))


@query("bilingual_worklist", """with d as (select distinct id, coalesce(title_en, '') as te, coalesce(title_dv, '') as td, coalesce(summary_en, '') as se, coalesce(summary_dv, '') as sd, coalesce(attrs, '{}') as attrs from search_document)
select id from d where (td = '' and te <> '') or (te = '' and td <> '') or (sd = '' and se <> '') or (se = '' and sd <> '') or attrs not in ('{}', '')""")
def bilingual_worklist(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a side to be filled from the other, or with attributes."""
    docs = documents(spark, d, "id", "title_en", "title_dv", "summary_en", "summary_dv", "attrs")
    te, td, se, sd = (F.coalesce(c, F.lit("")) for c in ("title_en", "title_dv", "summary_en", "summary_dv"))
    lacks = [(a == "") & (b != "") for a, b in ((td, te), (te, td), (sd, se), (se, sd))]
    return docs.where(lacks[0] | lacks[1] | lacks[2] | lacks[3] | ~F.coalesce("attrs", F.lit("{}")).isin("{}", "")).select("id")


@query("eav_project_sources", r"""with k as (select distinct key_id, spec_key from spec_key), s as (select distinct document_id, key_raw, value_num, value_text, unit, provenance from document_spec),
a as (select document_id, key_raw, value_num, coalesce(value_text, '') as t, coalesce(unit, '') as u, coalesce(provenance, '') as p, 0 as rank from s
union all select distinct id, 'views', null, json_extract_string(attrs, '$.views'), '', 'scraped', 1 from search_document where json_extract_string(attrs, '$.views') is not null),
r as (select document_id, left(regexp_replace(regexp_replace(lower(coalesce(key_raw, '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 64) as key_raw, value_num, case when length(u) > 16 and t = '' then u else t end as value_text, case when length(u) > 16 then '' else u end as unit, p as provenance, rank from a),
f as (select document_id, key_raw, value_num, value_text, min(row(rank, unit, provenance)) as z from r where key_raw not in ('', 'price', 'location', 'source', 'doc_type') and (value_num is null or not isnan(value_num)) group by all)
select k.key_id, document_id, key_raw, value_num, value_text, z[2] as unit, z[3] as provenance from f left join k on k.spec_key = f.key_raw""")
def eav_project_sources(spark: SparkSession, d: str) -> DataFrame:
    """Attribute rows out of the stored ones and the scraped attributes, each fact from the first source that states it."""
    stored = read_table(spark, d, "document_spec", "document_id", "key_raw", "value_num", "value_text", "unit", "provenance")
    docs = documents(spark, d, "id", "attrs")
    views = eav_project.of_map(docs, F.to_json(F.struct(F.get_json_object("attrs", "$.views").alias("views"))))
    return eav_project.project([stored, views], read_table(spark, d, "spec_key", "key_id", "spec_key"))


@query("index_worklist", """with d as (select distinct id, source, source_key, content_hash from search_document), e as (select distinct source, source_key, content_hash as held from enriched_record)
select id from d left join e using (source, source_key) where held is null or held is distinct from content_hash""")
def index_worklist(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose content the records of an earlier run do not hold."""
    docs = documents(spark, d, "id", "source", "source_key", "content_hash")
    held = read_table(spark, d, "enriched_record", "source", "source_key", F.col("content_hash").alias("held")).distinct()
    indexed = docs.drop("content_hash").join(held, ["source", "source_key"]).select("id", F.col("held").alias("content_hash"))
    return catalog_ops.to_index(docs, indexed).select("id")


@query("early_stop_pages", """with p as (select user_id as g, row_number() over (partition by user_id order by event_id) as page, event_type in ('view', 'click') as seen from events),
s as (select g, page, sum(seen::integer) over (partition by g order by page rows between 2 preceding and current row) as run from p) select g as user_id, coalesce(min(page) filter (run = 3), max(page))::bigint as read from s group by g""")
def early_stop_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages a crawl reads that stops after three fully seen ones; a crawl's pages are a bounded group."""
    e = read_table(spark, d, "events", "event_id", "user_id", "event_type")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    pages = e.select(F.col("user_id").alias("group"), number.alias("page"), F.col("event_type").isin("view", "click").alias("seen"))
    return catalog_ops.pages_read(pages).select(F.col("group").alias("user_id"), "read")


@query("ancestors_of_paths", """with p as (select distinct json_extract_string(attrs, '$.category_path[*]') as path from search_document where len(json_extract_string(attrs, '$.category_path[*]')) > 0),
n as (select unnest(range(2, len(path) + 1)) as i, path from p), a as (select i, unnest(range(1, i)) as j, path from n)
select distinct array_to_string(path[:i], ' > ') as node, array_to_string(path[:j], ' > ') as ancestor, min(i - j)::integer as distance from a group by all""")
def ancestors_of_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every category with those above it, however deep."""
    path = json_array("category_path")
    steps = F.transform(F.sequence(F.lit(2), F.size("path")), lambda i: F.struct(F.array_join(F.slice("path", 1, i), " > ").alias("node"), F.array_join(F.slice("path", 1, i - 1), " > ").alias("parent")))
    paths = documents(spark, d, "id", "attrs").select(path.alias("path")).where(F.size("path") > 1).distinct()
    return catalog_ops.ancestors(paths.select(F.inline(steps)).distinct())


@query("enrichment_input", """with d as (select distinct id, title_en, title_dv, summary_en, summary_dv from search_document),
l as (select id, [trim(coalesce(title_en, ''), ' '), trim(coalesce(title_dv, ''), ' '), trim(coalesce(summary_en, ''), ' '), trim(coalesce(summary_dv, ''), ' ')] as l from d),
w as (select id, array_to_string(list_filter(list_transform(list_zip(l, range(1, 5)), lambda z: case when list_position(l, z[1]) = z[2] then z[1] else '' end), lambda x: x <> ''), chr(10)) as whole from l)
select id, left(whole, 3500) as text, length(left(whole, 3500))::integer as chars, regexp_matches(left(whole, 3500), '[ހ-޿]') as thaana, length(whole) > 3500 as cut from w""")
def enrichment_input(spark: SparkSession, d: str) -> DataFrame:
    return enrich.assembled_input(documents(spark, d, "id", "title_en", "title_dv", "summary_en", "summary_dv"))


_MATCH = "trim(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'), ' ')"
_DIFFER = "trim(coalesce({0}, ''), ' ') <> '' and trim(coalesce({1}, ''), ' ') <> '' and {2} <> {3}"


def _clash(a: str, b: str) -> str:
    return _DIFFER.format(a, b, _MATCH.format(a), _MATCH.format(b))


@query("scraped_wins_merge", f"""with d as (select distinct id, source, source_key, title_en, summary_en from search_document), e as (select distinct record_id, source, source_key, canonical_title_en as m_title, summary_en as m_summary from enriched_record),
j as (select record_id, title_en as s_title, m_title, d.summary_en as s_summary, m_summary from d join e using (source, source_key)), c as (select *, {_clash('s_title', 'm_title')} as ct, {_clash('s_summary', 'm_summary')} as cs from j)
select record_id, case when trim(coalesce(s_title, ''), ' ') <> '' then s_title when trim(coalesce(m_title, ''), ' ') <> '' then m_title end as title, case when trim(coalesce(s_summary, ''), ' ') <> '' then s_summary when trim(coalesce(m_summary, ''), ' ') <> '' then m_summary end as summary,
case when ct and cs then 'title,summary' when ct then 'title' when cs then 'summary' else '' end as conflicts, ct or cs as needs_review from c""")
def scraped_wins_merge(spark: SparkSession, d: str) -> DataFrame:
    """What was scraped wins over what the model says; where both speak and differ, the record needs review."""
    docs = documents(spark, d, "id", "source", "source_key", F.col("title_en").alias("s_title"), F.col("summary_en").alias("s_summary"))
    records = read_table(spark, d, "enriched_record", "record_id", "source", "source_key", F.col("canonical_title_en").alias("m_title"), F.col("summary_en").alias("m_summary")).dropDuplicates(["record_id"])
    return enrich.scraped_wins(docs.join(records, ["source", "source_key"]), ("title", "summary")).select("record_id", "title", "summary", "conflicts", "needs_review")


_PRICE = "case when price is not null then coalesce(nullif(currency, ''), 'MVR') || ' ' || format('{{:,.0f}}', round_even(price::double, 0)) || ' / month' end"
_T = "coalesce(nullif(trim(title_en, ' '), ''), nullif(trim(title_dv, ' '), ''))"


@query("cards_by_type", f"""with d as (select distinct id, doc_type, title_en, title_dv, summary_en, summary_dv, island, price, currency, category_leaf, thumbnails, expires_at, published_at from search_document), s as (select *, date_diff('day', date '2025-01-01', expires_at::date) as days from d)
select id, json_merge_patch('{{}}', case doc_type
when 'job' then json_object('title', {_T}, 'place', nullif(trim(island, ' '), ''), 'deadline', strftime(expires_at, '%Y-%m-%d'), 'state', case when days < 0 then 'closed' when days <= 7 then 'closing_soon' when days > 7 then 'open' end)
when 'property' then json_object('title', {_T}, 'place', nullif(trim(island, ' '), ''), 'price', {_PRICE.replace("{{", "{").replace("}}", "}")}, 'pictures', nullif(len(thumbnails), 0))
when 'shopping' then json_object('title', {_T}, 'category', nullif(trim(category_leaf, ' '), ''), 'price', {_PRICE.replace("{{", "{").replace("}}", "}")}, 'pictures', nullif(len(thumbnails), 0))
else json_object('title', {_T}, 'summary', coalesce(nullif(trim(summary_en, ' '), ''), nullif(trim(summary_dv, ' '), '')), 'date', strftime(published_at, '%Y-%m-%d')) end)::varchar as card from s""")
def cards_by_type(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d, "id", "doc_type", "title_en", "title_dv", "summary_en", "summary_dv", "island", "price", "currency", "category_leaf", "thumbnails", "expires_at", "published_at")
    return docs.select("id", enrich.cards(docs, F.lit(AS_OF).cast("timestamp")).alias("card"))


@query("text_pieces", """with recursive d as (select distinct iulaan_id, regexp_replace(coalesce(body, ''), '<[^>]*>', ' ', 'g') as t from iulaan where iulaan_id is not null),
p as (select iulaan_id, t as rest, 0 as no, '' as piece from d union all
select iulaan_id, substr(rest, e + 1), no + 1, left(rest, e) from (select *, case when length(rest) <= 120 then length(rest) else coalesce(
(select 121 - list_min([x for x in [instr(reverse(left(rest, 120)), s)] if x > 0 and 120 - x > 60]) from (select chr(10) as s)), (select 121 - x from (select instr(reverse(left(rest, 120)), '.') as x) where x > 0 and 120 - x > 60), (select 121 - x from (select instr(reverse(left(rest, 120)), '،') as x) where x > 0 and 120 - x > 60),
(select 121 - x from (select instr(reverse(left(rest, 120)), ',') as x) where x > 0 and 120 - x > 60), (select 121 - x from (select instr(reverse(left(rest, 120)), '۔') as x) where x > 0 and 120 - x > 60), (select 121 - x from (select instr(reverse(left(rest, 120)), ' ') as x) where x > 0 and 120 - x > 60), 120) end as e from p where rest <> ''))
select iulaan_id, no, piece from p where no > 0""")
def text_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Notices in pieces of at most 120 characters, cut at the best boundary past the half."""
    body = F.regexp_replace(F.coalesce("body", F.lit("")), "<[^>]*>", " ")
    rows = _notices(spark, d).where("iulaan_id is not null")
    return rows.select("iulaan_id", F.posexplode(lang.chunks(body, 120)).alias("at", "piece")).select("iulaan_id", (F.col("at") + 1).alias("no"), "piece")
