"""Merging, grouping, overlays, taxonomy, worklists, enrichment gates, logs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reefglass import config
from reefglass.functions import lang, scoring
from reefglass.operators import catalog_ops as ops
from reefglass.operators import enrich
from reefglass.operators.search import documents
from reefglass.plans.registry import query
from reefglass.sources.tables import read_table
from reefglass.streaming import logs

_D = "d as (select distinct id, source, source_key, doc_type, title_en, title_dv, summary_en, price, currency, published_at, dedupe_key, content_hash, category_leaf, attrs, island, thumbnails, is_active, quality from search_document)"
_E = "e as (select distinct record_id, source, source_key, content_hash, doc_type, doc_type_confidence, canonical_title_en, canonical_title_dv, summary_en, summary_dv, model_name, prompt_version, status, attempts from enriched_record)"


def _docs(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return documents(spark, d, "id", *cols)


def _records(spark: SparkSession, d: str) -> DataFrame:
    cols = ("record_id", "source", "source_key", "content_hash", "doc_type", "doc_type_confidence", "canonical_title_en", "canonical_title_dv", "summary_en", "summary_dv", "model_name", "prompt_version", "status", "attempts")
    return read_table(spark, d, "enriched_record", *cols).dropDuplicates(["record_id"])


@query("source_dim_active", "select source, coalesce(nullif(label_en, ''), source) as label, site_url from doc_source where is_active order by source")
def source_dim_active(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "doc_source")
    return s.where("is_active").select("source", F.coalesce(F.nullif("label_en", F.lit("")), F.col("source")).alias("label"), "site_url").orderBy("source")


@query("raw_notice_to_draft", r"""with i as (select distinct iulaan_id, title, translated_title, office_id, iulaan_type, body, attachments from iulaan), o as (select office_id, name_dv, translated_name from office)
select iulaan_id as source_key, 'gazette' as source, coalesce(title, '') as title_dv, coalesce(translated_title, '') as title_en, coalesce(name_dv, '') as office_dv, case regexp_replace(lower(trim(coalesce(iulaan_type, ''))), '[^a-z]+', '', 'g') when 'job' then 'job' else 'news' end as doc_type,
trim(regexp_replace(regexp_replace(coalesce(body, ''), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as text_dv, round(least(1.0, ((case when length(trim(regexp_replace(regexp_replace(coalesce(body, ''), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) >= 500 then 0.3 else 0.1 end)
+ (case when coalesce(translated_title, '') <> '' then 0.2 else 0.0 end) + (case when i.office_id is not null then 0.15 else 0.0 end) + (case when attachments <> '{}' then 0.2 else 0.0 end) + (case when attachments <> '{}' then 0.15 else 0.0 end))::double), 3) as quality
from i left join o using (office_id)""")
def raw_notice_to_draft(spark: SparkSession, d: str) -> DataFrame:
    i = read_table(spark, d, "iulaan", "iulaan_id", "title", "translated_title", "office_id", "iulaan_type", "body", "attachments").dropDuplicates(["iulaan_id"])
    o = F.broadcast(read_table(spark, d, "office", "office_id", "name_dv"))  # a table of fixed size
    text = lang.strip_html(F.col("body"))
    n = F.coalesce(F.when(F.col("attachments") != "{}", 1), F.lit(0))
    q = scoring.notice_quality(F.length(text), F.coalesce("translated_title", F.lit("")) != "", F.col("office_id").isNotNull(), n, F.lit(False))
    kind = enrich.prior(F.lit("gazette"), F.regexp_replace(F.lower(F.col("iulaan_type")), "[^a-z]+", ""))
    return i.join(o, "office_id", "left").select(
        F.col("iulaan_id").alias("source_key"), F.lit("gazette").alias("source"), F.coalesce("title", F.lit("")).alias("title_dv"), F.coalesce("translated_title", F.lit("")).alias("title_en"),
        F.coalesce("name_dv", F.lit("")).alias("office_dv"), kind.alias("doc_type"), text.alias("text_dv"), q.alias("quality"),
    )


_ORDER = "published_at is null desc, published_at desc, id desc"


@query("dedupe_flag_latest", f"""with {_D}, g as (select id, dedupe_key, row_number() over (partition by dedupe_key order by {_ORDER}) as rn, count(*) over (partition by dedupe_key) as n from d where coalesce(dedupe_key, '') <> '')
select d.id, coalesce(n > 1 and rn > 1, false) as is_duplicate, coalesce(case when n > 1 and rn = 1 then n end, 0)::integer as duplicate_count from d left join g using (id)""")
def dedupe_flag_latest(spark: SparkSession, d: str) -> DataFrame:
    return ops.flag_reposts(_docs(spark, d, "dedupe_key", "published_at")).select("id", "is_duplicate", "duplicate_count")


@query("dedupe_group_stats", f"with {_D}, g as (select dedupe_key, count(*)::bigint as size from d where coalesce(dedupe_key, '') <> '' group by 1 having count(*) > 1) select size, count(*)::bigint as groups, ((size - 1) * count(*))::bigint as flagged from g group by size")
def dedupe_group_stats(spark: SparkSession, d: str) -> DataFrame:
    return ops.repost_groups(_docs(spark, d, "dedupe_key"))


@query("upsert_merge", f"""with {_D}, {_E}, b as (select source, source_key, title_en, content_hash from d), n as (select source, source_key, canonical_title_en as title_en, content_hash from e)
select * from n union all select * from b where not exists (select 1 from n where n.source is not distinct from b.source and n.source_key is not distinct from b.source_key)""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """The enriched records merged into the documents by source and key; the latest attempt of a key counts."""
    base = _docs(spark, d, "source", "source_key", "title_en", "content_hash").drop("id")
    feed = _records(spark, d).select("source", "source_key", F.col("canonical_title_en").alias("title_en"), "content_hash", "record_id")
    return ops.upsert(base, feed, ["source", "source_key"], F.col("record_id"))


@query("seed_without_overwrite", "with s as (select source, label_en from doc_source), n(source, label_en) as (values ('gazette', 'Overwritten?'), ('brandnew', 'Brand new')) select * from s union all select * from n where source not in (select source from s)")
def seed_without_overwrite(spark: SparkSession, d: str) -> DataFrame:
    from reefglass.sources.tables import local_table

    seed = local_table(spark, [("gazette", "Overwritten?"), ("brandnew", "Brand new")], source="string", label_en="string")
    return ops.add_missing(read_table(spark, d, "doc_source", "source", "label_en"), seed, ["source"])


@query("overlay_translation_fill", f"""with {_D}, {_E} select d.id, case when trim(coalesce(d.title_en, '')) <> '' then d.title_en else coalesce(e.canonical_title_en, d.title_en, '') end as title_en, case when trim(coalesce(d.summary_en, '')) <> '' then d.summary_en else coalesce(e.summary_en, d.summary_en, '') end as summary_en from d left join e using (source, source_key)""")
def overlay_translation_fill(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d).select("source", "source_key", F.col("canonical_title_en").alias("title_en"), "summary_en")
    return ops.overlay_fill(_docs(spark, d, "source", "source_key", "title_en", "summary_en"), records, ["source", "source_key"], ["title_en", "summary_en"]).select("id", "title_en", "summary_en")


@query("overlay_enrichment_gate", f"with {_D}, {_E} select d.id, e.canonical_title_en as new_title_en, e.doc_type as new_doc_type, e.doc_type_confidence as confidence from d left join (select * from e where status in ('ok', 'needs_review')) e using (source, source_key, content_hash)")
def overlay_enrichment_gate(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d, "source", "source_key", "content_hash")
    return ops.overlay_enriched(docs, _records(spark, d)).select("id", "new_title_en", "new_doc_type", "confidence")


@query("work_selection", f"""with {_D}, {_E}, w as (select d.id, case when e.record_id is null then 'new' when e.content_hash <> d.content_hash then 'changed' when e.status = 'failed' and e.attempts < 5 then 'failed' when e.prompt_version < 3 and d.source <> 'archive' then 'prompt' end as reason from d left join e using (source, source_key))
select * from w where reason is not null""")
def work_selection(spark: SparkSession, d: str) -> DataFrame:
    return ops.stale_work(_docs(spark, d, "source", "source_key", "content_hash"), _records(spark, d), 3, config.MAX_ATTEMPTS, ("archive",))


@query("pass_outcome_counts", f"with {_E} select status, count(*)::bigint as records, sum(attempts)::bigint as attempts, round(avg(doc_type_confidence), 6) as confidence from e group by status")
def pass_outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return enrich.outcomes(_records(spark, d))


@query("cold_pass_order", f"with {_D} select doc_type, count(*)::bigint as n from d group by 1 order by list_position(['job', 'news', 'property', 'shopping'], doc_type) nulls last, doc_type")
def cold_pass_order(spark: SparkSession, d: str) -> DataFrame:
    at = F.nullif(F.array_position(F.array(*[F.lit(x) for x in ("job", "news", "property", "shopping")]), F.col("doc_type")), F.lit(0))
    return _docs(spark, d, "doc_type").groupBy("doc_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.asc_nulls_last(at), "doc_type")


@query("classification_gate", f"""with {_D}, {_E} select d.id, case when e.doc_type in ('news', 'job', 'property', 'shopping', 'tender') and e.doc_type <> d.doc_type and e.doc_type_confidence >= 0.8 then e.doc_type else d.doc_type end as doc_type,
coalesce(e.doc_type in ('news', 'job', 'property', 'shopping', 'tender') and e.doc_type <> d.doc_type and e.doc_type_confidence >= 0.8, false) as overridden from d join e using (source, source_key)""")
def classification_gate(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).select("source", "source_key", F.col("doc_type").alias("model"), F.col("doc_type_confidence").alias("confidence"))
    g = enrich.gate(F.col("doc_type"), F.col("model"), F.col("confidence"))
    return _docs(spark, d, "source", "source_key", "doc_type").join(r, ["source", "source_key"]).select("id", g["doc_type"].alias("doc_type"), g["overridden"].alias("overridden"))


@query("seed_sample")
def seed_sample(spark: SparkSession, d: str) -> DataFrame:
    """A random sample of fifty records, the same for the same seed; sampling is the feature."""
    return _docs(spark, d, "source").orderBy(F.xxhash64("id", F.lit(42)), "id").limit(50)


@query("category_map_left", """with m as (select 'Root > ' || category_leaf as path, category_leaf as category, category_leaf <> 'Marine' as is_active from (select distinct category_leaf from search_document where category_leaf in ('Homes', 'Marine', 'Vacancies'))),
d as (select distinct id, array_to_string(json_extract_string(attrs, '$.category_path[*]'), ' > ') as path from search_document)
select id, case when is_active then category end as category, m.path is not null as mapped from d left join m using (path)""")
def category_map_left(spark: SparkSession, d: str) -> DataFrame:
    """Source paths -> categories: inactive ones and paths without a row give none; a reviewed path differs from an unknown one."""
    from reefglass.operators.filters import json_array
    from reefglass.sources.tables import local_table

    m = local_table(spark, [("Root > Homes", "Homes", True), ("Root > Marine", "Marine", False), ("Root > Vacancies", "Vacancies", True)], path="string", category="string", is_active="bool")
    docs = _docs(spark, d, "attrs").select("id", F.array_join(json_array("category_path"), " > ").alias("path"))
    return docs.join(F.broadcast(m), "path", "left").select("id", F.when(F.col("is_active"), F.col("category")).alias("category"), F.col("category").isNotNull().alias("mapped"))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    r = read_table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("family").alias("tier"))
    n = read_table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.lit("primary").alias("tier"))
    s = read_table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent"), F.lit("part").alias("tier"))
    return r.unionByName(n).unionByName(s)


_TREE = "tree as (select 'r' || r_regionkey as node, null as parent, 'family' as tier from region union all select 'n' || n_nationkey, 'r' || n_regionkey, 'primary' from nation union all select 's' || s_suppkey, 'n' || s_nationkey, 'part' from supplier)"


@query("category_family", f"with recursive {_TREE}, up as (select node, parent as ancestor from tree where parent is not null union all select up.node, t.parent from up join tree t on t.node = up.ancestor where t.parent is not null) select up.node, ancestor as family from up join tree t on t.node = up.ancestor where t.tier = 'family'")
def category_family(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d)
    top = tree.where("tier = 'family'").select(F.col("node").alias("family"))
    return ops.ancestors(tree).join(top, F.col("ancestor") == F.col("family")).select("node", "family")


@query("primary_sibling", f"with {_TREE}, p as (select parent as family, min(node) as primary_node from tree where tier = 'primary' group by 1) select n.node, primary_node from tree n join tree up on up.node = n.parent join p on p.family = up.parent where n.tier = 'part'")
def primary_sibling(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d)
    first = tree.where("tier = 'primary'").groupBy(F.col("parent").alias("family")).agg(F.min("node").alias("primary_node"))
    up = tree.select(F.col("node").alias("_n"), F.col("parent").alias("family"))
    return tree.where("tier = 'part'").join(up, F.col("parent") == F.col("_n")).join(first, "family").select("node", "primary_node")


_PATHS = "p as (select distinct json_extract_string(attrs, '$.category_path[*]') as path from search_document where len(json_extract_string(attrs, '$.category_path[*]')) > 0)"


@query("taxonomy_infer_tier", f"""with {_PATHS}, m as (select path, path[2:greatest(len(path) - 1, 1)] as middle, path[3:greatest(len(path) - 1, 2)] as below from p),
t as (select *, list_contains(middle, 'Parts') or len(list_filter(below, lambda s: s = 'Parts' or s like '% Parts' or s like '%& Parts')) > 0 as part, list_contains(middle, 'Accessories') or path[-1] like '%Accessories' or len(list_filter(below, lambda s: s like '%Accessories')) > 0 as accessory,
regexp_replace(regexp_replace(lower(array_to_string(list_filter(path[-2:], lambda s: s <> ''), '-')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from m)
select array_to_string(path, ' > ') as path, case when len(path) = 1 then 'family' when part then 'part' when accessory then 'accessory' when path[1] = 'Services' or regexp_matches(path[-1], '{"|".join(ops.SERVICES)}', 'i') then 'service' else 'primary' end as tier,
case when slug = '' then 'unmapped' else left(slug, 64) end as key from t""")
def taxonomy_infer_tier(spark: SparkSession, d: str) -> DataFrame:
    """Tier and key of every source path; the rules are covered by tests."""
    from reefglass.operators.filters import json_array

    p = json_array("category_path")
    return _docs(spark, d, "attrs").where(F.size(p) > 0).select(F.array_join(p, " > ").alias("path"), ops.infer_tier(p).alias("tier"), ops.category_key(p).alias("key")).distinct()


@query("path_counts", "with d as (select distinct id, attrs from search_document) select array_to_string(json_extract_string(attrs, '$.category_path[*]'), ' > ') as path, count(*)::bigint as n from d where len(json_extract_string(attrs, '$.category_path[*]')) > 0 group by 1")
def path_counts(spark: SparkSession, d: str) -> DataFrame:
    from reefglass.operators.filters import json_array

    p = json_array("category_path")
    return _docs(spark, d, "attrs").where(F.size(p) > 0).groupBy(F.array_join(p, " > ").alias("path")).agg(F.count(F.lit(1)).alias("n"))


@query("colliding_leaf_labels", """with p as (select distinct p_type, p_brand from part), k as (select lower(trim(p_type)) as leaf, regexp_replace(regexp_replace(lower(p_brand || '-' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as key from p)
select leaf, count(distinct key)::bigint as keys from k group by leaf having count(distinct key) > 1""")
def colliding_leaf_labels(spark: SparkSession, d: str) -> DataFrame:
    return ops.colliding_leaves(read_table(spark, d, "part", "p_type", "p_brand").distinct().select(F.array(F.lit("Root"), F.col("p_brand"), F.col("p_type")).alias("path")))


@query("seen_page_streak", """with p as (select user_id as g, row_number() over (partition by user_id order by event_id) as page, event_type in ('view', 'click') as seen, value >= 2 as ok from events),
f as (select *, sum(case when ok then 0 else 1 end) over (partition by g order by page) as gone from p), b as (select *, sum(case when seen then 0 else 1 end) over (partition by g order by page) as breaks from f where gone = 0),
r as (select g, breaks, count(*) as n from b where seen group by all) select g as user_id, max(n)::bigint as streak from r group by g""")
def seen_page_streak(spark: SparkSession, d: str) -> DataFrame:
    """Longest run of seen pages per crawl. Pages are numbered before the failed ones go, so a crawl ends at its first missing page; a crawl's pages are a bounded group."""
    e = read_table(spark, d, "events", "event_id", "user_id", "event_type", "value")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    pages = e.withColumn("page", number).where("value >= 2").select(F.col("user_id").alias("group"), "page", F.col("event_type").isin("view", "click").alias("seen"))
    return ops.longest_seen_run(pages).select(F.col("group").alias("user_id"), "streak")


@query("report_sibling_counts", "with r as (select event_id, user_id, ts from events where event_type = 'error'), c as (select user_id, count(*)::bigint as siblings from r group by 1) select event_id, siblings from r join c using (user_id)")
def report_sibling_counts(spark: SparkSession, d: str) -> DataFrame:
    r = read_table(spark, d, "events", "event_id", "user_id", "event_type").where("event_type = 'error'")
    return r.join(r.groupBy("user_id").agg(F.count(F.lit(1)).alias("siblings")), "user_id").select("event_id", "siblings")


@query("report_once", "with r as (select user_id, props, min(event_id) as event_id from events where event_type = 'error' group by all) select user_id, props, event_id from r")
def report_once(spark: SparkSession, d: str) -> DataFrame:
    """The first report of a visitor on a thing counts, later ones are swallowed."""
    return read_table(spark, d, "events", "event_id", "user_id", "event_type", "props").where("event_type = 'error'").groupBy("user_id", "props").agg(F.min("event_id").alias("event_id"))


@query("harvest_distinct_strings", "with e as (select unnest(keywords) as w from enriched_record union all select canonical_title_en from enriched_record) select distinct trim(w, ' ') as w from e where length(trim(w, ' ')) >= 3")
def harvest_distinct_strings(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "enriched_record", "keywords", "canonical_title_en")
    words = F.concat(F.coalesce("keywords", F.array().cast("array<string>")), F.array("canonical_title_en"))
    return e.select(F.explode(words).alias("w")).select(F.trim("w").alias("w")).where(F.length("w") >= 3).distinct()


@query("missing_translations", f"with {_D}, {_E} select distinct d.title_dv as text from d where coalesce(d.title_dv, '') <> '' and not exists (select 1 from e where e.canonical_title_dv = d.title_dv)")
def missing_translations(spark: SparkSession, d: str) -> DataFrame:
    have = _records(spark, d).select(F.col("canonical_title_dv").alias("text"))
    return _docs(spark, d, "title_dv").where("title_dv <> ''").select(F.col("title_dv").alias("text")).distinct().join(have, "text", "left_anti")


# pay: order lines as allowances of a monthly salary
_PAY = """p as (select o_orderkey, o_totalprice as basic, o_orderpriority = '1-URGENT' as pension from orders), a as (select l_orderkey as o_orderkey, sum(case l_returnflag when 'A' then l_extendedprice when 'N' then l_quantity * 20 else l_tax * 8 * 20 end) as added, count(*) as n from lineitem group by 1)"""


@query("net_pay_estimate", f"with {_PAY} select p.o_orderkey, round(basic - (case when pension then basic * 0.07 else 0 end) + coalesce(added, 0), 4) as net from p left join a using (o_orderkey)")
def net_pay_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Salary less pension plus allowances by basis; allowances of one notice are a bounded list."""
    lines = read_table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_quantity", "l_tax")
    flag = F.col("l_returnflag")
    a = F.struct(
        F.col("l_linenumber").cast("string").alias("kind"), F.when(flag == "A", F.col("l_extendedprice")).when(flag == "N", F.col("l_quantity")).otherwise(F.col("l_tax")).alias("amount"),
        F.when(flag == "A", "fixed_monthly").when(flag == "N", "per_day").otherwise("per_hour").alias("basis"),
    )
    per = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(a).alias("allowances"))
    o = read_table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderpriority").join(per, "o_orderkey", "left")
    lists = F.coalesce("allowances", F.array().cast("array<struct<kind:string,amount:double,basis:string>>"))
    net = scoring.net_pay(F.col("o_totalprice"), F.lit("month"), lists, F.col("o_orderpriority") == "1-URGENT", F.lit(0.07), F.lit("full"), F.lit(None).cast("double"))
    return o.select("o_orderkey", F.round(net, 4).alias("net"))


@query("rent_display", f"with {_D} select id, case when price is null then 'Price on request' else coalesce(nullif(currency, ''), 'MVR') || ' ' || format('{{:,.0f}}', round_even(price::double, 0)) || ' / month' end as rent from d")
def rent_display(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d, "price", "currency")
    return docs.select("id", scoring.rent_display(F.col("price"), F.col("currency"), F.lit("month")).alias("rent"))


@query("salary_display", "select o_orderkey, case when o_orderstatus = 'P' then 'Negotiable' when o_orderstatus <> 'F' or o_totalprice = 0 then 'Unlisted' else 'MVR ' || format('{:,.0f}', floor(o_totalprice)) || ' / month' end as salary from orders")
def salary_display(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    state = F.when(F.col("o_orderstatus") == "P", "negotiable").when(F.col("o_orderstatus") == "F", "listed").otherwise("unlisted")
    return o.select("o_orderkey", scoring.salary_display(state, F.floor("o_totalprice").cast("double"), F.lit(None).cast("double"), F.lit(""), F.lit("month")).alias("salary"))


@query("capacity_display", "select p_partkey, case p_size % 4 when 0 then p_size || ' room' when 1 then 'Bed space, ' || p_size || ' available, shared' when 2 then 'Guest house room, up to ' || p_size else 'Whole unit, ' || p_size || ' rooms' end as capacity from part")
def capacity_display(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part", "p_partkey", "p_size")
    n, kind = F.col("p_size"), F.element_at(F.array(*[F.lit(x) for x in ("room", "bed_space", "guest_house", "whole_unit")]), F.col("p_size") % 4 + 1)
    total = F.when(kind == "whole_unit", n)
    return p.select("p_partkey", scoring.capacity_display(kind, n, total, n, n, kind == "bed_space").alias("capacity"))


@query("card_build", f"""with {_D} select id, json_merge_patch('{{}}', json_object('title', coalesce(nullif(trim(title_en, ' '), ''), title_dv), 'place', island,
'price', case when price is null then 'Price on request' else coalesce(nullif(currency, ''), 'MVR') || ' ' || format('{{:,.0f}}', round_even(price::double, 0)) || ' / month' end, 'picture', thumbnails[1]))::varchar as card from d""")
def card_build(spark: SparkSession, d: str) -> DataFrame:
    """The card of every record as JSON."""
    docs = _docs(spark, d, "title_en", "title_dv", "island", "price", "currency", "thumbnails")
    return docs.select("id", enrich.card(docs).alias("card"))


@query("string_grounding", r"""with e as (select distinct record_id, summary_en, canonical_title_en from enriched_record), n as (select record_id, trim(regexp_replace(lower(coalesce(canonical_title_en, '')), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) as v, trim(regexp_replace(lower(coalesce(summary_en, '')), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) as s from e),
t as (select *, list_distinct(string_split(v, ' ')) as a, list_distinct(string_split(s, ' ')) as b from n)
select record_id, length(v) < 3 or contains(s, v) or len(list_intersect(a, b))::double / least(len(a), len(b)) >= 0.85 as grounded from t""")
def string_grounding(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("record_id", scoring.grounded(F.coalesce("canonical_title_en", F.lit("")), F.coalesce("summary_en", F.lit(""))).alias("grounded"))


@query("json_grounding")
def json_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of the attributes kept only where title or summary support them; a walk over free JSON."""
    docs = _docs(spark, d, "attrs", "title_en", "summary_en", "category_leaf")
    return enrich.ground(docs.select("id", F.col("attrs").alias("value"), F.concat_ws(" ", F.lit("Root"), "category_leaf", "title_en", "summary_en").alias("source")))


@query("attrs_merge_answered", f"""with {_D} select id, coalesce(nullif(island, ''), 'unknown') as island, source from d""")
def attrs_merge_answered(spark: SparkSession, d: str) -> DataFrame:
    """Answered values replace the base, unanswered and the scraper's own do not."""
    docs = _docs(spark, d, "island", "source")
    base = F.create_map(F.lit("island"), F.lit("unknown"), F.lit("source"), F.col("source"))
    told = F.create_map(F.lit("island"), F.col("island"), F.lit("source"), F.lit("elsewhere"))
    m = enrich.merge_answered(base, told, ("source",))
    return docs.select("id", m["island"].alias("island"), m["source"].alias("source"))


@query("attachment_worklist", r"""with i as (select distinct iulaan_id, attachments, iulaan_type from iulaan where attachments is not null), a as (select iulaan_id, iulaan_type, attachments, unnest(json_keys(attachments)) as label from i)
select iulaan_id, label from a where not regexp_matches(label || ' ' || json_extract_string(attachments, '$."' || label || '"'), 'form|foam|ފޯމ|އެދޭ|application|apply', 'i') and (iulaan_type is null or lower(trim(iulaan_type, ' ')) <> 'job')""")
def attachment_worklist(spark: SparkSession, d: str) -> DataFrame:
    from reefglass.functions.extract import attachment_role

    i = read_table(spark, d, "iulaan", "iulaan_id", "attachments", "iulaan_type").dropDuplicates(["iulaan_id"])
    a = i.select("iulaan_id", "iulaan_type", F.explode(F.from_json("attachments", "map<string,string>")).alias("label", "url"))
    return a.where((attachment_role(F.col("label"), F.col("url")) != "application_form") & (F.col("iulaan_type").isNull() | (F.lower(F.trim("iulaan_type")) != "job"))).select("iulaan_id", "label")


@query("attachment_text_concat", "with e as (select distinct record_id, source, summary_en from enriched_record where coalesce(summary_en, '') <> '' and status = 'ok') select source, count(*)::bigint as texts, sum(length(summary_en))::bigint as chars, bool_or(length(summary_en) > 200) as any_long from e group by source")
def attachment_text_concat(spark: SparkSession, d: str) -> DataFrame:
    e = _records(spark, d).where("summary_en <> '' and status = 'ok'")
    return e.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length("summary_en")).cast("long").alias("chars"), F.bool_or(F.length("summary_en") > 200).alias("any_long"))


@query("reset_signature", f"with {_E} select record_id, case when status = 'failed' and attempts >= 3 then 'pending' else status end as status, case when status = 'failed' and attempts >= 3 then 0 else attempts end as attempts from e")
def reset_signature(spark: SparkSession, d: str) -> DataFrame:
    hit = (F.col("status") == "failed") & (F.col("attempts") >= 3)
    return _records(spark, d).select("record_id", F.when(hit, "pending").otherwise(F.col("status")).alias("status"), F.when(hit, 0).otherwise(F.col("attempts")).alias("attempts"))


# logs: the events table as a query log
@query("log_zero_result_top", "select props as q, count(*)::bigint as n from events where value < 5 group by 1 order by n desc, q limit 20")
def log_zero_result_top(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events", "props", "value").where("value < 5")
    return e.groupBy(F.col("props").alias("q")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "q").limit(20)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return logs.event_time(read_table(spark, d, "events"))


def _us(c: str):
    return F.unix_micros(c).alias(c)


_HOUR = 3_600_000_000


@query("rate_limit_window", f"select user_id, (epoch_us(ts) // {24 * _HOUR} * {24 * _HOUR})::bigint as window_start, count(*)::bigint as n from events group by all having count(*) > 3")
def rate_limit_window(spark: SparkSession, d: str) -> DataFrame:
    """Visitors with more than three events in a day."""
    return logs.over_fixed_limit(_events(spark, d), 3, 86_400).select("user_id", _us("window_start"), "n")


@query("rate_limit_sliding", "select user_id, event_id, n from (select user_id, event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 86399999999 preceding and current row)::bigint as n from events) where n > 3")
def rate_limit_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Events that are the fourth or later of their visitor within the day before them."""
    return logs.over_limit(_events(spark, d), 3, 86_400).select("user_id", "event_id", "n")


@query("click_join_query", "select q.event_id as query_id, c.event_id as click_id, user_id from events q join events c using (user_id) where q.event_type = 'view' and c.event_type = 'click' and c.ts >= q.ts and c.ts <= q.ts + interval 1 hour")
def click_join_query(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return logs.clicks_of_queries(e.where("event_type = 'click'"), e.where("event_type = 'view'"))


@query("tumbling_counts", f"select (epoch_us(ts) // {_HOUR} * {_HOUR})::bigint as window_start, event_type, count(*)::bigint as n, round(sum(value), 4) as total from events group by all")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    return logs.tumbling(_events(spark, d)).select(_us("window_start"), "event_type", "n", "total")


@query("sliding_counts", f"with e as (select event_type, epoch_us(ts) // {3 * _HOUR} * {3 * _HOUR} as s from events) select (s - k * {3 * _HOUR})::bigint as window_start, event_type, count(*)::bigint as n from e, (select unnest([0, 1]) as k) group by all")
def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    return logs.sliding(_events(spark, d)).select(_us("window_start"), "event_type", "n")


@query("session_counts", """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) as k from e)
select user_id, epoch_us(min(ts)) as session_start, count(*)::bigint as n from s group by user_id, k""")
def session_counts(spark: SparkSession, d: str) -> DataFrame:
    return logs.sessions(_events(spark, d)).select("user_id", _us("session_start"), "n")


@query("monthly_partitions", "select strftime(ts, '%Y-%m') as month, count(*)::bigint as n from events group by 1")
def monthly_partitions(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy(logs.month(F.col("ts")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("new_keys_once", "select distinct user_id, event_type from events")
def new_keys_once(spark: SparkSession, d: str) -> DataFrame:
    return logs.once(_events(spark, d), ["user_id", "event_type"]).select("user_id", "event_type")


@query("stream_tumbling_counts", f"select (epoch_us(ts) // {24 * _HOUR} * {24 * _HOUR})::bigint as window_start, event_type, count(*)::bigint as n from events group by all")
def stream_tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same counts from a stream over the events file, run until all is read, in complete mode."""
    import uuid

    name = f"t{uuid.uuid4().hex}"
    stream = logs.tumbling(logs.read_events(spark, d, read_table(spark, d, "events").schema), "1 day").select("window_start", "event_type", "n")
    run = stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination(600)
    if run.exception() is not None:
        raise RuntimeError(str(run.exception()))
    return spark.table(name).select(_us("window_start"), "event_type", "n")
