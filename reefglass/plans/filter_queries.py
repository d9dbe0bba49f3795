"""Filters, facets and discovered facets over search_document and its attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefglass.functions import lang
from reefglass.operators import facets as fc
from reefglass.operators import filters as flt
from reefglass.operators.search import documents, reposts
from reefglass.plans.registry import AS_OF, AS_OF_US, query
from reefglass.sources.tables import read_table

_COLS = ("id", "source", "doc_type", "title_en", "title_dv", "summary_en", "price", "currency", "island", "atoll", "published_at", "expires_at", "is_active", "attrs", "thumbnails", "category_leaf", "dedupe_key")
_D = f"d as (select distinct {', '.join(_COLS)} from search_document)"
_SOON = AS_OF_US + 7 * 86_400_000_000


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, *_COLS)


def _filtered(spark: SparkSession, d: str, tab: str, filters: list[str]) -> DataFrame:
    return flt.apply(_docs(spark, d), flt.parse(tab, filters), _as_of()).select("id")


def _where(name: str, tab: str, filters: list[str], condition: str) -> None:
    @query(name, f"with {_D} select id from d where {condition}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _filtered(spark, d, tab, filters)


_VIEWS = "try_cast(json_extract_string(attrs, '$.views') as double)"
_where("filter_enum_multi", "property", ["island:Dhiyathoogiri", "island:Kelathoodhoo", "island:Makugangiri"], "island in ('Dhiyathoogiri', 'Kelathoodhoo', 'Makugangiri')")
_where("filter_range", "property", ["price:9000..100"], "price between 100 and 9000")
_where("filter_range_open", "property", ["price:50000.."], "price >= 50000")
_where("filter_json_range", "news", ["views:100..300"], f"{_VIEWS} between 100 and 300")
_where("filter_array_overlap", "shopping", ["category_path:Marine", "category_path:Homes"], "list_has_any(json_extract_string(attrs, '$.category_path[*]'), ['Marine', 'Homes'])")
_where("filter_has_images", "property", ["has_images:yes"], "len(thumbnails) > 0")
_where("filter_no_images", "property", ["has_images:no"], "coalesce(len(thumbnails), 0) = 0")
_where("filter_deadline_open", "job", ["deadline:open"], f"expires_at is null or epoch_us(expires_at) >= {AS_OF_US}")
_where("filter_deadline_soon", "job", ["deadline:closing_soon"], f"epoch_us(expires_at) >= {AS_OF_US} and epoch_us(expires_at) < {_SOON}")
_where("filter_deadline_closed", "job", ["deadline:closed"], f"epoch_us(expires_at) < {AS_OF_US}")
_where("filter_deadline_unknown", "job", ["deadline:whenever"], "true")
_where("filter_combined", "property", ["island:Dhiyathoogiri", "island:Fenethoodhoo", "price:..60000", "has_images:true"], "island in ('Dhiyathoogiri', 'Fenethoodhoo') and price <= 60000 and len(thumbnails) > 0")


@query("filter_json_scalar", f"with {_D} select id, json_extract_string(attrs, '$.views') as views from d where json_extract_string(attrs, '$.views') in ('100', '200', '300')")
def filter_json_scalar(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(flt.json_scalar("views").isin("100", "200", "300")).select("id", flt.json_scalar("views").alias("views"))


@query("base_predicate", f"""with {_D}, dup as (select id from (select id, row_number() over (partition by dedupe_key order by published_at is null desc, published_at desc, id desc) as rn from d where coalesce(dedupe_key, '') <> '') where rn > 1)
select doc_type, count(*)::bigint as n from d where is_active and id not in (select id from dup) group by doc_type""")
def base_predicate(spark: SparkSession, d: str) -> DataFrame:
    """What a search may show: active documents that are no flagged reposts."""
    return _docs(spark, d).where("is_active").join(reposts(read_table(spark, d, "search_document", "id", "dedupe_key", "published_at")), "id", "left_anti").groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"))


@query("title_by_language", f"with {_D} select id, case when trim(coalesce(title_dv, '')) <> '' then title_dv else coalesce(title_en, '') end as title, trim(coalesce(title_dv, '')) = '' as translated from d")
def title_by_language(spark: SparkSession, d: str) -> DataFrame:
    empty = F.trim(F.coalesce("title_dv", F.lit(""))) == ""
    return _docs(spark, d).select("id", F.when(~empty, F.col("title_dv")).otherwise(F.coalesce("title_en", F.lit(""))).alias("title"), empty.alias("translated"))


@query("bilingual_missing", f"with {_D} select id from d where trim(coalesce(title_en, '')) = '' or trim(coalesce(title_dv, '')) = '' or trim(coalesce(summary_en, '')) = ''")
def bilingual_missing(spark: SparkSession, d: str) -> DataFrame:
    empty = [F.trim(F.coalesce(c, F.lit(""))) == "" for c in ("title_en", "title_dv", "summary_en")]
    return _docs(spark, d).where(empty[0] | empty[1] | empty[2]).select("id")


@query("images_tab", f"with {_D} select id, len(thumbnails)::integer as pictures, thumbnails[1] as picture from d where len(thumbnails) > 0")
def images_tab(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(F.size("thumbnails") > 0).select("id", F.size("thumbnails").alias("pictures"), F.get("thumbnails", F.lit(0)).alias("picture"))


# attributes: the registry's own rows, by id
_CELLS = """cells as (select distinct s.spec_id, s.document_id, k.spec_key, k.datatype, s.value_text as text, case when isfinite(s.value_num) then s.value_num end as num
from document_spec s join spec_key k using (key_id))"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Rows that carry a registry id, values as stored."""
    keys = read_table(spark, d, "spec_key", "key_id", "spec_key", "datatype").dropDuplicates(["key_id"])  # a table of fixed size
    rows = read_table(spark, d, "document_spec", "spec_id", "document_id", "key_id", "value_num", "value_text").where("key_id is not null").dropDuplicates(["spec_id"])
    num = F.when(~F.isnan("value_num") & (F.abs("value_num") < float("inf")), F.col("value_num"))
    return rows.join(F.broadcast(keys), "key_id").select("spec_id", "document_id", "spec_key", "datatype", F.col("value_text").alias("text"), num.alias("num"))


@query("filter_spec_range", f"with {_D}, {_CELLS} select id from d where exists (select 1 from cells c where c.document_id = d.id and spec_key = 'bedrooms' and num between 2 and 3)")
def filter_spec_range(spark: SparkSession, d: str) -> DataFrame:
    return flt.with_spec(_docs(spark, d), cells(spark, d), "bedrooms", "range", (2.0, 3.0)).select("id")


@query("filter_spec_eq", f"with {_D}, {_CELLS} select id from d where exists (select 1 from cells c where c.document_id = d.id and spec_key = 'material' and text in ('Rattan', 'Bamboo'))")
def filter_spec_eq(spark: SparkSession, d: str) -> DataFrame:
    return flt.with_spec(_docs(spark, d), cells(spark, d), "material", "checkbox", ["Rattan", "Bamboo"]).select("id")


@query("filter_spec_bool", f"with {_D}, {_CELLS} select id from d where exists (select 1 from cells c where c.document_id = d.id and spec_key = 'has_lift' and num = 1.0)")
def filter_spec_bool(spark: SparkSession, d: str) -> DataFrame:
    return flt.with_spec(_docs(spark, d), cells(spark, d), "has_lift", "toggle", True).select("id")


@query("facet_enum_topn", f"with {_D} select island as value, count(*)::bigint as n from d where coalesce(island, '') <> '' group by 1 order by n desc, value limit 12")
def facet_enum_topn(spark: SparkSession, d: str) -> DataFrame:
    return fc.enum_counts(_docs(spark, d), F.col("island"))


@query("facet_array", f"with {_D}, v as (select unnest(json_extract_string(attrs, '$.category_path[*]')) as value from d) select value, count(*)::bigint as n from v where value <> '' group by 1 order by n desc, value limit 12")
def facet_array(spark: SparkSession, d: str) -> DataFrame:
    return fc.array_counts(_docs(spark, d), flt.json_array("category_path"))


_BUCKET = f"case when expires_at is null or epoch_us(expires_at) >= {_SOON} then 'open' when epoch_us(expires_at) >= {AS_OF_US} then 'closing_soon' else 'closed' end"


@query("facet_deadline_buckets", f"with {_D} select {_BUCKET} as bucket, count(*)::bigint as n from d group by 1")
def facet_deadline_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy(fc.deadline_bucket(F.col("expires_at"), _as_of()).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("facet_range_minmax", f"with {_D}, v as (select 'price' as key, price::double as x from d union all select 'views', {_VIEWS} from d) select key, min(x) as lo, max(x) as hi, count(*)::bigint as n from v where x is not null group by key")
def facet_range_minmax(spark: SparkSession, d: str) -> DataFrame:
    return fc.ranges(_docs(spark, d), {"price": F.col("price"), "views": flt.json_scalar("views").try_cast("double")})


def _hist(x: str, source: str) -> str:
    return f"""v as (select x from (select {x} as x from {source}) where x is not null), e as (select min(x) as lo, max(x) as hi from v),
    b as (select least(10, floor((x - lo) / (hi - lo) * 10)::integer + 1) as bucket, count(*) as n from v, e group by 1)
    select g.bucket, round(lo + (hi - lo) / 10 * (g.bucket - 1), 6) as lo, round(lo + (hi - lo) / 10 * g.bucket, 6) as hi, coalesce(n, 0)::bigint as n from e, (select unnest(range(1, 11))::integer as bucket) g left join b using (bucket)"""


@query("facet_histogram", f"with {_D}, {_hist('price::double', 'd')}")
def facet_histogram(spark: SparkSession, d: str) -> DataFrame:
    return fc.histogram(_docs(spark, d), F.col("price"))


@query("histogram_fold_last", f"with {_hist('p_retailprice', 'part')}")
def histogram_fold_last(spark: SparkSession, d: str) -> DataFrame:
    """The greatest value falls into the last bucket."""
    return fc.histogram(read_table(spark, d, "part", "p_retailprice"), F.col("p_retailprice"))


@query("facet_toggle", f"with {_D} select 'has_images' as key, count(*) filter (len(thumbnails) > 0)::bigint as n from d union all select 'active', count(*) filter (is_active)::bigint from d")
def facet_toggle(spark: SparkSession, d: str) -> DataFrame:
    return fc.toggles(_docs(spark, d), {"has_images": F.size("thumbnails") > 0, "active": F.col("is_active"), "never": F.lit(False)})


@query("facet_all_static", f"""with {_D}, v as (
select 'category_leaf' as key, 12 as top, category_leaf as value from d union all select 'deadline', 12, {_BUCKET} from d union all select 'island', 20, island from d union all select 'location', 12, island from d
union all select k, n, json_extract_string(attrs, '$.' || p) from d, (values ('job_category', 12, 'job_category'), ('position_type', 12, 'position_type'), ('salary_state', 12, 'compensation.salary_state'), ('employer', 20, 'employer'), ('grade', 12, 'grade')) j(k, n, p)),
c as (select key, top, value, count(*)::bigint as n from v where coalesce(value, '') <> '' group by all),
r as (select *, row_number() over (partition by key order by n desc, value)::integer as rank from c) select key, value, n, rank from r where rank <= top""")
def facet_all_static(spark: SparkSession, d: str) -> DataFrame:
    return fc.static_facets(_docs(spark, d), flt.TABS["job"], _as_of())


def _page_sql(tab: str) -> str:
    boxes, rest = [], []
    for f in flt.TABS[tab]:
        js = f"json_extract_string(attrs, '$.{f.path}')"
        if f.store == "spec":
            continue
        if f.widget == "range":
            parts = [f"upper(coalesce({c if c in _COLS else f"json_extract_string(attrs, '$.{c}')"}, ''))" for c in f.split_by]
            x = f"{f.path}::double" if f.store == "column" else f"try_cast({js} as double)"
            rest.append(f"select '{f.key}' as key, 'range' as widget, {" || '/' || ".join(parts) or "''"} as part, null::varchar as value, count(x)::bigint as n, null::integer as rank, min(x) as lo, max(x) as hi from (select *, {x} as x from t) where x is not null group by part")
        elif f.widget == "toggle":
            cond = "len(thumbnails) > 0" if f.path == "thumbnails" else f"coalesce(len(json_extract_string(attrs, '$.{f.path}[*]')), 0) > 0" if f.key == "has_attachments" else f"{js} = 'true'"
            rest.append(f"select '{f.key}', 'toggle', '', 'true', count(*)::bigint, null, null, null from t where {cond} having count(*) > 0")
        else:
            v = _BUCKET if f.key == "deadline" else f.path if f.store == "column" else f"unnest(json_extract_string(attrs, '$.{f.path}[*]'))" if f.store == "json_array" else js
            boxes.append(f"select '{f.key}' as key, {f.top} as top, {v} as value from t")
    where = "is_active" if tab == "all" else f"is_active and doc_type = '{tab}'"
    ranked = f"select *, row_number() over (partition by key order by n desc, value)::integer as rank from (select key, top, value, count(*)::bigint as n from ({" union all ".join(boxes)}) where coalesce(value, '') <> '' group by all)"
    return f"with {_D}, t as (select * from d where {where}) " + " union all ".join([f"select key, 'checkbox' as widget, '' as part, value, n, rank, null::double as lo, null::double as hi from ({ranked}) where rank <= top", *rest])


def _page(tab: str) -> None:
    @query(f"facet_page_{tab}", _page_sql(tab))
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = _docs(spark, d).where("is_active")
        return fc.page_facets(docs if tab == "all" else docs.where(F.col("doc_type") == tab), flt.TABS[tab], _as_of())


for _tab in ("job", "property", "shopping", "news", "all"):
    _page(_tab)


@query("facet_dominant_category", f"""with {_D}, p as (select category_leaf as category, count(*)::bigint as n from d where doc_type = 'property' and coalesce(category_leaf, '') <> '' group by 1 order by n desc, 1 limit 1)
select category, n, round(n / (select count(*) from d where doc_type = 'property'), 6) as share from p where n / (select count(*) from d where doc_type = 'property') >= 0.7""")
def facet_dominant_category(spark: SparkSession, d: str) -> DataFrame:
    return fc.dominant_category(_docs(spark, d).where("doc_type = 'property'"))


_STATS = "stats as (select spec_key, count(distinct document_id)::bigint as documents, count(distinct coalesce(nullif(coalesce(text, ''), ''), num::varchar))::bigint as distinct_values from cells group by spec_key)"


@query("facet_key_stats", f"with {_CELLS}, {_STATS} select * from stats")
def facet_key_stats(spark: SparkSession, d: str) -> DataFrame:
    return fc.key_stats(cells(spark, d))


_COUNTS = """ends as (select spec_key, min(num) as lo, max(num) as hi from cells group by spec_key),
vals as (select spec_key, document_id, case when datatype = 'numeric' and lo < hi then least(10, floor((num - lo) / (hi - lo) * 10)::integer + 1)::varchar
when datatype = 'bool' then case when num = 1 then 'true' else 'false' end when datatype = 'enum' then lower(trim(text, ' ')) end as value from cells join ends using (spec_key)),
counts as (select spec_key, value, count(distinct document_id)::bigint as n from vals where coalesce(value, '') <> '' group by all)"""
_ENTROPY = "ent as (select spec_key, round(case when count(*) > 1 then sum(-p * log2(p)) / log2(count(*)) else 0.0 end, 6) as entropy from (select spec_key, n / sum(n) over (partition by spec_key) as p from counts) group by spec_key)"


def _kinds(spark: SparkSession, d: str) -> dict[str, str]:
    return {r.spec_key: r.datatype for r in read_table(spark, d, "spec_key", "spec_key", "datatype").collect()}  # a table of fixed size


@query("facet_value_counts", f"with {_CELLS}, {_COUNTS} select * from counts")
def facet_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return fc.value_counts(cells(spark, d), _kinds(spark, d))


@query("facet_entropy", f"with {_CELLS}, {_COUNTS}, {_ENTROPY} select spec_key, entropy from ent")
def facet_entropy(spark: SparkSession, d: str) -> DataFrame:
    return fc.entropy(fc.value_counts(cells(spark, d), _kinds(spark, d)))


@query("facet_discovery", f"""with {_D}, {_CELLS}, {_STATS}, {_COUNTS}, {_ENTROPY}, t as (select count(*) as total from d)
select spec_key, documents, coverage, entropy, round(coverage * entropy, 6) as score from (select *, round(documents / total::double, 6) as coverage from stats, t) join ent using (spec_key)
where documents >= 8 and coverage >= 0.05 and distinct_values > 1 and entropy >= 0.05 order by score desc, spec_key limit 8""")
def facet_discovery(spark: SparkSession, d: str) -> DataFrame:
    return fc.discover(cells(spark, d), _kinds(spark, d), documents(spark, d, "id").count())


@query("facet_spec_bool", f"with {_CELLS} select spec_key, count(distinct document_id) filter (num = 1)::bigint as n_true, count(distinct document_id)::bigint as documents from cells where datatype = 'bool' group by spec_key")
def facet_spec_bool(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d).where("datatype = 'bool'")
    return rows.groupBy("spec_key").agg(F.countDistinct(F.when(F.col("num") == 1, F.col("document_id"))).alias("n_true"), F.countDistinct("document_id").alias("documents"))


@query("facet_promotion_queue", r"""with s as (select distinct spec_id, document_id, key_raw, value_text, value_num from document_spec where key_id is null)
select regexp_replace(regexp_replace(lower(key_raw), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as key_raw, count(distinct document_id)::bigint as documents,
count(distinct coalesce(nullif(coalesce(value_text, ''), ''), value_num::varchar))::bigint as distinct_values from s group by 1 order by documents desc, key_raw limit 50""")
def facet_promotion_queue(spark: SparkSession, d: str) -> DataFrame:
    specs = read_table(spark, d, "document_spec", "spec_id", "document_id", "key_id", "key_raw", "value_text", "value_num").dropDuplicates(["spec_id"])
    return fc.promotion_queue(specs, lang.slugify_key(F.col("key_raw")))


@query("orphan_specs", "select distinct spec_id, document_id from document_spec s where not exists (select 1 from search_document d where d.id = s.document_id)")
def orphan_specs(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "search_document", "id").select(F.col("id").alias("document_id"))
    return read_table(spark, d, "document_spec", "spec_id", "document_id").join(docs, "document_id", "left_anti").select("spec_id", "document_id").distinct()


@query("eav_projection", """with s as (select distinct spec_id, document_id, key_raw, value_num, value_text, unit from document_spec)
select document_id, regexp_replace(regexp_replace(lower(key_raw), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as key_raw, value_num, case when length(unit) > 16 then unit else coalesce(value_text, '') end as value_text,
case when length(unit) > 16 then '' else coalesce(unit, '') end as unit from s where value_num is null or isfinite(value_num) group by all""")
def eav_projection(spark: SparkSession, d: str) -> DataFrame:
    """One row per document, key, number and text; nulls compare equal; a unit over 16 characters is text."""
    s = read_table(spark, d, "document_spec", "spec_id", "document_id", "key_raw", "value_num", "value_text", "unit")
    long = F.length("unit") > 16
    s = s.where("value_num is null or not (isnan(value_num) or abs(value_num) = double('infinity'))")
    text = F.when(long, F.col("unit")).otherwise(F.coalesce("value_text", F.lit("")))
    return s.select("document_id", lang.slugify_key(F.col("key_raw")).alias("key_raw"), "value_num", text.alias("value_text"), F.when(F.coalesce(long, F.lit(False)), F.lit("")).otherwise(F.coalesce("unit", F.lit(""))).alias("unit")).distinct()


@query("approx_distinct_values")
def approx_distinct_values(spark: SparkSession, d: str) -> DataFrame:
    """Extension: HyperLogLog counts of documents per attribute."""
    return cells(spark, d).groupBy("spec_key").agg(F.approx_count_distinct("document_id").alias("documents"))
