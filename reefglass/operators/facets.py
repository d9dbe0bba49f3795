"""Facet counts, histograms, and facets discovered from attribute-value rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reefglass import config
from reefglass.operators.filters import Facet, condition, json_array, json_scalar


SKETCH_ERROR = 0.02


def enum_counts(docs: DataFrame, value: Column, top: int = 12) -> DataFrame:
    """(value, n) of the commonest non-empty values; ties by value."""
    return docs.select(value.alias("value")).where("value is not null and value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top)


def array_counts(docs: DataFrame, values: Column, top: int = 12) -> DataFrame:
    """As enum_counts over array elements; repeated elements of one document count each."""
    return enum_counts(docs.select(F.explode(values).alias("v")), F.col("v"), top)


def deadline_bucket(column: Column, as_of: Column) -> Column:
    """open, closing_soon or closed: here they do not overlap."""
    soon = as_of + F.expr(f"INTERVAL {config.CLOSING_SOON_DAYS} DAYS")
    return F.when(column.isNull() | (column >= soon), "open").when(column >= as_of, "closing_soon").otherwise("closed")


def bucket_of(x: Column, lo: Column, hi: Column, buckets: int = 10) -> Column:
    """Equal-width bucket 1..buckets; the maximum belongs to the last, a single value to the first."""
    return F.when(hi == lo, F.lit(1)).otherwise(F.least(F.lit(buckets), F.floor((x - lo) / (hi - lo) * buckets).cast("int") + 1))


def histogram(docs: DataFrame, value: Column, buckets: int = 10) -> DataFrame:
    """(bucket, lo, hi, n), zero-filled; none for no values, one bucket if all values are equal."""
    rows = docs.select(value.cast("double").alias("x")).where("x is not null")
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # one row
    counted = rows.join(F.broadcast(ends)).groupBy(bucket_of(F.col("x"), F.col("lo"), F.col("hi"), buckets).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    frame = ends.where("lo is not null").select("lo", "hi", F.explode(F.sequence(F.lit(1), F.when(F.col("lo") == F.col("hi"), 1).otherwise(buckets))).alias("bucket"))
    width = (F.col("hi") - F.col("lo")) / buckets
    return frame.join(counted, "bucket", "left").select("bucket", F.round(F.col("lo") + width * (F.col("bucket") - 1), 6).alias("lo"), F.round(F.col("lo") + width * F.col("bucket"), 6).alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _labelled(values: Column, f: Facet) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(f.key).alias("key"), F.lit(f.top).alias("top"), v.alias("value")))


def static_facets(docs: DataFrame, facets: tuple[Facet, ...], as_of: Column) -> DataFrame:
    """(key, value, n) of all checkbox facets of a tab in one pass: each row is unpivoted once and counted with map-side combine."""
    entries = []
    for f in facets:
        if f.widget != "checkbox" or f.store == "spec":
            continue
        if f.key == "deadline":
            values = F.array(deadline_bucket(F.col(f.path), as_of))
        elif f.store == "json_array":
            values = json_array(f.path)
        else:
            values = F.array((F.col(f.path) if f.store == "column" else json_scalar(f.path)).cast("string"))
        entries.append(_labelled(values, f))
    if not entries:
        entries = [F.array().cast("array<struct<key:string,top:int,value:string>>")]
    long = docs.select(F.inline(F.concat(*entries))).where("value is not null and value <> ''")
    counted = long.groupBy("key", "top", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("key").orderBy(F.desc("n"), "value")
    return counted.withColumn("rank", F.row_number().over(w)).where("rank <= top").select("key", "value", "n", "rank")


def ranges(docs: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(key, lo, hi, n) of several range facets in one pass; those without values are left out."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("x")) for k, v in values.items()])
    return docs.select(F.inline(entries)).where("x is not null").groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))


def toggles(docs: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(key, n) of the toggles that hold anywhere, in one pass."""
    one = docs.agg(*[F.count_if(c).alias(k) for k, c in conditions.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("n")) for k in conditions]))).where("n > 0")


PAGE_SCHEMA = ("key", "widget", "part", "value", "n", "rank", "lo", "hi")


def split_ranges(docs: DataFrame, f: Facet) -> DataFrame:
    """(part, lo, hi, n) of a range facet, one row for each part in which its values can be compared."""
    number = F.col(f.path).cast("double") if f.store == "column" else json_scalar(f.path).try_cast("double")
    part = F.concat_ws("/", *[F.upper(F.coalesce(F.col(c) if c in docs.columns else json_scalar(c), F.lit(""))) for c in f.split_by]) if f.split_by else F.lit("")
    return docs.select(part.alias("part"), number.alias("x")).where("x is not null").groupBy("part").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))


def page_facets(docs: DataFrame, facets: tuple[Facet, ...], as_of: Column, cells: DataFrame | None = None, kinds: dict[str, str] | None = None) -> DataFrame:
    """(key, widget, part, value, n, rank, lo, hi): every facet of a page over its candidates.

    Checkboxes give their commonest values, ranges their ends per part, toggles that hold anywhere their number. With cells, the
    attributes worth offering (``discover``) are added as facets of their own, in the order of their scores.
    """
    null = F.lit(None)
    boxes = static_facets(docs, facets, as_of).select("key", F.lit("checkbox").alias("widget"), F.lit("").alias("part"), "value", "n", "rank", null.cast("double").alias("lo"), null.cast("double").alias("hi"))
    out = [boxes]
    for f in facets:
        if f.widget == "range" and f.store != "spec":
            out.append(split_ranges(docs, f).select(F.lit(f.key).alias("key"), F.lit("range").alias("widget"), "part", null.cast("string").alias("value"), "n", null.cast("int").alias("rank"), "lo", "hi"))
    conditions = {f.key: condition(f, True, as_of) for f in facets if f.widget == "toggle" and f.store != "spec"}
    if conditions:
        held = toggles(docs, conditions)
        out.append(held.select("key", F.lit("toggle").alias("widget"), F.lit("").alias("part"), F.lit("true").alias("value"), "n", null.cast("int").alias("rank"), null.cast("double").alias("lo"), null.cast("double").alias("hi")))
    if cells is not None:
        mine = cells.join(docs.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_semi")
        found = discover(mine, kinds, docs.count(), exact=False) if kinds else None
        if found is not None:
            out.append(found.select(F.col("spec_key").alias("key"), F.lit("discovered").alias("widget"), F.lit("").alias("part"), null.cast("string").alias("value"), F.col("documents").alias("n"), null.cast("int").alias("rank"), F.col("coverage").alias("lo"), F.col("score").alias("hi")))
    return reduce(lambda a, b: a.unionByName(b), out)


def dominant_category(docs: DataFrame, share: float = config.DISCOVERY["dominant"]) -> DataFrame:
    """(category, n, share) of the commonest leaf if it holds the share of all rows, blank ones counted in."""
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    per = docs.where("coalesce(category_leaf, '') <> ''").groupBy("category_leaf").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category_leaf").limit(1)
    out = per.join(F.broadcast(total)).select(F.col("category_leaf").alias("category"), "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))
    return out.where(F.col("share") >= share)


def _distinct(c: Column | str, exact: bool) -> Column:
    """Number of distinct values; not exact by a mergeable HyperLogLog sketch with a relative standard deviation of SKETCH_ERROR."""
    return F.countDistinct(c) if exact else F.approx_count_distinct(c, SKETCH_ERROR)


def key_stats(cells: DataFrame, exact: bool = True) -> DataFrame:
    """(spec_key, documents, distinct_values) of cells (document_id, spec_key, num, text)."""
    value = F.coalesce(F.nullif(F.coalesce("text", F.lit("")), F.lit("")), F.col("num").cast("string"))
    return cells.groupBy("spec_key").agg(_distinct("document_id", exact).alias("documents"), _distinct(value, exact).alias("distinct_values"))


def value_counts(cells: DataFrame, kinds: dict[str, str], exact: bool = True) -> DataFrame:
    """(spec_key, value, n): numbers by ten buckets between the attribute's ends, yes and no, or texts, by distinct documents."""
    ends = cells.groupBy("spec_key").agg(F.min("num").alias("lo"), F.max("num").alias("hi"))  # one row per attribute
    kind = F.coalesce(*[F.when(F.col("spec_key") == k, F.lit(v)) for k, v in kinds.items()])
    rows = cells.join(F.broadcast(ends), "spec_key").withColumn("kind", kind)
    value = (
        F.when((F.col("kind") == "numeric") & (F.col("lo") < F.col("hi")), bucket_of(F.col("num"), F.col("lo"), F.col("hi")).cast("string"))
        .when(F.col("kind") == "bool", F.when(F.col("num") == 1, "true").otherwise("false")).when(F.col("kind") == "enum", F.lower(F.trim("text")))
    )
    return rows.withColumn("value", value).where("value is not null and value <> ''").groupBy("spec_key", "value").agg(_distinct("document_id", exact).alias("n"))


def entropy(counts: DataFrame) -> DataFrame:
    """(spec_key, entropy): Shannon entropy of the values' shares over its greatest possible value; 0 for a single value."""
    w = Window.partitionBy("spec_key")
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(w))
    out = p.groupBy("spec_key").agg((F.sum(-F.col("p") * F.log2("p"))).alias("h"), F.count(F.lit(1)).alias("k"))
    return out.select("spec_key", F.round(F.when(F.col("k") > 1, F.col("h") / F.log2("k")).otherwise(F.lit(0.0)), 6).alias("entropy"))


def discover(cells: DataFrame, kinds: dict[str, str], total: int, d: dict = config.DISCOVERY, exact: bool = True) -> DataFrame:
    """(spec_key, documents, coverage, entropy, score): the attributes worth offering as facets, best first."""
    stats = key_stats(cells, exact).withColumn("coverage", F.round(F.col("documents") / F.lit(float(max(1, total))), 6))
    stats = stats.where((F.col("documents") >= d["min_docs"]) & (F.col("coverage") >= d["min_coverage"]) & (F.col("distinct_values") > 1))
    found = stats.join(entropy(value_counts(cells, kinds, exact)), "spec_key").where(F.col("entropy") >= d["min_entropy"])
    return found.select("spec_key", "documents", "coverage", "entropy", F.round(F.col("coverage") * F.col("entropy"), 6).alias("score")).orderBy(F.desc("score"), "spec_key").limit(d["facets"])


def promotion_queue(specs: DataFrame, key_form: Column, top: int = 50) -> DataFrame:
    """(key_raw, documents, distinct_values) of rows without a registry id, by documents."""
    rows = specs.where("key_id is null").withColumn("k", key_form)
    value = F.coalesce(F.nullif(F.coalesce("value_text", F.lit("")), F.lit("")), F.col("value_num").cast("string"))
    out = rows.groupBy(F.col("k").alias("key_raw")).agg(F.countDistinct("document_id").alias("documents"), F.countDistinct(value).alias("distinct_values"))
    return out.orderBy(F.desc("documents"), "key_raw").limit(top)


def conjunction(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
