"""Attribute-value rows of documents out of several sources in order of trust."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefglass.functions import extract, lang

#: Attributes that documents hold as columns.
SKIPPED = ("price", "location", "source", "doc_type")
LONGEST_UNIT = 16
COLUMNS = ("document_id", "key_raw", "value_num", "value_text", "unit", "provenance")


def of_text(docs: DataFrame, text: Column) -> DataFrame:
    """Quantities read from a text: the unit is the attribute."""
    pairs = docs.select(F.col("id").alias("document_id"), F.explode(extract.units(text)).alias("q"))
    unit = F.split_part("q", F.lit(" "), F.lit(2))
    return pairs.select("document_id", unit.alias("key_raw"), F.split_part("q", F.lit(" "), F.lit(1)).try_cast("double").alias("value_num"), F.lit("").alias("value_text"), unit.alias("unit"), F.lit("extracted").alias("provenance"))


def of_map(docs: DataFrame, json: Column) -> DataFrame:
    """The scalar entries of a JSON object as texts, several values of one text apart."""
    entries = docs.select(F.col("id").alias("document_id"), F.explode(F.from_json(json, "map<string,string>")).alias("key_raw", "v")).where(~F.col("v").rlike(r"^\s*[\[{]"))
    return entries.select("document_id", "key_raw", F.lit(None).cast("double").alias("value_num"), F.explode(lang.split_multivalue(F.col("v"))).alias("value_text"), F.lit("").alias("unit"), F.lit("scraped").alias("provenance"))


def project(sources: list[DataFrame], registry: DataFrame) -> DataFrame:
    """(key_id, *COLUMNS): the rows of all sources, each (document, key, number, text) once, from the first source that has it.

    Keys become slugs, those without one and the skipped ones give no row. A unit of over LONGEST_UNIT characters is a value in the
    wrong place: it becomes the text where there is none. registry (key_id, spec_key) is a table of fixed size.
    """
    every = reduce(lambda a, b: a.unionByName(b), [s.select(*COLUMNS, F.lit(i).alias("rank")) for i, s in enumerate(sources)])
    long, text, unit = F.length(F.coalesce("unit", F.lit(""))) > LONGEST_UNIT, F.coalesce("value_text", F.lit("")), F.coalesce("unit", F.lit(""))
    rows = every.select(
        "document_id", lang.slugify_key(F.col("key_raw")).alias("key_raw"), "value_num", F.when(long & (text == ""), unit).otherwise(text).alias("value_text"),
        F.when(long, F.lit("")).otherwise(unit).alias("unit"), F.coalesce("provenance", F.lit("")).alias("provenance"), "rank",
    ).where((F.col("key_raw") != "") & ~F.col("key_raw").isin(*SKIPPED) & (F.col("value_num").isNull() | ~F.isnan("value_num")))
    first = rows.groupBy("document_id", "key_raw", "value_num", "value_text").agg(F.min(F.struct("rank", "unit", "provenance")).alias("f"))
    out = first.select("document_id", "key_raw", "value_num", "value_text", "f.unit", "f.provenance")
    ids = registry.select(F.col("spec_key").alias("key_raw"), "key_id").where("key_raw is not null").dropDuplicates(["key_raw"])
    return out.join(F.broadcast(ids), "key_raw", "left").select("key_id", *COLUMNS)


def replace_by_document(current: DataFrame, incoming: DataFrame, documents: DataFrame) -> DataFrame:
    """current with the rows of the given documents (document_id) replaced by those of incoming; a document without new rows loses its old ones."""
    ids = documents.select("document_id").distinct()
    return current.join(ids, "document_id", "left_anti").unionByName(incoming.join(ids, "document_id", "left_semi").select(*current.columns))
