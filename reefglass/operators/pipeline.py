"""The steps of a full build in order, each a DataFrame -> DataFrame function, with skips and a dry run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefglass.functions import extract, hashes, lang, scoring
from reefglass.operators import catalog_ops

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Pipeline:
    """Named steps; ``run`` leaves out the skipped ones and reports which it applied."""

    steps: list[tuple[str, Step]] = field(default_factory=list)

    def add(self, name: str, step: Step) -> Pipeline:
        self.steps.append((name, step))
        return self

    def run(self, df: DataFrame, skip: tuple[str, ...] = (), dry: bool = False) -> tuple[DataFrame, list[str]]:
        done = [n for n, _ in self.steps if n not in skip]
        if not dry:
            for n, f in self.steps:
                if n in done:
                    df = f(df)
        return df, done


def routed(df: DataFrame) -> DataFrame:
    """Titles on the side of their script."""
    r = lang.route_bilingual(F.col("title_en"), F.col("title_dv"))
    return df.withColumn("_r", r).withColumn("title_en", F.col("_r.en")).withColumn("title_dv", F.col("_r.dv")).drop("_r")


def with_contacts(df: DataFrame) -> DataFrame:
    """The phone number of title and summary where none is given."""
    empty = F.trim(F.coalesce("contact_phone", F.lit(""))) == ""
    return df.withColumn("contact_phone", F.when(empty, extract.primary_phone(F.col("title_en"), F.col("summary_en"))).otherwise(F.col("contact_phone")))


def with_quality(df: DataFrame) -> DataFrame:
    """Quality less the penalty for stuffed titles, at least 0."""
    pen = scoring.stuffing_penalty(F.coalesce(F.nullif("title_en", F.lit("")), F.col("title_dv")))
    return df.withColumn("quality", F.greatest(F.lit(0.0), F.coalesce("quality", F.lit(0.0)) - pen))


def with_repost_key(df: DataFrame) -> DataFrame:
    return df.withColumn("dedupe_key", hashes.repost_key(F.col("source"), F.col("contact_phone"), F.col("title_en"), F.col("price")))


def index_build() -> Pipeline:
    """The build of an index row."""
    return (
        Pipeline().add("route", routed).add("contacts", with_contacts).add("quality", with_quality).add("key", with_repost_key).add("reposts", catalog_ops.flag_reposts)
    )


def promote_key(specs: DataFrame, registry: DataFrame, key_raw: str, key_id: int) -> tuple[DataFrame, DataFrame]:
    """(specs with the key's rows given the id, registry plus the key): numeric if most rows hold numbers, with their commonest unit."""
    form = lang.slugify_key(F.col("key_raw"))
    mine = specs.where(form == key_raw)
    facts = mine.agg(
        (F.count("value_num") * 2 > F.count(F.lit(1))).alias("numeric"), F.mode(F.nullif("unit", F.lit(""))).alias("unit")
    )  # one row
    row = facts.select(F.lit(key_id).cast("long").alias("key_id"), F.lit(key_raw).alias("spec_key"), F.when(F.col("numeric"), "numeric").otherwise("enum").alias("datatype"), F.coalesce("unit", F.lit("")).alias("unit"))
    given = specs.withColumn("key_id", F.when(F.col("key_id").isNull() & (form == key_raw), F.lit(key_id).cast("long")).otherwise(F.col("key_id")))
    return given, registry.select("key_id", "spec_key", "datatype", "unit").unionByName(row)


def attachment_status(status: Column, error: Column, text: Column, chars_per_page: Column) -> Column:
    """Next state of an attachment: failed on error, ocr where a page holds under 200 characters, ok with text, none without."""
    return F.when(F.coalesce(error, F.lit("")) != "", "failed").when(status.isin("ok", "skipped"), status).when(chars_per_page < 200, "ocr").when(F.trim(F.coalesce(text, F.lit(""))) != "", "ok").otherwise("none")
