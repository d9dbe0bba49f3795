"""Translation with a cache: distinct strings go to a provider once, checked answers are kept and joined back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefglass.functions import hashes, lang

#: A provider takes a batch of texts and gives one translation or None for each; without one nothing is translated.
Provider = Callable[[list[str]], list[str | None]]
BATCH = 8


def offline(texts: list[str]) -> list[str | None]:
    """The provider where no service is configured."""
    return [None] * len(texts)


def missing(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """(source_hash, text) of the distinct non-empty texts that the cache (source_hash, translation) lacks."""
    rows = texts.select(hashes.text_key(F.col("text")).alias("source_hash"), "text").where(F.trim("text") != "").dropDuplicates(["source_hash"])
    return rows.join(cache.select("source_hash"), "source_hash", "left_anti")


def translate(texts: DataFrame, cache: DataFrame, target: str, provider: Provider = offline) -> DataFrame:
    """The cache with the new translations: in batches of eight, only answers in the target's script and other than the source are kept."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            got: list[str | None] = []
            for i in range(0, len(pdf), BATCH):
                part = list(pdf["text"][i : i + BATCH])
                answer = provider(part)
                got += answer if len(answer) == len(part) else [None] * len(part)
            yield pd.DataFrame({"source_hash": pdf["source_hash"], "text": pdf["text"], "translation": got})

    new = missing(texts, cache).mapInPandas(run, "source_hash string, text string, translation string")
    good = new.where(F.col("translation").isNotNull() & (F.col("translation") != F.col("text")) & lang.is_clean_translation(F.col("translation"), target))
    return cache.select("source_hash", "translation").unionByName(good.select("source_hash", "translation"))


def fill(docs: DataFrame, source: str, target: str, cache: DataFrame) -> DataFrame:
    """Fills an empty target column from the cached translation of the source column."""
    c = cache.select(F.col("source_hash").alias("_h"), F.col("translation").alias("_t"))
    out = docs.join(c, hashes.text_key(F.col(source)) == F.col("_h"), "left")
    empty = F.trim(F.coalesce(F.col(target), F.lit(""))) == ""
    return out.withColumn(target, F.when(empty & F.col("_t").isNotNull(), F.col("_t")).otherwise(F.col(target))).drop("_h", "_t")
