"""Problem 8: a selection of documents in which every source has its target share of the tokens.

The total is the largest at which no source has to be repeated more than ``max_repeats`` times; a
source's budget is its share of it. Whole epochs of a source come first; the rest of its budget is
filled by Efraimidis-Spirakis sampling: every document gets the key -ln(u)/weight (u from a hash of
mix and document, weight from the text's quality), and documents are taken in order of their keys
while the running sum of tokens stays within the budget.

Running sums are distributed: rows are range-partitioned by (mix, source, key), written to the
checkpoint, summed per partition, and each partition starts from the sums before it. Nothing but a row
per mix and source reaches the driver. A source with a third of all rows spans many partitions.

Defined results: sources are matched without regard to case, blanks and single misspellings, others
and null are in no mix; a listed source without documents has share 0 and the other targets are
scaled up; documents without tokens are not selected; empty tables give no selection.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reefglass.checkpoints import cut
from reefglass.llm.text_stats import _EMAIL, _TOKEN
from reefglass.llm.tokens import TOKENIZER, token_sizes
from reefglass.sources.tables import fixed_rows, local_table, read_table

SEED = 20
ROWS_PER_PARTITION = 250_000
CLOSING = 3
STRETCH = 100


def text_quality(texts: list[str | None]) -> np.ndarray:
    """Weights in (0, 1]: the squared share of well-formed words, lowered where few distinct words repeat.

    Distinct words are counted in stretches of ``STRETCH`` words, so the measure is that of a long text and a short one alike.
    """
    split = [(t or "").split() for t in texts]
    size = np.array([len(x) for x in split], dtype=np.int64)
    if not size.sum():
        return np.full(len(texts), 0.01)
    owner = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    code, words = pd.factorize(np.array([w for ws in split for w in ws], dtype=object))
    good = np.array([bool(_TOKEN.match(w) or _EMAIL.match(w)) for w in words], dtype=float)
    well = np.bincount(owner, good[code], len(texts)) / np.maximum(size, 1)
    stretch = owner * (int(size.max()) // STRETCH + 1) + place // STRETCH
    first = np.unique(stretch * len(words) + code, return_index=True)[1]  # a distinct word of a stretch
    distinct = np.bincount(owner[first], minlength=len(texts)) / np.maximum(size, 1)
    return np.where(size > 0, np.maximum(0.01, well * well * np.minimum(1.0, 0.2 + 2 * distinct)), 0.01)


def source_name(c: Column, known: list[str]) -> Column:
    """The known source that is meant, null if none: case, blanks and marks do not count, one edit is allowed."""
    form = F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "")
    out = F.lit(None).cast("string")
    for s in reversed(known):
        plain = re.sub(r"[^a-z0-9]+", "", s.lower())
        near = F.levenshtein(form, F.lit(plain)) <= (2 if len(plain) >= 8 else 1)
        swapped = F.sort_array(F.split(form, "")) == F.sort_array(F.split(F.lit(plain), ""))
        out = F.when((form == plain) | near | swapped, F.lit(s)).otherwise(out)
    return out


def budgets(sizes: DataFrame, targets: DataFrame) -> list[dict]:
    """Per mix and source: budget, epochs and rest. mix_target has a fixed, small number of rows."""
    have = {r.source: (r.tokens, r.docs) for r in sizes.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()}
    by: dict[int, list] = {}
    for r in fixed_rows(targets.dropDuplicates(["mix_id", "source"])):
        by.setdefault(r.mix_id, []).append(r)
    out = []
    for mix, rows in sorted(by.items()):
        live = [r for r in rows if have.get(r.source, (0, 0))[0] and r.target_share > 0 and r.max_repeats >= 1]
        scale = sum(r.target_share for r in live)
        total = min((have[r.source][0] * r.max_repeats * scale / r.target_share for r in live), default=0.0)
        for r in rows:
            available = have.get(r.source, (0, 0))[0]
            budget = total * r.target_share / scale if r in live else 0.0
            epochs = min(int(r.max_repeats), int(budget / available + 1e-9)) if available else 0
            out.append({"mix_id": mix, "source": r.source, "target_share": r.target_share, "max_repeats": r.max_repeats, "available": available, "budget": budget, "epochs": epochs, "rest": max(0.0, budget - epochs * available)})
    return out


def running_sums(rows: DataFrame, partitions: int) -> DataFrame:
    """rows (mix_id, source, doc_id, tokens, key, ...) plus before: the tokens of earlier rows of the mix and source.

    Two levels: sums per range partition, running over the partitions of a group; then running within the partition.
    """
    order = ("mix_id", "source", "key", "doc_id")
    part = ("pid", "mix_id", "source")
    placed = cut(rows.repartitionByRange(partitions, *order).withColumn("pid", F.spark_partition_id()).select(*part, "key", "doc_id", "tokens"))
    sums = placed.groupBy(*part).agg(F.sum("tokens").alias("t"))
    earlier = Window.partitionBy("mix_id", "source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = sums.select(*part, F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy(*part).orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("tokens").over(within), F.lit(0))
    return placed.join(starts, [*part]).select("mix_id", "source", "doc_id", "tokens", before.alias("before"))


def select_mix(sizes: DataFrame, plan: list[dict], rows: int) -> DataFrame:
    """(mix_id, source, doc_id, tokens, copies): how often each document is taken in each mix."""
    spark = sizes.sparkSession
    live = [(int(p["mix_id"]), p["source"], int(p["epochs"]), float(p["rest"])) for p in plan if p["budget"] > 0]
    table = F.broadcast(local_table(spark, live, mix_id="int32", source="string", epochs="int32", rest="double"))
    u = (F.pmod(F.xxhash64("mix_id", "doc_id", F.lit(SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = sizes.where("tokens > 0").join(table, "source").select("mix_id", "source", "doc_id", "tokens", (-F.log(u) / F.col("weight")).alias("key"))
    sums = running_sums(keyed, max(8, rows * max(1, len({p[0] for p in live})) // ROWS_PER_PARTITION))
    sums = cut(sums.join(table, ["mix_id", "source"]).withColumn("taken", F.col("before") + F.col("tokens") <= F.col("rest")))
    extra = closing_documents(sums)
    closing = F.lit(False)
    for mix, source, doc in extra:
        closing = closing | ((F.col("mix_id") == mix) & (F.col("source") == source) & (F.col("doc_id") == doc))
    return sums.select("mix_id", "source", "doc_id", "tokens", (F.col("epochs") + (F.col("taken") | closing).cast("int")).alias("copies")).where("copies > 0")


def closing_documents(sums: DataFrame, rounds: int = CLOSING) -> list[tuple[int, str, int]]:
    """What the running sum leaves of a budget (less than one document) is closed by up to ``rounds`` more documents.

    In each round, every mix and source gets the document whose size is nearest to the gap, if it makes the gap smaller.
    """
    groups = {(r.mix_id, r.source): r.gap for r in sums.groupBy("mix_id", "source").agg((F.first("rest") - F.sum(F.when(F.col("taken"), F.col("tokens")).otherwise(0))).alias("gap")).collect()}
    extra: list[tuple[int, str, int]] = []
    for _ in range(rounds):
        if not groups:
            break
        gap = F.coalesce(*[F.when((F.col("mix_id") == m) & (F.col("source") == s), F.lit(float(g))) for (m, s), g in groups.items()])
        free = sums.where(~F.col("taken")).withColumn("gap", gap).where(F.abs(F.col("gap") - F.col("tokens")) < F.abs("gap"))
        for m, s, d in extra:
            free = free.where(~((F.col("mix_id") == m) & (F.col("source") == s) & (F.col("doc_id") == d)))
        best = free.groupBy("mix_id", "source").agg(F.min_by(F.struct("doc_id", "tokens"), F.struct(F.abs(F.col("gap") - F.col("tokens")), "before", "doc_id")).alias("b")).collect()
        if not best:
            break
        for r in best:
            extra.append((r.mix_id, r.source, r.b.doc_id))
            groups[r.mix_id, r.source] -= r.b.tokens
    return extra


def _mixed(spark: SparkSession, data_dir: str, tokenizer: str = TOKENIZER) -> tuple[DataFrame, list[dict]]:
    targets = read_table(spark, data_dir, "mix_target")
    known = sorted({r.source for t in (targets, read_table(spark, data_dir, "doc_source")) for r in fixed_rows(t.select("source")) if r.source})
    docs = read_table(spark, data_dir, "documents", "doc_id", "source", "text").withColumn("source", source_name(F.col("source"), known))
    sizes = cut(token_sizes(docs, tokenizer, text_quality))
    plan = budgets(sizes, targets)
    return select_mix(sizes, plan, spark.read.parquet(f"{data_dir}/documents.parquet").count()), plan


def p8_selection(spark: SparkSession, data_dir: str) -> DataFrame:
    """(mix_id, source, doc_id, tokens, copies)."""
    return _mixed(spark, data_dir)[0]


def p8_shares(spark: SparkSession, data_dir: str) -> DataFrame:
    """Per mix and source: target share, share reached, tokens, documents, most copies of one document."""
    chosen, plan = _mixed(spark, data_dir)
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    rows = [(int(p["mix_id"]), p["source"], float(p["target_share"]), int(p["max_repeats"]), int(p["available"])) for p in plan]
    table = local_table(spark, rows, mix_id="int32", source="string", target_share="double", max_repeats="int32", available_tokens="int64")
    out = table.join(got, ["mix_id", "source"], "left").fillna(0, ["tokens", "documents", "most_copies"])
    total = out.groupBy("mix_id").agg(F.sum("tokens").alias("total"))  # one row per mix
    return out.join(F.broadcast(total), "mix_id").select("mix_id", "source", "target_share", F.round(F.try_divide("tokens", "total"), 6).alias("reached_share"), "tokens", "available_tokens", "documents", "most_copies", "max_repeats")
