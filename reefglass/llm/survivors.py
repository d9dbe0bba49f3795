"""Problem 2: one surviving record for each group of duplicate records, field by field.

Every row of a group claims a value for each field it fills, fillers and dummies among them. Which
claims are true is latent, and several values of a field may be: a two-sided latent-truth model judges
each distinct value. Its witnesses are the sources (one that fills the field in the group states the
value or does not) and the form of the value (it reads like a value or like a filler). A witness has a
sensitivity (it speaks for a true value) and a specificity (it does not speak for a false one). Those of
the form are given and anchor what true means; those of the sources and the share of true values are
inferred per field: EM alternates between the values' posteriors and these until they stand still.
Values with a posterior of ``KEEP`` and more are true. ``p2_found`` takes, field by field, the most
recent row that states a true value; ``p2_kept_values`` keeps every true value.

Scale: groups of one row are dropped first, on two narrow columns. Claims are reduced per (group, field,
value) to their latest row and a bit set of sources, with map-side combine, so a group holding a third
of all rows shrinks before the shuffle and is never gathered in one task; joins spread the rows of the
groups found hot by count. EM runs on the counts of distinct patterns (sources that state the value,
sources that fill the field, form): at most 2 * 3 ** ``MAX_SOURCES`` a field, whatever the data.

Defined results: null and blank values are no claims; groups whose key is null or empty, or with one
id, give nothing; ties go to the higher id; sources beyond the first ``MAX_SOURCES`` - 1 listed, and
spellings that are not listed, speak as one; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reefglass.checkpoints import cut
from reefglass.functions.text import ASCII_DIGITS, OTHER_DIGITS, is_filler, plain
from reefglass.operators.skew import hot_join, hot_keys
from reefglass.sources.tables import read_table

FIELDS = ("contact_phone", "title_dv", "summary_en", "island")
KEEP = 0.5
MAX_SOURCES = 8
ROUNDS, STILL = 200, 1e-6
#: (sensitivity, 1 - specificity) of the form, which anchors what true means, and of a source where EM starts, with its pseudo-count.
FORM, SOURCE_START, HELD = (0.98, 0.02), (0.5, 0.5), 2.0


def phone_digits(c: Column) -> Column:
    """National digits of a phone number."""
    d = F.regexp_replace(F.translate(c, OTHER_DIGITS, ASCII_DIGITS), r"[^0-9]", "")
    return F.when((F.length(d) > 8) & d.startswith("00960"), F.substring(d, 6, 20)).when((F.length(d) >= 10) & d.startswith("960"), F.substring(d, 4, 20)).otherwise(d)


def usable_value(name: str) -> Column:
    """The comparable form of a usable value of the field, null if the value is not usable."""
    c = F.col(name)
    if name == "contact_phone":
        d = phone_digits(c)
        dummy = d.rlike(r"^(\d)\1+$") | d.isin("1234567", "2345678", "7654321", "9876543", "0123456", "1231231", "1212121")
        return F.when((F.length(d) >= 7) & ~dummy & ~c.rlike(r"\p{L}{3,}"), d)
    return F.when(~is_filler(c), plain(c))


def recency() -> Column:
    """Orders rows: publication time, an impossible one counts as missing, missing is oldest, ties by id."""
    ts = F.when(F.col("published_at") <= F.coalesce("indexed_at", "published_at"), F.unix_micros("published_at"))
    return F.struct(F.coalesce(ts, F.lit(-(1 << 62))).alias("at"), F.col("id").alias("id"))


def _group_key() -> list[Column]:
    key = F.col("dedupe_key")
    return [F.xxhash64(key).alias("k1"), F.xxhash64(F.reverse(key)).alias("k2")]  # 128 bits of the key


def shared_groups(docs: DataFrame) -> DataFrame:
    """(k1, k2, dedupe_key, record, n) of the groups with two or more ids; record is the most recent (at, id)."""
    rows = docs.where(F.col("dedupe_key").isNotNull() & (F.trim("dedupe_key") != "")).select("dedupe_key", *_group_key(), recency().alias("latest"))
    return rows.groupBy("k1", "k2").agg(
        F.any_value("dedupe_key").alias("dedupe_key"), F.max("latest").alias("record"), F.min("latest.id").alias("lo"), F.max("latest.id").alias("hi"), F.count(F.lit(1)).alias("n")
    ).where("lo < hi").drop("lo", "hi")


def claims(docs: DataFrame, shared: DataFrame, hot: DataFrame | None, sources: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per (k1, k2, field_no, value, fit) of the shared groups: latest, and the bit set of sources that state it.

    fit: the value reads like one of the field. A row delivered twice changes nothing.
    """
    src = F.coalesce(*[F.when(F.col("source") == s, F.lit(1 << i)) for i, s in enumerate(sources)], F.lit(1 << len(sources)))
    read = [F.struct(usable_value(f).alias("v"), plain(F.col(f)).alias("p")).alias(f"_v{i}") for i, f in enumerate(fields)]
    rows = docs.where(F.col("dedupe_key").isNotNull() & (F.trim("dedupe_key") != "")).select(*_group_key(), src.alias("src"), recency().alias("latest"), *read)
    entries = F.array(*[
        F.struct(F.lit(i).cast("tinyint").alias("field_no"), F.when(F.col(f"_v{i}.p") != "", F.xxhash64(F.coalesce(f"_v{i}.v", f"_v{i}.p"))).alias("value"), F.col(f"_v{i}.v").isNotNull().alias("fit"))
        for i in range(len(fields))
    ])
    rows = rows.select("k1", "k2", "src", "latest", entries.alias("entries"))
    mine = hot_join(rows, shared.select("k1", "k2"), ["k1", "k2"], hot, F.col("latest.id"))
    long = mine.select("k1", "k2", "src", "latest", F.inline(F.filter("entries", lambda e: e["value"].isNotNull())))
    return long.groupBy("k1", "k2", "field_no", "value", "fit").agg(F.max("latest").alias("latest"), F.bit_or("src").alias("states"))


def with_covers(found: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Adds fills: the bit set of the sources that fill the field in the group."""
    covers = found.groupBy("k1", "k2", "field_no").agg(F.bit_or("states").alias("fills"))
    fields = F.explode(F.array(*[F.lit(i).cast("tinyint") for i in range(len(FIELDS))]))
    return hot_join(found, covers, ["k1", "k2", "field_no"], None if hot is None else hot.select("k1", "k2", fields.alias("field_no")), F.col("value"))


def fit_witnesses(patterns: np.ndarray, n_sources: int) -> tuple[float, np.ndarray, int]:
    """EM on one field's patterns, rows (states, fills, fit, count).

    -> (prior of truth, array (witness, 2) of sensitivity and 1 - specificity, rounds); the form is the last witness.
    """
    states, fills, fit, count = patterns.T
    said = np.stack([(states >> i) & 1 for i in range(n_sources)] + [fit], 1).astype(float)
    heard = np.stack([(fills >> i) & 1 for i in range(n_sources)] + [np.ones_like(fit)], 1).astype(float)
    start = np.array([SOURCE_START] * n_sources + [FORM])
    prior, params = 0.5, start
    for rounds in range(1, ROUNDS + 1):
        p = posteriors(states, fills, fit, prior, params)
        w = np.stack([count * p, count * (1 - p)], 1)  # rows: weight as true, as false
        new = ((said[:, :, None] * w[:, None, :]).sum(0) + HELD * start) / ((heard[:, :, None] * w[:, None, :]).sum(0) + HELD)
        new = np.clip(new, 1e-3, 1 - 1e-3)
        new[-1] = FORM
        new_prior = (w[:, 0].sum() + 1) / (count.sum() + 2)
        moved = max(float(np.abs(new - params).max()), abs(new_prior - prior))
        prior, params = float(new_prior), new
        if moved < STILL:
            break
    return prior, params, rounds


def posteriors(states: np.ndarray, fills: np.ndarray, fit: np.ndarray, prior: float, params: np.ndarray) -> np.ndarray:
    """Probability that a value is true."""
    x = np.full(len(states), np.log(prior / (1 - prior)))
    for i, (sens, false) in enumerate(params):
        said = (fit if i == len(params) - 1 else (states >> i) & 1) == 1
        heard = np.ones(len(fit), bool) if i == len(params) - 1 else ((fills >> i) & 1) == 1
        x += np.where(heard, np.where(said, np.log(sens / false), np.log((1 - sens) / (1 - false))), 0.0)
    return 1 / (1 + np.exp(-x))


def posterior(models: dict[int, tuple[float, np.ndarray]]) -> Column:
    """The posterior as a column expression of field_no, states, fills and fit."""
    out = F.lit(None).cast("double")
    for f, (prior, params) in models.items():
        x = F.lit(float(np.log(prior / (1 - prior))))
        for i, (sens, false) in enumerate(params):
            yes, no = float(np.log(sens / false)), float(np.log((1 - sens) / (1 - false)))
            if i == len(params) - 1:
                x = x + F.when(F.col("fit"), yes).otherwise(no)
            else:
                bit = F.lit(1 << i)
                x = x + F.when(F.col("states").bitwiseAND(bit) != 0, yes).when(F.col("fills").bitwiseAND(bit) != 0, no).otherwise(0.0)
        out = F.when(F.col("field_no") == f, F.lit(1.0) / (F.lit(1.0) + F.exp(-x))).otherwise(out)
    return out


def fit_models(rivals: DataFrame, n_sources: int) -> dict[int, tuple[float, np.ndarray]]:
    """field_no -> (prior, witnesses' parameters); what is gathered is the bounded table of patterns."""
    got = rivals.groupBy("field_no", "states", "fills", "fit").agg(F.count(F.lit(1)).alias("n")).collect()
    models = {}
    for f in sorted({r.field_no for r in got}):
        patterns = np.array([(r.states, r.fills, int(r.fit), r.n) for r in got if r.field_no == f], dtype=np.int64)
        models[f] = fit_witnesses(patterns, n_sources)[:2]
    return models


def judged_claims(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame]:
    """(shared groups, claims (k1, k2, field_no, value, fit, latest, states, fills, posterior) on them)."""
    # at most MAX_SOURCES counters, whatever doc_source holds
    sources = [r.source for r in read_table(spark, data_dir, "doc_source", "source").where("source is not null").distinct().orderBy("source").limit(MAX_SOURCES - 1).collect()]
    docs = read_table(spark, data_dir, "search_document", "id", "source", "dedupe_key", "published_at", "indexed_at", *FIELDS)
    shared = cut(shared_groups(docs))
    hot = hot_keys(shared, ["k1", "k2"])
    rivals = cut(with_covers(cut(claims(docs, shared, hot, sources)), hot))
    return shared, rivals.withColumn("posterior", posterior(fit_models(rivals, len(sources) + 1)))


def survivors(shared: DataFrame, judged: DataFrame) -> DataFrame:
    """(dedupe_key, field_name, id): the most recent row, and per field the most recent row that states a true value."""
    true = judged.where(F.col("posterior") >= KEEP)
    best = true.groupBy("k1", "k2").agg(*[F.max(F.when(F.col("field_no") == i, F.col("latest"))).alias(f"l_{f}") for i, f in enumerate(FIELDS)])
    groups = shared.withColumnRenamed("record", "l_record").join(best, ["k1", "k2"], "left")
    picks = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"l_{f}.id").alias("id")) for f in ("record", *FIELDS)])
    return groups.select("dedupe_key", F.inline(F.filter(picks, lambda e: e["id"].isNotNull())))


def p2_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """(dedupe_key, field_name, id): the row that serves each field of the group best."""
    return survivors(*judged_claims(spark, data_dir))


def p2_kept_values(spark: SparkSession, data_dir: str) -> DataFrame:
    """(dedupe_key, field_name, id, posterior): every value judged true, by the latest row that states it."""
    shared, judged = judged_claims(spark, data_dir)
    kept = hot_join(judged.where(F.col("posterior") >= KEEP), shared.select("k1", "k2", "dedupe_key"), ["k1", "k2"], hot_keys(shared, ["k1", "k2"]), F.col("value"))
    name = F.element_at(F.array(*[F.lit(f) for f in FIELDS]), F.col("field_no") + 1)
    return kept.select("dedupe_key", name.alias("field_name"), F.col("latest.id").alias("id"), F.round("posterior", 6).alias("posterior"))
