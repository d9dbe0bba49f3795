"""Attribute keys as typed -> registry keys.

``key_raw`` may be the registry key, a label, a synonym, a misspelling, and may carry a unit
("Weight [kg]", "Length_in", "holds in ml"). Half of the rows also carry the registry's id, so the
synonyms are learned from the table itself: every normalised key gets the id most of its rows name.
Keys are counted as typed, by one aggregation with map-side combine over two columns, and resolved
once each. Up to ``MAX_BROADCAST_KEYS`` of them the table of keys is broadcast; beyond that it is joined
by a shuffle that spreads the hot keys, so that one holding a third of all rows does not end in one task.
The registry itself is a table of a fixed, small number of rows; it becomes map literals.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reefglass.checkpoints import cut
from reefglass.functions.text import plain
from reefglass.functions.units import spelling_codes, unit_key
from reefglass.operators.skew import HOT_SHARE, bounded_keys, hot_join, hot_keys
from reefglass.sources.tables import fixed_rows, read_table

MAX_BROADCAST_KEYS = 20_000
#: "<key> in <unit>", "<key>_<unit>", "<key> (<unit>)", "<key> [<unit>]".
_SUFFIX = r"^(.*?)(?:\s+in\s+|_|\s*\(|\s*\[)([^\[\]]+?)[\)\]]?\s*$"


def key_form(c: Column) -> Column:
    """Letters, marks and digits of the key in lower case."""
    return F.regexp_replace(plain(c), r"[^\p{L}\p{M}\p{N}]+", "")


def lookup(table: dict, key: Column) -> Column:
    """The value of a small fixed table, null for other keys."""
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


@dataclass
class Registry:
    """The attributes and units on the driver: both tables have a fixed, small number of rows."""

    attributes: list = field(default_factory=list)
    units: dict = field(default_factory=dict)  # unit_code -> (quantity, factor, offset)
    spellings: dict = field(default_factory=dict)  # unit key -> set of unit codes

    @classmethod
    def load(cls, spark: SparkSession, data_dir: str) -> Registry:
        cols = ("key_id", "spec_key", "label_en", "label_dv", "datatype", "unit", "unit_code", "unit_aliases", "value_aliases")
        rows = {r.spec_key: r for r in fixed_rows(read_table(spark, data_dir, "spec_key", *cols)) if r.spec_key}
        attributes = sorted(rows.values(), key=lambda r: r.key_id)
        units = {r.unit_code: (r.quantity, r.to_common_factor, r.to_common_offset) for r in fixed_rows(read_table(spark, data_dir, "unit_code"))}
        return cls(attributes, units, spelling_codes(attributes))

    def scoped_units(self) -> dict[str, str]:
        """'quantity|spelling' -> unit code."""
        return {f"{self.units[c][0]}|{s}": c for s, codes in self.spellings.items() for c in sorted(codes) if c in self.units}

    @property
    def quantities(self) -> dict[str, str]:
        """spec_key -> quantity of its common unit."""
        return {a.spec_key: self.units[a.unit_code][0] for a in self.attributes if a.unit_code in self.units}


def with_key_parts(df: DataFrame, registry: Registry) -> DataFrame:
    """Adds key_form (without a unit suffix) and key_unit (the suffix as a unit key, or null)."""
    df = df.withColumn("_suffix", unit_key(F.regexp_extract("key_raw", _SUFFIX, 2)))
    has = F.col("_suffix").isin(*registry.spellings)
    return (
        df.withColumn("key_form", key_form(F.when(has, F.regexp_extract("key_raw", _SUFFIX, 1)).otherwise(F.col("key_raw"))))
        .withColumn("key_unit", F.when(has, F.col("_suffix")))
        .drop("_suffix")
    )


def _votes(parts: DataFrame) -> DataFrame:
    seen = parts.where("key_id is not null and key_form is not null").groupBy("key_form", "key_id").agg(F.sum("n").alias("n"))
    return seen.groupBy("key_form").agg(F.max_by("key_id", F.struct("n", -F.col("key_id"))).alias("vote_id")).withColumnRenamed("key_form", "vote_form")


def key_votes(specs: DataFrame, registry: Registry) -> DataFrame:
    """(vote_form, vote_id): for every key form that some row ties to a registry id, the id most rows name.

    Rows are counted per key as typed before keys are normalised, so normalising costs one step per distinct key.
    """
    return _votes(with_key_parts(specs.groupBy("key_raw", "key_id").agg(F.count(F.lit(1)).alias("n")), registry))


def key_table(specs: DataFrame, registry: Registry) -> DataFrame:
    """(key_raw, key_id, n, spec_key, datatype, unit_code, key_unit) of every distinct key as typed that is a registry attribute's; n rows carry it.

    A row's own key_id counts first, then the registry's own names, then the vote for its key.
    """
    typed = with_key_parts(cut(specs.groupBy("key_raw", "key_id").agg(F.count(F.lit(1)).alias("n"))), registry)
    joined = typed.join(_votes(typed), F.col("key_form") == F.col("vote_form"), "left")
    ids = {a.key_id: a.spec_key for a in registry.attributes}
    own = {}
    for a in registry.attributes:
        for name in (a.spec_key, a.label_en, a.label_dv):
            form = "".join(ch for ch in (name or "").lower() if ch.isalnum() or "ަ" <= ch <= "ް")
            own.setdefault(form, a.spec_key)
    joined = joined.withColumn("spec_key", F.coalesce(lookup(ids, F.col("key_id")), lookup(own, F.col("key_form")), lookup(ids, F.col("vote_id")))).where("spec_key is not null")
    kinds = {a.spec_key: a.datatype for a in registry.attributes}
    codes = {a.spec_key: a.unit_code for a in registry.attributes if a.unit_code in registry.units}
    return joined.select("key_raw", "key_id", "n", "spec_key", lookup(kinds, F.col("spec_key")).alias("datatype"), lookup(codes, F.col("spec_key")).alias("unit_code"), "key_unit")


def resolve_keys(spark: SparkSession, specs: DataFrame, registry: Registry) -> DataFrame:
    """specs plus spec_key, datatype, unit_code, key_unit; rows of no registry attribute are dropped.

    Keys are resolved once per distinct key as typed; the rows then meet the table of keys by hash.
    """
    keys = cut(key_table(specs.select("key_raw", "key_id"), registry))
    found = ["spec_key", "datatype", "unit_code", "key_unit"]
    if keys.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS:
        small = F.broadcast(keys.select(F.col("key_raw").alias("_raw"), F.col("key_id").alias("_id"), *found))
        return specs.join(small, F.col("key_raw").eqNullSafe(F.col("_raw")) & F.col("key_id").eqNullSafe(F.col("_id"))).drop("_raw", "_id")
    none = [F.coalesce("key_raw", F.lit("")).alias("_raw"), F.coalesce("key_id", F.lit(0)).alias("_id"), F.col("key_raw").isNull().alias("_no_raw"), F.col("key_id").isNull().alias("_no_id")]
    right = keys.select(*none, "n", *found)
    on = ["_raw", "_id", "_no_raw", "_no_id"]
    return hot_join(specs.select("*", *none), right.drop("n"), on, hot_keys(right, on), F.col("spec_id")).drop(*on)


def hot_documents(df: DataFrame, key: str = "document_id") -> DataFrame | None:
    """The documents that hold more than one in HOT_SHARE of the rows, by a heavy-hitter sketch of bounded size; None if there are none."""
    seen = df.agg(F.expr(f"approx_top_k({key}, {HOT_SHARE}, {20 * HOT_SHARE})").alias("top"), F.count(F.lit(1)).alias("_n"))
    return bounded_keys(seen.select("_n", F.inline("top")).where(F.col("item").isNotNull() & (F.col("count") * HOT_SHARE > F.col("_n"))).select(F.col("item").alias(key)))


def of_live_documents(df: DataFrame, documents: DataFrame, *columns: str, hot: DataFrame | None = None) -> DataFrame:
    """Rows whose document_id is in search_document; with columns, those of the document are added.

    The documents are reduced to one row per id before the join (rows may be delivered twice). With
    ``hot``, the documents known to hold very many rows, df needs a spec_id by which those are spread.
    """
    unique = documents.select(F.col("id").alias("document_id"), *columns).groupBy("document_id").agg(*[F.min(c).alias(c) for c in columns] or [F.lit(1).alias("_live")]).drop("_live")
    return hot_join(df, unique, ["document_id"], hot, F.col("spec_id") if hot is not None else F.lit(0))
