"""Problem 5: attribute-value rows -> one row per entity with typed columns.

1. Keys are resolved and values read into one typed cell candidate each (Column expressions).
2. Candidates are reduced to one per (document, attribute), the latest readable one, with map-side
   combine: after it no document has more rows than the registry has attributes, however hot it was.
3. Documents are hashed into buckets of about ``BUCKET_CELLS`` cells; in each bucket entities and
   attributes are dictionary-encoded and the values scattered by row and column index into one numpy
   array per type, which leave as Arrow tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reefglass.functions import units as U
from reefglass.functions.text import is_filler
from reefglass.operators.spec_keys import Registry, of_live_documents, resolve_keys
from reefglass.sources.tables import read_table

BUCKET_CELLS = 200_000
_TYPES = {"numeric": T.DoubleType(), "bool": T.BooleanType(), "enum": T.StringType()}


def typed_cells(spark: SparkSession, data_dir: str, registry: Registry) -> DataFrame:
    """(document_id, spec_key, num, text): the cell's value, latest extraction first, ties to the higher spec_id."""
    specs = read_table(spark, data_dir, "document_spec", "spec_id", "document_id", "key_id", "key_raw", "value_num", "value_text", "extracted_at")
    rows = resolve_keys(spark, specs, registry)
    num = U.finite(F.col("value_num"))
    value = F.when(F.col("datatype") == "numeric", F.coalesce(num, U.read_number(F.col("value_text")))).when(F.col("datatype") == "bool", U.read_bool(num, F.col("value_text")))
    text = F.when((F.col("datatype") == "enum") & ~is_filler(F.col("value_text")), F.trim("value_text"))
    rows = rows.select("document_id", "spec_key", value.alias("num"), text.alias("text"), "extracted_at", "spec_id")
    rows = rows.where("num is not null or text is not null")
    order = F.struct("extracted_at", "spec_id")
    cells = rows.groupBy("document_id", "spec_key").agg(F.max_by(F.struct("num", "text"), order).alias("v"))
    cells = cells.select("document_id", "spec_key", "v.num", "v.text")
    return of_live_documents(cells, read_table(spark, data_dir, "search_document", "id"))


def wide_schema(registry_rows: list) -> T.StructType:
    """document_id, then one typed, nullable column per registry attribute in registry order."""
    cols = [T.StructField(r.spec_key, _TYPES.get(r.datatype, T.StringType())) for r in registry_rows]
    return T.StructType([T.StructField("document_id", T.LongType()), *cols])


def widen(cells: DataFrame, registry_rows: list, buckets: int) -> DataFrame:
    """cells (document_id, spec_key, num, text), unique per pair, -> the wide table.

    A document without any cell gives no row; an attribute outside the registry is ignored;
    an empty table gives none. ``registry_rows`` has one row per attribute (spec_key, datatype).
    """
    schema = wide_schema(registry_rows)
    names = [r.spec_key for r in registry_rows]
    kinds = [r.datatype for r in registry_rows]
    number_cols = [j for j, k in enumerate(kinds) if k in ("numeric", "bool")]
    text_cols = [j for j, k in enumerate(kinds) if k not in ("numeric", "bool")]
    slot = {j: i for cols in (number_cols, text_cols) for i, j in enumerate(cols)}

    def scatter(table: pa.Table) -> pa.Table:
        doc = table["document_id"].combine_chunks().dictionary_encode()
        row, ids = doc.indices.to_numpy(zero_copy_only=False), doc.dictionary
        key = table["spec_key"].combine_chunks().dictionary_encode()
        at = np.array([names.index(k) if k in names else -1 for k in key.dictionary.to_pylist()], dtype=np.int64)
        col = at[key.indices.to_numpy(zero_copy_only=False)] if len(at) else np.empty(0, np.int64)
        place = np.array([slot.get(j, 0) for j in range(len(names))], dtype=np.int64)
        is_num = np.isin(col, number_cols)
        is_txt = np.isin(col, text_cols)
        nums = np.full((len(number_cols), len(ids)), np.nan)
        nums[place[col[is_num]], row[is_num]] = table["num"].to_numpy(zero_copy_only=False)[is_num]
        texts = np.full((len(text_cols), len(ids)), None, dtype=object)
        texts[place[col[is_txt]], row[is_txt]] = table["text"].to_numpy(zero_copy_only=False)[is_txt]
        out = [ids.cast(pa.int64())]
        for j, kind in enumerate(kinds):
            if kind == "enum" or j not in number_cols:
                out.append(pa.array(texts[slot[j]], pa.string(), from_pandas=True))
            elif kind == "bool":
                v = nums[slot[j]]
                out.append(pa.array(v == 1.0, pa.bool_(), mask=np.isnan(v)))
            else:
                out.append(pa.array(nums[slot[j]], pa.float64(), from_pandas=True))
        return pa.Table.from_arrays(out, names=["document_id", *names])

    bucketed = cells.where(F.col("spec_key").isin(names)).withColumn("_bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)))
    return bucketed.groupBy("_bucket").applyInArrow(scatter, schema)


def wide_table(spark: SparkSession, data_dir: str) -> DataFrame:
    """One row per live search_document that has at least one readable attribute."""
    registry = Registry.load(spark, data_dir)
    rows = spark.read.parquet(f"{data_dir}/document_spec.parquet").count()  # from the footers
    return widen(typed_cells(spark, data_dir, registry), registry.attributes, max(8, -(-rows // BUCKET_CELLS)))


def p5_wide(spark: SparkSession, data_dir: str) -> DataFrame:
    """The wide table of document_spec."""
    return wide_table(spark, data_dir)


def p5_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """(document_id, spec_key) of the filled cells of the wide table."""
    wide = wide_table(spark, data_dir)
    names = [c for c in wide.columns if c != "document_id"]
    filled = F.filter(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in names]), lambda x: x.isNotNull())
    return wide.select("document_id", F.explode(filled).alias("spec_key"))
