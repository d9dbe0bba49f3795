"""Joins whose left side may hold a third of its rows on one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 8


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "left", salts: int = SALTS) -> DataFrame:
    """left joined with right, which has one row per key: the key's rows are spread over ``salts`` tasks by the hash of ``spread``.

    The small, unique side is repeated once per salt; the result is that of the plain join.
    """
    l = left.withColumn("_jsalt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    r = right.withColumn("_jsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [*keys, "_jsalt"], how).drop("_jsalt")


#: A key is hot if it holds more than one in HOT_SHARE of all rows; there are fewer than HOT_SHARE such keys at any size.
HOT_SHARE, HOT_SALTS = 1000, 64


def bounded_keys(found: DataFrame) -> DataFrame | None:
    """At most HOT_SHARE keys as a table in the plan itself; None if there are none, which is the rule, and then nothing needs to be spread."""
    rows = found.limit(HOT_SHARE).collect()
    return found.sparkSession.createDataFrame(rows, found.schema) if rows else None


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame | None:
    """The hot keys of a table of counts (keys, n), fewer than HOT_SHARE at any size, or None."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("_total"))
    return bounded_keys(counts.crossJoin(F.broadcast(total)).where(F.col(n) * HOT_SHARE > F.col("_total")).select(*keys))


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None, spread: Column, how: str = "inner", salts: int = HOT_SALTS) -> DataFrame:
    """left joined with right, which has one row per key: rows of hot keys are spread over ``salts`` tasks, right's rows of them repeated.

    Rows of other keys are not salted, and right is not repeated for them.
    """
    if hot is None:
        return left.join(right, keys, how)
    h = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    l = left.join(h, keys, "left").withColumn("_jsalt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(0).cast("int"))
    every = F.sequence(F.lit(0), F.when(F.col("_hot"), F.lit(salts - 1)).otherwise(F.lit(0)))
    r = right.join(h, keys, "left").withColumn("_jsalt", F.explode(every)).drop("_hot")
    return l.drop("_hot").join(r, [*keys, "_jsalt"], how).drop("_jsalt")
