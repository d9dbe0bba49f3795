"""Query and click logs as streams: windows, rate limits, sessions, joins, keyed deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reefglass import config


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Event times as TIMESTAMP, which watermarks need (UTC sessions)."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def read_events(spark: SparkSession, folder: str, schema: StructType, pattern: str = "events.parquet", files_per_batch: int | None = None) -> DataFrame:
    """A file stream over one table of a shared folder.

    A backlog is read in one batch, as its files are in no order of event time: a watermark only moves
    between batches, so no row of the backlog can be late. With ``files_per_batch`` the backlog comes in
    several batches, and the watermarks behind must be as wide as the disorder between the files.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return event_time(reader.parquet(folder))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n) per fixed window; works on streams and tables."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding(events: DataFrame, width: str = "6 hours", step: str = "3 hours", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, n): runs of a visitor's events without a pause of the gap."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("s.start").alias("session_start"), "n")


def over_fixed_limit(events: DataFrame, limit: int = config.RATE_LIMIT, seconds: int = config.RATE_SECONDS) -> DataFrame:
    """(user_id, window_start, n) of visitors with more events than allowed in a fixed window; works on streams and tables."""
    w = events.withWatermark("ts", f"{seconds} seconds").groupBy("user_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.where(F.col("n") > limit).select("user_id", F.col("w.start").alias("window_start"), "n")


def over_limit(events: DataFrame, limit: int = config.RATE_LIMIT, seconds: int = config.RATE_SECONDS) -> DataFrame:
    """(user_id, event_id, ts, n) of the events that find the quota used up: n events of the visitor, this one included, in the ``seconds`` up to it.

    A sliding window over a table; events of one moment count together. A visitor's events are split by
    time: each stretch of ``seconds`` sees itself and the one before it, so no visitor is one task.
    """
    width = seconds * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    own = F.floor(at / width)
    rows = events.select("user_id", "event_id", "ts", at.alias("at"), own.alias("own"), F.explode(F.array(own, own + 1)).alias("stretch"))
    near = Window.partitionBy("user_id", "stretch").orderBy("at").rangeBetween(-width + 1, 0)
    counted = rows.withColumn("n", F.count(F.lit(1)).over(near))
    return counted.where((F.col("own") == F.col("stretch")) & (F.col("n") > limit)).select("user_id", "event_id", "ts", "n")


def clicks_of_queries(clicks: DataFrame, queries: DataFrame, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Clicks joined with the same visitor's query up to ``within`` before; both sides watermarked on streams.

    ``late`` is how far a row may come behind the latest one of the batches before it without being lost.
    """
    c = clicks.select(F.col("event_id").alias("click_id"), F.col("user_id").alias("click_user"), F.col("ts").alias("click_ts")).withWatermark("click_ts", late)
    q = queries.select(F.col("event_id").alias("query_id"), "user_id", F.col("ts").alias("query_ts")).withWatermark("query_ts", late)
    near = (F.col("click_user") == F.col("user_id")) & (F.col("click_ts") >= F.col("query_ts")) & (F.col("click_ts") <= F.col("query_ts") + F.expr(f"INTERVAL {within}"))
    return q.join(c, near).select("query_id", "click_id", "user_id")


def once(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Every key once within the watermark (streams) or at all (tables)."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def append_log(df: DataFrame, path: str) -> None:
    """Append-only log, partitioned by month."""
    df.withColumn("month", month(F.col("ts"))).write.mode("append").partitionBy("month").parquet(path)


def expired_months(spark: SparkSession, path: str, today: str, keep_days: int = config.LOG_RETENTION_DAYS) -> list[str]:
    """Months of a log that end before the first of the month of (today - keep_days)."""
    cutoff = spark.range(1).select(F.date_format(F.trunc(F.date_sub(F.lit(today).cast("date"), keep_days), "month"), "yyyy-MM").alias("m")).first().m
    return sorted(r.month for r in spark.read.parquet(path).select("month").distinct().collect() if r.month < cutoff)
