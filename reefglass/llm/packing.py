"""Problem 7: items into containers of fixed capacity, no item divided unless it alone exceeds the capacity.

Items are hashed into partitions of about ``ITEMS`` items. Each partition is packed by best-fit
decreasing and certified by lower bounds from dual feasible functions: if the number of containers
equals the bound, no packing of these items is better. Partitions with a gap release the items of
their containers below ``FULL``; the released items of all of them are exchanged (hashed anew, so
that they meet other items) and packed again; the round is kept where it needs fewer containers.
An item larger than the capacity fills whole containers first; only its rest is packed.

Defined results: items of size 0 (null and empty texts) are in no container; ties are ordered by
doc_id; an empty table gives no containers; a capacity that is null or below 1 is ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefglass.checkpoints import cut
from reefglass.llm.tokens import TOKENIZER, token_sizes
from reefglass.sources.tables import fixed_rows, local_table, read_table

ITEMS = 20_000
FULL = 0.995
ROUNDS = 3
MAX_K = 100
MAX_SIZES = 5_000_000  #: distinct sizes over all capacities, at most the sum of the capacities


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Containers that any packing needs: the best of two families of dual feasible functions.

    Each function of a family gives a bound of its own. Of f_a every threshold is tried, of u_k every k up to ``MAX_K``.
    """
    if not len(sizes):
        return 0
    order = np.argsort(sizes, kind="stable")
    s, n = np.asarray(sizes, dtype=np.int64)[order], (np.ones(len(sizes), np.int64) if counts is None else np.asarray(counts, dtype=np.int64)[order])
    total, number = np.concatenate([[0], np.cumsum(s * n)]), np.concatenate([[0], np.cumsum(n)])
    best = -(-int(total[-1]) // capacity)
    # f_a: sizes over capacity - a count as a whole container, sizes under a as nothing
    a = np.unique(np.append(s[s <= capacity / 2], capacity // 2))
    big = np.searchsorted(s, capacity - a, side="right")
    small = np.minimum(np.searchsorted(s, a, side="left"), big)
    value = (number[-1] - number[big]) * capacity + total[big] - total[small]
    best = max(best, int((-(-value // capacity)).max()))
    # u_k: sizes rounded to multiples of 1/k
    for k in range(1, MAX_K + 1):
        x = s * (k + 1)
        exact = x % capacity == 0
        value = float((np.where(exact, s / capacity, (x // capacity) / k) * n).sum())
        best = max(best, int(np.ceil(value - 1e-6)))
    return best


def best_fit_decreasing(sizes: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of every item; items are taken in ``order``."""
    where = np.empty(len(sizes), dtype=np.int64)
    free: list[tuple[int, int]] = []  # (room, container), sorted
    n = 0
    for i in order.tolist():
        size = int(sizes[i])
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, c = free.pop(at)
        else:
            room, c, n = capacity, n, n + 1
        where[i] = c
        if room - size > 0:
            insort(free, (room - size, c))
    return where


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity = int(pdf["capacity"].iloc[0])
    sizes = pdf["tokens"].to_numpy()
    order = np.lexsort((pdf["piece_no"].to_numpy(), pdf["doc_id"].to_numpy(), -sizes))
    where = best_fit_decreasing(sizes, order, capacity)
    fill = np.bincount(where, weights=sizes)
    bound = lower_bound(sizes, capacity)
    name = f"{int(pdf['round'].iloc[0])}.{int(pdf['part'].iloc[0])}."
    return pdf[["pack_id", "capacity", "round", "part", "doc_id", "piece_no", "tokens"]].assign(
        container_id=[name + str(c) for c in where], used=fill[where].astype(np.int64), bound=bound, bins=len(fill)
    )


_SCHEMA = "pack_id int, capacity int, round int, part long, doc_id long, piece_no int, tokens long, container_id string, used long, bound long, bins long"


def _partitioned(items: DataFrame, round_no: int, per_part: int = ITEMS) -> DataFrame:
    """items plus round and part; the number of partitions of each pack follows its number of items."""
    counts = {r.pack_id: r.n for r in items.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per pack
    if not counts:
        return items.withColumn("round", F.lit(round_no)).withColumn("part", F.lit(0).cast("long"))
    parts = F.coalesce(*[F.when(F.col("pack_id") == p, F.lit(max(1, -(-n // per_part)))) for p, n in counts.items()])
    return items.withColumn("round", F.lit(round_no)).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(round_no)), parts))


def pack(sizes: DataFrame, capacities: DataFrame, per_part: int = ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """sizes (doc_id, tokens), capacities (pack_id, capacity_tokens) -> one row per packed item or piece.

    Columns: pack_id, container_id, doc_id, piece_no, tokens, capacity, used (of the container), bound and bins (of its partition).
    """
    caps = capacities.select("pack_id", F.col("capacity_tokens").cast("int").alias("capacity")).where("capacity >= 1").dropDuplicates(["pack_id"])
    pieces = sizes.where("tokens > 0").select("doc_id", F.col("tokens").alias("size")).crossJoin(F.broadcast(caps))  # a table of a few capacities
    rest = pieces.select("pack_id", "capacity", "doc_id", F.floor(F.col("size") / F.col("capacity")).cast("int").alias("piece_no"), (F.col("size") % F.col("capacity")).cast("long").alias("tokens"))
    whole = rest.where("piece_no > 0").select("pack_id", "capacity", "doc_id", F.explode(F.sequence(F.lit(0), F.col("piece_no") - 1)).alias("piece_no"), F.col("capacity").cast("long").alias("tokens"))
    whole = whole.select(
        "pack_id", "capacity", F.lit(-1).alias("round"), F.lit(0).cast("long").alias("part"), "doc_id", "piece_no", "tokens",
        F.concat(F.lit("w."), F.col("doc_id").cast("string"), F.lit("."), F.col("piece_no").cast("string")).alias("container_id"),
        F.col("tokens").alias("used"), F.lit(1).cast("long").alias("bound"), F.lit(1).cast("long").alias("bins"),
    )
    items = rest.where("tokens > 0")
    packed = cut(_partitioned(cut(items), 0, per_part).groupBy("pack_id", "part").applyInPandas(_pack, _SCHEMA))
    for r in range(1, rounds + 1):
        loose = (F.col("bins") > F.col("bound")) & (F.col("used") < F.col("capacity") * FULL)
        released = packed.where(loose)
        before = {x.pack_id: x.n for x in released.select("pack_id", "container_id").distinct().groupBy("pack_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not before:
            break
        again = cut(_partitioned(released.select("pack_id", "capacity", "doc_id", "piece_no", "tokens"), r, per_part).groupBy("pack_id", "part").applyInPandas(_pack, _SCHEMA))
        after = {x.pack_id: x.n for x in again.select("pack_id", "part", "bins").distinct().groupBy("pack_id").agg(F.sum("bins").alias("n")).collect()}
        better = [p for p in before if after[p] < before[p]]
        if not better:
            break
        mine = F.col("pack_id").isin(*better)
        packed = cut(packed.where(~(loose & mine)).unionByName(again.where(mine)))
    return packed.unionByName(whole)


def packed_documents(spark: SparkSession, data_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    sizes = cut(token_sizes(read_table(spark, data_dir, "documents", "doc_id", "source", "text"), tokenizer).select("doc_id", "tokens"))
    return pack(sizes, read_table(spark, data_dir, "pack_capacity"))


def p7_containers(spark: SparkSession, data_dir: str) -> DataFrame:
    """(pack_id, container_id, doc_id, piece_no, tokens, unused_tokens of the container), one row per item."""
    p = packed_documents(spark, data_dir)
    return p.select("pack_id", "container_id", "doc_id", "piece_no", "tokens", (F.col("capacity") - F.col("used")).alias("unused_tokens"))


def p7_report(spark: SparkSession, data_dir: str) -> DataFrame:
    """Per capacity: containers, the number that is certified to be needed, the gap between them, unused tokens and their share.

    The bound is that of the whole collection: its items are counted per size, at most ``capacity`` sizes, and the counts reach the driver.
    certified_partitions of partitions reach their own bound.
    """
    p = cut(packed_documents(spark, data_dir))
    per = p.groupBy("pack_id", "capacity").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"), F.count_if(F.col("round") == -1).alias("whole"))
    bins = p.select("pack_id", "container_id").distinct().groupBy("pack_id").agg(F.count(F.lit(1)).alias("containers"))
    parts = p.where("round >= 0").select("pack_id", "round", "part", "bins", "bound").distinct()
    parts = parts.groupBy("pack_id").agg(F.count(F.lit(1)).alias("partitions"), F.count_if(F.col("bins") == F.col("bound")).alias("certified_partitions"))
    sizes: dict[tuple[int, int], list] = {}
    for r in fixed_rows(p.where("round >= 0").groupBy("pack_id", "capacity", "tokens").agg(F.count(F.lit(1)).alias("n")), MAX_SIZES):
        sizes.setdefault((r.pack_id, r.capacity), []).append((r.tokens, r.n))
    bounds = [(pack, lower_bound(*np.array(x, dtype=np.int64).T[:1], capacity, np.array(x, dtype=np.int64).T[1])) for (pack, capacity), x in sizes.items()]
    certified = local_table(spark, bounds, pack_id="int32", rest_bound="int64")
    out = per.join(bins, "pack_id").join(parts, "pack_id", "left").join(F.broadcast(certified), "pack_id", "left")
    out = out.withColumn("certified_bound", F.col("whole") + F.coalesce("rest_bound", F.lit(0)))
    return out.select(
        "pack_id", "capacity", "items", "tokens", "containers", "certified_bound", (F.col("containers") - F.col("certified_bound")).alias("gap"),
        F.coalesce("partitions", F.lit(0)).alias("partitions"), F.coalesce("certified_partitions", F.lit(0)).alias("certified_partitions"),
        (F.col("containers") * F.col("capacity") - F.col("tokens")).alias("unused_tokens"),
        F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("unused_share"),
    )
