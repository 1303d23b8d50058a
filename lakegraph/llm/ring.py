"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a ring of hashes; a row belongs to the owner of
the next point clockwise. A shard takes no more rows than its share; rows that
find it full go on clockwise to the next shard with room. Shares differ by one at
most, so counts do too, and only the overflow moves.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from lakegraph.llm.common import map_columns
from lakegraph.session import cut


def ring_points(shards: int, points: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places of all virtual nodes, as signed longs, and the shard of each."""
    place = {
        int.from_bytes(hashlib.blake2b(f"{seed}/{s}/{p}".encode(), digest_size=8).digest(), "little", signed=True): s
        for s in range(shards) for p in range(points)
    }
    ordered = sorted(place)
    return np.array(ordered, np.int64), np.array([place[x] for x in ordered], np.int64)


def fill(counts: np.ndarray, owner: np.ndarray, room: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(arc, from, to, shard)``: which rows of each arc a shard takes, by their rank in the arc.

    ``counts`` are rows per arc, ``room`` the rows a shard takes. First every arc goes
    to its owner, in ring order; what is left over goes on clockwise, again in
    ring order, to the next shard that is not full, until all rows have one.
    """
    room = room.copy()
    taken = np.zeros(len(counts), np.int64)
    at = np.arange(len(counts))
    out = []
    waiting = list(np.flatnonzero(counts))
    while waiting:
        left = []
        for arc in waiting:
            shard = owner[at[arc]]
            n = min(int(counts[arc] - taken[arc]), int(room[shard]))
            if n:
                out.append((int(arc), int(taken[arc]), int(taken[arc]) + n, int(shard)))
                taken[arc] += n
                room[shard] -= n
            if taken[arc] < counts[arc]:
                left.append(arc)
        for arc in left:
            while room[owner[at[arc]]] == 0:
                at[arc] = (at[arc] + 1) % len(owner)
        waiting = left
    return out


def shares(n: int, shards: int) -> np.ndarray:
    """Rows per shard, at most one apart; the first shards have the larger ones."""
    return np.array([n // shards + (s < n % shards) for s in range(shards)], np.int64)


def assign(rows: DataFrame, key: list[str], shards: int, points: int = 256, rank_rows: int = 50_000) -> DataFrame:
    """Adds ``shard`` and ``slot`` (0, 1, ... within a shard) to every row.

    ``key``: columns whose hash places a row on the ring. Per arc of the ring only
    the count comes to the driver, ``shards * points`` numbers at any size. Within
    an arc, rows are ranked by their hash in buckets of about ``rank_rows``; rows of
    equal keys tie, and either may be first. Null keys hash like a value. An empty
    table gives no rows; input columns named like the new ones are replaced.
    """
    place, owner = ring_points(shards, points)

    def make():
        return lambda hashes: {"arc": np.searchsorted(place, np.array(hashes, np.int64)) % len(place)}

    rows = rows.drop("shard", "slot", "arc", "hash").withColumn("hash", F.xxhash64(*key))
    placed = cut(map_columns(rows, ["hash"], make, [T.StructField("arc", T.LongType())]))
    total = placed.count()
    buckets = max(1, -(-total // (shards * points * rank_rows)))
    # The hash orders rows within an arc; other bits of it deal the arc into buckets.
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("hash"), F.lit(buckets)))
    held = placed.groupBy("arc", "bucket").agg(F.count("*").alias("n"))
    per_arc = np.zeros(len(place), np.int64)
    for arc, n in held.groupBy("arc").agg(F.sum("n")).collect():
        per_arc[arc] = n
    plan, used = [], defaultdict(int)
    for arc, begin, end, shard in fill(per_arc, owner, shares(total, shards)):
        plan.append((arc, begin, end, shard, used[shard]))
        used[shard] += end - begin
    plan = rows.sparkSession.createDataFrame(plan, "a long, begin long, stop long, shard int, base long")
    earlier = Window.partitionBy("arc").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(F.col("arc").alias("a"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("arc", "bucket").orderBy("hash", *key)
    ranked = placed.withColumn("rank", F.row_number().over(within) - 1)
    if buckets > 1:
        ranked = ranked.join(before, (F.col("arc") == F.col("a")) & (F.col("bucket") == F.col("b"))).drop("a", "b")
        ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("before")
    # The plan has at most shards * (points + shards) rows.
    found = ranked.join(F.broadcast(plan), (F.col("arc") == F.col("a")) & (F.col("rank") >= F.col("begin")) & (F.col("rank") < F.col("stop")))
    return found.withColumn("slot", F.col("base") + F.col("rank") - F.col("begin")).drop(
        "a", "begin", "stop", "base", "arc", "hash", "bucket", "rank")


def shard_documents(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", **ring) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every document; law ``rows``: counts per shard are at most one apart.

    The key is the id and the text's checksum and size, so one id on many texts is
    spread. ``size`` is the text's UTF-8 bytes plus 8; a null text counts as empty.
    """
    filled = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(filled) + 8).cast("bigint").alias("size"), F.crc32(filled.cast("binary")).alias("text_crc32"))
    return assign(rows, ["doc_id", "text_crc32", "size"], shards, **ring)
