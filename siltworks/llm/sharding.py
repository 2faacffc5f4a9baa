"""Balanced label propagation: linked documents move towards their neighbours' shards under capacity quotas.

Built-in DataFrame operations only. A group (documents with one link key) is joined as (key, shard) counts, never
as pairs, so a group with a third of all rows costs no more than its rows. Groups of at least 1 / HOT of all rows,
of which there are at most HOT, meet their rows by a broadcast, all others by their key, so no task gets a hot key.
Ranks are two-level, and the driver sees one number for each shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, bucket_count, table, two_level_rank


HOT = 10_000


def _longs(values: list[int]):
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def propagate(spark: SparkSession, stage: Stage, linked: DataFrame, shards: int, capacity: int, rounds: int, buckets: int) -> DataFrame:
    """Moves rows (doc_id, g1, g2, hot, shard, ...) until no row gains or `rounds` are over.

    In each round a row's target is the shard where most of its group lies, itself included, among its own shard
    and those with room (ties: the lower hash of group and shard). Moves into a shard are admitted by rank up to
    its room: capacity less what it holds.
    """
    current = linked
    for _ in range(rounds):
        held = {r["shard"]: r["n"] for r in current.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        room = [max(0, capacity - held.get(s, 0)) for s in range(shards)]
        liked = (
            current.groupBy("g1", "g2", "hot", "shard")
            .agg(F.count("*").alias("n"))
            .groupBy("g1", "g2", "hot")
            .agg(F.reverse(F.array_sort(F.collect_list(F.struct("n", F.xxhash64("g1", "shard").alias("tie"), F.col("shard").alias("s"))))).alias("liked"))
        )
        free = _longs(room)
        by_broadcast = current.where("hot").join(F.broadcast(liked.where("hot").drop("hot")), ["g1", "g2"])
        by_key = current.where("NOT hot").join(liked.where("NOT hot").drop("hot"), ["g1", "g2"])
        wanted = by_broadcast.unionByName(by_key).withColumn(
            "target",
            F.filter("liked", lambda x: (x["s"] == F.col("shard")) | (F.element_at(free, x["s"] + 1) > 0))[0]["s"],
        ).drop("liked")
        wanted = stage.write(wanted, "wanted")
        movers = two_level_rank(wanted.where("target <> shard"), ["target"], F.col("doc_id"), ["doc_id", "g1"], buckets, "turn")
        moved = movers.withColumn("shard", F.when(F.col("turn") < F.element_at(free, F.col("target") + 1), F.col("target")).otherwise(F.col("shard"))).drop("turn")
        following = stage.write(wanted.where("target = shard").unionByName(moved).select(*current.columns, F.col("target")), "moved")
        moves, short = wanted.where("target <> shard").count(), following.where("target <> shard").count()
        stage.drop(wanted, *([current] if current is not linked else []))
        current = following.drop("target")
        current._siltworks_path = following._siltworks_path
        if moves == 0 or moves == short:
            break
    return current


def balanced_shards(spark: SparkSession, docs: DataFrame, shards: int = 16, rounds: int = 8) -> DataFrame:
    """All documents in shards whose row counts are at most one apart, equal texts together as far as room allows.

    docs: doc_id, text (others are ignored). Linked are documents with equal texts (null and empty texts are
    texts like any other, null taken as empty). Linked documents start on a hashed shard and are propagated under
    the quota of a shard, floor(rows / shards); the documents without a neighbour then fill every shard to its
    exact size. Repeated rows and null ids are rows like any other; an empty table gives no rows.

    Returns doc_id, size, text_crc32, law ('rows'), shard, slot (gapless from 0 in a shard), grown_shard (null).
    """
    stage = Stage(spark, "sharding")
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("g1"),
        F.xxhash64(F.lit(7), text).alias("g2"),
    )
    base = stage.write(base, "base")
    n = base.count()
    buckets = bucket_count(n)
    groups = base.groupBy("g1", "g2").agg(F.count("*").alias("n")).where("n > 1")
    groups = stage.write(groups.select("g1", "g2", (F.col("n") * HOT >= n).alias("hot")), "groups")
    start = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(shards)).cast("int")
    flagged = base.join(F.broadcast(groups.where("hot")), ["g1", "g2"], "left")
    others = flagged.where("hot IS NULL").drop("hot").join(groups.where("NOT hot"), ["g1", "g2"], "left")
    marked = flagged.where("hot").unionByName(others).withColumn("shard", F.when(F.col("hot").isNotNull(), start))
    marked = stage.write(marked.select("doc_id", "size", "text_crc32", "g1", "g2", "hot", "shard"), "marked")
    stage.drop(base, groups)
    floor, more = divmod(n, shards)
    sizes = [floor + (s < more) for s in range(shards)]
    linked = propagate(spark, stage, marked.where("shard IS NOT NULL"), shards, floor, rounds, buckets)

    placed = two_level_rank(linked, ["shard"], F.col("doc_id"), ["doc_id", "g1"], buckets, "slot")
    placed = stage.write(placed, "placed")
    room = _longs(sizes)
    keeps = placed.where(F.col("slot") < F.element_at(room, F.col("shard") + 1))
    kept = {r["shard"]: r["n"] for r in keeps.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    over = placed.where(F.col("slot") >= F.element_at(room, F.col("shard") + 1)).drop("slot", "shard")
    pool = marked.where("shard IS NULL").drop("shard").unionByName(over)
    pool = two_level_rank(pool, [], F.col("doc_id"), ["doc_id", "g1"], buckets, "turn")
    ends, total = [], 0
    for s in range(shards):
        total += sizes[s] - kept.get(s, 0)
        ends.append(total)
    begins = [0, *ends[:-1]]
    dealt = pool.withColumn("shard", F.size(F.filter(_longs(ends), lambda e: e <= F.col("turn"))).cast("int")).withColumn(
        "slot",
        F.col("turn") - F.element_at(_longs(begins), F.col("shard") + 1) + F.element_at(_longs([kept.get(s, 0) for s in range(shards)]), F.col("shard") + 1),
    )
    columns = ["doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")]
    return keeps.select(*columns).unionByName(dealt.select(*columns))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(spark, table(spark, sf_dir, "documents"))
