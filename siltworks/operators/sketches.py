"""Stream sketches as set plans: Bloom false positives, distinct estimates, reservoirs. Rows are (ask, seq, id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import BLOOM_BITS, stream_hash, trailing_zeros, unit_interval


def asks(df: DataFrame, seq: str, id_: str, size: int) -> DataFrame:
    """(ask, seq, id) from a gapless sequence number: an ask is `size` rows."""
    return df.select(F.floor(F.col(seq) / size).cast("long").alias("ask"), F.col(seq).cast("long").alias("seq"), F.col(id_).cast("string").alias("id"))


def bloom_false_positives(stream: DataFrame, bits: int = BLOOM_BITS) -> DataFrame:
    """(ask, n_new, n_false, fpr): new ids of each ask whose bits were all set by earlier asks. Bits of an ask show
    only after it, and a repeated id counts once. fpr is null where no id is new."""
    ids = stream.groupBy("id").agg(F.min("ask").alias("ask"))
    coded = ids.select("id", "ask", F.explode(F.array(*[stream_hash(F.col("id"), j) % bits for j in (0, 1)])).alias("bit"))
    first = coded.groupBy("bit").agg(F.min("ask").alias("first"))
    judged = coded.join(first, "bit").groupBy("id", "ask").agg(F.min((F.col("first") < F.col("ask")).cast("int")).alias("false"))
    counts = judged.groupBy("ask").agg(F.count("*").alias("n_new"), F.sum("false").alias("n_false"))
    every = stream.select("ask").distinct()
    out = every.join(counts, "ask", "left").select("ask", F.coalesce("n_new", F.lit(0)).alias("n_new"), F.coalesce("n_false", F.lit(0)).alias("n_false"))
    return out.withColumn("fpr", F.try_divide(F.col("n_false"), F.col("n_new")))


def distinct_estimate(stream: DataFrame) -> DataFrame:
    """(ask, truth, estimate): the exact count, and half the sum of the two least powers of two of three hashes."""
    tops = [F.max(trailing_zeros(stream_hash(F.col("id"), j))).alias(f"r{j}") for j in range(3)]
    rated = stream.groupBy("ask").agg(F.count_distinct("id").alias("truth"), *tops)
    low = F.array_sort(F.array("r0", "r1", "r2"))
    return rated.select("ask", "truth", F.floor((F.pow(F.lit(2.0), low[0]) + F.pow(F.lit(2.0), low[1])) / 2).cast("long").alias("estimate"))


def taken(stream: DataFrame, size: int = 100) -> DataFrame:
    """(id, n, slot): the rows that a reservoir takes, n counted from 1."""
    n = F.col("seq") + 1
    slot = F.when(n <= size, n - 1).when(unit_interval(n, 1) < F.lit(float(size)) / n, F.floor(unit_interval(n, 9) * size))
    return stream.select("id", n.alias("n"), slot.cast("int").alias("slot")).where("slot IS NOT NULL")


def reservoir(stream: DataFrame, size: int = 100, step: int = 100, slots: tuple[int, ...] = (0, 20, 40, 60, 80), before: DataFrame | None = None) -> DataFrame:
    """(seqnum, `<slot>_id` ...) after every `step` rows. Row n (from 1) beyond the size is taken with probability
    size / n into a uniform slot; both come from the MD5 of n, so any replay gives the same sample.

    A slot holds its last taken row: a maximum over checkpoints first, then over the checkpoints' few rows. before:
    (id, n, slot) that the reservoir held ahead of these rows, if they do not begin the stream.
    """
    points = stream.select((F.col("seq") + 1).alias("seqnum")).where(F.col("seqnum") % step == 0)
    wanted = taken(stream, size).withColumn("block", F.ceil(F.col("n") / step).cast("long"))
    if before is not None:
        begun = stream.agg(F.ceil((F.min("seq") + 1) / step).cast("long").alias("block"))  # one row
        wanted = wanted.unionByName(before.select("id", "n", "slot").crossJoin(F.broadcast(begun)))
    last = wanted.where(F.col("slot").isin(*slots)).groupBy("block", "slot").agg(F.max(F.struct("n", "id")).alias("last"))
    return _running(points, last, step, slots)


def _running(points: DataFrame, last: DataFrame, step: int, slots: tuple[int, ...]) -> DataFrame:
    """The latest row of each slot up to each checkpoint, by a running maximum over the blocks of each slot."""
    grid = points.select("seqnum", (F.col("seqnum") / step).cast("long").alias("block"), F.explode(F.array(*[F.lit(s) for s in slots])).alias("slot"))
    filled = grid.join(last, ["block", "slot"], "left")
    latest = F.max("last").over(Window.partitionBy("slot").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    wide = filled.withColumn("latest", latest).groupBy("seqnum").agg(*[F.max(F.when(F.col("slot") == s, F.col("latest.id"))).alias(f"{s}_id") for s in slots])
    return wide.select("seqnum", *[f"{s}_id" for s in slots])
