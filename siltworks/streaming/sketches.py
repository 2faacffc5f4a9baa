"""The sketches over streams of asks: one micro-batch is one ask; state lives in tables of a folder.

Every batch appends its own part (named by the batch), so a batch that is run again after a failure overwrites its
part and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import BLOOM_BITS, stream_hash
from ..operators.sketches import distinct_estimate, reservoir, taken
from ..sources.sinks import to_csv


def _asks(batch: DataFrame, ask: int) -> DataFrame:
    return batch.select(F.lit(ask).cast("long").alias("ask"), F.monotonically_increasing_id().alias("seq"), F.col("user_id").cast("string").alias("id"))


def per_ask(stream: DataFrame, results: str, checkpoint: str, what) -> StreamingQuery:
    """Runs what(rows of one ask) on each micro-batch and keeps its result as a part of `results`."""

    def one(batch: DataFrame, number: int) -> None:
        what(_asks(batch, number)).write.mode("overwrite").parquet(f"{results}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_distinct(stream: DataFrame, results: str, checkpoint: str) -> StreamingQuery:
    """Distinct estimates; an ask needs no state."""
    return per_ask(stream, results, checkpoint, distinct_estimate)


def stream_bloom(spark: SparkSession, stream: DataFrame, state: str, results: str, checkpoint: str) -> StreamingQuery:
    """Bloom false positives. State: the ids and the bits that are new in each ask, as parts named by the ask; an ask
    sees the parts of asks before it. Ids are hashed in their own ask only, and bits are at most BLOOM_BITS rows."""

    def old(kind: str, schema: str, number: int) -> DataFrame:
        if not number:
            return spark.createDataFrame([], schema)
        return spark.read.schema(f"{schema}, batch int").parquet(f"{state}/{kind}").where(F.col("batch") < number).drop("batch")

    def one(batch: DataFrame, number: int) -> None:
        fresh = _asks(batch, number).select("id").distinct().join(old("ids", "id string", number), "id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{state}/ids/batch={number}")
        fresh = spark.read.schema("id string").parquet(f"{state}/ids/batch={number}")
        coded = fresh.select("id", F.explode(F.array(*[stream_hash(F.col("id"), j) % BLOOM_BITS for j in (0, 1)])).alias("bit"))
        seen = old("bits", "bit long", number).withColumn("set", F.lit(1))
        judged = coded.join(seen, "bit", "left")
        judged.where("set IS NULL").select("bit").distinct().write.mode("overwrite").parquet(f"{state}/bits/batch={number}")
        counts = judged.groupBy("id").agg(F.min(F.coalesce("set", F.lit(0))).alias("false")).agg(F.count("*").alias("n_new"), F.coalesce(F.sum("false"), F.lit(0)).alias("n_false"))
        counts.select(F.lit(number).cast("long").alias("ask"), "n_new", "n_false", F.try_divide("n_false", "n_new").alias("fpr")).write.mode("overwrite").parquet(f"{results}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _numbered(batch: DataFrame, start: int) -> DataFrame:
    """(seq, id) numbered from `start` without gaps in the order of the rows: what comes to the driver is one count for
    each partition."""
    placed = batch.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), F.col("user_id").cast("string").alias("id"))
    begins, seq = {}, start
    for r in sorted(placed.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).collect(), key=lambda r: r["part"]):
        begins[r["part"]] = seq - r["first"]
        seq += r["n"]
    if not begins:
        return placed.select(F.col("at").alias("seq"), "id")
    offsets = F.create_map(*[F.lit(x) for pair in begins.items() for x in pair])
    return placed.select((F.col("at") + offsets[F.col("part")]).cast("long").alias("seq"), "id")


def stream_reservoir(spark: SparkSession, stream: DataFrame, state: str, results: str, checkpoint: str, size: int = 100, step: int = 100) -> StreamingQuery:
    """The reservoir after every `step` rows of the whole stream. State: for each ask the rows that the reservoir held
    at its end (at most `size`) and the number of rows so far; an ask reads the part of the ask before it."""
    held = "id string, n long, slot int"

    def one(batch: DataFrame, number: int) -> None:
        before, start = spark.createDataFrame([], held), 0
        if number:
            before = spark.read.schema(held).parquet(f"{state}/held/batch={number - 1}")
            start = spark.read.parquet(f"{state}/rows/batch={number - 1}").first()["n"]
        rows = _numbered(batch, start)
        now = taken(rows, size).unionByName(before).groupBy("slot").agg(F.max(F.struct("n", "id")).alias("last"))
        now.select("last.id", "last.n", "slot").write.mode("overwrite").parquet(f"{state}/held/batch={number}")
        rows.agg((F.count("*") + start).alias("n")).write.mode("overwrite").parquet(f"{state}/rows/batch={number}")
        reservoir(rows, size, step, before=before).write.mode("overwrite").parquet(f"{results}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collected(spark: SparkSession, results: str, path: str, order: str) -> None:
    """The results of all asks as one ordered table with a header, written once after the stream has ended."""
    to_csv(spark.read.parquet(results).drop("batch").orderBy(order), path)
