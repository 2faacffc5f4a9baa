"""What the operators share: the shared folder, staged tables, two-level ranks, connected components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
MOST_BATCH_BYTES = 6 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where the session names none, a local session gets one of
    its own, and any other one is refused: its executors would each write to their own disk."""
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="siltworks-")
        spark.conf.set(CHECKPOINT_KEY, named)
    return named.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


class Stage:
    """Written tables of one run: each cuts the lineage, survives a lost executor and is dropped when it is used up."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.base}/{self.count:04d}-{name}"

    def write(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        """Writes the rows and gives them back as read from the shared folder."""
        return self.read(self.save(df, name, compression), df)

    def save(self, df: DataFrame, name: str, compression: str = "zstd") -> str:
        where = self.path(name)
        df.write.option("compression", compression).parquet(where)
        return where

    def read(self, where: str, like: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read if like is None else self.spark.read.schema(like.schema)
        df = reader.parquet(where)
        df._siltworks_path = where
        return df

    def drop(self, *tables: DataFrame | str) -> None:
        """Deletes tables that nothing reads any more."""
        for t in tables:
            where, fs = _hadoop_path(self.spark, t if isinstance(t, str) else t._siltworks_path)
            fs.delete(where, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, so that Python workers can import it wherever they run, and bounds
    the batches that they get by bytes, since texts may be very long."""
    spark.conf.set(BATCH_KEY, str(MOST_BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_siltworks_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="siltworks-")), "siltworks_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(target)
    context._siltworks_sent = True


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work on Arrow batches, after which a Python worker, which lives on, gives its free memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run


def slices(batches: Iterator, rows: int) -> Iterator:
    """Smaller Arrow batches, for work that makes Python objects of their rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def bucket_count(rows: int, per_bucket: int = 50_000, least: int = 64) -> int:
    """Buckets for a two-level rank: no bucket gets many more than per_bucket rows."""
    return max(least, -(-rows // per_bucket))


def two_level_rank(df: DataFrame, parts: list[str], spread: Column, order: list, buckets: int, out: str) -> DataFrame:
    """A gapless rank from 0 within parts, without one task for each part.

    Rows are dealt to hash buckets of `spread`; the counts of buckets are summed up first (rows: parts x buckets),
    then rows are numbered inside each bucket. The columns in parts hold no nulls.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(spread, F.lit(17)), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*parts, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(parts or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*parts, "_bucket").orderBy(*order)
    joined = dealt.join(offsets, [*parts, "_bucket"])
    return joined.withColumn(out, (F.row_number().over(inside) - 1 + F.col("_before")).cast("long")).drop("_bucket", "_before")


def components(spark: SparkSession, stage: Stage, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a long, b long) edges: rows (node, component), the smallest node of each.

    Alternating large and small stars over DataFrames; each round is written to the shared folder, and it ends
    when a round changes nothing. A node with very many edges is only ever a key of sums (partial ones first)
    and of joins that adaptive execution can split.
    """
    current = stage.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    mark = None
    for _ in range(rounds):
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: neighbours above u hang on the least neighbour
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = stage.write(large, "large")
        # small star: neighbours at or below u hang on the least of them
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        following = (
            large.join(lower, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        following = stage.write(following, "small")
        stage.drop(current, large)
        current = following
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
