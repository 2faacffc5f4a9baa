"""Sources: each reads with an explicit schema, so column pruning and filters reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Newline-separated JSON; fields that a record lacks are null, records that are no JSON are rows of nulls."""
    return spark.read.schema(schema).json(path)


def csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", header).csv(path)


def ratings(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, schemas.RATINGS)


def user_business(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, schemas.PAIRS)


def transactions(spark: SparkSession, path: str) -> DataFrame:
    """date, customer_id, product_id from the first, second and sixth column of a quoted CSV file with a header."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    date, customer, product = raw.columns[0], raw.columns[1], raw.columns[5]
    return raw.select(F.col(f"`{date}`").alias("date"), F.col(f"`{customer}`").alias("customer_id"), F.col(f"`{product}`").alias("product_id"))


def points(spark: SparkSession, path: str) -> DataFrame:
    """id and features (array<double>) from lines `id, true cluster, f1, ..., fd`; the true cluster is not read."""
    parts = F.split(F.col("value"), ",")
    return spark.read.text(path).select(parts[0].alias("id"), F.slice(parts, 3, F.size(parts) - 2).cast("array<double>").alias("features"))


def stream_asks(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of text files, one for each ask, one user id on each line."""
    return spark.readStream.schema(schemas.STREAM).option("maxFilesPerTrigger", 1).csv(folder)
