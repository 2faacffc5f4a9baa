"""Counts, top lists, joined averages and partition profiles."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_in_year(reviews: DataFrame, year: int) -> DataFrame:
    return reviews.agg(F.count_if(F.year("date") == year).alias("n_review_year"))


def top_keys(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k most frequent keys with their counts; ties by key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(k)


def review_stats(reviews: DataFrame, year: int, k: int = 10) -> DataFrame:
    """One row: counts of reviews, users and businesses, and both top lists as `key:count` texts."""

    def listed(key: str, name: str) -> DataFrame:
        best = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(key).alias("key"))))
        return top_keys(reviews, key, k).agg(F.array_join(F.transform(best, lambda x: F.concat_ws(":", x["key"].cast("string"), (-x["m"]).cast("string"))), ",").alias(name))

    counts = reviews.agg(
        F.count("*").alias("n_review"),
        F.count_if(F.year("date") == year).alias("n_review_year"),
        F.count_distinct("user_id").alias("n_user"),
        F.count_distinct("business_id").alias("n_business"),
    )
    # three tables of one row each
    return counts.join(listed("user_id", "top_user")).join(listed("business_id", "top_business"))


def city_average(reviews: DataFrame, businesses: DataFrame, k: int | None = 10, how: str = "inner") -> DataFrame:
    """Average stars by city, best first, ties by city. Reviews are summed by business before the join, so that only
    one row for each business is shuffled to it. how: 'inner', or 'left' to keep reviews without a city (null)."""
    sums = reviews.groupBy("business_id").agg(F.sum("stars").alias("total"), F.count("stars").alias("n"))
    joined = sums.join(businesses.select("business_id", "city"), "business_id", how)
    averages = joined.groupBy("city").agg((F.sum("total") / F.sum("n")).alias("stars"))
    ordered = averages.orderBy(F.desc("stars"), F.asc("city"))
    return ordered.limit(k) if k else ordered


def partition_profile(df: DataFrame, n: int, key: str) -> DataFrame:
    """Rows in each of n partitions when rows are dealt by key modulo n, empty ones included."""
    counts = df.groupBy(F.pmod(F.col(key), F.lit(n)).cast("long").alias("partition")).agg(F.count("*").alias("n_items"))
    every = df.sparkSession.range(n).withColumnRenamed("id", "partition")
    return every.join(counts, "partition", "left").select("partition", F.coalesce("n_items", F.lit(0)).alias("n_items"))


def physical_profile(df: DataFrame, n: int | None = None, key: str | None = None) -> DataFrame:
    """Rows in each partition as they lie, or after hash partitioning by key."""
    if n:
        df = df.repartition(n, key)
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n_items"))


def timed_profiles(df: DataFrame, n: int, key: str) -> DataFrame:
    """(layout, n_partition, n_items array<long>, exe_time): rows in each partition as they lie ('default') and after
    hash partitioning by key ('customized'), empty ones included, with the seconds that each took. Runs both; what
    comes to the driver is one number for each partition."""
    rows = []
    for layout, count, profile in (("default", df.rdd.getNumPartitions(), physical_profile(df)), ("customized", n, physical_profile(df, n, key))):
        begun = time.perf_counter()
        sizes = {r["partition"]: r["n_items"] for r in profile.collect()}
        rows.append((layout, count, [sizes.get(i, 0) for i in range(count)], time.perf_counter() - begun))
    return df.sparkSession.createDataFrame(rows, "layout string, n_partition int, n_items array<long>, exe_time double")
