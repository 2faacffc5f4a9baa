"""The stored tables in the shapes that the operators take, as DataFrames and as the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import table

REVIEWS_SQL = """reviews AS (
  SELECT o_custkey AS user_id, l_partkey AS business_id, l_suppkey AS supplier_id, o_orderkey AS order_id,
         CAST(ceil(l_quantity / 10) AS BIGINT) AS stars, o_orderdate AS date, CAST(round(l_discount * 100) AS BIGINT) AS useful
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def reviews(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("business_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.ceil(F.col("l_quantity") / 10).cast("long").alias("stars"),
        F.round(F.col("l_discount") * 100).cast("long").alias("useful"),
    )
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("date"))
    return lines.join(orders, "order_id")


RATINGS_SQL = """ratings AS (
  SELECT user_id AS "user", business_id AS item, max(stars) AS stars, max(order_id) AS order_id
  FROM reviews GROUP BY user_id, business_id)"""


def ratings(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """rows: the reviews, where they are at hand."""
    return (rows or reviews(spark, d)).groupBy(F.col("user_id").alias("user"), F.col("business_id").alias("item")).agg(F.max("stars").alias("stars"), F.max("order_id").alias("order_id"))


def split(rated: DataFrame, of: int, held: int) -> tuple[DataFrame, DataFrame]:
    """Ratings to predict, of one remainder of the order number, and all others to learn from."""
    part = F.col("order_id") % of
    return rated.where(part != held).select("user", "item", "stars"), rated.where(part == held).select("user", "item", "stars")


def split_sql(of: int, held: int) -> str:
    return f"""train AS (SELECT "user", item, stars FROM ratings WHERE order_id % {of} <> {held}),
val AS (SELECT "user", item, stars FROM ratings WHERE order_id % {of} = {held})"""


def cold_split(rated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of every tenth item, all ratings but a few are to be predicted, so that items are new or nearly so; all others
    are to learn from."""
    cold = (F.col("item") % 10 == 3) & (F.col("order_id") % 20 != 0)
    return rated.where(~cold).select("user", "item", "stars"), rated.where(cold).select("user", "item", "stars")


COLD_SPLIT_SQL = """train AS (SELECT "user", item, stars FROM ratings WHERE NOT (item % 10 = 3 AND order_id % 20 <> 0)),
val AS (SELECT "user", item, stars FROM ratings WHERE item % 10 = 3 AND order_id % 20 <> 0)"""


BUSINESSES_SQL = """businesses AS (
  SELECT business_id, avg(stars) AS business_mean, count(*) * (1 + business_id % 40) AS review_count FROM reviews GROUP BY business_id)"""


def businesses(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """Parts as businesses; review counts are spread so that every bucket of the blend occurs."""
    return (rows or reviews(spark, d)).groupBy("business_id").agg(F.avg("stars").alias("business_mean"), (F.count("*") * (1 + F.col("business_id") % 40)).alias("review_count"))


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as businesses, their nation as city."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("city"))
    return table(spark, d, "supplier").join(nations, "s_nationkey").select(F.col("s_suppkey").alias("business_id"), "city")


def users(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    own = (rows or reviews(spark, d)).groupBy("user_id").agg(F.count("*").alias("user_reviews"), F.avg("stars").alias("user_mean"), F.sum("useful").alias("user_useful"))
    segments = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.round("c_acctbal", 2).alias("balance"), F.length("c_mktsegment").cast("long").alias("segment_length"))
    return segments.join(own, "user_id", "left")


USERS_SQL = """users AS (
  SELECT c_custkey AS user_id, round(c_acctbal, 2) AS balance, length(c_mktsegment) AS segment_length, user_reviews, user_mean, user_useful
  FROM customer LEFT JOIN (SELECT user_id, count(*) AS user_reviews, avg(stars) AS user_mean, CAST(sum(useful) AS BIGINT) AS user_useful FROM reviews GROUP BY user_id) u
  ON c_custkey = u.user_id)"""


def order_brands(spark: SparkSession, d: str) -> DataFrame:
    """Baskets: the brands of each order."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("p_partkey"))
    return lines.join(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("item")), "p_partkey").select("basket", "item").distinct()


BRANDS_SQL = "baskets AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"


def document_words(spark: SparkSession, d: str) -> DataFrame:
    """(item, member): documents and their distinct words, members numbered by a hash of the word. Rows that share a
    doc_id or a hash can give a member twice; whoever counts them makes sets first."""
    words = table(spark, d, "documents").select(F.col("doc_id").alias("item"), F.explode(F.array_distinct(F.split(F.lower("text"), "[ \t\r\n]+"))).alias("word")).where("word <> ''")
    digest = F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 7), 16, 10).cast("long")
    return words.select("item", digest.alias("member"))


WORDS_SQL = """words AS (
  SELECT DISTINCT doc_id AS item, CAST(('0x' || substr(md5(word), 1, 7)) AS BIGINT) AS member
  FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+')) AS word FROM documents) WHERE word <> '')"""


def event_asks(spark: SparkSession, d: str, size: int) -> DataFrame:
    from ..operators.sketches import asks

    return asks(table(spark, d, "events"), "event_id", "user_id", size)


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label")


def part_suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_suppkey", "l_partkey")


EDGES_SQL = """pairs AS (
  SELECT a.l_suppkey AS src, b.l_suppkey AS dst, count(*) AS n
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) b
  ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2),
edges AS (SELECT src, dst FROM pairs WHERE n >= (SELECT avg(n) + 2.5 * stddev_pop(n) FROM pairs)),
directed AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"""
