"""The queries over the stored tables, and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import BLOOM_BITS, STREAM_HASHES
from ..operators import clustering, graph, itemsets, recommend, relational, similarity, sketches
from ..operators.iteration import stored
from ..sources import sinks
from ..sources.readers import table
from ..sources.schemas import COMPLIMENTS
from . import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Counts and joined averages


@query(f"""WITH {v.REVIEWS_SQL},
u AS (SELECT user_id AS k, count(*) AS n FROM reviews GROUP BY 1 ORDER BY n DESC, k LIMIT 10),
b AS (SELECT business_id AS k, count(*) AS n FROM reviews GROUP BY 1 ORDER BY n DESC, k LIMIT 10)
SELECT count(*) AS n_review, count(*) FILTER (WHERE year(date) = 1998) AS n_review_year, count(DISTINCT user_id) AS n_user,
count(DISTINCT business_id) AS n_business, (SELECT string_agg(k || ':' || n, ',' ORDER BY n DESC, k) FROM u) AS top_user,
(SELECT string_agg(k || ':' || n, ',' ORDER BY n DESC, k) FROM b) AS top_business FROM reviews""")
def review_stats(spark, d):
    return relational.review_stats(v.reviews(spark, d), 1998)


@query("SELECT count(*) FILTER (WHERE year(o_orderdate) = 1998) AS n_review_year FROM orders")
def reviews_in_year(spark, d):
    return relational.count_in_year(table(spark, d, "orders").withColumnRenamed("o_orderdate", "date"), 1998)


@query("SELECT o_custkey AS user_id, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def top_users(spark, d):
    return relational.top_keys(table(spark, d, "orders").withColumnRenamed("o_custkey", "user_id"), "user_id")


@query("SELECT l_partkey AS business_id, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, business_id LIMIT 10")
def top_items(spark, d):
    return relational.top_keys(table(spark, d, "lineitem").withColumnRenamed("l_partkey", "business_id"), "business_id")


CITY = f"WITH {v.REVIEWS_SQL} SELECT n_name AS city, round(avg(stars), 6) AS stars FROM reviews JOIN supplier ON supplier_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 ORDER BY avg(stars) DESC, city"


@query(CITY + " LIMIT 10")
def city_avg_stars(spark, d):
    rows = v.reviews(spark, d).drop("business_id").withColumnRenamed("supplier_id", "business_id")
    return rounded(relational.city_average(rows, v.suppliers(spark, d)), "stars")


@query(CITY)
def city_avg_stars_all(spark, d):
    rows = v.reviews(spark, d).drop("business_id").withColumnRenamed("supplier_id", "business_id")
    return rounded(relational.city_average(rows, v.suppliers(spark, d), None, "left"), "stars")


@query('SELECT p.range AS "partition", count(l_partkey) AS n_items FROM range(8) p LEFT JOIN lineitem ON l_partkey % 8 = p.range GROUP BY 1')
def partition_profile(spark, d):
    return relational.partition_profile(table(spark, d, "lineitem"), 8, "l_partkey")


@query()
def partition_profile_hashed(spark, d):
    return relational.physical_profile(table(spark, d, "lineitem").select("l_partkey"), 8, "l_partkey")


@query()
def partition_profile_default(spark, d):
    return relational.physical_profile(table(spark, d, "lineitem").select("l_partkey"))


@query()
def partition_times(spark, d):
    return relational.timed_profiles(table(spark, d, "lineitem").select("l_partkey"), 8, "l_partkey")


@query(f"""WITH {v.REVIEWS_SQL} SELECT CAST(to_json({{'n_review': count(*), 'n_user': count(DISTINCT user_id), 'n_business': count(DISTINCT business_id)}}) AS VARCHAR) AS line FROM reviews""")
def review_counts_json(spark, d):
    counts = relational.review_stats(v.reviews(spark, d), 1998).select("n_review", "n_user", "n_business")
    return sinks.json_lines(counts)


@query(f"SELECT 0 AS part, 'city,stars' AS line UNION ALL SELECT 1, city || ',' || CAST(stars AS VARCHAR) FROM ({CITY})")
def city_csv(spark, d):
    return sinks.csv_lines(city_avg_stars_all(spark, d))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_fields(spark, d):
    parsed = table(spark, d, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return parsed.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"))


@query("""SELECT 'both' AS part, count(*) AS n FROM (SELECT l_suppkey FROM lineitem INTERSECT SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'either', count(*) FROM (SELECT l_suppkey FROM lineitem UNION SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'only_customers', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)""")
def set_operations(spark, d):
    lines, own = table(spark, d, "lineitem").select("l_suppkey"), table(spark, d, "supplier").select("s_suppkey")
    customers, buyers = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_custkey")
    parts = [("both", lines.intersect(own)), ("either", lines.union(own).distinct()), ("only_customers", customers.exceptAll(buyers.distinct()))]
    out = None
    for name, df in parts:
        one = df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def users_without_reviews(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.count("*").alias("n"))


# Itemsets


@query(f"WITH {v.BRANDS_SQL} SELECT basket, item FROM baskets")
def baskets_by_order(spark, d):
    return v.order_brands(spark, d)


@query(f"WITH {v.REVIEWS_SQL} SELECT DISTINCT user_id AS basket, CAST(business_id AS VARCHAR) AS item FROM reviews")
def baskets_by_user(spark, d):
    return itemsets.baskets(v.reviews(spark, d), 1)


@query(f"WITH {v.REVIEWS_SQL} SELECT DISTINCT business_id AS basket, CAST(user_id AS VARCHAR) AS item FROM reviews")
def baskets_by_business(spark, d):
    return itemsets.baskets(v.reviews(spark, d), 2)


@query(f"""WITH {v.REVIEWS_SQL},
b AS (SELECT DISTINCT strftime(date, '%Y-%m-%d') || '-' || ltrim(CAST(user_id AS VARCHAR), '0') AS basket, ltrim(CAST(business_id AS VARCHAR), '0') AS item FROM reviews)
SELECT basket, item FROM b WHERE basket IN (SELECT basket FROM b GROUP BY basket HAVING count(*) > 3)""")
def transaction_baskets(spark, d):
    rows = v.reviews(spark, d).select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("user_id").alias("customer_id"), F.col("business_id").alias("product_id"))
    return itemsets.transaction_baskets(rows, 3)


SUPPORT = 75
MOST_BRANDS = 7  # an order has at most seven lines


def _level_sql(k: int) -> str:
    joins = "".join(f" JOIN baskets b{i} ON b{i}.basket = b{i - 1}.basket AND b{i - 1}.item < b{i}.item" for i in range(2, k + 1))
    items = " || ',' || ".join(f"b{i}.item" for i in range(1, k + 1))
    return f"SELECT {k} AS k, {items} AS items, count(*) AS n FROM baskets b1{joins} GROUP BY 2 HAVING count(*) >= {SUPPORT}"


SETS_SQL = f"WITH {v.BRANDS_SQL}, found AS ({' UNION ALL '.join(_level_sql(k) for k in range(1, MOST_BRANDS + 1))}) "


@query(SETS_SQL + "SELECT k, items, n FROM found")
def frequent_itemsets(spark, d):
    found = itemsets.frequent_sets(v.order_brands(spark, d), SUPPORT)
    return found.select("k", F.array_join("items", ",").alias("items"), "n")


@query(SETS_SQL + """SELECT k, string_agg('(''' || replace(items, ',', ''', ''') || ''')', ',' ORDER BY items) AS line FROM found GROUP BY k""")
def itemset_report(spark, d):
    return sinks.itemset_lines(itemsets.frequent_sets(v.order_brands(spark, d), SUPPORT))


CANDIDATES_SQL = f"""WITH {v.BRANDS_SQL},
c AS (SELECT basket, ntile(2) OVER (ORDER BY basket) AS chunk FROM (SELECT DISTINCT basket FROM baskets)),
b AS (SELECT chunk, basket, item FROM baskets JOIN c USING (basket))
"""


def _shown_sql(name: str) -> str:
    return f"""SELECT k, string_agg('(''' || replace(items, ',', ''', ''') || ''')', ',' ORDER BY items) AS line FROM {name} GROUP BY k"""


def _chunk_level_sql(k: int) -> str:
    joins = "".join(f" JOIN b b{i} ON b{i}.basket = b{i - 1}.basket AND b{i - 1}.item < b{i}.item" for i in range(2, k + 1))
    items = " || ',' || ".join(f"b{i}.item" for i in range(1, k + 1))
    return f"SELECT DISTINCT {k} AS k, items FROM (SELECT b1.chunk, {items} AS items FROM b b1{joins} GROUP BY 1, 2 HAVING count(*) >= ceil({SUPPORT} / 2))"


ITEMSETS_SQL = f"""{CANDIDATES_SQL}, found AS ({' UNION ALL '.join(_level_sql(k) for k in range(1, MOST_BRANDS + 1))}),
possible AS ({' UNION ALL '.join(_chunk_level_sql(k) for k in range(1, MOST_BRANDS + 1))}),
lines AS (SELECT 0 AS section, k, line FROM ({_shown_sql('possible')}) UNION ALL SELECT 1, k, line FROM ({_shown_sql('found')}))
SELECT 0 AS section, 0 AS place, 'Candidates:' AS line UNION ALL SELECT 1, 0, 'Frequent Itemsets:'
UNION ALL SELECT section, 2 * k - 1, line FROM lines UNION ALL SELECT section, 2 * k, '' FROM lines"""


@query(ITEMSETS_SQL)
def candidates_report(spark, d):
    """Both passes: the candidates of two chunks and the frequent itemsets, as lines with headings."""
    baskets = v.order_brands(spark, d)
    return sinks.itemset_report(itemsets.all_candidates(baskets, SUPPORT), itemsets.frequent_sets(baskets, SUPPORT))


@query(CANDIDATES_SQL + "SELECT DISTINCT item AS items FROM b GROUP BY chunk, item HAVING count(*) >= ceil(2000 / 2)")
def son_candidates_1(spark, d):
    return itemsets.candidates(v.order_brands(spark, d), 2000, 1).select(F.array_join("items", ",").alias("items"))


@query(CANDIDATES_SQL + """SELECT DISTINCT x.item || ',' || y.item AS items FROM b x JOIN b y ON x.chunk = y.chunk AND x.basket = y.basket AND x.item < y.item
GROUP BY x.chunk, x.item, y.item HAVING count(*) >= ceil(400 / 2)""")
def son_candidates_2(spark, d):
    return itemsets.candidates(v.order_brands(spark, d), 400, 2).select(F.array_join("items", ",").alias("items"))


@query(f"""WITH {v.BRANDS_SQL},
f2 AS (SELECT x.item AS a, y.item AS b FROM baskets x JOIN baskets y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= 400)
SELECT DISTINCT array_to_string(list_sort(list_distinct([p.a, p.b, q.a, q.b])), ',') AS items FROM f2 p JOIN f2 q ON len(list_distinct([p.a, p.b, q.a, q.b])) = 3""")
def possible_triples(spark, d):
    pairs = itemsets.frequent_sets(v.order_brands(spark, d), 400, 2).where("k = 2")
    return itemsets.possible_sets(pairs).select(F.array_join("items", ",").alias("items"))


# Similar items


def _affine_sql(j: int) -> str:
    return f"min(({1103515245 + 40692 * j}::BIGINT * member + {12345 + 16807 * j}) % 2147483647) AS h{j}"


SIGNED_SQL = f"WITH {v.WORDS_SQL}, signed AS (SELECT item, {', '.join(_affine_sql(j) for j in range(54))} FROM words GROUP BY item)"
BUCKETS_SQL = ", ".join(f"(h{2 * i} + h{2 * i + 1} + h{2 * i} * h{2 * i + 1}) % 1000000" for i in range(27))
MET_SQL = f"""{SIGNED_SQL},
banded AS (SELECT item, generate_subscripts(l, 1) AS band, unnest(l) AS bucket FROM (SELECT item, [{BUCKETS_SQL}] AS l FROM signed)),
met AS (SELECT DISTINCT x.item AS a, y.item AS b FROM banded x JOIN banded y ON x.band = y.band AND x.bucket = y.bucket AND x.item < y.item)"""
JACCARD_SQL = """sizes AS (SELECT item, count(*) AS n FROM words GROUP BY item),
common AS (SELECT met.a, met.b, count(*) AS k FROM met JOIN words x ON x.item = met.a JOIN words y ON y.item = met.b AND y.member = x.member GROUP BY 1, 2)
SELECT a, b, round(k / (p.n + q.n - k), 6) AS similarity FROM common JOIN sizes p ON p.item = a JOIN sizes q ON q.item = b WHERE k / (p.n + q.n - k) >= 0.5"""


@query(f"{SIGNED_SQL} SELECT item, array_to_string([{', '.join(f'h{j}' for j in range(54))}], ',') AS sig FROM signed")
def minhash_signatures(spark, d):
    return similarity.signatures(v.document_words(spark, d)).select("item", F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig"))


@query(f"{MET_SQL} SELECT a, b FROM met")
def lsh_candidates(spark, d):
    return similarity.bucket_pairs(v.document_words(spark, d))


@query(f"{MET_SQL}, {JACCARD_SQL}")
def similar_pairs(spark, d):
    return rounded(similarity.similar_pairs(v.document_words(spark, d)), "similarity").orderBy("a", "b")


@query(f"""WITH {v.WORDS_SQL},
met AS (SELECT x.item AS a, y.item AS b FROM (SELECT DISTINCT item FROM words) x JOIN (SELECT DISTINCT item FROM words) y ON x.item < y.item),
sizes AS (SELECT item, count(*) AS n FROM words GROUP BY item),
common AS (SELECT x.item AS a, y.item AS b, count(*) AS k FROM words x JOIN words y ON x.member = y.member AND x.item < y.item GROUP BY 1, 2)
SELECT a, b, round(k / (p.n + q.n - k), 6) AS similarity FROM common JOIN sizes p ON p.item = a JOIN sizes q ON q.item = b WHERE k / (p.n + q.n - k) >= 0.5""")
def similar_pairs_exact(spark, d):
    return rounded(similarity.similar_pairs_exact(v.document_words(spark, d)), "similarity")


# Recommendation


FIFTH_SQL = v.split_sql(5, 3)


def _cf_sql(parts: str, neighbours: int | None = None) -> str:
    best = f"QUALIFY row_number() OVER (PARTITION BY w.\"user\", w.item ORDER BY round(p.w, 9) DESC, p.b) <= {neighbours}" if neighbours else ""
    return f"""WITH {v.REVIEWS_SQL}, {v.RATINGS_SQL}, {parts},
items AS (SELECT item, count(*) AS n, avg(stars) AS item_mean FROM train GROUP BY item),
people AS (SELECT "user", avg(stars) AS user_mean FROM train GROUP BY "user"),
main AS (SELECT * FROM train WHERE item IN (SELECT item FROM items WHERE n > 2)),
need AS (SELECT DISTINCT val.item AS a, main.item AS b FROM val JOIN main ON val."user" = main."user" WHERE val.item IN (SELECT item FROM items WHERE n > 2)),
s AS (SELECT need.a, need.b, count(*) AS n, sum(x.stars)::BIGINT AS sx, sum(y.stars)::BIGINT AS sy, sum(x.stars * x.stars)::BIGINT AS sxx,
  sum(y.stars * y.stars)::BIGINT AS syy, sum(x.stars * y.stars)::BIGINT AS sxy
  FROM need JOIN train x ON x.item = need.a JOIN train y ON y.item = need.b AND y."user" = x."user" GROUP BY 1, 2),
p AS (SELECT a, b, n, CASE WHEN n >= 2 AND n * sxx > sx * sx AND n * syy > sy * sy
  THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx)::DOUBLE * (n * syy - sy * sy)::DOUBLE) ELSE 0 END AS w FROM s),
near AS (SELECT w."user", w.item, p.w, t.stars FROM val w JOIN p ON p.a = w.item AND p.w > 0 JOIN train t ON t."user" = w."user" AND t.item = p.b {best}),
best AS (SELECT "user", item, sum(w * stars) / sum(w) AS near FROM near GROUP BY 1, 2),
cf AS (SELECT val."user", val.item, val.stars, CASE WHEN n IS NULL THEN CASE WHEN user_mean IS NOT NULL THEN ({recommend.NEW_ITEM_MEAN} + user_mean) / 2 ELSE {recommend.NEW_BOTH_MEAN} END
  WHEN n <= 2 THEN ({recommend.MINOR_ITEM_MEAN} + item_mean) / 2 WHEN near IS NOT NULL THEN 0.7 * item_mean + 0.3 * near ELSE item_mean END AS prediction
  FROM val LEFT JOIN items USING (item) LEFT JOIN people USING ("user") LEFT JOIN best USING ("user", item))
"""


CF_OUT = 'SELECT "user", item, round(prediction, 6) AS prediction FROM cf'


@query(_cf_sql(FIFTH_SQL) + "SELECT a AS item_a, b AS item_b, n, round(w, 6) AS w FROM p")
def item_pearson(spark, d):
    train, val = v.split(v.ratings(spark, d), 5, 3)
    return rounded(recommend.item_pearson(train, recommend.needed_pairs(train, val)), "w")


@query(_cf_sql(FIFTH_SQL) + CF_OUT)
def item_cf(spark, d):
    return rounded(recommend.predict(*v.split(v.ratings(spark, d), 5, 3)), "prediction")


@query(_cf_sql(FIFTH_SQL, 15) + CF_OUT)
def item_cf_top15(spark, d):
    return rounded(recommend.predict(*v.split(v.ratings(spark, d), 5, 3), 15), "prediction")


@query(_cf_sql(v.COLD_SPLIT_SQL) + CF_OUT)
def cf_cold_start(spark, d):
    return rounded(recommend.predict(*v.cold_split(v.ratings(spark, d))), "prediction")


@query(f"WITH {v.REVIEWS_SQL} SELECT business_id, round(sum((50 + useful) * stars) / sum(50 + useful), 6) AS rate FROM reviews GROUP BY 1")
def weighted_item_mean(spark, d):
    return rounded(recommend.useful_mean(v.reviews(spark, d)), "rate")


@query(f"""WITH {v.REVIEWS_SQL}, {v.BUSINESSES_SQL}, {v.USERS_SQL}
SELECT user_id, business_id, supplier_id, order_id, stars, date, useful, round(business_mean, 6) AS business_mean, review_count, balance, segment_length, user_reviews,
round(user_mean, 6) AS user_mean, user_useful FROM reviews LEFT JOIN businesses USING (business_id) LEFT JOIN users USING (user_id)""")
def feature_table(spark, d):
    return rounded(recommend.feature_table(v.reviews(spark, d), v.users(spark, d), v.businesses(spark, d)), "business_mean", "user_mean")


def _blend_inputs(spark, d):
    rows = v.reviews(spark, d).select("user_id", "business_id", "order_id").distinct()
    rates = recommend.useful_mean(v.reviews(spark, d)).withColumnRenamed("rate", "useful_rate")
    joined = recommend.feature_table(rows, v.users(spark, d), v.businesses(spark, d)).join(rates, "business_id", "left")
    mean = (F.col("business_mean") + F.col("user_mean")) / 2
    return joined.withColumns({"regression": mean, "item_cf": F.col("business_mean")})


def _blend_sql() -> str:
    lines = []
    for low, high, *c in recommend.BLEND:
        bounds = [f"review_count > {low}"] * (low is not None) + [f"review_count <= {high}"] * (high is not None)
        terms = " + ".join(f"({w!r}::DOUBLE) * {name}" for name, w in zip(recommend.BLEND_INPUTS, c[:-1], strict=True))
        lines.append((" AND ".join(bounds), f"{terms} + ({c[-1]!r}::DOUBLE)"))
    bucket = "CASE " + " ".join(f"WHEN {b} THEN {i}" for i, (b, _) in enumerate(lines)) + " END"
    value = "CASE " + " ".join(f"WHEN {b} THEN {t}" for b, t in lines) + " END"
    return f"""WITH {v.REVIEWS_SQL}, {v.BUSINESSES_SQL}, {v.USERS_SQL},
rates AS (SELECT business_id, sum((50 + useful) * stars) / sum(50 + useful) AS useful_rate FROM reviews GROUP BY 1),
x AS (SELECT user_id, business_id, order_id, review_count, business_mean, user_mean, user_useful, coalesce(useful_rate, business_mean) AS useful_rate, (business_mean + user_mean) / 2 AS regression, business_mean AS item_cf
 FROM (SELECT DISTINCT user_id, business_id, order_id FROM reviews) r LEFT JOIN businesses USING (business_id) LEFT JOIN users USING (user_id) LEFT JOIN rates USING (business_id))
SELECT user_id, business_id, order_id, {bucket} AS bucket, CASE WHEN ({value}) IS NOT NULL THEN round(greatest(1.0::DOUBLE, least(5.0::DOUBLE, {value})), 5) END AS prediction FROM x"""


@query(_blend_sql())
def blend_piecewise(spark, d):
    return recommend.blend(_blend_inputs(spark, d)).select("user_id", "business_id", "order_id", "bucket", F.round("prediction", 5).alias("prediction"))


RECORD = {"review_count": "c_custkey % 97", "average_stars": "c_acctbal", "fans": "c_nationkey", "useful": "c_custkey % 11", "funny": "c_custkey % 7", "cool": "c_custkey % 5"}
RECORD |= {f"compliment_{c}": f"c_custkey % {i + 2}" for i, c in enumerate(COMPLIMENTS)}
PLAIN = {"review_count": "u_review_count", "average_stars": "u_stars", "fans": "u_fans"}


@query(f"""SELECT c_custkey AS user_id, {', '.join(f'{x} AS {PLAIN.get(c, c)}' for c, x in RECORD.items())},
length(c_name) AS u_friends, CASE WHEN c_custkey % 3 > 0 THEN length(c_mktsegment) END AS u_elite FROM customer""")
def user_features(spark, d):
    """Customers as user records with all 19 features."""
    own = table(spark, d, "customer").selectExpr("c_custkey AS user_id", *(f"{x} AS {c}" for c, x in RECORD.items()), "c_name AS friends", "CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS elite")
    return recommend.user_features(own)


FEATURES = ["business_mean", "review_count", "balance", "segment_length", "user_reviews", "user_mean", "user_useful"]


def _boosted(spark, d, rows=None, users=None, businesses=None):
    rows = recommend.feature_table(rows or v.reviews(spark, d), users or v.users(spark, d), businesses or v.businesses(spark, d))
    part = F.col("order_id") % 5
    return recommend.boosted(rows.where(part != 3), rows.where(part == 3), FEATURES)


@query()
def gbt_predict(spark, d):
    return _boosted(spark, d).select("user_id", "business_id", "order_id", "stars", "regression")


@query(_cf_sql(FIFTH_SQL) + """SELECT CAST(least(floor(abs(prediction - stars)), 4) AS BIGINT) AS band, count(*) AS n,
(SELECT round(sqrt(sum((prediction - stars) * (prediction - stars)) / count(*)), 6) FROM cf) AS rmse FROM cf GROUP BY 1""")
def rating_eval(spark, d):
    train, val = v.split(v.ratings(spark, d), 5, 3)
    rated = recommend.predict(train, val).join(val, ["user", "item"])
    return rounded(recommend.evaluate(rated), "rmse")


def _hybrid(spark, d):
    """The whole blend: regression by boosted trees, collaborative filtering and means, learned from all but a fifth."""
    rows = stored(v.reviews(spark, d).select("user_id", "business_id", "order_id", "stars", "useful"))
    users, businesses = stored(v.users(spark, d, rows)), stored(v.businesses(spark, d, rows))
    train, val = v.split(stored(v.ratings(spark, d, rows)), 5, 3)
    cf = stored(recommend.predict(train, val, 15).select(F.col("user").alias("user_id"), F.col("item").alias("business_id"), F.col("prediction").alias("item_cf")))
    trees = _boosted(spark, d, rows, users, businesses).groupBy("user_id", "business_id").agg(F.max("regression").alias("regression"), F.max("stars").alias("stars"))
    facts = recommend.feature_table(stored(trees).join(cf, ["user_id", "business_id"]), users, businesses)
    rates = recommend.useful_mean(rows).withColumnRenamed("rate", "useful_rate")
    return recommend.blend(facts.join(rates, "business_id", "left"))


@query()
def hybrid_predict(spark, d):
    return _hybrid(spark, d).select("user_id", "business_id", "bucket", "prediction")


@query()
def hybrid_eval(spark, d):
    """Error bands and RMSE of the whole blend on the held-out fifth."""
    return rounded(recommend.evaluate(_hybrid(spark, d)), "rmse")


# Graphs


def edges(spark, d):
    return graph.co_graph(v.part_suppliers(spark, d), "l_suppkey", "l_partkey")


REACH_SQL = f"""WITH RECURSIVE {v.EDGES_SQL},
reach AS (SELECT src AS node, src AS seen FROM directed UNION SELECT reach.node, directed.dst FROM reach JOIN directed ON directed.src = reach.seen),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
"""


@query(f"WITH {v.EDGES_SQL} SELECT src, dst FROM edges")
def co_graph(spark, d):
    return edges(spark, d)


@query(f"WITH {v.EDGES_SQL} SELECT src AS node, count(*) AS degree FROM directed GROUP BY 1")
def degrees(spark, d):
    return graph.degrees(edges(spark, d))


@query(REACH_SQL + "SELECT node, component FROM comp")
def connected_components(spark, d):
    return graph.components(edges(spark, d))


@query(REACH_SQL + """, m AS (SELECT count(*) AS m FROM edges), k AS (SELECT src AS node, count(*)::DOUBLE AS degree FROM directed GROUP BY 1),
x AS (SELECT sum(s) AS x FROM (SELECT sum(degree) * sum(degree) - sum(degree * degree) AS s FROM k JOIN comp USING (node) GROUP BY component)),
i AS (SELECT count(*) AS i FROM edges JOIN comp a ON a.node = src JOIN comp b ON b.node = dst WHERE a.component = b.component)
SELECT round((i - x / (4 * m)) / (2 * m), 6) AS q FROM m, x, i""")
def modularity(spark, d):
    found = edges(spark, d)
    return rounded(graph.modularity(found, graph.components(found)), "q")


def _labels_sql(steps: int) -> str:
    parts = ["l0 AS (SELECT DISTINCT src AS node, src AS label FROM directed)"]
    for i in range(1, steps + 1):
        parts.append(f"l{i} AS (SELECT node, label FROM (SELECT src AS node, label, count(*) AS n FROM directed JOIN l{i - 1} ON node = dst GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, label) = 1)")
    return f"WITH {v.EDGES_SQL}, {', '.join(parts)}"


@query(_labels_sql(5) + " SELECT node, label FROM l5")
def label_propagation(spark, d):
    return graph.label_propagation(edges(spark, d))


@query(_labels_sql(5) + """ SELECT count(*) AS size, min(CAST(node AS VARCHAR)) AS first, string_agg('''' || node || '''', ', ' ORDER BY CAST(node AS VARCHAR)) AS line FROM l5 GROUP BY label""")
def community_report(spark, d):
    return sinks.community_lines(graph.communities(graph.label_propagation(edges(spark, d))))


@query(_labels_sql(5) + " SELECT node, dense_rank() OVER (ORDER BY label) - 1 AS label FROM l5")
def community_numbers(spark, d):
    return clustering.relabel(graph.label_propagation(edges(spark, d))).withColumn("label", F.col("label").cast("long"))


BETWEENNESS_SQL = f"""WITH RECURSIVE {v.EDGES_SQL},
walk AS (SELECT DISTINCT src AS root, src AS node, 0 AS level FROM directed
  UNION SELECT walk.root, directed.dst, level + 1 FROM walk JOIN directed ON directed.src = walk.node WHERE level < 40),
dist AS (SELECT root, node, min(level) AS level FROM walk GROUP BY 1, 2),
path AS (SELECT root, node, level, [root] AS nodes FROM dist WHERE level = 0
  UNION ALL SELECT path.root, dist.node, dist.level, list_append(nodes, dist.node) FROM path JOIN directed ON directed.src = path.node
  JOIN dist ON dist.root = path.root AND dist.node = directed.dst AND dist.level = path.level + 1),
counted AS (SELECT root, node, nodes, 1.0::DOUBLE / count(*) OVER (PARTITION BY root, node) AS share FROM path WHERE root < node),
steps AS (SELECT share, unnest(list_zip(nodes[:-2], nodes[2:])) AS s FROM counted),
flows AS (SELECT least(s[1], s[2]) AS src, greatest(s[1], s[2]) AS dst, sum(share) AS b FROM (SELECT share, [s[1], s[2]] AS s FROM steps) GROUP BY 1, 2)
SELECT src, dst, round(b, 6) AS betweenness FROM flows"""


@query(BETWEENNESS_SQL)
def edge_betweenness(spark, d):
    return rounded(graph.edge_betweenness(edges(spark, d)), "betweenness")


@query(BETWEENNESS_SQL.removesuffix("SELECT src, dst, round(b, 6) AS betweenness FROM flows") + """SELECT src, dst, round(b, 6) AS betweenness,
'(''' || src || ''', ''' || dst || '''), ' || CAST(CAST(round_even(round(b, 9), 5) AS DOUBLE) AS VARCHAR) AS line FROM flows""")
def betweenness_report(spark, d):
    found = graph.edge_betweenness(edges(spark, d)).withColumn("betweenness", F.round("betweenness", 9))
    return rounded(sinks.betweenness_lines(found), "betweenness")


@query(BETWEENNESS_SQL)
def edge_betweenness_by_roots(spark, d):
    return rounded(graph.edge_betweenness_by_roots(edges(spark, d)), "betweenness")


@query()
def girvan_newman(spark, d):
    return graph.girvan_newman(edges(spark, d))[1]


# Streams


def _modulo_sql(p: int) -> str:
    return f"list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(id) + 1), lambda i: ascii(substr(id, i, 1))::BIGINT)), lambda acc, x: (acc * 256 + x) % {p})"


def _hash_sql(j: int) -> str:
    a, b, p = STREAM_HASHES[j]
    return f"({a}::BIGINT * {_modulo_sql(p)} + {b}::BIGINT) % {p}"


@query(f"""WITH s AS (SELECT event_id // 20 AS ask, CAST(user_id AS VARCHAR) AS id FROM events),
ids AS (SELECT id, min(ask) AS ask FROM s GROUP BY id),
bits AS (SELECT id, ask, {_hash_sql(0)} % {BLOOM_BITS} AS bit FROM ids UNION ALL SELECT id, ask, {_hash_sql(1)} % {BLOOM_BITS} FROM ids),
firsts AS (SELECT bit, min(ask) AS f FROM bits GROUP BY bit),
judged AS (SELECT id, bits.ask, min(CASE WHEN f < bits.ask THEN 1 ELSE 0 END) AS bad FROM bits JOIN firsts USING (bit) GROUP BY 1, 2)
SELECT a.ask, count(id) AS n_new, CAST(coalesce(sum(bad), 0) AS BIGINT) AS n_false, CASE WHEN count(id) > 0 THEN round(coalesce(sum(bad), 0) / count(id), 6) END AS fpr
FROM (SELECT DISTINCT ask FROM s) a LEFT JOIN judged ON judged.ask = a.ask GROUP BY 1""")
def bloom_fpr(spark, d):
    return rounded(sketches.bloom_false_positives(v.event_asks(spark, d, 20)), "fpr")


def _zeros_sql(j: int) -> str:
    return f"max(CASE WHEN h{j} = 0 THEN 1 ELSE bit_count((h{j} & (-h{j})) - 1) END) AS r{j}"


@query(f"""WITH s AS (SELECT event_id // 100 AS ask, CAST(user_id AS VARCHAR) AS id FROM events),
h AS (SELECT ask, id, {", ".join(f"{_hash_sql(j)} AS h{j}" for j in range(3))} FROM s),
r AS (SELECT ask, count(DISTINCT id) AS truth, {", ".join(_zeros_sql(j) for j in range(3))} FROM h GROUP BY ask),
o AS (SELECT ask, truth, list_sort([r0, r1, r2]) AS l FROM r)
SELECT ask, truth, CAST(floor((pow(2.0, l[1]) + pow(2.0, l[2])) / 2) AS BIGINT) AS estimate FROM o""")
def fm_estimate(spark, d):
    return sketches.distinct_estimate(v.event_asks(spark, d, 100))


@query("""WITH s AS (SELECT event_id + 1 AS n, CAST(user_id AS VARCHAR) AS id FROM events),
u AS (SELECT n, id, CAST('0x' || substr(md5(CAST(n AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u, CAST('0x' || substr(md5(CAST(n AS VARCHAR)), 9, 8) AS BIGINT) / 4294967296.0::DOUBLE AS w FROM s),
t AS (SELECT n, id, CASE WHEN n <= 100 THEN n - 1 WHEN u < 100.0::DOUBLE / n THEN CAST(floor(w * 100) AS BIGINT) END AS slot FROM u),
c AS (SELECT n AS seqnum FROM s WHERE n % 100 = 0)
SELECT seqnum, """ + ", ".join(f'(SELECT arg_max(id, n) FROM t WHERE slot = {s} AND n <= seqnum) AS "{s}_id"' for s in (0, 20, 40, 60, 80)) + " FROM c")
def reservoir_sample(spark, d):
    return sketches.reservoir(v.event_asks(spark, d, 100))


# Clusters


STATS_SQL = """x AS (SELECT vec_id AS id, label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
s AS (SELECT label, dim, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM x GROUP BY 1, 2)"""


@query(f"WITH {STATS_SQL} SELECT label, n, round(sum(s), 4) AS total, round(sum(q), 4) AS squares FROM s GROUP BY 1, 2")
def cluster_statistics(spark, d):
    stats = clustering.statistics(v.points(spark, d))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 4)
    return stats.select("label", "n", total("sums").alias("total"), total("squares").alias("squares"))


@query(f"""WITH {STATS_SQL},
c AS (SELECT label, dim, s / n AS m, sqrt(greatest(0, q / n - (s / n) * (s / n))) AS sd FROM s),
dist AS (SELECT x.id, c.label AS near, round(sqrt(sum(CASE WHEN sd > 0 THEN ((x - m) / sd) * ((x - m) / sd) ELSE 0 END)), 9) AS distance FROM x JOIN c USING (dim) GROUP BY 1, 2),
best AS (SELECT id, near, distance FROM dist QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, near) = 1)
SELECT id, CASE WHEN distance < 2 * sqrt(64) THEN 'ds' ELSE 'rs' END AS target, CASE WHEN distance < 2 * sqrt(64) THEN near END AS near FROM best""")
def bfr_assign(spark, d):
    rows = v.points(spark, d)
    return clustering.assign(rows.select("id", "features"), clustering.statistics(rows), None).select("id", "target", "near")


@query()
def kmeans(spark, d):
    return clustering.kmeans(v.points(spark, d).select("id", "features"), 10).select("id", F.col("label").cast("int").alias("label"))


@query()
def bfr_rounds(spark, d):
    return clustering.Bfr(3).run(v.points(spark, d).select("id", "features"))[0]


@query()
def bfr_labels(spark, d):
    return clustering.Bfr(3).run(v.points(spark, d).select("id", "features"))[1]


@query()
def bfr_report(spark, d):
    rounds, labels = clustering.Bfr(3).run(v.points(spark, d).select("id", "features"))
    return sinks.cluster_lines(rounds, labels)
