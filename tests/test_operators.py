"""Small cases worked out by hand."""

import math
import random

import numpy as np
import pytest

from siltworks.functions import hashing
from siltworks.operators import clustering, graph, itemsets, recommend, relational, similarity, sketches
from siltworks.sources import readers, sinks
from pyspark.sql import functions as F


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_frequent_sets(spark, rows):
    baskets = {1: "abc", 2: "ab", 3: "ac", 4: "b"}
    long = frame(spark, [(k, i) for k, v in baskets.items() for i in v], "basket long, item string")
    found = itemsets.frequent_sets(long, 2).select("k", F.array_join("items", "").alias("s"), "n")
    assert rows(found) == [(1, "a", 3), (1, "b", 3), (1, "c", 2), (2, "ab", 2), (2, "ac", 2)]
    lines = rows(sinks.itemset_lines(itemsets.frequent_sets(long, 2)))
    assert lines == [(1, "('a'),('b'),('c')"), (2, "('a', 'b'),('a', 'c')")]


def test_two_passes_lose_no_frequent_set(spark, rows):
    rng = random.Random(3)
    long = frame(spark, sorted({(b, rng.choice("abcdef")) for b in range(60) for _ in range(3)}), "basket long, item string")
    frequent = {tuple(r["items"]) for r in itemsets.frequent_sets(long, 8).where("k = 2").collect()}
    assert frequent <= {tuple(r["items"]) for r in itemsets.candidates(long, 8, 2).collect()}


def test_possible_sets(spark):
    pairs = frame(spark, [(["a", "b"],), (["a", "c"],), (["d", "e"],)], "items array<string>")
    assert [r["items"] for r in itemsets.possible_sets(pairs).collect()] == [["a", "b", "c"]]


def test_transaction_baskets(spark, rows):
    t = frame(spark, [('"1/1"', '"007"', f'"00{i}"') for i in (1, 2, 2)] + [("1/1", "8", "1")], "date string, customer_id string, product_id string")
    assert rows(itemsets.transaction_baskets(t, 1)) == [("1/1-7", "1"), ("1/1-7", "2")]


def test_jaccard(spark, rows):
    pairs = frame(spark, [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (2, 4), (3, 9)], "item long, member long")
    assert rows(similarity.similar_pairs_exact(pairs, 0.5)) == [(1, 2, 0.5)]
    assert {r[:2] for r in rows(similarity.similar_pairs(pairs, 0.5))} <= {(1, 2)}


@pytest.mark.parametrize("ratings,expected", [([(1, 2), (2, 4), (3, 6)], 1.0), ([(3, 1), (3, 5)], 0.0), ([(3, 4)], 0.0)])
def test_pearson(spark, ratings, expected):
    train = frame(spark, [(u, i, s) for u, pair in enumerate(ratings) for i, s in enumerate(pair)], "user long, item long, stars long")
    needed = frame(spark, [(0, 1)], "item_a long, item_b long")
    assert recommend.item_pearson(train, needed).first()["w"] == pytest.approx(expected)


def test_cold_start(spark):
    train = frame(spark, [(1, 10, 4), (1, 11, 4)], "user long, item long, stars long")
    wanted = frame(spark, [(1, 10), (2, 11), (1, 99), (2, 99)], "user long, item long")
    got = {(r["user"], r["item"]): r["prediction"] for r in recommend.predict(train, wanted).collect()}
    assert got[1, 10] == pytest.approx(3.875243664717349)
    assert got[1, 99] == pytest.approx(3.9201954397394134)
    assert got[2, 99] == pytest.approx(3.628701193699879)


def test_near_means_make_no_row_of_a_pair(spark):
    """String keys and several groups: the means are those of the pairs' correlations, and no pair is in the plan."""
    rng = random.Random(8)
    rated = {(f"u{rng.randrange(25)}", f"i{rng.randrange(12)}"): rng.randrange(1, 6) for _ in range(200)}
    asked = {k for k in rated if rng.random() < 0.2}
    train = frame(spark, [(*k, s) for k, s in rated.items() if k not in asked] + [(None, "i1", 5), ("u1", None, 5)], "user string, item string, stars long")
    wanted = frame(spark, sorted(asked), "user string, item string")
    weight = {(r["item_a"], r["item_b"]): r["w"] for r in recommend.item_pearson(train, recommend.needed_pairs(train, wanted)).collect()}
    for most in (3, None):
        expected = {}
        for user, item in asked:
            best = sorted((-round(weight.get((item, b), 0), 9), b, s) for (u, b), s in rated.items() if u == user and (u, b) not in asked and weight.get((item, b), 0) > 0)[:most]
            if best:
                expected[user, item] = sum(w * s for w, _, s in best) / sum(w for w, _, _ in best)
        got = {(r["user"], r["item"]): r["near"] for r in recommend.near_means(train, wanted, most, 3, 40).collect()}
        assert got == pytest.approx(expected, abs=1e-7) and len(got) > 5
    plan = recommend.predict(train, wanted, 3)._jdf.queryExecution().executedPlan().toString()
    assert "item_b" not in plan and "Window" not in plan


def test_useful_mean(spark):
    reviews = frame(spark, [("b", 5.0, 0), ("b", 1.0, 50)], "business_id string, stars double, useful long")
    assert recommend.useful_mean(reviews).first()["rate"] == pytest.approx(350 / 150)


def test_blend_buckets(spark):
    counts = [50, 51, 100, 101, 200, 201, 300, 301, 500, 501, 1000, 1001, None]
    got = [r["b"] for r in frame(spark, [(i, c) for i, c in enumerate(counts)], "i int, c long").withColumn("b", recommend.blend_bucket(F.col("c"))).orderBy("i").collect()]
    assert got == [6, 5, 5, 4, 4, 3, 3, 2, 2, 1, 1, 0, None]


def test_blend_of_missing_inputs(spark):
    names = ["k", "review_count", *recommend.BLEND_INPUTS]
    at = {c: i for i, c in enumerate(names)}
    full = [0, 60, *([3.0] * len(recommend.BLEND_INPUTS))]
    full[at["review_count"]] = 60
    without_rate, without_regression, low = list(full), list(full), list(full)
    without_rate[0], without_rate[at["useful_rate"]] = 1, None
    without_regression[0], without_regression[at["regression"]] = 2, None
    low[0], low[at["regression"]] = 3, -50.0
    schema = ", ".join("review_count long" if c == "review_count" else f"{c} long" if c == "k" else f"{c} double" for c in dict.fromkeys(names))
    keep = [names.index(c) for c in dict.fromkeys(names)]
    given = [[int(r[i]) if names[i] in ("k", "review_count") else r[i] for i in keep] for r in (full, without_rate, without_regression, low)]
    got = {r["k"]: r["prediction"] for r in recommend.blend(spark.createDataFrame([[float(x) if x is not None and c not in ("k", "review_count") else x for x, c in zip(r, dict.fromkeys(names), strict=True)] for r in given], schema)).collect()}
    assert got[1] == got[0] and 1 < got[0] < 5 and got[2] is None and got[3] == 1.0


def test_labels_of_strings(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z")], "src string, dst string")
    got = {}
    for r in graph.label_propagation(edges).collect():
        got.setdefault(r["label"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == [["a", "b", "c"], ["x", "y", "z"]]


def test_frequent_sets_of_every_size(spark):
    long = spark.createDataFrame([(b, i) for b in range(3) for i in "abcde"], "basket long, item string")
    got = {r["k"]: r["c"] for r in itemsets.frequent_sets(long, 3).groupBy("k").agg(F.count("*").alias("c")).collect()}
    assert got == {1: 5, 2: 10, 3: 10, 4: 5, 5: 1}


def test_evaluation(spark, rows):
    rated = frame(spark, [(1.0, 1.5), (1.0, 5.0)], "prediction double, stars double")
    out = rows(recommend.evaluate(rated))
    assert [(b, n) for b, n, _ in out] == [(0, 1), (4, 1)] and out[0][2] == pytest.approx(math.sqrt((0.25 + 16) / 2))


def edges(spark, pairs):
    return frame(spark, pairs, "src string, dst string")


@pytest.mark.parametrize("way", [graph.edge_betweenness, graph.edge_betweenness_by_roots])
def test_betweenness(spark, rows, way):
    assert rows(way(edges(spark, [("a", "b"), ("b", "c")]))) == [("a", "b", 2.0), ("b", "c", 2.0)]
    assert rows(way(edges(spark, [("a", "b"), ("b", "c"), ("a", "c")]))) == [("a", "b", 1.0), ("a", "c", 1.0), ("b", "c", 1.0)]


def test_ways_of_betweenness_agree(spark, monkeypatch):
    """A graph of several components, by edges sent to all tasks, by components and by joins."""
    rng = random.Random(4)
    pairs = sorted({tuple(sorted(rng.sample(range(40 * k, 40 * k + 25), 2))) for k in range(3) for _ in range(50)})
    data = frame(spark, pairs, "src long, dst long")
    got = lambda df: {(r["src"], r["dst"]): round(r["betweenness"], 8) for r in df.collect()}
    sent = got(graph.edge_betweenness(data))
    joined = got(graph.edge_betweenness_by_joins(data))
    assert len(sent) == len(pairs) and sent == joined
    monkeypatch.setattr(graph, "MOST_SENT_EDGES", 60)
    monkeypatch.setattr(graph, "edge_betweenness_by_joins", None)
    assert got(graph.edge_betweenness(data)) == joined


def test_walks_of_betweenness_agree():
    """Levels by visits to neighbours, in one chunk or many, and by products with the adjacency matrix."""
    rng = random.Random(8)
    pairs = np.array(sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(70)}))
    walk, nodes = graph.path_flows(), 40
    flow = lambda k, *how: sum(walk(pairs[:, 0], pairs[:, 1], nodes, np.arange(i, min(i + k, nodes)), np.arange(min(k, nodes - i)), *how) for i in range(0, nodes, k))
    expected = flow(1, 1 << 20, 0)
    for k in (7, 40):
        for how in ((1 << 20, 0), (20, 0), (1 << 20, 5), (20, 30), (1 << 20, 10**9)):
            assert flow(k, *how) == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("way", [graph.edge_betweenness, graph.edge_betweenness_by_roots])
def test_betweenness_of_many_edges_takes_no_joins(spark, monkeypatch, way):
    """All pairs of 640 nodes, 204,480 edges in one component, beside many small components."""
    monkeypatch.setattr(graph, "edge_betweenness_by_joins", None)
    nodes = spark.range(640).select(F.col("id").alias("src"))
    full = nodes.join(nodes.select(F.col("src").alias("dst"))).where("src < dst")
    paths = spark.range(1000, 2000, 4).selectExpr("explode(array(struct(id AS src, id + 1 AS dst), struct(id + 1 AS src, id + 2 AS dst))) AS e").select("e.*")
    found = way(full.union(paths)).groupBy((F.col("src") >= 1000).alias("path"), F.round("betweenness", 9).alias("b")).count()
    assert sorted(tuple(r) for r in found.collect()) == [(False, 1.0, 204_480), (True, 2.0, 500)]


def test_shared_counts_expand_no_pair(spark, rows):
    rng = random.Random(5)
    pairs = sorted({(f"u{rng.randrange(30)}", rng.randrange(40)) for _ in range(400)}) * 2 + [(None, 1), ("u1", None), ("u2", None)]
    data = frame(spark, pairs, "u string, i int").repartition(7)
    have = {}
    for u, i in pairs:
        if u is not None and i is not None:
            have.setdefault(u, set()).add(i)
    expected = sorted((a, b, len(have[a] & have[b])) for a in have for b in have if a < b and have[a] & have[b])
    counted = graph.shared_counts(data, "u", "i")
    assert rows(counted, "src", "dst", "n") == expected
    assert "Join" not in counted._jdf.queryExecution().executedPlan().toString()


def test_modularity_components_and_labels(spark, rows):
    two = edges(spark, [("a", "b"), ("c", "d")])
    groups = graph.components(two)
    assert rows(groups) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")]
    assert graph.modularity(two, groups).first()["q"] == pytest.approx(0.375)
    triangles = frame(spark, [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6)], "src long, dst long")
    assert graph.label_propagation(triangles).select("label").distinct().count() == 2


def test_girvan_newman_splits_at_the_bridge(spark, rows):
    pairs = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6)]
    rounds, groups = graph.girvan_newman(frame(spark, pairs, "src long, dst long"))
    assert rows(groups) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4)]
    assert rounds.count() >= 2


def test_girvan_newman_takes_components_apart_in_few_jobs(spark, rows):
    """Copies of a graph whose edges go in many rounds, beside a square whose edges all tie: rounds, modularity and
    groups are those of the walk of the whole graph in each round, without jobs for each round."""
    rng = random.Random(11)
    one = sorted({tuple(sorted(rng.sample(range(9), 2))) for _ in range(16)})
    pairs = [(a + k, b + k) for k in (0, 100) for a, b in one] + [(200, 201), (201, 202), (202, 203), (200, 203)]
    data = frame(spark, pairs, "src long, dst long").cache()
    context = spark.sparkContext
    context.setJobGroup("apart", "")
    rounds, groups = graph.girvan_newman(data)
    got, found = rows(rounds), rows(groups)
    jobs = len(context.statusTracker().getJobIdsForGroup("apart"))
    context.setJobGroup("rounds", "")
    plain = graph.girvan_newman_by_rounds(data)
    assert found == rows(plain[1])
    assert [(a, round(b, 12), c) for a, b, c in got] == [(a, round(b, 12), c) for a, b, c in rows(plain[0])]
    assert len(got) > 6 and jobs < 60 < len(context.statusTracker().getJobIdsForGroup("rounds"))
    assert rows(graph.girvan_newman(data, 2)[1]) == rows(graph.girvan_newman_by_rounds(data, 2)[1])


def test_girvan_newman_of_strings_and_large_components(spark, rows, monkeypatch):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f")]
    data = frame(spark, pairs, "src string, dst string")
    expected = [(x, "a") for x in "abc"] + [(x, "d") for x in "def"]
    assert rows(graph.girvan_newman(data)[1]) == expected
    monkeypatch.setattr(graph, "MOST_HELD_NODES", 3)
    assert rows(graph.girvan_newman(data)[1]) == expected
    assert rows(graph.girvan_newman(frame(spark, [], "src long, dst long"))[1]) == []


def test_girvan_newman_holds_components_of_many_nodes(spark, monkeypatch):
    """Two binary trees of 1,300 nodes each, joined by their roots: one component, not taken apart by rounds."""
    monkeypatch.setattr(graph, "girvan_newman_by_rounds", None)
    pairs = [(k + i // 2, k + i) for k in (0, 2000) for i in range(2, 1301)] + [(1, 2001)]
    rounds, groups = graph.girvan_newman(frame(spark, pairs, "src long, dst long"))
    history = sorted(tuple(r) for r in rounds.collect())
    assert [r[2] for r in history[:2]] == [1, 2] and history[-1][1:] == (0.0, 2600)
    assert groups.count() == 2600 and groups.select("component").distinct().count() == next(r[2] for r in history if r[1] == max(q for _, q, _ in history))


def test_bloom(spark, rows):
    stream = frame(spark, [(0, 0, "x"), (0, 1, "y"), (1, 2, "x"), (1, 3, "z"), (2, 4, "x")], "ask long, seq long, id string")
    out = rows(sketches.bloom_false_positives(stream))
    assert out[0] == (0, 2, 0, 0.0) and out[1][1] == 1 and out[2] == (2, 0, 0, None)


def test_hash_of_bytes(spark):
    for text in ("", "a", "user-17", "Ünïcode"):
        for j, (a, b, p) in enumerate(hashing.STREAM_HASHES):
            x = int.from_bytes(text.encode(), "big")
            assert spark.range(1).select(hashing.stream_hash(F.lit(text), j).alias("h")).first()["h"] == (a * x + b) % p


def test_trailing_zeros(spark):
    got = [r["z"] for r in frame(spark, [(x,) for x in (0, 1, 2, 4, 8)], "x long").select(hashing.trailing_zeros(F.col("x")).alias("z")).collect()]
    assert got == [1, 0, 1, 2, 3]


def test_reservoir_replays(spark):
    stream = frame(spark, [(0, i, str(i)) for i in range(1000)], "ask long, seq long, id string")
    import hashlib

    slots = {}
    expected = []
    for n in range(1, 1001):
        digest = hashlib.md5(str(n).encode()).hexdigest()
        u, w = int(digest[:8], 16) / 2**32, int(digest[8:16], 16) / 2**32
        if n <= 100:
            slots[n - 1] = str(n - 1)
        elif u < 100 / n:
            slots[int(100 * w)] = str(n - 1)
        if n % 100 == 0:
            expected.append((n, *(slots[s] for s in (0, 20, 40, 60, 80))))
    assert [tuple(r) for r in sketches.reservoir(stream).orderBy("seqnum").collect()] == expected


def test_bfr_blobs(spark):
    rng = random.Random(5)
    data = [(i, [rng.gauss(c, 0.1), rng.gauss(-c, 0.1)]) for i, c in enumerate([0, 10] * 100)] + [(999, [500.0, 500.0])]
    rounds, labels = clustering.Bfr(2).run(frame(spark, data, "id long, features array<double>"))
    got = {r["id"]: r["label"] for r in labels.collect()}
    assert len(got) == 201 and got[999] == -1
    assert len({got[i] for i in range(0, 200, 2)} - {-1}) == 1
    assert all(r["n_ds"] + r["n_cs"] + r["n_rs"] > 0 for r in rounds.collect())
    assert rounds.orderBy(F.desc("round")).first()["n_ds"] + rounds.orderBy(F.desc("round")).first()["n_cs"] + rounds.orderBy(F.desc("round")).first()["n_rs"] == 201


def test_city_average_and_profiles(spark, rows):
    reviews = frame(spark, [("u", "b1", 4.0), ("u", "b1", 2.0), ("v", "b2", 5.0), ("v", "b3", 1.0)], "user_id string, business_id string, stars double")
    cities = frame(spark, [("b1", "X"), ("b2", "Y")], "business_id string, city string")
    assert rows(relational.city_average(reviews, cities)) == [("X", 3.0), ("Y", 5.0)]
    assert relational.city_average(reviews, cities, None, "left").count() == 3
    assert rows(relational.partition_profile(spark.range(5), 3, "id")) == [(0, 2), (1, 2), (2, 1)]
    assert sum(r["n_items"] for r in relational.physical_profile(spark.range(50), 4, "id").collect()) == 50


def test_sources_and_sinks(spark, tmp_path, rows):
    (tmp_path / "r.json").write_text('{"user_id": "u", "stars": 4.0}\nnot json\n')
    assert readers.ndjson(spark, str(tmp_path / "r.json"), "user_id string, stars double").count() == 2
    (tmp_path / "p.csv").write_text("user_id,business_id,stars\nu,b,3.0\n")
    assert rows(readers.ratings(spark, str(tmp_path / "p.csv"))) == [("u", "b", 3.0)]
    (tmp_path / "x.txt").write_text("1,0,0.5,1.5\n2,-1,2,3\n")
    assert rows(readers.points(spark, str(tmp_path / "x.txt"))) == [("1", [0.5, 1.5]), ("2", [2.0, 3.0])]
    (tmp_path / "t.csv").write_text('"d","c","x","y","z","p"\n"1/1","1","","","","9"\n')
    assert rows(readers.transactions(spark, str(tmp_path / "t.csv"))) == [("1/1", "1", "9")]
    lines = frame(spark, [(1, "b"), (0, "a")], "n int, line string")
    sinks.to_lines(lines, str(tmp_path / "out"), ["n"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a", "b"]
    report = sinks.betweenness_lines(frame(spark, [("a", "b", 1.5)], "src string, dst string, betweenness double"))
    assert report.first()["line"] == "('a', 'b'), 1.5"


def test_written_sinks(spark, tmp_path, rows):
    table = frame(spark, [("X", 1.5), ("Y", None)], "city string, stars double").coalesce(1)
    sinks.to_csv(table, str(tmp_path / "headed"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "headed")), "city", "stars") == [("X", "1.5"), ("Y", None)]
    sinks.to_csv(table, str(tmp_path / "bare"), header=False)
    assert spark.read.text(str(tmp_path / "bare")).first()["value"] == "X,1.5"
    sinks.to_json(table, str(tmp_path / "json"))
    assert rows(spark.read.schema(table.schema).json(str(tmp_path / "json"))) == [("X", 1.5), ("Y", None)]
    assert rows(sinks.csv_lines(table)) == [(0, "city,stars"), (1, "X,1.5"), (1, "Y,")]
    assert rows(sinks.json_lines(table)) == [('{"city":"X","stars":1.5}',), ('{"city":"Y"}',)]


def test_itemset_report(spark):
    long = frame(spark, [(b, x) for b in range(4) for x in ("p", "q")] + [(0, "r")], "basket int, item string")
    report = sinks.itemset_report(itemsets.all_candidates(long, 2), itemsets.frequent_sets(long, 2))
    both = ["('p'),('q')", "", "('p', 'q')", ""]
    # half of a support of two is one, so the rare item is a candidate in its chunk
    expected = ["Candidates:", "('p'),('q'),('r')", "", "('p', 'q'),('p', 'r'),('q', 'r')", "", "('p', 'q', 'r')", "", "Frequent Itemsets:", *both]
    assert [r["line"] for r in report.collect()] == expected
    none = sinks.itemset_report(itemsets.all_candidates(long, 99), itemsets.frequent_sets(long, 99))
    assert [r["line"] for r in none.collect()] == ["Candidates:", "Frequent Itemsets:"]


def test_orders_of_reports(spark):
    flows = frame(spark, [("b", "c", 2.0), ("a", "b", 2.000001), ("a", "c", 2.0), ("a", "d", 0.125005)], "src string, dst string, betweenness double")
    assert [r["line"] for r in sinks.betweenness_lines(flows).collect()] == ["('a', 'b'), 2.0", "('a', 'c'), 2.0", "('b', 'c'), 2.0", "('a', 'd'), 0.125"]
    groups = frame(spark, [(["z", "y"],), (["b"],), (["c", "a"],)], "members array<string>")
    assert [r["line"] for r in sinks.community_lines(groups).collect()] == ["'b'", "'a', 'c'", "'y', 'z'"]


def test_timed_profiles(spark):
    got = {r["layout"]: r for r in relational.timed_profiles(spark.range(0, 50, 1, 3), 4, "id").collect()}
    assert sum(got["default"]["n_items"]) == sum(got["customized"]["n_items"]) == 50
    assert got["default"]["n_partition"] == 3 and len(got["customized"]["n_items"]) == 4
    assert all(r["exe_time"] > 0 for r in got.values())


def test_dense_labels(spark, rows):
    labels = frame(spark, [("a", 7), ("b", 3), ("c", 7), ("d", None)], "id string, label int")
    assert rows(clustering.relabel(labels), "id", "label") == [("a", 1), ("b", 0), ("c", 1), ("d", None)]


def test_user_features(spark):
    from siltworks.sources import schemas

    users = spark.createDataFrame([], schemas.USERS)
    assert len(recommend.user_features(users).columns) == 20
    (row,) = recommend.user_features(spark.sql("SELECT 'u' AS user_id, 'ab, c' AS friends, CAST(NULL AS STRING) AS elite").unionByName(users, True)).collect()
    assert (row["u_friends"], row["u_elite"], row["u_fans"]) == (5, None, None)
    assert recommend.business_features(spark.createDataFrame([], schemas.BUSINESSES)).columns == ["business_id", "b_stars", "b_review_count"]


def test_bitmaps_lose_no_pair(spark, rows):
    """Sets of any size, some far more than a bitmap has bits: pairs that reach the threshold are kept."""
    rng = random.Random(9)
    sets = {}
    for group in range(6):
        core = rng.sample(range(100_000), [1, 3, 40, 300, 1500, 3000][group])
        for i in range(4):
            sets[group * 10 + i] = set(core[: len(core) - len(core) * i // 5]) | set(rng.sample(range(100_000), len(core) // 6 * i))
    pairs = frame(spark, [(k, m) for k, x in sets.items() for m in x], "item int, member long")
    every = pairs.select("item").distinct()
    met = every.toDF("a").join(every.toDF("b"), F.expr("a < b"))
    expected = sorted((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]))
    kept = rows(similarity.possible(pairs, met, 0.5), "a", "b")
    assert set(expected) <= set(kept) and len(kept) < met.count()
    assert rows(similarity.similar_pairs_exact(pairs), "a", "b") == expected


def test_groups_lose_and_repeat_no_pair(spark, rows):
    """Pairs met by groups inside tasks are those of the joins, each once, with members that repeat and wide ones."""
    rng = random.Random(11)
    sets = {i: {rng.randrange(60) for _ in range(rng.randint(1, 12))} | ({1 << 40} if i % 9 == 0 else set()) for i in range(90)}
    sets |= {i: sets[i - 60] for i in range(100, 130)}
    pairs = frame(spark, [(k, m) for k, x in sets.items() for m in x] * 2 + [(None, 1)], "item long, member long").repartition(5)
    small = pairs.where("member < 100 AND item IS NOT NULL")
    assert rows(similarity.bucket_pairs(small)) == rows(similarity.candidate_pairs(similarity.bands(similarity.signatures(small))))
    expected = sorted((a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]))
    assert rows(similarity.similar_pairs_exact(pairs)) == expected
    for found in (similarity.bucket_pairs(small), similarity.similar_pairs_exact(pairs)):
        assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
