"""Streams give what the stored rows give."""

import os
import random

from siltworks.operators import sketches
from siltworks.sources import readers
from siltworks.streaming import sketches as streams


def test_stream_matches_batch(spark, tmp_path):
    rng = random.Random(1)
    (tmp_path / "in").mkdir()
    rows = []
    for ask in range(4):
        ids = [str(rng.randrange(40)) for _ in range(20)]
        (tmp_path / "in" / f"{ask}.csv").write_text("\n".join(ids) + "\n")
        os.utime(tmp_path / "in" / f"{ask}.csv", (1_000_000 + ask * 10, 1_000_000 + ask * 10))
        rows += [(ask, ask * 20 + i, x) for i, x in enumerate(ids)]
    stored = spark.createDataFrame(rows, "ask long, seq long, id string")
    source = readers.stream_asks(spark, f"file://{tmp_path}/in")
    streams.stream_distinct(source, f"file://{tmp_path}/fm", f"file://{tmp_path}/c1").awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/fm").select("ask", "truth", "estimate").collect())
    assert got == sorted(tuple(r) for r in sketches.distinct_estimate(stored).collect())
    streams.stream_bloom(spark, source, f"file://{tmp_path}/state", f"file://{tmp_path}/fpr", f"file://{tmp_path}/c2").awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/fpr").select("ask", "n_new", "n_false").collect())
    assert got == sorted(tuple(r) for r in sketches.bloom_false_positives(stored).select("ask", "n_new", "n_false").collect())


def test_reservoir_carries_its_state(spark, tmp_path):
    """Asks of sizes that are no multiples of the step give what one stored table gives."""
    rng = random.Random(2)
    (tmp_path / "in").mkdir()
    rows = []
    for ask, size in enumerate((130, 1, 260, 309)):
        ids = [str(rng.randrange(10_000)) for _ in range(size)]
        file = tmp_path / "in" / f"{ask}.csv"
        file.write_text("\n".join(ids) + "\n")
        os.utime(file, (1_000_000 + ask * 10, 1_000_000 + ask * 10))
        rows += [(ask, len(rows) + i, x) for i, x in enumerate(ids)]
    source, base = readers.stream_asks(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}"
    streams.stream_reservoir(spark, source, f"{base}/state", f"{base}/out", f"{base}/c").awaitTermination(120)
    expected = sorted(tuple(r) for r in sketches.reservoir(spark.createDataFrame(rows, "ask long, seq long, id string")).collect())
    assert sorted(tuple(r) for r in spark.read.parquet(f"{base}/out").drop("batch").collect()) == expected and len(expected) == 7
    streams.collected(spark, f"{base}/out", f"{base}/csv", "seqnum")
    read = spark.read.option("header", True).csv(f"{base}/csv")
    assert read.columns == ["seqnum", "0_id", "20_id", "40_id", "60_id", "80_id"]
    assert [int(r["seqnum"]) for r in read.collect()] == [100, 200, 300, 400, 500, 600, 700]


def test_numbers_of_many_partitions(spark):
    rows = streams._numbered(spark.range(0, 25, 1, 7).selectExpr("id AS user_id"), 10)
    assert sorted((r["seq"], r["id"]) for r in rows.collect()) == [(10 + i, str(i)) for i in range(25)]
