"""MinHash near-duplicates by a signature-coordinate inverted join.

Documents with one shingle set are one class. Each class is posted under (coordinate, value) pairs of its signature:
of all coordinates, ordered by how often their values occur, only the first coordinates - threshold + 1 (the prefix)
are merged; two signatures that agree in `threshold` places must meet there. The frequent rest is skipped: a posting
carries three bits of every coordinate, so that a meeting counts the places that can agree without looking at lists.

A large group of near copies is never turned into its pairs. Classes that share a band of coordinates with many others
are compared with one of these, their hub, on full sets; a class near a hub belongs to its group, and what differs from
the hub is kept. Two classes of a group differ by the symmetric difference of their own differences from the hub. If one
of them is not linked with the hub, a link needs more than half of the other's differences to be shared, so both meet
under the rarest of these (a prefix again); two classes that are linked with the hub need no comparison. All other
pairs that meet in a list are confirmed on their full sets. No link is lost to a group's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stage, components, lean, ship, slices, table
from .shingles import minhash_factors, mix, shingle_sets, signature

BUCKETS = 1 << 20
MOST_BROADCAST = 1_000_000
PLANES = 3


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in batch.column(column).to_pylist()]


def class_key(shingles: np.ndarray) -> int:
    """64 bits that stand for a set (signed)."""
    return int.from_bytes(xxhash.xxh3_128_digest(shingles.astype("<u8"))[:8], "little", signed=True)


def signatures(docs: DataFrame, width: int, coordinates: int, seed: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, the set's key and its signature (null: no shingles)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = minhash_factors(coordinates, seed)
        for batch in slices(batches, 128):
            sets = shingle_sets(_texts(batch, 2), width)
            keys = [class_key(s) if len(s) else None for s in sets]
            signed = [signature(s, factors).astype("<u4").tobytes() if len(s) else None for s in sets]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array(signed, pa.binary())], ["doc_id", "text_hash", "n_shingles", "node", "sig"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return chosen.mapInArrow(lean(work), "doc_id long, text_hash long, n_shingles long, node long, sig binary")


def _raw(sig: pa.Array, coordinates: int) -> np.ndarray:
    return np.frombuffer(b"".join(sig.to_pylist()), "<u4").reshape(-1, coordinates)


def _values(raw: np.ndarray) -> np.ndarray:
    """(rows, coordinates) keys of coordinate-value pairs."""
    return mix(raw.astype(np.uint64) | (np.arange(raw.shape[1], dtype=np.uint64) << np.uint64(32)))


def postings(classes: DataFrame, coordinates: int, prefix: int) -> DataFrame:
    """Rows (value, node, size, p0, p1, p2): each class under the `prefix` rarest of its coordinate values, with the
    lowest three bits of all its coordinates as bit planes.

    How often a value occurs is counted over all classes in 2^20 hashed counters; any order that is the same for
    all classes gives the same pairs, so counters that several values share only cost time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, 4_096):
            total += np.bincount((_values(_raw(batch.column(0), coordinates)).ravel() >> np.uint64(44)).astype(np.int64), minlength=BUCKETS)
        seen = np.flatnonzero(total)
        for i in range(0, len(seen), 1 << 17):
            part = seen[i : i + (1 << 17)]
            yield pa.record_batch([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], ["bucket", "n"])

    counted = classes.select("sig").mapInArrow(lean(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    mean = counted.agg(F.avg("n")).first()[0] or 0
    heavy = counted.where(F.col("n") > 4 * mean + 16).toPandas()  # of 2^20 counters
    often = np.zeros(BUCKETS, np.int64)
    often[heavy["bucket"].to_numpy(np.int64)] = heavy["n"].to_numpy(np.int64)
    places, weights = np.flatnonzero(often).astype(np.int32), often[often > 0]
    names = ["value", "node", "size", *(f"p{i}" for i in range(PLANES))]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = np.zeros(BUCKETS, np.int64)
        table_[places] = weights
        place = np.uint64(1) << np.arange(coordinates, dtype=np.uint64)
        for batch in slices(batches, 1_024):
            raw = _raw(batch.column(1), coordinates)
            values = _values(raw)
            order = np.lexsort((values, table_[(values >> np.uint64(44)).astype(np.int64)]), axis=1)[:, :prefix]
            own = np.take_along_axis(values, order, 1)
            planes = [(((raw >> np.uint32(b)) & np.uint32(1)).astype(np.uint64) * place).sum(axis=1, dtype=np.uint64).view(np.int64) for b in range(PLANES)]
            columns = [np.repeat(x, prefix) for x in (batch.column(0).to_numpy(), batch.column(2).to_numpy(), *planes)]
            yield pa.record_batch([pa.array(own.ravel().view(np.int64)), *(pa.array(c, pa.int64()) for c in columns)], names)

    return classes.select("node", "sig", "n_shingles").mapInArrow(lean(post), ", ".join(f"{c} long" for c in names))


def bands(classes: DataFrame, coordinates: int, width: int) -> DataFrame:
    """Rows (value, node): each class under every band of `width` neighbouring coordinates."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_024):
            own = _values(_raw(batch.column(1), coordinates)).reshape(batch.num_rows, coordinates // width, width)
            keys = mix((own * (np.arange(width, dtype=np.uint64) * np.uint64(2) + np.uint64(1))).sum(axis=2, dtype=np.uint64))
            yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]), pa.int64())], ["value", "node"])

    return classes.select("node", "sig").mapInArrow(lean(work), "value long, node long")


def full_sets(stage: Stage, docs: DataFrame, classes: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the full sets of some classes, made again from the texts of their first documents."""
    wanted = stage.write(classes.join(nodes, "node", "left_semi").select("rep").distinct(), "wanted")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            sets = [s for s in shingle_sets(_texts(batch, 0), width) if len(s)]
            own = [np.sort(s.view(np.int64)) for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *own])))
            yield pa.record_batch([pa.array([class_key(s) for s in sets], pa.int64()), lists], ["node", "shingles"])

    # the list of ids is sent to all only while it is known to be short
    side = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted
    chosen = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(side, "rep", "left_semi").select("text")
    # one id may have several texts: only the classes asked for stay, each once
    made = chosen.mapInArrow(lean(work), "node long, shingles array<long>").join(nodes, "node", "left_semi").dropDuplicates(["node"])
    made = stage.write(made, "sets", "lz4")
    stage.drop(wanted)
    return made


def _linked(difference: Column, sizes: Column, percent: int) -> Column:
    """J >= percent / 100, of sets that differ in so many members and have so many members together."""
    return difference * (100 + percent) <= sizes * (100 - percent)


def _differing(first: str, second: str) -> Column:
    """How many coordinates differ for sure, by the bit planes of two classes (of the expected 7/8 of those that do)."""
    differ = F.lit(0).cast("long")
    for i in range(PLANES):
        differ = differ.bitwiseOR(F.col(f"p{i}{first}").bitwiseXOR(F.col(f"p{i}{second}")))
    return F.bit_count(differ)


def _deltas(star: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(hub, node, heat, n, m, d, delta): sizes, how many members differ from the hub, and these (sorted), for classes
    that are within three radii of the hub."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            own = [[np.frombuffer(x.values.buffers()[1], np.int64, len(x.values), x.values.offset * 8) for x in batch.column(i)] for i in (3, 4)]
            rows = []
            for at, (x, h) in enumerate(zip(*own, strict=True)):
                d = np.setxor1d(x, h, assume_unique=True)
                both = len(x) + len(h)
                if 200 * len(d) <= 3 * (100 - percent) * (both + len(d)):  # Jaccard distance: 2 d / (both + d)
                    rows.append((at, len(x), len(h), len(d), d))
            if not rows:
                continue
            at, n, m, d, delta = zip(*rows, strict=True)
            kept = batch.take(pa.array(at, pa.int64()))
            columns = [pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(d, pa.int64()), pa.array(delta, pa.list_(pa.int64()))]
            yield pa.record_batch([*kept.columns[:3], *columns], ["hub", "node", "heat", "n", "m", "d", "delta"])

    mine = sets.select("node", F.col("shingles").alias("x"))
    hubs = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("h"))
    joined = star.join(mine, "node").join(hubs, "hub").select("hub", "node", "heat", "x", "h")
    return joined.mapInArrow(lean(work), "hub long, node long, heat long, n long, m long, d long, delta array<long>")


def _by_differences(stage: Stage, deltas: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of classes near a hub, at least one of them not linked with it, by their differences from it."""
    near = deltas.where("d > 0").withColumn("open", ~_linked(F.col("d"), F.col("n") + F.col("m"), percent))
    # only hubs with an unlinked class need any comparison
    hubs = near.where("open").select("hub").distinct()
    near = near.join(hubs, "hub", "left_semi")
    places = stage.write(near.select("hub", "node", "n", "m", "d", "open", F.explode("delta").alias("member")), "differences")
    counted = places.groupBy("hub", "member").agg(F.count("*").alias("often"))
    inside = Window.partitionBy("hub", "node").orderBy("often", "member")
    # a link with an open class needs more than (d + q (m - n)) / 2 shared differences, q = (100 - p) / (100 + p)
    half = (F.col("d") * (100 + percent) + (F.col("m") - F.col("n")) * (100 - percent)) / (2 * (100 + percent))
    # members that only one class has come first in the order, and are met by none
    ranked = places.join(counted, ["hub", "member"]).withColumn("rank", F.row_number().over(inside)).where("often > 1")
    homes = ranked.where(F.col("rank") <= F.col("d") - F.floor(half))
    left = ranked.where("open").select("hub", "member", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("d").alias("dx"), F.col("rank").alias("rx"))
    right = homes.select("hub", "member", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("d").alias("dy"), F.col("rank").alias("ry"))
    sizes = F.col("nx") + F.col("ny")
    fits = _linked(F.abs(F.col("dx") - F.col("dy")), sizes, percent)
    # where a pair first meets, no more than what follows in both orders can be shared
    most = F.least(F.col("dx") - F.col("rx"), F.col("dy") - F.col("ry")) + 1
    enough = _linked(F.col("dx") + F.col("dy") - 2 * most, sizes, percent)
    met = left.join(right, ["hub", "member"]).where((F.col("x") != F.col("y")) & fits & enough).select("hub", "x", "y", "nx", "ny", "dx", "dy").distinct()
    own = near.select("hub", "node", "delta")
    both = met.join(own.select("hub", F.col("node").alias("x"), F.col("delta").alias("ex")), ["hub", "x"]).join(own.select("hub", F.col("node").alias("y"), F.col("delta").alias("ey")), ["hub", "y"])
    differ = F.col("dx") + F.col("dy") - 2 * F.size(F.array_intersect("ex", "ey"))
    found = both.where(_linked(differ, F.col("nx") + F.col("ny"), percent)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    found = stage.write(found.distinct(), "found")
    stage.drop(places)
    return found


def _confirmed(stage: Stage, docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    sets = full_sets(stage, docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), width)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = (np.frombuffer(v.values.buffers()[1], np.int64, len(v.values), v.values.offset * 8) for v in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
    linked = stage.write(pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(lean(work), "a long, b long"), "links")
    stage.drop(sets)
    return linked


def hub_groups(spark: SparkSession, stage: Stage, docs: DataFrame, classes: DataFrame, planes: DataFrame, width: int, percent: int, coordinates: int, band: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """(node, hub) of the classes in groups, and all links found with hubs and inside groups.

    planes: node, size, p0, p1, p2. Lists of bands of more than `most` classes choose as their hub the class in the
    largest lists, the middle of its group; a class near several hubs belongs to the one in the largest lists.
    """
    chosen = classes.join(planes.select("node"), "node", "left_semi")
    banded = stage.write(bands(chosen, coordinates, band), "bands")
    long = stage.write(banded.join(banded.groupBy("value").agg(F.count("*").alias("length")).where(F.col("length") > most), "value"), "long")
    stage.drop(banded)
    heat = long.groupBy("node").agg(F.sum("length").alias("heat"))
    hubs = long.join(heat, "node").groupBy("value").agg(F.max(F.struct("heat", "node")).alias("hub")).select("value", F.col("hub.node").alias("hub"), F.col("hub.heat").alias("heat"))
    star = long.join(hubs, "value").where("node <> hub").groupBy("hub", "node").agg(F.max("heat").alias("heat"))
    near = star.join(planes, "node").join(planes.select(*(F.col(c).alias(f"{c}_h") for c in planes.columns)).withColumnRenamed("node_h", "hub"), "hub")
    # a class beyond three radii by far is no member; this is no decision about links, only about who is in the group
    star = stage.write(near.where(_differing("", "_h") <= coordinates * 5 // 8).select("hub", "node", "heat"), "star")
    stage.drop(long)
    sets = full_sets(stage, docs, classes, star.select(F.explode(F.array("hub", "node")).alias("node")).distinct(), width)
    deltas = stage.write(_deltas(star, sets, percent), "deltas", "lz4")
    stage.drop(sets)
    starred = deltas.where(_linked(F.col("d"), F.col("n") + F.col("m"), percent)).select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    own = star.select("hub", F.col("hub").alias("node"), "heat")
    home = deltas.select("hub", "node", "heat").union(own).groupBy("node").agg(F.max(F.struct("heat", "hub"))["hub"].alias("hub"))
    home = stage.write(home, "home")
    links = [stage.write(starred.distinct(), "starred"), _by_differences(stage, deltas.join(home, ["node", "hub"], "left_semi"), percent)]
    stage.drop(star, deltas)
    return home, links


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    coordinates: int = 64,
    threshold: int = 34,
    band: int = 4,
    most: int = 16,
    seed: int = 1,
) -> DataFrame:
    """Groups of near-duplicates: doc_id, text_hash, n_shingles, component_id and kept, a row for each row of docs.

    docs: doc_id, text. Linked are rows with 100 * intersection >= percent * union of their sets of `width`-word
    shingles (ASCII letters lower-cased; a text of fewer words is one shingle). Null, empty and blank texts have no
    shingles and are linked with nothing. Rows of one doc_id with different texts are linked one by one, each by its own
    text; a row is kept if its doc_id is the least of its component. Rows without a doc_id are kept as they are, without
    a component, and link nothing. text_hash (xxhash64 of the text) tells rows of one doc_id apart. An empty table gives
    no rows. A pair just at 80 percent agrees in fewer than 34 of 64 coordinates with a probability below 1e-6, which is
    the only way to miss a link. band and most: classes that share `band` neighbouring coordinates with more than `most`
    others are grouped by hubs; this changes the cost only.
    """
    ship(spark)
    stage = Stage(spark, "minhash")
    rows = stage.write(signatures(docs, width, coordinates, seed), "rows")
    classes = rows.where("doc_id IS NOT NULL AND node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = stage.write(classes, "classes")
    # n shingles and n + 1 are the nearest that two different sets can be: smaller ones have no links but copies
    least = percent // (100 - percent) if percent < 100 else 1 << 62
    posted = stage.write(postings(classes.where(F.col("n_shingles") >= least), coordinates, coordinates - threshold + 1), "postings")
    planes = ["node", "size", *(f"p{i}" for i in range(PLANES))]
    members = stage.write(posted.join(posted.groupBy("value").agg(F.count("*").alias("length")).where("length > 1").select("value"), "value"), "members")
    stage.drop(posted)
    # a link's classes meet in a list, so others need no group
    home, links = hub_groups(spark, stage, docs, classes, stage.write(members.select(*planes).distinct(), "planes"), width, percent, coordinates, band, most)

    # pairs that no group has settled, whose sizes allow the similarity and whose coordinates can agree often enough
    grouped = members.join(home, "node", "left").withColumn("hub", F.coalesce("hub", "node"))
    left, right = (grouped.select("value", *(F.col(c).alias(f"{c}_{side}") for c in [*planes, "hub"])) for side in "ab")
    fits = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent
    met = left.join(right, "value").where((F.col("node_a") < F.col("node_b")) & (F.col("hub_a") != F.col("hub_b")) & fits & (_differing("_a", "_b") <= coordinates - threshold))
    pairs = stage.write(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "pairs")
    links.append(_confirmed(stage, docs, classes, pairs, width, percent))
    stage.drop(members, pairs)
    edges = links[0]
    for part in links[1:]:
        edges = edges.unionByName(part)
    groups = stage.write(components(spark, stage, edges), "components")
    stage.drop(*links)
    grouped = classes.select("node", "rep").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_of = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    class_of = grouped.join(least_of, "component").select("node", "component_id")
    known = rows.where("node IS NOT NULL AND doc_id IS NOT NULL").join(class_of, "node")
    alone = rows.where("node IS NULL OR doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "text_hash", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")]
    return known.select(*columns).unionByName(alone.select(*columns))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents at two-word shingles; the edge cases are those of near_duplicates."""
    return near_duplicates(spark, table(spark, sf_dir, "documents"), width=2).drop("text_hash")
