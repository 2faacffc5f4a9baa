"""Similar item pairs: MinHash signatures with banding, and an exact join by sizes and bitmaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import affine
from .iteration import cut

BANDS, ROWS, BUCKETS = 27, 2, 1_000_000
WORDS = 16  # of 64 bits in a bitmap
FOLDS = 4  # a wide bitmap is so many times as wide, and gives the other one when it is folded


def signatures(pairs: DataFrame, hashes: int = BANDS * ROWS) -> DataFrame:
    """(item, sig array<long>): per hash the least value over an item's members. pairs: item, member long >= 0."""
    mins = [F.min(affine(F.col("member"), j)).alias(f"h{j}") for j in range(hashes)]
    return pairs.groupBy("item").agg(*mins).select("item", F.array(*[f"h{j}" for j in range(hashes)]).alias("sig"))


def bands(signed: DataFrame, count: int = BANDS) -> DataFrame:
    """(band, bucket, item): a band of two rows goes to the bucket (sum + product) modulo BUCKETS."""
    buckets = F.array(*[(F.element_at("sig", 2 * i + 1) + F.element_at("sig", 2 * i + 2) + F.element_at("sig", 2 * i + 1) * F.element_at("sig", 2 * i + 2)) % BUCKETS for i in range(count)])
    return signed.select("item", F.posexplode(buckets).alias("band", "bucket"))


def candidate_pairs(banded: DataFrame) -> DataFrame:
    """Distinct pairs a < b that share a bucket."""
    left = banded.select("band", "bucket", F.col("item").alias("a"))
    right = banded.select("band", "bucket", F.col("item").alias("b"))
    return left.join(right, ["band", "bucket"]).where("a < b").select("a", "b").distinct()


def confirmed(pairs: DataFrame, candidates: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of candidates with a Jaccard similarity of at least `least`, from the full sets."""
    pairs = pairs.select("item", "member").distinct()
    sizes = pairs.groupBy("item").agg(F.count("*").alias("n"))
    common = (
        candidates.join(pairs.withColumnRenamed("item", "a"), "a")
        .join(pairs.withColumnRenamed("item", "b"), ["b", "member"])
        .groupBy("a", "b")
        .agg(F.count("*").alias("k"))
    )
    rated = common.join(sizes.withColumnsRenamed({"item": "a", "n": "n_a"}), "a").join(sizes.withColumnsRenamed({"item": "b", "n": "n_b"}), "b")
    return rated.withColumn("similarity", F.col("k") / (F.col("n_a") + F.col("n_b") - F.col("k"))).where(F.col("similarity") >= least).select("a", "b", "similarity")


def possible(pairs: DataFrame, candidates: DataFrame, least: float) -> DataFrame:
    """The candidates that may reach `least` by their sizes and bitmaps; no pair that does is lost. Each member sets one
    of 64 * WORDS bits of its item, so a bit of a that b lacks is a member of a at least that b lacks."""
    bit = F.pmod(F.xxhash64("member"), F.lit(64 * WORDS))
    placed = pairs.select("item", "member").distinct().select("item", F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, CAST(pmod(xxhash64(member), 64) AS INT))").alias("mask"))
    maps = [F.bit_or(F.when(F.col("word") == i, F.col("mask")).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(WORDS)]
    drawn = placed.groupBy("item").agg(F.count("*").alias("n"), *maps).select("item", "n", F.array(*[f"w{i}" for i in range(WORDS)]).alias("bits"))
    met = candidates.select("a", "b").join(drawn.toDF("a", "n_a", "bits_a"), "a").join(drawn.toDF("b", "n_b", "bits_b"), "b")
    own = lambda x, y: sum((F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(WORDS)), F.lit(0))
    most = F.least(F.col("n_a") - own("bits_a", "bits_b"), F.col("n_b") - own("bits_b", "bits_a"))
    return met.where(most >= (F.col("n_a") + F.col("n_b") - most) * least - F.lit(1e-9)).select("a", "b")


def drawn_sets(pairs: DataFrame, banded: bool = True) -> DataFrame:
    """(item, n, members, buckets, bits) of each item, checkpointed: its distinct members in order, as 4 or 8 bytes
    each, the bucket of each band (none unless banded) and a wide bitmap. Members of an item that follow
    one another travel as one row. Members are 0 at least."""
    kind = pairs.schema["item"].dataType.simpleString()
    hashes = [(1103515245 + 40692 * j, 12345 + 16807 * j) for j in range(BANDS * ROWS if banded else 0)]
    width, buckets = 64 * WORDS * FOLDS, BUCKETS

    def packed(x: np.ndarray) -> bytes:
        return x.astype("<u4" if x.max() < 1 << 32 else "<i8").tobytes()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, member = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.append(True, item[1:] != item[:-1])[: len(item)])
            parts = [np.unique(x) for x in np.split(member, starts[1:])] if len(item) else []
            # a part of 8 bytes each is told by its first byte
            raw = [bytes([int(x[-1] >= 1 << 32)]) + packed(x) for x in parts]
            yield pa.record_batch([batch.column(0).take(pa.array(starts, pa.int64())), pa.array(raw, pa.binary())], ["item", "part"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                own = batch.slice(i, 1024)
                out: list[tuple] = []
                for parts in own.column(1).to_pylist():
                    x = np.unique(np.concatenate([np.frombuffer(p, "<i8" if p[0] else "<u4", offset=1).astype(np.int64) for p in parts]))
                    h = [int(((a * x + b) % 2147483647).min()) for a, b in hashes]
                    met = np.array([(h[j] + h[j + 1] + h[j] * h[j + 1]) % buckets for j in range(0, len(h), 2)], "<i4")
                    with np.errstate(over="ignore"):
                        mixed = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    bits = np.zeros(width, bool)
                    bits[(mixed >> np.uint64(40)) % np.uint64(width)] = True
                    out.append((len(x), packed(x), met.tobytes(), np.packbits(bits).tobytes()))
                n, members, met, bits = zip(*out, strict=True)
                yield pa.record_batch([own.column(0), pa.array(n, pa.int32()), pa.array(members, pa.binary()), pa.array(met, pa.binary()), pa.array(bits, pa.binary())], ["item", "n", "members", "buckets", "bits"])

    rows = pairs.select("item", F.col("member").cast("long").alias("member")).where("item IS NOT NULL AND member IS NOT NULL")
    sets = rows.mapInArrow(runs, f"item {kind}, part binary").groupBy("item").agg(F.collect_list("part").alias("parts"))
    return cut(sets.mapInArrow(draw, f"item {kind}, n int, members binary, buckets binary, bits binary"))


def met_pairs(sets: DataFrame, least: float | None, banded: bool = True, least_groups: int = 8, group_rows: int = 200_000) -> DataFrame:
    """(a, b), a < b, each pair once: items that share a bucket (all items unless banded) and, by their sizes and
    bitmaps, may reach `least` (None: any). Items are dealt to groups by hash and sent to half of the other groups, so
    pairs are met and ruled out inside tasks and none that is ruled out is ever a row. The bitmaps lose no pair: a bit
    of one that the other lacks is a member that it lacks. What the folded ones leave, the wide ones go through again."""
    kind = sets.schema["item"].dataType.simpleString()
    groups = max(least_groups, -(-sets.count() // group_rows))
    folds = FOLDS
    parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * groups)
    ahead = F.pmod(F.col("own") - F.col("home"), F.lit(groups))
    hosted = (F.col("own") == F.col("home")) | (2 * ahead < groups) | (2 * ahead == groups) & (F.col("own") > F.col("home"))
    sent = sets.select("item", "n", "buckets", "bits", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int").alias("own"))
    sent = sent.withColumn("home", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).where(hosted)
    dealt = sent.select("home", (F.col("own") != F.col("home")).cast("int").alias("role"), "item", "n", "buckets", "bits")

    class Homes:
        def __init__(self, item, n, buckets, bits):
            order = np.argsort(n, kind="stable")
            self.item, self.n, self.buckets, self.wide = item[order], n[order], buckets[order], bits[order]
            self.bits, self.ones = self.folded(self.wide)
            self.wide_ones = np.bitwise_count(self.wide).sum(axis=1, dtype=np.int64)
            self.columns = np.ascontiguousarray(self.bits.T)
            self.orders = [np.argsort(self.buckets[:, j], kind="stable") for j in range(buckets.shape[1])]
            self.sorted = [self.buckets[o, j] for j, o in enumerate(self.orders)]

        def folded(self, wide):
            bits = np.bitwise_or.reduce(wide.reshape(len(wide), folds, -1), axis=1)
            return bits, np.bitwise_count(bits).sum(axis=1, dtype=np.int64)

        def may(self, n_a, ones_a, n_b, ones_b, shared):
            most = np.minimum(n_a - (ones_a - shared), n_b - (ones_b - shared))
            return most >= (n_a + n_b - most) * least - 1e-9

        def of_buckets(self, n, buckets, bits, ones):
            seen = np.zeros((len(n), len(self.n)), bool)
            for j, (order, have) in enumerate(zip(self.orders, self.sorted, strict=True)):
                low, high = np.searchsorted(have, buckets[:, j], "left"), np.searchsorted(have, buckets[:, j], "right")
                size = high - low
                row = np.repeat(np.arange(len(n)), size)
                seen[row, order[np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + low[row]]] = True
            at = np.flatnonzero(seen)
            for i in range(0, len(at), 1 << 16):
                row, home = np.divmod(at[i : i + (1 << 16)], len(self.n))
                if least is not None:
                    near = np.minimum(n[row], self.n[home]) >= np.maximum(n[row], self.n[home]) * least - 1e-9
                    row, home = row[near], home[near]
                    shared = np.bitwise_count(bits[row] & self.bits[home]).sum(axis=1, dtype=np.int64)
                    near = self.may(n[row], ones[row], self.n[home], self.ones[home], shared)
                    row, home = row[near], home[near]
                yield row, home

        def of_all(self, n, bits, ones):
            low = np.searchsorted(self.n, int(n.min() * least) - 1, "left")
            high = np.searchsorted(self.n, n.max() / least + 1, "right") if least else len(self.n)
            for i in range(low, high, 2048):
                e = min(high, i + 2048)
                shared = np.zeros((len(n), e - i), np.uint16)
                for w in range(bits.shape[1]):
                    shared += np.bitwise_count(bits[:, w, None] & self.columns[w, None, i:e])
                row, home = np.nonzero(self.may(n[:, None], ones[:, None], self.n[None, i:e], self.ones[None, i:e], shared.astype(np.int64)))
                yield row, home + i

        def meet(self, item, n, buckets, bits, first=None):
            wide, wide_ones = bits, np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
            bits, ones = self.folded(wide)
            order = np.argsort(n, kind="stable") if first is None else np.arange(len(n))
            for i in range(0, len(n), 64):
                own = order[i : i + 64]
                found = self.of_buckets(n[own], buckets[own], bits[own], ones[own]) if banded else self.of_all(n[own], bits[own], ones[own])
                for row, home in found:
                    if first is not None:
                        later = home > row + i
                        row, home = row[later], home[later]
                    if least is not None and len(row):
                        at = own[row]
                        shared = np.bitwise_count(wide[at] & self.wide[home]).sum(axis=1, dtype=np.int64)
                        near = self.may(n[at], wide_ones[at], self.n[home], self.wide_ones[home], shared)
                        row, home = row[near], home[near]
                    a, b = item[own][row], self.item[home]
                    if len(a):
                        yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order: the homes of a group first, then the items that stream past them."""
        key, held, homes = None, [], None

        def begun():
            nonlocal held, homes
            if homes is None and held:
                homes, held = Homes(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                yield from homes.meet(homes.item, homes.n, homes.buckets, homes.wide, 0)

        for batch in batches:
            home, role = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(home) != 0) | (np.diff(role) != 0)) + 1
            for b, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(home)], strict=True):
                if b == e:
                    continue
                if home[b] != key:
                    yield from begun()
                    key, held, homes = home[b], [], None
                part = batch.slice(b, e - b)
                buckets, bits = (np.frombuffer(b"".join(part.column(c).to_pylist()), kind_of).reshape(e - b, -1) if len(part.column(c)[0].as_py()) else np.zeros((e - b, 0), kind_of) for c, kind_of in ((4, "<i4"), (5, "<u8")))
                own = (part.column(2).to_numpy(), part.column(3).to_numpy().astype(np.int64), buckets, bits)
                if role[b] == 0:
                    held.append(own)
                else:
                    yield from begun()
                    if homes is not None:
                        yield from homes.meet(*own)
        yield from begun()

    return dealt.repartition(parts, "home").sortWithinPartitions("home", "role").mapInArrow(join, f"a {kind}, b {kind}")


def decided(sets: DataFrame, met: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of met pairs with a Jaccard similarity of at least `least`, from the full sets."""
    kind = sets.schema["item"].dataType.simpleString()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, common = batch.column(2).to_numpy().astype(np.int64), batch.column(4).to_numpy().astype(np.int64), np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column(3), batch.column(5), strict=True)):
                x, y = (np.frombuffer(v.as_py(), f"<{'u4' if len(v.as_py()) == 4 * n else 'i8'}").astype(np.int64) for v, n in ((x, n_a[i]), (y, n_b[i])))
                common[i] = len(np.intersect1d(x, y, assume_unique=True))
            similarity = common / (n_a + n_b - common)
            near = np.flatnonzero(similarity >= least)
            yield pa.record_batch([batch.column(0).take(pa.array(near)), batch.column(1).take(pa.array(near)), pa.array(similarity[near])], ["a", "b", "similarity"])

    sides = [sets.select(F.col("item").alias(x), F.col("n").alias(f"n_{x}"), F.col("members").alias(f"m_{x}")) for x in "ab"]
    full = met.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "m_a", "n_b", "m_b")
    return full.mapInArrow(decide, f"a {kind}, b {kind}, similarity double")


def bucket_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b), a < b, of all items that share a bucket, each pair once."""
    return met_pairs(drawn_sets(pairs), None)


def similar_pairs(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs that share a bucket and reach `least`. Bands of two rows let many pairs through, most of which their sizes
    and bitmaps rule out before they are rows."""
    sets = drawn_sets(pairs)
    return decided(sets, met_pairs(sets, least), least)


def similar_pairs_exact(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """All pairs at `least` without sketching: sizes and bitmaps of all pairs are compared, which rules out nearly all
    pairs and loses none; the full sets decide the rest."""
    sets = drawn_sets(pairs, banded=False)
    return decided(sets, met_pairs(sets, least, banded=False), least)
