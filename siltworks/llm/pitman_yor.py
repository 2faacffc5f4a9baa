"""A hierarchical Pitman-Yor language model, its Chinese-restaurant seating sampled by Gibbs sweeps.

Every previous word of the training texts has a restaurant, and so have the beginnings of texts; all of them share
one root. Dishes are the frequent words (a bounded table that all tasks get) and one dish for all rarer words. Which
rarer word it is comes from a second floor of restaurants: one for each frequent previous word, one for each class of
rarer previous words (by their last two bytes), with a root of their own over the rarer words.

So each pair of words can be dealt to a bucket that has all that its seating needs: pairs of frequent words go by the
pair, the restaurants of rarer previous words by that word, the second floor by its dish, the rarer word. From
elsewhere a sweep needs only vectors by frequent word, which are bounded; they are summed up after each sweep.
Pairs of two of the `hot` most frequent words (or beginnings, or the dish of rarer words) are no part of any bucket:
their counts are one bounded matrix, which the driver seats. Any pair that makes up more than 1 / hot of all tokens
is among them, so no bucket gets a hot key.

No seating is stored: random numbers depend on the sweep and the bucket only, so a task replays the sweeps from the
sums, after the loss of an executor as well. Dishes of more than SINGLY customers are seated in blocks of an eighth
of those seated, with one probability for a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, lean, ship, slices, table
from .shingles import mix, words

SINGLY = 48
END = np.uint64(0xE2D0_0000_0000_0001)
CHUNK = 8_192
#: Kinds of restaurants: of a frequent previous word, of a rarer one, of the second floor.
OFTEN, RARE, WHICH = 0, 1, 2


@dataclass(frozen=True)
class Settings:
    """frequent: most words of the table that is sent to all. classes: second-floor restaurants of rarer previous
    words (frequent + classes stay below 65,000). discounts and strengths: of the roots, of the restaurants.
    hot: words whose pairs are counted in a matrix. buckets: of corpora that give each at least 10,000 training
    tokens; more for corpora that would give one more than bucket_tokens."""

    frequent: int = 60_000
    hot: int = 512
    classes: int = 256
    burn_in: int = 2
    samples: int = 4
    seed: int = 11
    discounts: tuple[float, float] = (0.7, 0.8)
    strengths: tuple[float, float] = (10.0, 10.0)
    buckets: int = 128
    bucket_tokens: int = 2_000_000


@dataclass(frozen=True)
class Vocabulary:
    """The frequent words (sorted hashes; a word's number is its place) and their training counts; training tokens
    and distinct words in all."""

    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    types: int
    hot: int

    @cached_property
    def hottest(self) -> np.ndarray:
        """Numbers of the words with a place in the matrix; the last place is that of `rare`."""
        return np.append(np.lexsort((np.arange(self.rare), -self.counts))[: self.hot], self.rare)

    @cached_property
    def places(self) -> np.ndarray:
        """By word number, and for `rare`: the place in the matrix, or -1."""
        out = np.full(self.rare + 1, -1)
        out[self.hottest] = np.arange(len(self.hottest))
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    @property
    def rare(self) -> int:
        """The number of the dish of all rarer words, and as a context that of beginnings."""
        return len(self.hashes)


def class_of(last: np.ndarray, second: np.ndarray, classes: int) -> np.ndarray:
    return (last.astype(np.int64) * 263 + second.astype(np.int64) * 71) % (classes - 1)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens (each text's words, then its end), tokens of each text, the last two bytes of each
    token's word, and whether a token is the first of its text."""
    hashes, counts, last, second = words([t.lower() for t in texts])
    ends = np.cumsum(counts)
    hashes, last, second = np.insert(hashes, ends, END), np.insert(last, ends, 0), np.insert(second, ends, 0)
    counts = counts + 1
    first = np.zeros(len(hashes), bool)
    first[np.cumsum(counts) - counts] = True
    return hashes, counts, last, second, first


def seat(customers: np.ndarray, opening: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers sat down one after another; opening: the weight of a new table."""
    tables = np.minimum(customers, 1).astype(np.int64)
    active = np.flatnonzero(customers > 1)
    seated = 1
    while len(active):
        block = 1 if seated < SINGLY else seated // 8
        many = np.minimum(block, customers[active] - seated)
        weight = opening[active]
        p = weight / (weight + np.maximum(seated - discount * tables[active], 1e-12))
        tables[active] += rng.random(len(active)) < p if block == 1 else rng.binomial(many, p)
        seated += block
        active = active[customers[active] > seated]
    return tables


@dataclass(frozen=True)
class Sums:
    """What a sweep leaves: customers and tables by frequent context; tables of all contexts, and of the root, by
    dish; customers and tables by restaurant of the second floor; customers and tables of its root."""

    customers: np.ndarray
    tables: np.ndarray
    dishes: np.ndarray
    dish_tables: np.ndarray
    room_customers: np.ndarray
    room_tables: np.ndarray
    rare: np.ndarray

    def chances(self, s: Settings) -> np.ndarray:
        """The root's probability of each dish."""
        base = 1.0 / len(self.dishes)
        opened = (s.strengths[0] + s.discounts[0] * self.dish_tables.sum()) * base
        return (np.maximum(0, self.dishes - s.discounts[0] * self.dish_tables) + opened) / (s.strengths[0] + self.dishes.sum())


def predicted(count, tables, customers, all_tables, parent, s: Settings) -> np.ndarray:
    """A restaurant's probabilities of dishes with so many customers and tables, given its parent's."""
    served = np.maximum(0, count - s.discounts[1] * tables)
    return (served + (s.strengths[1] + s.discounts[1] * all_tables) * parent) / (s.strengths[1] + customers)


class Dishes:
    """The dishes of one bucket, sorted by kind, key and small, with their training customers. OFTEN: key is the
    context's number, small the dish. RARE: key is the context's hash. WHICH: key is the word's hash, small the room."""

    def __init__(self, number: int, sizes: np.ndarray, key: np.ndarray, small: np.ndarray, count: np.ndarray, vocabulary: Vocabulary, settings: Settings):
        self.number, self.v, self.s = number, vocabulary, settings
        cuts = np.cumsum([0, *sizes])
        self.key, self.small, self.count = ([x[cuts[k] : cuts[k + 1]].astype(np.int64) for k in range(3)] for x in (key, small, count))
        self.own = [self.key[OFTEN]] + [np.cumsum(np.diff(self.key[k], prepend=self.key[k][:1]) != 0) for k in (RARE, WHICH)]
        self.groups = [0, *(int(self.own[k].max()) + 1 if len(self.own[k]) else 0 for k in (RARE, WHICH))]
        self.tables = [np.minimum(c, 1) for c in self.count]
        self.rare_base = 1.0 / (vocabulary.types - vocabulary.rare + 1)
        self.rare_customers = self._summed(WHICH, self.tables[WHICH])
        self.rare_tables = np.minimum(self.rare_customers, 1)

    def _summed(self, kind: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.own[kind], values, self.groups[kind]).astype(np.int64)

    def rare_chances(self, before: Sums) -> np.ndarray:
        """The second root's probabilities of this bucket's rarer words."""
        d, t = self.s.discounts[0], self.s.strengths[0]
        return (np.maximum(0, self.rare_customers - d * self.rare_tables) + (t + d * before.rare[1]) * self.rare_base) / (t + before.rare[0])

    def sweep(self, number: int, before: Sums, last: bool = True) -> None:
        """Seats all customers anew, given the sums and probabilities of the sweep before. Where it is only replayed
        for a later one, frequent contexts are left out, as nothing of theirs is kept here."""
        s, chances = self.s, before.chances(self.s)
        rng = [np.random.Generator(np.random.Philox(key=[s.seed * 1_000_003 + number, self.number * 4 + k])) for k in range(3)]
        opening = lambda tables: s.strengths[1] + s.discounts[1] * tables
        if last:
            self.tables[OFTEN] = seat(self.count[OFTEN], opening(before.tables[self.own[OFTEN]]) * chances[self.small[OFTEN]], s.discounts[1], rng[0])
        mine = self._summed(RARE, self.tables[RARE])
        self.tables[RARE] = seat(self.count[RARE], opening(mine[self.own[RARE]]) * chances[self.small[RARE]], s.discounts[1], rng[1])
        parent = self.rare_chances(before)[self.own[WHICH]]
        self.tables[WHICH] = seat(self.count[WHICH], opening(before.room_tables[self.small[WHICH]]) * parent, s.discounts[1], rng[2])
        self.rare_customers = self._summed(WHICH, self.tables[WHICH])
        fresh = np.full(len(self.rare_customers), (s.strengths[0] + s.discounts[0] * before.rare[1]) * self.rare_base)
        self.rare_tables = seat(self.rare_customers, fresh, s.discounts[0], rng[2])

    def sums(self) -> list[np.ndarray]:
        """This bucket's share of the fields of Sums, but for the root's tables."""
        f = self.v.rare + 1
        rooms = f + self.s.classes
        by = lambda at, values, n: np.bincount(at, values, n).astype(np.int64)
        return [
            by(self.own[OFTEN], self.count[OFTEN], f),
            by(self.own[OFTEN], self.tables[OFTEN], f),
            by(self.small[OFTEN], self.tables[OFTEN], f) + by(self.small[RARE], self.tables[RARE], f),
            by(self.small[WHICH], self.count[WHICH], rooms),
            by(self.small[WHICH], self.tables[WHICH], rooms),
            np.array([self.rare_customers.sum(), self.rare_tables.sum()], np.int64),
        ]

    def predict(self, sums: Sums) -> list[np.ndarray]:
        """The probability of each dish in its restaurant, by kind."""
        chances = sums.chances(self.s)
        often = predicted(self.count[OFTEN], self.tables[OFTEN], sums.customers[self.own[OFTEN]], sums.tables[self.own[OFTEN]], chances[self.small[OFTEN]], self.s)
        customers, tables = (self._summed(RARE, x)[self.own[RARE]] for x in (self.count[RARE], self.tables[RARE]))
        rare = predicted(self.count[RARE], self.tables[RARE], customers, tables, chances[self.small[RARE]], self.s)
        rooms = self.small[WHICH]
        which = predicted(self.count[WHICH], self.tables[WHICH], sums.room_customers[rooms], sums.room_tables[rooms], self.rare_chances(sums)[self.own[WHICH]], self.s)
        return [often, rare, which]


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Slices of texts of about a megabyte: (begin, end, texts)."""
    own, begin, size = column.to_pylist(), 0, 0
    for i, t in enumerate(own):
        size += len(t or "")
        if size >= 250_000 or i + 1 == len(own):
            yield begin, i + 1, [(x or "").encode("utf-8", "surrogatepass") for x in own[begin : i + 1]]
            begin, size = i + 1, 0


def _count(docs: DataFrame) -> DataFrame:
    """(word, n, last, second): training counts by word hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def squeezed() -> tuple[np.ndarray, ...]:
            hashes, n, tails = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            return keys, np.bincount(inverse, n).astype(np.int64), tails[first]

        for batch in slices(batches, 1_024):
            for _, _, texts in _texts(batch.column(0)):
                hashes, _, last, second, _ = tokens(texts)
                held.append((hashes, np.ones(len(hashes), np.int64), last.astype(np.int64) * 256 + second))
                rows += len(hashes)
                if rows > 800_000:
                    held = [squeezed()]
                    rows = len(held[0][0])
                    if rows > 400_000:
                        yield made(held[0])
                        held, rows = [], 0
        if held:
            yield made(squeezed())

    def made(x: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x[0].view(np.int64)), pa.array(x[1]), pa.array(x[2].astype(np.int32))], ["word", "n", "tail"])

    return docs.where("train").select("text").mapInArrow(lean(work), "word long, n long, tail int").groupBy("word").agg(F.sum("n").alias("n"), F.first("tail").alias("tail"))


class HotPairs:
    """The matrix of hot pairs on the driver: counts, and tables after the latest sweep. Rows are contexts."""

    def __init__(self, counts: np.ndarray, vocabulary: Vocabulary, settings: Settings):
        own = vocabulary.hottest
        self.count, self.v, self.s = counts, vocabulary, settings
        self.context, self.dish = np.repeat(own, len(own)), np.tile(own, len(own))
        self.tables = np.minimum(counts, 1)
        self.mean = np.zeros(len(counts))

    def sweep(self, before: Sums, rng: np.random.Generator) -> None:
        s = self.s
        self.tables = seat(self.count, (s.strengths[1] + s.discounts[1] * before.tables[self.context]) * before.chances(s)[self.dish], s.discounts[1], rng)

    def sums(self) -> list[np.ndarray]:
        f = self.v.rare + 1
        pairs = ((self.context, self.count), (self.context, self.tables), (self.dish, self.tables))
        return [np.bincount(at, values, f).astype(np.int64) for at, values in pairs]

    def sample(self, sums: Sums) -> None:
        chances = sums.chances(self.s)[self.dish]
        self.mean += predicted(self.count, self.tables, sums.customers[self.context], sums.tables[self.context], chances, self.s) / self.s.samples


def _contexts(v: Vocabulary, number: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: its context's number (-1: a rarer word), its dish, its cell in the matrix of hot pairs (or -1)."""
    previous = np.where(first, v.rare, np.concatenate([number[:1], number[:-1]]))
    dish = np.where(number >= 0, number, v.rare)
    row, column = np.where(previous >= 0, v.places[previous], -1), v.places[dish]
    return previous, dish, np.where((row >= 0) & (column >= 0), row * len(v.hottest) + column, -1)


def _chunks(total: np.ndarray) -> pa.RecordBatch:
    cuts = range(0, len(total), CHUNK)
    raw = [pa.compress(total[c : c + CHUNK].astype("<i8").tobytes(), codec="zstd", asbytes=True) for c in cuts]
    return pa.record_batch([pa.array([c // CHUNK for c in cuts], pa.int32()), pa.array(raw, pa.binary())], ["chunk", "data"])


def _added(rows: DataFrame, length: int, parts: int) -> np.ndarray:
    """The sum of vectors that tasks gave in chunks; the driver gets one row for each chunk."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = min(CHUNK, length - chunk * CHUNK)
                held[chunk] = held.get(chunk, 0) + np.frombuffer(pa.decompress(data, n * 8, codec="zstd", asbytes=True), "<i8")
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["chunk", "data"])

    found = rows.repartition(parts, "chunk").mapInArrow(lean(add), "chunk int, data binary").collect()
    if not found:
        return np.zeros(length, np.int64)
    return np.concatenate([np.frombuffer(r["data"], "<i8") for r in sorted(found, key=lambda r: r["chunk"])])


def _hot_counts(docs: DataFrame, vocabulary: Vocabulary, sent, parts: int) -> np.ndarray:
    """Training counts of the hot pairs."""
    length = len(vocabulary.hottest) ** 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        total = np.zeros(length, np.int64)
        for batch in slices(batches, 1_024):
            for _, _, texts in _texts(batch.column(0)):
                hashes, _, _, _, first = tokens(texts)
                cell = _contexts(v, v.find(hashes), first)[2]
                at, n = np.unique(cell[cell >= 0], return_counts=True)
                total[at] += n
        yield _chunks(total)

    return _added(docs.where("train").select("text").mapInArrow(lean(work), "chunk int, data binary"), length, parts)


PACKED = "bucket int, sizes binary, data binary, docs binary"
GATHERED = "bucket int, sizes binary, often binary, rare binary, small binary, count binary, each binary, doc binary, docs binary"


def _raw(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _split(raw: bytes, *shape: tuple[str, int]) -> list[np.ndarray]:
    out, at = [], 0
    for kind, n in shape:
        out.append(np.frombuffer(raw, kind, n, at))
        at += np.dtype(kind).itemsize * n
    return out


def _postings(docs: DataFrame, vocabulary, settings: Settings, buckets: int) -> DataFrame:
    """Packed rows of a bucket: all tokens but hot pairs, by kind and then in the order of their documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        f = v.rare
        held: list[tuple[np.ndarray, ...]] = []
        docs_: list[tuple[np.ndarray, np.ndarray]] = []
        rows = before = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            kind, key, small, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            name, train = (np.concatenate(x) for x in zip(*docs_, strict=True))
            to = (mix(key + np.where(kind == OFTEN, small.astype(np.uint64) << np.uint64(32), np.uint64(0))) >> np.uint64(33)).astype(np.int64) % buckets
            # within a kind, documents come in order already
            order = np.argsort((to * 3 + kind).astype(np.uint16 if buckets < 20_000 else np.int64), kind="stable")
            cuts = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=buckets))])
            for b in range(buckets):
                at = order[cuts[b] : cuts[b + 1]]
                if not len(at):
                    continue
                sizes = np.bincount(kind[at], minlength=3)
                used, inverse = np.unique(doc[at], return_inverse=True)
                step = np.diff(inverse, prepend=0).astype("<i4")
                data = _raw(key[at[: sizes[0]]].astype("<u2"), key[at[sizes[0] :]].astype("<u8"), small[at].astype("<u2"), step)
                of = _raw(name[used].astype("<i8"), train[used].astype("u1"))
                head = np.array([*sizes, len(used), len(data)], "<i8").tobytes()
                packed = pa.compress(data, codec="zstd", asbytes=True)
                yield pa.record_batch([pa.array([b], pa.int32()), *(pa.array([x], pa.binary()) for x in (head, packed, of))], [c.split()[0] for c in PACKED.split(", ")])

        for batch in slices(batches, 1_024):
            doc, train = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for begin, end, texts in _texts(batch.column(2)):
                hashes, counts, last, second, first = tokens(texts)
                number = v.find(hashes)
                shift = lambda x: np.concatenate([x[:1], x[:-1]])
                previous, dish, cell = _contexts(v, number, first)
                of = np.repeat(np.arange(before, before + end - begin), counts)
                kind = np.where(previous >= 0, OFTEN, RARE)
                key = np.where(previous >= 0, previous.astype(np.uint64), shift(hashes))
                cool = cell < 0
                held.append((kind[cool].astype(np.int8), key[cool], dish[cool].astype(np.uint16), of[cool]))
                rare = number < 0
                room = np.where(previous >= 0, previous, f + 1 + class_of(shift(last), shift(second), settings.classes + 1))[rare]
                held.append((np.full(len(room), WHICH, np.int8), hashes[rare], room.astype(np.uint16), of[rare]))
                docs_.append((doc[begin:end], train[begin:end]))
                before += end - begin
                rows += len(hashes) + len(room)
                if rows > 2_000_000:
                    yield from flushed()
                    held, docs_, rows, before = [], [], 0, 0
        if held:
            yield from flushed()

    return docs.select("doc", "train", "text").mapInArrow(lean(work), PACKED)


def _gather(postings: DataFrame, buckets: int) -> DataFrame:
    """One row for each bucket: its dishes sorted by kind, key and small, with their training customers, and the
    documents of each dish's tokens."""
    names = [c.split()[0] for c in GATHERED.split(", ")]

    def out(bucket: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        kind, key, small, doc, name, train = (np.concatenate(x) for x in zip(*held, strict=True))
        docs, same = np.unique(name, return_inverse=True)
        trained, doc = train[doc], same[doc]
        order = np.lexsort((small.astype(np.int64) << 32 | doc, key, kind))
        kind, key, small = kind[order], key[order], small[order]
        fresh = np.concatenate([[True], (kind[1:] != kind[:-1]) | (key[1:] != key[:-1]) | (small[1:] != small[:-1])])
        at = np.flatnonzero(fresh)
        count = np.add.reduceat(trained[order].astype(np.int64), at)
        each = np.diff(np.append(at, len(order)))
        kind, key, small = kind[at], key[at], small[at]
        sizes = np.bincount(kind, minlength=3)
        raw = [sizes.astype("<i8"), key[: sizes[0]].astype("<u2"), key[sizes[0] :], small, count.astype("<u4"), each.astype("<u4"), doc[order].astype("<u4"), docs]
        return pa.record_batch([pa.array([bucket], pa.int32()), *(pa.array([_raw(x)], pa.binary()) for x in raw)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        now, before = None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, sizes, data, of = (batch.column(j)[i].as_py() for j in range(4))
                if now is not None and bucket != now:
                    yield out(now, held)
                    held, before = [], 0
                now = bucket
                a, b, c, docs, length = np.frombuffer(sizes, "<i8")
                n = int(a + b + c)
                key0, key, small, step = _split(pa.decompress(data, int(length), codec="zstd", asbytes=True), ("<u2", int(a)), ("<u8", int(b + c)), ("<u2", n), ("<i4", n))
                name, train = _split(of, ("<i8", int(docs)), ("u1", int(docs)))
                kind = np.repeat(np.arange(3, dtype=np.int8), [a, b, c])
                held.append((kind, np.concatenate([key0.astype(np.uint64), key]), small, (np.cumsum(step) + before).astype(np.int64), name, train))
                before += len(name)
        if now is not None:
            yield out(now, held)

    return postings.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(work), GATHERED)


DISHES = ["bucket", "sizes", "often", "rare", "small", "count"]


def _dishes(row: pa.RecordBatch, vocabulary: Vocabulary, settings: Settings) -> Dishes:
    number, sizes, often, rare, small, count = (row.column(i)[0].as_py() for i in range(len(DISHES)))
    key = np.concatenate([np.frombuffer(often, "<u2").astype(np.uint64), np.frombuffer(rare, "<u8")]).view(np.int64)
    return Dishes(number, np.frombuffer(sizes, "<i8"), key, np.frombuffer(small, "<u2"), np.frombuffer(count, "<u4"), vocabulary, settings)


def _sweep(gathered: DataFrame, hot: HotPairs, sent, history: list[Sums], history_sent, parts: int) -> Sums:
    """The sums after the next sweep (or of the first seating). The driver seats the customers of the hot pairs and of
    the root, which are bounded."""
    settings = hot.s

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for i in range(batch.num_rows):
                own = _dishes(batch.slice(i, 1), sent.value, settings)
                past = history_sent.value if history_sent else []
                for number, before in enumerate(past):
                    own.sweep(number + 1, before, number + 1 == len(past))
                flat = np.concatenate(own.sums())
                total = flat if total is None else total + flat
        if total is not None:
            yield _chunks(total)

    f = hot.v.rare + 1
    rooms = f + settings.classes
    flat = _added(gathered.select(*DISHES).mapInArrow(lean(work), "chunk int, data binary"), 3 * f + 2 * rooms + 2, parts)
    *often, room_customers, room_tables, rare = np.split(flat, np.cumsum([f, f, f, rooms, rooms]))
    rng = np.random.Generator(np.random.Philox(key=[settings.seed * 1_000_003 + len(history), 3]))
    if history:
        hot.sweep(history[-1], rng)
    customers, tables, dishes = (x + y for x, y in zip(often, hot.sums(), strict=True))
    if history:
        d, t = settings.discounts[0], settings.strengths[0]
        dish_tables = seat(dishes, np.full(f, (t + d * history[-1].dish_tables.sum()) / f), d, rng)
    else:
        dish_tables = np.minimum(dishes, 1)
    return Sums(customers, tables, dishes, dish_tables, room_customers, room_tables, rare)


def _rate(gathered: DataFrame, sent, settings: Settings, history_sent) -> DataFrame:
    """(doc, base, model, known): sums over a document's tokens in one bucket: of log10 probabilities, and of the
    rarer words' base and training counts."""
    names = ["doc", "base", "model", "known"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, s, history = sent.value, settings, history_sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                own = _dishes(row, v, s)
                mean = 0.0
                for number in range(1, len(history)):
                    own.sweep(number, history[number - 1])
                    if number > s.burn_in:
                        mean = mean + np.concatenate(own.predict(history[number])) / s.samples
                each, doc, docs = (np.frombuffer(row.column(len(DISHES) + j)[0].as_py(), t) for j, t in enumerate(("<u4", "<u4", "<i8")))
                model = np.bincount(doc, np.repeat(np.log10(mean), each), len(docs))
                trained = own._summed(WHICH, own.count[WHICH])[own.own[WHICH]]
                which = len(own.count[OFTEN]) + len(own.count[RARE])
                rest = each[which:]
                at = doc[len(doc) - int(rest.sum()) :]
                base = np.bincount(at, np.repeat(np.log10((trained + 1) / (v.tokens + v.types + 1)), rest), len(docs)).astype(float)
                known = np.bincount(at, np.repeat(trained > 0, rest), len(docs)).astype(np.int64)
                yield pa.record_batch([pa.array(docs), pa.array(base), pa.array(model.astype(float)), pa.array(known)], names)

    return gathered.mapInArrow(lean(work), "doc long, base double, model double, known long")


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the frequent words: whole classes of counts, from the greatest on, while they
    hold at most so many words."""
    class_ = F.floor(F.log2("n") * 16).cast("int")
    bound = total = 0
    classes = counts.groupBy(class_.alias("class")).agg(F.count("*").alias("words")).orderBy(F.desc("class")).collect()  # at most 1,024
    for r in classes:
        total += r["words"]
        if total > most:
            bound = r["class"] + 1
            break
    rows = counts.where(class_ >= bound).select("word", "n").collect()  # at most `most`
    hashes = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r["n"] for r in rows], np.int64)[order]


def score_documents(spark: SparkSession, docs: DataFrame, is_held_out: Column, settings: Settings | None = None) -> DataFrame:
    """Learns from the documents that are not held out and scores all.

    docs: doc_id, text. Null and empty texts are their end alone; a null is_held_out counts as training. Each row is
    scored by its own text, whatever its id: ids may be null or repeated, and equal rows count as often as they occur.
    Without training tokens every token has the base's probability. An empty table gives no rows. Returns doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score and score (log10).
    """
    settings = settings or Settings()
    ship(spark)
    stage = Stage(spark, "pitman-yor")
    flagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).alias("doc"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(is_held_out, F.lit(False)).alias("held_out"))
    flagged = flagged.withColumn("train", ~F.col("held_out"))
    counts = stage.write(_count(flagged), "counts")
    n, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    vocabulary = Vocabulary(*_frequent(counts, settings.frequent), int(n), int(types), settings.hot)
    stage.drop(counts)
    context = spark.sparkContext
    sent = context.broadcast(vocabulary)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4)
    buckets = max(parts, min(settings.buckets, int(n) // 10_000), -(-int(n) // settings.bucket_tokens))
    gathered = stage.write(_gather(_postings(flagged, sent, settings, buckets), buckets), "gathered")
    hot = HotPairs(_hot_counts(flagged, vocabulary, sent, parts), vocabulary, settings)
    history: list[Sums] = []
    history_sent = None
    for number in range(1 + settings.burn_in + settings.samples):
        history.append(_sweep(gathered, hot, sent, history, history_sent, parts))
        history_sent = context.broadcast(list(history))
        if number > settings.burn_in:
            hot.sample(history[-1])
    logs = context.broadcast(np.log10(hot.mean))
    rated = _rate(gathered, sent, settings, history_sent)
    rated = rated.groupBy("doc").agg(F.sum("base").alias("rare_base"), F.sum("model").alias("model"), F.sum("known").alias("rare_known"))

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for batch in slices(batches, 1_024):
            doc = batch.column(0).to_numpy()
            for begin, end, texts in _texts(batch.column(1)):
                found, counts_, _, _, first = tokens(texts)
                known = v.find(found)
                of = np.repeat(np.arange(end - begin), counts_)
                cell = _contexts(v, known, first)[2]
                model = np.bincount(of[cell >= 0], logs.value[cell[cell >= 0]], end - begin).astype(float)
                at = known >= 0
                base = np.bincount(of[at], np.log10((v.counts[known[at]] + 1) / (v.tokens + v.types + 1)), end - begin) if at.any() else np.zeros(end - begin)
                seen = np.bincount(of[at], minlength=end - begin)
                yield pa.record_batch([pa.array(doc[begin:end]), pa.array(counts_), pa.array(seen.astype(np.int64)), pa.array(base), pa.array(model)], ["doc", "n_tokens", "known", "base", "hot"])

    frequent = flagged.select("doc", "text").mapInArrow(lean(often), "doc long, n_tokens long, known long, base double, hot double")
    # rows that are equal in id and text are summed up together; each gets its share
    frequent = frequent.groupBy("doc").agg(F.count("*").alias("rows"), *(F.sum(c).alias(c) for c in ("n_tokens", "known", "base", "hot")))
    joined = flagged.select("doc_id", "doc", "held_out").join(frequent, "doc").join(rated, "doc", "left")
    zero = F.lit(0)
    shared = lambda c: (c / F.col("rows")).cast("long")
    return joined.select(
        "doc_id",
        "held_out",
        shared(F.col("n_tokens")).alias("n_tokens"),
        shared(F.col("known") + F.coalesce("rare_known", zero)).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        ((F.col("base") + F.coalesce("rare_base", zero)) / F.col("rows")).alias("base_score"),
        ((F.col("hot") + F.coalesce("model", zero)) / F.col("rows")).alias("score"),
    )


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; the edge cases are those of score_documents."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return score_documents(spark, table(spark, sf_dir, "documents"), held_out)
