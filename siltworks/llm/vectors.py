"""Embedding near-duplicates: an exact metric range join over pivot cells.

Unit vectors at cosine c are sqrt(2 - 2c) apart. Every vector lies in the cell of its nearest pivot; by the triangle
inequality a neighbour within the radius r can be in another cell only if that cell's pivot is not farther than the
own one by more than 2r, and for Euclidean distances only if the plane between both pivots is within r. Cells are put
into groups, few of them whatever the rows. A vector is sent to the groups of such cells (of two groups one is the host,
so that a pair meets once), as a sketch of 16-bit numbers, and every group is joined by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, components, lean, ship, table

MARGIN = 1e-6
ROWS = "dim int, home int, role int, rep long, weight long, sketch binary"


def usable(c: Column) -> Column:
    """Whether a vector can be compared: no null, NaN or infinity in it, and not zero."""
    odd = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(c.isNotNull() & ~odd & F.exists(c, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def cosines(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Cosines in double precision of all rows of v with all rows of w. Rows are scaled by powers of two first, which is
    exact, so that no square overflows or vanishes."""
    v, w = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (v, w))
    return (v @ w.T) / (np.sqrt(np.einsum("ij,ij->i", v, v))[:, None] * np.sqrt(np.einsum("ij,ij->i", w, w)))


def reach(units: np.ndarray, pivots: np.ndarray, between: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each unit vector, and which other cells may hold a neighbour of it (rows by cells)."""
    squares = np.maximum(0.0, 2 - 2 * (units @ pivots.T))
    home = squares.argmin(axis=1)
    least = squares[np.arange(len(units)), home]
    distance = np.sqrt(squares)
    triangle = distance <= np.sqrt(least)[:, None] + 2 * radius + MARGIN
    plane = squares - least[:, None] <= 2 * radius * between[home] + MARGIN
    return home, triangle & plane


def hosts(groups: int) -> np.ndarray:
    """Whether the group of a row has its vectors sent to the group of a column: of two groups one is the host, and
    each hosts about half of the others."""
    ahead = (np.arange(groups)[:, None] - np.arange(groups)) % groups
    return (ahead > 0) & ((2 * ahead < groups) | (2 * ahead == groups) & (np.arange(groups)[:, None] > np.arange(groups)))


def sketch(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as 16-bit numbers times a step, and how far that is from them at most."""
    step = (np.abs(units).max(axis=1) / 32767).astype(np.float32)
    short = np.clip(np.rint(units / step[:, None].astype(float)), -32767, 32767).astype(np.int16)
    off = np.sqrt(np.square(units - short * step[:, None].astype(float)).sum(axis=1))
    return short, step, (off * 1.01 + 1e-9).astype(np.float32)


class Group:
    """The home vectors of a group of cells, joined with vectors that stream past, all as sketches. The bounds of the
    sketches decide nearly all pairs; those that they leave open are given out to be decided by the vectors."""

    def __init__(self, reps: np.ndarray, weights: np.ndarray, short: np.ndarray, step: np.ndarray, off: np.ndarray, least: float):
        self.reps, self.weights, self.short, self.step, self.off, self.least = reps, weights, short, step, off, least
        self.links = np.zeros(len(reps), np.int64)
        self.parent = np.arange(len(reps))
        self.most_off = float(off.max())
        self.rounding = 1e-6 + 2.4e-7 * short.shape[1]

    def _roots(self, at: np.ndarray) -> np.ndarray:
        found = self.parent[at]
        while (above := self.parent[found]).tolist() != found.tolist():
            found = above
        self.parent[at] = found
        return found

    def _merge(self, rows: np.ndarray, columns: np.ndarray) -> None:
        """Homes that are linked with one vector are one group. rows are in order."""
        roots = self._roots(columns)
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        mixed = np.minimum.reduceat(roots, starts) < np.maximum.reduceat(roots, starts)
        ends = np.append(starts[1:], len(rows))
        for b, e in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
            old = np.unique(self._roots(columns[b:e]))
            self.parent[old] = old[0]

    def _hits(self, short: np.ndarray, step: np.ndarray, off: np.ndarray, first: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For blocks of homes from `first` on: rows, homes, and whether the pair is a link for sure."""
        single = short.astype(np.float32) * step[:, None]
        zone = float(off.max()) + self.most_off + 1e-6 + self.rounding
        for i in range(first, len(self.reps), block):
            homes = self.short[i : i + block].astype(np.float32) * self.step[i : i + block, None]
            near = single @ homes.T
            if near.max() < self.least - zone:
                continue
            rows, columns = np.divmod(np.flatnonzero(near >= np.float32(self.least - zone)), near.shape[1])
            if len(rows):
                slack = off[rows].astype(float) + self.off[columns + i] + off[rows] * self.off[columns + i].astype(float) + self.rounding
                found = near[rows, columns].astype(float)
                open_too = found >= self.least - slack
                yield rows[open_too], columns[open_too] + i, (found >= self.least + slack)[open_too]

    def inner(self, rows: int = 512, block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i in range(0, len(self.reps), rows):
            own = slice(i, i + rows)
            for r, c, sure in self._hits(self.short[own], self.step[own], self.off[own], i, block):
                later = c > r + i
                r, c, sure = r[later] + i, c[later], sure[later]
                if not sure.all():
                    yield np.full((~sure).sum(), 2), self.reps[r[~sure]], self.reps[c[~sure]]
                r, c = r[sure], c[sure]
                if len(r):
                    np.add.at(self.links, r, self.weights[c])
                    np.add.at(self.links, c, self.weights[r])
                    firsts = np.unique(r)
                    order = np.argsort(both := np.concatenate([r, firsts]), kind="stable")
                    self._merge(both[order], np.concatenate([c, firsts])[order])

    def meet(self, reps: np.ndarray, weights: np.ndarray, short: np.ndarray, step: np.ndarray, off: np.ndarray, rows: int = 512, block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i in range(0, len(reps), rows):
            own = slice(i, i + rows)
            links, one = np.zeros(len(reps[own]), np.int64), np.full(len(reps[own]), -1)
            for r, c, sure in self._hits(short[own], step[own], off[own], 0, block):
                if not sure.all():
                    yield np.full((~sure).sum(), 2), reps[own][r[~sure]], self.reps[c[~sure]]
                r, c = r[sure], c[sure]
                if len(r):
                    np.add.at(self.links, c, weights[own][r])
                    np.add.at(links, r, self.weights[c])
                    # homes of another block that the vector is linked with belong here too
                    before = np.unique(r[one[r] >= 0])
                    order = np.argsort(both := np.concatenate([r, before]), kind="stable")
                    self._merge(both[order], np.concatenate([c, one[before]])[order])
                    one[r] = c
            met = np.flatnonzero(one >= 0)
            yield np.zeros(len(met), int), reps[own][met], links[met]
            yield np.ones(len(met), int), reps[own][met], self.reps[one[met]]

    def end(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        some = np.flatnonzero(self.links)
        yield np.zeros(len(some), int), self.reps[some], self.links[some]
        roots = self._roots(np.arange(len(self.reps)))
        some = np.flatnonzero(roots != np.arange(len(self.reps)))
        yield np.ones(len(some), int), self.reps[some], self.reps[roots[some]]


def near_vectors(spark: SparkSession, vectors: DataFrame, least_cosine: float = 0.95, cell_rows: int = 2_048, most_pivots: int = 4_096, least_groups: int = 8, group_bytes: int = 96 << 20) -> DataFrame:
    """Links of all vectors with a cosine of at least least_cosine: vec_id, n_links, component_id, kept.

    vectors: vec_id, embedding (an array of numbers). Null and zero vectors, and those with a null or non-finite
    component, are linked with nothing; so are rows without a vec_id (kept, without a component). Vectors of
    different lengths are never linked. Equal vectors are compared as one and counted each. Rows of one vec_id are
    vectors of their own. Pivots are a hashed sample of at most most_pivots vectors; larger
    cells are dealt out in chunks of about cell_rows home vectors. Chunks are put into at least least_groups groups, of
    about group_bytes of sketches, so no task holds more; a vector goes to a group at most once, however many of its
    cells are in reach. An empty table gives none.
    """
    ship(spark)
    stage = Stage(spark, "vectors")
    radius = math.sqrt(2 - 2 * least_cosine)
    # floats stay floats, which take half the bytes and are the same numbers
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    ok = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    # -0.0 + 0.0 is 0.0: equal vectors have equal hashes
    clean = F.transform("embedding", lambda x: x + F.lit(0.0).cast(kind))
    known = base.where(ok).select("vec_id", clean.alias("embedding")).select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(5), "embedding").alias("h2"))
    classes = known.groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    # a class goes by its hash: an id that several vectors have would mix them up
    classes = stage.write(classes.withColumn("rep", F.col("h1")), "classes")
    n = classes.count()
    k = max(1, min(most_pivots, -(-n // cell_rows)))
    chosen = classes.orderBy(F.xxhash64("rep"), "h1").limit(k).select("embedding").collect()
    by_dim: dict[int, np.ndarray] = {}
    for d in {len(r[0]) for r in chosen}:
        by_dim[d] = unit(np.array([r[0] for r in chosen if len(r[0]) == d], float))
    between = {d: np.sqrt(np.maximum(0, 2 - 2 * p @ p.T)) for d, p in by_dim.items()}

    def numbers(column: pa.Array) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Rows by dimension: (their places, the dimension, their vectors)."""
        lengths = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(lengths) - lengths
        for d in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == d)
            yield at, d, flat[starts[at][:, None] + np.arange(d)].astype(float)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros(batch.num_rows, np.int32)
            dims = np.zeros(batch.num_rows, np.int32)
            for at, d, rows in numbers(batch.column(0)):
                dims[at] = d
                if d in by_dim:
                    cells[at] = (unit(rows) @ by_dim[d].T).argmax(axis=1)
            yield pa.record_batch([pa.array(dims), pa.array(cells)], ["dim", "cell"])

    # at most as many rows as pivots and dimensions
    sizes = {(r["dim"], r["cell"]): r["n"] for r in classes.select("embedding").mapInArrow(lean(homes), "dim int, cell int").groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}
    chunks = {key: -(-size // cell_rows) for key, size in sizes.items()}
    # by dimension: the number of groups, the first chunk and the group of each chunk by cell
    places: dict[int, tuple[int, dict[int, int], np.ndarray]] = {}
    for d in {d for d, _ in sizes}:
        cells = sorted(c for e, c in sizes if e == d)
        total, counts = sum(sizes[d, c] for c in cells), [chunks[d, c] for c in cells]
        groups = max(1, min(sum(counts), max(least_groups, -(-total * 2 * d // group_bytes))))
        shares = np.concatenate([np.full(n, sizes[d, c] / n) for c, n in zip(cells, counts, strict=True)])
        group = np.minimum(groups - 1, ((np.cumsum(shares) - shares / 2) * groups / max(1, total)).astype(np.int64))
        places[d] = (groups, dict(zip(cells, (np.cumsum(counts) - counts).tolist(), strict=True)), group)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = {}  # by dimension: which cells have chunks in which groups
        for d, (groups, first, group) in places.items():
            has[d] = np.zeros((len(by_dim[d]) if d in by_dim else 1, groups), bool)
            for c, start in first.items():
                has[d][c, group[start : start + chunks[d, c]]] = True
        for batch in batches:
            reps, weights = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, d, rows in numbers(batch.column(2)):
                for i in range(0, len(at), 1024):
                    yield emit(d, has[d], reps[at[i : i + 1024]], weights[at[i : i + 1024]], rows[i : i + 1024])

    def emit(d: int, has: np.ndarray, reps: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        units = unit(rows)
        if d in by_dim:
            home, near = reach(units, by_dim[d], between[d], radius)
        else:
            home, near = np.zeros(len(rows), np.int64), np.ones((len(rows), 1), bool)
        near[np.arange(len(rows)), home] = True
        groups, first, group = places[d]
        own = np.array([group[first[h] + ((rep & 0xFFFFFFFF) * 0x9E3779B1 >> 7) % chunks[d, h]] for h, rep in zip(home.tolist(), reps.tolist(), strict=True)])
        sent = ((near.astype(np.float32) @ has.astype(np.float32)) > 0) & hosts(groups)[own]
        row, there = np.nonzero(sent)
        row, there = np.concatenate([np.arange(len(rows)), row]), np.concatenate([own, there])
        role = (np.arange(len(row)) >= len(rows)).astype(np.int32)
        short, step, off = sketch(units)
        raw = np.concatenate([short.view(np.uint8).reshape(len(rows), -1), step[:, None].view(np.uint8), off[:, None].view(np.uint8)], axis=1)
        raw = pa.array([r.tobytes() for r in raw], pa.binary()).take(pa.array(row))
        return pa.record_batch([pa.array(np.full(len(row), d), pa.int32()), pa.array(there, pa.int32()), pa.array(role), pa.array(reps[row], pa.int64()), pa.array(weights[row], pa.int64()), raw], [c.split()[0] for c in ROWS.split(", ")])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows: the homes of a group first, then the vectors that stream past them."""
        names, key, held, group = ["kind", "a", "b"], None, [], None

        def made(rows: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for kinds, a, b in rows:
                if len(a):
                    yield pa.record_batch([pa.array(kinds, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names)

        def begun() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            nonlocal group, held
            if group is None and held:
                parts, held = [np.concatenate(x) for x in zip(*held, strict=True)], []
                group = Group(*parts, least_cosine)
                yield from group.inner()

        def closed() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            yield from begun()
            if group is not None:
                yield from group.end()

        for batch in batches:
            ids = np.stack([batch.column(i).to_numpy() for i in range(2)], axis=1)
            role = batch.column(2).to_numpy()
            cuts = np.flatnonzero((np.diff(ids, axis=0) != 0).any(axis=1) | (np.diff(role) != 0)) + 1
            for b, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if b == e:
                    continue
                now = tuple(ids[b].tolist())
                if now != key:
                    yield from made(closed())
                    key, held, group = now, [], None
                part = batch.slice(b, e - b)
                raw = np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint8).reshape(e - b, 2 * now[0] + 8)
                short, step, off = raw[:, :-8].copy().view(np.int16), raw[:, -8:-4].copy().view(np.float32)[:, 0], raw[:, -4:].copy().view(np.float32)[:, 0]
                own = (part.column(3).to_numpy(), part.column(4).to_numpy(), short, step, off)
                if role[b] == 0:
                    held.append(own)
                elif held or group is not None:
                    yield from made(begun())
                    yield from made(group.meet(*own))
        yield from made(closed())

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs (a, weight_a, v, b, weight_b, w) that sketches left open, by cosines of the vectors."""
        for batch in batches:
            a, n_a, b, n_b = (batch.column(i).to_numpy() for i in range(4))
            kinds, left, right = [], [], []
            for (at, d, v), (_, _, w) in zip(numbers(batch.column(4)), numbers(batch.column(5)), strict=True):
                met = at[[bool(cosines(x[None], y[None])[0, 0] >= least_cosine) for x, y in zip(v, w, strict=True)]]
                kinds += [np.zeros(2 * len(met), int), np.ones(len(met), int)]
                left += [a[met], b[met], a[met]]
                right += [n_b[met], n_a[met], b[met]]
            if kinds:
                yield pa.record_batch([pa.array(np.concatenate(kinds), pa.int32()), pa.array(np.concatenate(left), pa.int64()), pa.array(np.concatenate(right), pa.int64())], ["kind", "a", "b"])

    dealt = classes.select("rep", "weight", "embedding").mapInArrow(lean(deal), ROWS)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * sum(groups for groups, _, _ in places.values()))
    found = dealt.repartition(parts, "dim", "home").sortWithinPartitions("dim", "home", "role").mapInArrow(lean(join), "kind int, a long, b long")
    found = stage.write(found, "found")
    sides = [classes.select(F.col("rep").alias(x), F.col("weight").alias(f"n_{x}"), F.col("embedding").alias(f"v_{x}")) for x in "ab"]
    left_open = found.where("kind = 2").select("a", "b").join(sides[0], "a").join(sides[1], "b").select("a", "n_a", "b", "n_b", "v_a", "v_b")
    found = stage.write(found.where("kind < 2").unionByName(left_open.mapInArrow(lean(decide), "kind int, a long, b long")), "decided")
    links = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("others")).withColumnRenamed("a", "rep")
    groups = components(spark, stage, found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "rep")
    rated = classes.select("h1", "h2", "rep", "first", "weight").join(links, "rep", "left").join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    rated = rated.join(rated.groupBy("component").agg(F.min("first").alias("component_id")), "component")
    rated = rated.select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), "component_id")
    linked = known.select("vec_id", "h1", "h2").join(rated, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = base.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors at a cosine of 0.95; the edge cases are those of near_vectors."""
    return near_vectors(spark, table(spark, sf_dir, "embeddings"))
