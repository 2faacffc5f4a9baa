"""Clustering in bounded memory: points arrive in chunks; only counts, sums and sums of squares of clusters are kept.

State: discard set (ds: the K clusters), compression set (cs: small groups apart from them) and retained points
(rs). Statistics are DataFrames (label, n, sums, squares); a run has a few of them, whatever the number of points.
"""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import deviations, normalised_distance
from .iteration import cut


def kmeans(points: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """points (id, features array<double>) with a column `label`."""
    ready = points.withColumn("_vector", array_to_vector("features"))
    model = KMeans(k=k, seed=seed, featuresCol="_vector", predictionCol="label").fit(ready)
    return model.transform(ready).drop("_vector")


def statistics(labelled: DataFrame) -> DataFrame:
    """(label, n, sums, squares) of labelled points, summed by dimension."""
    long = labelled.select("label", F.posexplode("features").alias("dim", "x"))
    sums = long.groupBy("label", "dim").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    ordered = sums.groupBy("label").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "s", "q"))).alias("by_dim"))
    return ordered.select("label", "n", F.col("by_dim.s").alias("sums"), F.col("by_dim.q").alias("squares"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Statistics of two sets of clusters, those with one label added up."""
    both = a.unionByName(b)
    long = both.select("label", "n", F.posexplode(F.arrays_zip("sums", "squares")).alias("dim", "v"))
    sums = long.groupBy("label", "dim").agg(F.sum("n").alias("n"), F.sum("v.sums").alias("s"), F.sum("v.squares").alias("q"))
    ordered = sums.groupBy("label").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "s", "q"))).alias("by_dim"))
    return ordered.select("label", "n", F.col("by_dim.s").alias("sums"), F.col("by_dim.q").alias("squares"))


def nearest(points: DataFrame, stats: DataFrame) -> DataFrame:
    """points with the nearest cluster's `near` label and `distance`. stats is sent to all: a row for each cluster."""
    centre = F.transform("sums", lambda s: s / F.col("n"))
    known = F.broadcast(stats.select(F.col("label").alias("near"), centre.alias("centre"), deviations(F.col("n"), F.col("sums"), F.col("squares")).alias("deviation")))
    rated = points.join(known).withColumn("distance", normalised_distance(F.col("features"), F.col("centre"), F.col("deviation")))
    best = rated.groupBy("id").agg(F.min(F.struct(F.round("distance", 9).alias("distance"), "near")).alias("best"))
    return points.join(best, "id", "left").select(*points.columns, F.col("best.near").alias("near"), F.col("best.distance").alias("distance"))


def assign(points: DataFrame, ds: DataFrame, cs: DataFrame | None) -> DataFrame:
    """points with `target` ('ds', 'cs' or 'rs') and `near`: the nearest cluster of ds within 2 sqrt(d), else of cs."""
    limit = 2 * F.sqrt(F.size("features"))
    first = nearest(points, ds).withColumnsRenamed({"near": "ds_near", "distance": "ds_distance"})
    if cs is None:
        second = first.withColumns({"cs_near": F.lit(None).cast("int"), "cs_distance": F.lit(None).cast("double")})
    else:
        second = nearest(first, cs).withColumnsRenamed({"near": "cs_near", "distance": "cs_distance"})
    in_ds, in_cs = F.coalesce(F.col("ds_distance") < limit, F.lit(False)), F.coalesce(F.col("cs_distance") < limit, F.lit(False))
    target = F.when(in_ds, F.lit("ds")).when(in_cs, F.lit("cs")).otherwise(F.lit("rs"))
    near = F.when(in_ds, F.col("ds_near")).when(in_cs, F.col("cs_near"))
    return second.select(*points.columns, target.alias("target"), near.alias("near"))


class Bfr:
    """A run over chunks. Cluster statistics and their merges live on the driver: K, 3K and 8K clusters bound them."""

    def __init__(self, k: int, seed: int = 1, chunks: int = 5):
        self.k, self.seed, self.chunks = k, seed, chunks
        self.ds: DataFrame | None = None
        self.cs: DataFrame | None = None
        self.labels: DataFrame | None = None  # id, kind, label of all points seen
        self.rounds: list[tuple[int, int, int, int, int]] = []

    def run(self, points: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rounds, labels): counts after each chunk, and each id with its cluster, -1 outside of all."""
        spark = points.sparkSession
        # a random split: chunks by hash have equal sizes but for chance, and no global order is needed
        dealt = cut(points.withColumn("_chunk", F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(self.seed)), F.lit(self.chunks))))
        for chunk in range(self.chunks):
            own = dealt.where(F.col("_chunk") == chunk).select("id", "features")
            if self.ds is None:
                self._begin(own)
            else:
                self._take(own)
            if chunk == self.chunks - 1:
                self._close()
            self._count(chunk + 1)
        rounds = spark.createDataFrame(self.rounds, "round int, n_ds long, n_cs_clusters long, n_cs long, n_rs long")
        labels = self.labels.select("id", F.when(F.col("kind") == "ds", F.col("label")).otherwise(F.lit(-1)).alias("label"))
        return rounds, labels

    def _split(self, points: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(points in clusters of several, points alone in theirs) of a k-means with at most as many clusters as points."""
        labelled = cut(kmeans(points, k, self.seed))
        sizes = labelled.groupBy("label").agg(F.count("*").alias("size"))
        sized = labelled.join(F.broadcast(sizes), "label")
        return sized.where("size > 1").drop("size"), sized.where("size = 1").drop("size")

    def _begin(self, points: DataFrame) -> None:
        several, alone = self._split(points, min(8 * self.k, max(2, points.count())))
        if several.limit(1).count() == 0:
            several, alone = alone, several
        found = cut(kmeans(several.drop("label"), self.k, self.seed))
        self.ds = cut(statistics(found))
        self.labels = cut(found.select("id", F.lit("ds").alias("kind"), "label", "features").unionByName(alone.select("id", F.lit("rs").alias("kind"), F.lit(-1).alias("label"), "features")))
        self._regroup()

    def _regroup(self) -> None:
        """Retained points become groups when there are more than 3K of them."""
        retained = self.labels.where("kind = 'rs'").select("id", "features")
        if retained.count() <= 3 * self.k:
            return
        several, alone = self._split(retained, 3 * self.k)
        if several.limit(1).count() == 0:
            return
        top = 0 if self.cs is None else (self.cs.agg(F.max("label")).first()[0] or 0) + 1
        fresh = cut(several.withColumn("label", (F.col("label") + top).cast("int")))
        stats = statistics(fresh)
        self.cs = cut(stats if self.cs is None else self.cs.unionByName(stats))
        self.labels = cut(
            self.labels.where("kind <> 'rs'")
            .unionByName(fresh.select("id", F.lit("cs").alias("kind"), "label", "features"))
            .unionByName(alone.select("id", F.lit("rs").alias("kind"), F.lit(-1).alias("label"), "features"))
        )

    def _take(self, points: DataFrame) -> None:
        placed = cut(assign(points, self.ds, self.cs))
        for kind in ("ds", "cs"):
            own = placed.where(F.col("target") == kind).select(F.col("near").cast("int").alias("label"), "features")
            stats = getattr(self, kind)
            if stats is not None:
                setattr(self, kind, cut(merged(stats, statistics(own))))
        label = F.when(F.col("target") == "rs", F.lit(-1)).otherwise(F.col("near")).cast("int")
        self.labels = cut(self.labels.unionByName(placed.select("id", F.col("target").alias("kind"), label.alias("label"), "features")))
        self._regroup()
        self._merge_groups()

    def _rows(self, stats: DataFrame | None) -> dict[int, tuple[int, list[float], list[float]]]:
        return {} if stats is None else {r["label"]: (r["n"], list(r["sums"]), list(r["squares"])) for r in stats.collect()}

    @staticmethod
    def _distance(a: tuple, b: tuple) -> float:
        """The lesser of both distances between centres, each in the other's deviations."""
        out = []
        for one, other in ((a, b), (b, a)):
            total = 0.0
            for s, q, t in zip(one[1], one[2], other[1], strict=True):
                spread = max(0.0, q / one[0] - (s / one[0]) ** 2)
                if spread > 0:
                    total += (t / other[0] - s / one[0]) ** 2 / spread
            out.append(math.sqrt(total))
        return min(out)

    @staticmethod
    def _sum(a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)], [x + y for x, y in zip(a[2], b[2], strict=True)]

    def _save(self, kind: str, rows: dict[int, tuple], like: DataFrame) -> None:
        spark = like.sparkSession
        setattr(self, kind, spark.createDataFrame([(k, *v) for k, v in rows.items()], like.schema) if rows else None)

    def _rename(self, kind: str, names: dict[int, tuple[str, int]]) -> None:
        if not names:
            return
        spark = self.labels.sparkSession
        table = spark.createDataFrame([(kind, old, new_kind, new) for old, (new_kind, new) in names.items()], "kind string, label int, new_kind string, new_label int")
        joined = self.labels.join(F.broadcast(table), ["kind", "label"], "left")
        self.labels = cut(joined.select("id", F.coalesce("new_kind", "kind").alias("kind"), F.coalesce("new_label", "label").alias("label"), "features"))

    def _merge_groups(self) -> None:
        """The closest two groups merge while they are within 2 sqrt(d); then groups are numbered anew."""
        rows = self._rows(self.cs)
        like, origin = self.cs, {k: [k] for k in rows}
        while len(rows) > 1:
            limit = 2 * math.sqrt(len(next(iter(rows.values()))[1]))
            labels = sorted(rows)
            best = min(((self._distance(rows[a], rows[b]), a, b) for i, a in enumerate(labels) for b in labels[i + 1 :]), default=None)
            if best is None or best[0] >= limit:
                break
            _, a, b = best
            rows[a] = self._sum(rows[a], rows.pop(b))
            origin[a] += origin.pop(b)
        if like is None:
            return
        numbered = {old: new for new, kept in enumerate(sorted(rows)) for old in origin[kept]}
        self._rename("cs", {old: ("cs", new) for old, new in numbered.items() if old != new})
        self._save("cs", {new: rows[kept] for new, kept in enumerate(sorted(rows))}, like)

    def _close(self) -> None:
        """After the last chunk, groups join the nearest cluster within 2 sqrt(d) until none does."""
        ds, cs = self._rows(self.ds), self._rows(self.cs)
        like, moved = self.ds, {}
        changed = True
        while changed and cs:
            changed = False
            limit = 2 * math.sqrt(len(next(iter(ds.values()))[1]))
            for label in sorted(cs):
                distance, to = min((self._distance(cs[label], ds[k]), k) for k in sorted(ds))
                if distance < limit:
                    ds[to] = self._sum(ds[to], cs.pop(label))
                    moved[label] = ("ds", to)
                    changed = True
        self._rename("cs", moved)
        self._save("ds", ds, like)
        self._save("cs", cs, like)

    def _count(self, number: int) -> None:
        counts = {r["kind"]: r["n"] for r in self.labels.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        self.rounds.append((number, counts.get("ds", 0), 0 if self.cs is None else self.cs.count(), counts.get("cs", 0), counts.get("rs", 0)))


def relabel(labels: DataFrame) -> DataFrame:
    """Labels numbered from 0 without gaps, in their order; rows without a label keep none. One window over the
    distinct labels only, which are as many as there are clusters."""
    dense = labels.select("label").distinct().where("label IS NOT NULL").withColumn("dense", F.row_number().over(Window.orderBy("label")) - 1)
    return labels.join(dense, "label", "left").drop("label").withColumnRenamed("dense", "label")
