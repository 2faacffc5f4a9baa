"""Best-two-fit packing: bins are filled greedily, then a bin's smallest piece gives way to two that fit better.

Packing depends on lengths alone, and there are at most `capacity` of them. So the plan is made on the histogram
of lengths, pattern by pattern with multiplicities, and is as small for any number of documents; documents then
find their place by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import library_pieces
from .common import Stage, bucket_count, lean, ship, table, two_level_rank


def best_pair(free: np.ndarray, most: int, above: int) -> tuple[int, int] | None:
    """The two lengths with free pieces whose sum is the largest that is at most `most` and more than `above`."""
    has = free > 0
    for total in range(most, above, -1):
        half = total // 2
        low = np.arange(1, half + 1)
        low = low[(total - low) < len(free)]
        ok = has[low] & has[total - low]
        if total % 2 == 0 and len(ok) and low[-1] == half and free[half] < 2:
            ok[-1] = False
        found = np.flatnonzero(ok)
        if len(found):
            small = int(low[found[0]])
            return total - small, small
    return None


def fill(free: np.ndarray, capacity: int) -> list[int]:
    """One bin from the free pieces: the longest first, then always the longest that fits, then best-two-fit."""
    free = free.copy()
    gap, items = capacity, []
    while gap and (fits := np.flatnonzero(free[: gap + 1])).size:
        length = int(fits[-1])
        items.append(length)
        free[length] -= 1
        gap -= length
    while gap and len(items) > 1:
        smallest = min(items)
        pair = best_pair(free, gap + smallest, smallest)
        if pair is None:
            break
        items.remove(smallest)
        free[smallest] += 1
        for length in pair:
            items.append(length)
            free[length] -= 1
        gap += smallest - sum(pair)
    return sorted(items, reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many bins of that kind). A kind is used as long as its pieces last."""
    free = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        free[length] = n
    out = []
    while free.any():
        items = fill(free, capacity)
        need = Counter(items)
        times = min(int(free[length]) // n for length, n in need.items())
        for length, n in need.items():
            free[length] -= n * times
        out.append((items, times))
    return out


def pieces_of(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [n]
    rest = n % capacity
    return [rest] * (rest > 0) + [capacity] * (n // capacity)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(docs: DataFrame, tokenizer: str | None, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of the token ids of every whole text, each text followed by end_id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_pieces(tokenizer)
        for batch in batches:
            texts, doc_ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            ids, counts = encoder.encode(texts)
            raw = memoryview(np.insert(ids, np.cumsum(counts), np.uint32(end_id)).astype("<u4")).cast("B")
            rows, at = [], 0
            for doc_id, n in zip(doc_ids, (counts + 1).tolist(), strict=True):
                start = 0
                for piece, length in enumerate(pieces_of(n, capacity)):
                    own = raw[4 * (at + start) : 4 * (at + start + length)]
                    rows.append((doc_id, piece, start, length, zlib.crc32(own), *([bytes(own)] if with_ids else [])))
                    start += length
                at += n
            columns = list(zip(*rows, strict=True)) or [()] * (5 + with_ids)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(work), PIECES + ", ids binary" * with_ids)


def pack_documents(spark: SparkSession, docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Packs every whole text of docs (doc_id, text) into sequences of at most `capacity` tokens.

    Null and empty texts are their end id alone. Only texts longer than a sequence are cut. Repeated rows and null
    ids are packed like any others; an empty table gives no rows. Returns one row for each piece: doc_id, piece,
    start, length, ids_crc32, sequence_id and offset (gapless from 0), with the ids if asked for.
    """
    ship(spark)
    stage = Stage(spark, "packing")
    pieces = stage.write(cut_documents(docs, tokenizer, end_id, capacity, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places, taken, base = [], Counter(), 0
    for items, times in plan(histogram, capacity):
        offset = 0
        for length in items:
            places.append((length, taken[length], taken[length] + times, base - taken[length], offset))
            taken[length] += times
            offset += length
        base += times
    if not places:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    n = sum(histogram.values())
    ranked = two_level_rank(pieces, ["length"], F.struct("doc_id", "piece", "ids_crc32"), ["doc_id", "piece"], bucket_count(n // 64), "rank")
    # the plan has a bounded number of rows for a capacity, however many documents there are
    planned = spark.createDataFrame(places, "length long, first long, past long, shift long, offset long")
    joined = ranked.join(F.broadcast(planned), (ranked["length"] == planned["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")))
    return joined.select(*[ranked[c] for c in pieces.columns], (F.col("rank") + F.col("shift")).alias("sequence_id"), "offset")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"))
