"""Suffix-array dedup: every byte that a `depth`-byte string covers which also starts earlier is removed.

Windows of `depth` bytes are grouped into segments by content-defined anchors (`anchors`), so that equal windows
meet wherever they are. Equal segments are settled by their hashes: the first keeps its windows, the others lose
them. Different segments of one anchor are settled by merging the Burrows-Wheeler transforms of shards of them
(`bwt`): the blocks of the merged transform are the repeated windows, and all but a block's first are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Hasher
from .bwt import repeated
from .common import Stage, lean, ship, slices, table

ANCHOR_BYTES = 32
MOST_BROADCAST = 1_000_000
MOST_SEGMENTS = 2_048
BUCKET_BYTES = 60_000
COMBINE_ROWS = 500_000


def _numbered(spark: SparkSession, stage: Stage, docs: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame, bool]:
    """doc_id, text and doc, a number that orders the documents: the id, or, where ids are null or repeated with
    different texts, a dense rank by (id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    hashed = rows.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(9), "text").alias("h2"), F.octet_length("text").cast("long").alias("n_bytes"))
    ids = stage.write(hashed, "ids")
    plain = ids.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_distinct("h1", "h2").alias("n")).where("n > 1").limit(1).count() == 0
    plain = plain and ids.where("doc_id IS NULL").limit(1).count() == 0
    if plain:
        numbers = ids.select("doc_id", "h1", "h2", "n_bytes", F.col("doc_id").alias("doc"))
    else:
        ordered = ids.distinct().orderBy(F.col("doc_id").asc_nulls_first(), "h1", "h2")
        numbers = ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])).toDF("doc_id long, h1 long, h2 long, n_bytes long, doc long")
    return stage.write(numbers.distinct(), "numbers"), rows, plain


def _segments(texts: DataFrame, depth: int) -> DataFrame:
    """All segments of all texts. sure: an equal segment starts earlier among the rows that one task combined."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(depth, min(ANCHOR_BYTES, depth))
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def out() -> pa.RecordBatch:
            anchor, content, doc, start, windows = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((start, doc, content, anchor))
            anchor, content, doc, start, windows = (x[order] for x in (anchor, content, doc, start, windows))
            sure = np.concatenate([[False], (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])])
            return pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(doc), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(sure)], ["anchor", "content", "doc", "start", "windows", "sure"])

        for batch in slices(batches, 2_048):
            docs = batch.column(0).to_numpy()
            texts_, begin, size = batch.column(1).to_pylist(), 0, 0
            for i, t in enumerate(texts_):
                size += len(t)
                if size < 200_000 and i + 1 < len(texts_):
                    continue
                text, start, windows, anchor, content = hasher.segments([x.encode("utf-8", "surrogatepass") for x in texts_[begin : i + 1]])
                if len(text):
                    held.append((anchor, content, docs[begin + text], start, windows))
                    rows += len(text)
                begin, size = i + 1, 0
                if rows >= COMBINE_ROWS:
                    yield out()
                    held, rows = [], 0
        if held:
            yield out()

    return texts.select("doc", "text").mapInArrow(lean(work), "anchor long, content long, doc long, start int, windows int, sure boolean")


def _settle(rows: DataFrame) -> DataFrame:
    """Of rows sorted by (anchor, content, doc, start): kind 0, windows that are removed (not the first of their
    content); kind 1, first segments of an anchor that has several contents. Others need no more work."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "anchor", "doc", "start", "windows"]
        last: np.ndarray | None = None  # the last row seen
        waiting: np.ndarray | None = None  # the last first-of-content, and whether it is known to be open

        def made(kind: int, x: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.full(len(x), kind), pa.int32()), pa.array(x[:, 0]), pa.array(x[:, 2]), pa.array(x[:, 3], pa.int32()), pa.array(x[:, 4], pa.int32())], names)

        open_before = False
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)], axis=1)
            same = np.empty(len(x), bool)
            same[1:] = (x[1:, :2] == x[:-1, :2]).all(axis=1)
            same[0] = last is not None and bool((x[0, :2] == last[:2]).all())
            last = x[-1]
            if same.any():
                yield made(0, x[same])
            first = x[~same]
            if waiting is not None:
                first = np.concatenate([waiting[None], first])
            if not len(first):
                continue
            after = first[1:, 0] == first[:-1, 0]
            opened = np.zeros(len(first), bool)
            opened[:-1] |= after
            opened[1:] |= after
            opened[0] |= open_before
            if opened[:-1].any():
                yield made(1, first[:-1][opened[:-1]])
            waiting, open_before = first[-1], bool(opened[-1])
        if waiting is not None and open_before:
            yield made(1, waiting[None])

    columns = ["anchor", "content", "doc", "start", "windows"]
    sorted_ = rows.where("NOT sure").select(*columns).repartition("anchor").sortWithinPartitions("anchor", "content", "doc", "start")
    return sorted_.mapInArrow(lean(work), "kind int, anchor long, doc long, start int, windows int")


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring window starts."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)]))
    return doc[cut], start[cut], np.diff(np.append(cut, len(doc)))


def _merge(segments: DataFrame, depth: int) -> DataFrame:
    """Merges the segments of each (anchor, part). kind 0: runs of windows that are not the first of their block;
    kind 2 (anchors in several parts only): the first window of each block, by the hash of its bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "window", "doc", "start", "windows"]

        def made(kind: int, window: np.ndarray, doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.full(len(doc), kind), pa.int32()), pa.array(window, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(windows, pa.int32())], names)

        def bucket(texts: list[bytes], meta: np.ndarray) -> Iterator[pa.RecordBatch]:
            place, block = repeated(texts, depth)
            lengths = np.array([len(t) + 1 for t in texts])
            begins = np.cumsum(lengths) - lengths
            text = np.repeat(np.arange(len(texts)), lengths)[place]
            at = place - begins[text]
            usable = at < meta[text, 2]
            text, at, block = text[usable], at[usable], block[usable]
            doc, start = meta[text, 0], meta[text, 1] + at
            order = np.lexsort((start, doc, block))
            doc, start, block, text, at = (x[order] for x in (doc, start, block, text, at))
            first = np.concatenate([[True], block[1:] != block[:-1]])
            if not first.all():
                d, s, n = _runs(doc[~first], start[~first])
                yield made(0, np.zeros(len(d), np.int64), d, s, n)
            shared = first & (meta[text, 3] > 1)
            if shared.any():
                hashes = [int.from_bytes(hashlib.blake2b(texts[t][a : a + depth], digest_size=8).digest(), "little", signed=True) for t, a in zip(text[shared].tolist(), at[shared].tolist(), strict=True)]
                yield made(2, np.array(hashes, np.int64), doc[shared], start[shared], np.ones(int(shared.sum()), np.int64))

        texts: list[bytes] = []
        rows: list[np.ndarray] = []
        key, size, group = None, 0, 0
        for batch in slices(batches, 4_096):
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            meta = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in (3, 4, 5, 2)], axis=1)
            for i, (k, t) in enumerate(zip(keys, batch.column(6).to_pylist(), strict=True)):
                if k != key and size >= BUCKET_BYTES:
                    yield from bucket(texts, np.array(rows))
                    texts, rows, size = [], [], 0
                key = k
                texts.append(t)
                rows.append(meta[i])
                size += len(t)
        if texts:
            yield from bucket(texts, np.array(rows))

    sorted_ = segments.select("anchor", "part", "parts", "doc", "start", "windows", "bytes").repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return sorted_.mapInArrow(lean(work), "kind int, window long, doc long, start int, windows int")


def removed_windows(spark: SparkSession, stage: Stage, texts: DataFrame, depth: int) -> DataFrame:
    """(doc, start, windows): runs of windows of which an equal one starts earlier. texts: doc (unique), text."""
    rows = stage.write(_segments(texts, depth), "segments")
    settled = stage.write(_settle(rows), "settled")
    sure = stage.write(rows.where("sure").select("doc", "start", "windows"), "sure")
    stage.drop(rows)
    opened = settled.where("kind = 1")
    hot = opened.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > MOST_SEGMENTS).select("anchor", F.ceil(F.col("n") / MOST_SEGMENTS).cast("int").alias("parts"))
    dealt = opened.join(hot, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc", "start"), F.col("parts")).cast("int"))
    wanted = dealt.groupBy("doc").agg(F.collect_list(F.struct("anchor", "part", "parts", "start", "windows")).alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "part", "parts", "doc", "start", "windows", "bytes"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in slices(batches, 128):
            out = []
            for doc, text, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for c in cuts:
                    out.append((c["anchor"], c["part"], c["parts"], doc, c["start"], c["windows"], raw[c["start"] : c["start"] + c["windows"] + depth - 1]))
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = "anchor long, part int, parts int, doc long, start int, windows int, bytes binary"
    segments = stage.write(texts.join(wanted, "doc").select("doc", "text", "cuts").mapInArrow(lean(cut), schema), "bytes")
    merged = stage.write(_merge(segments, depth), "merged")
    stage.drop(segments)
    # windows of anchors that were dealt to several parts meet here, at most one of a kind from each part
    across = merged.where("kind = 2")
    firsts = across.groupBy("window").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("window", "first")
    later = across.join(firsts, "window").where((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start"))).select("doc", "start", "windows")
    return sure.unionByName(settled.where("kind = 0").select("doc", "start", "windows")).unionByName(merged.where("kind = 0").select("doc", "start", "windows")).unionByName(later)


def covered(n: int, starts: np.ndarray, windows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes of a text of n bytes: (begins, ends)."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + windows - 1 + depth, -1)
    inside = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return change[::2], change[1::2]


def remove_repeats(spark: SparkSession, docs: DataFrame, depth: int = 100, digests: bool = False, whole_characters: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Removes repeated bytes from every whole text.

    docs: doc_id, text. A byte goes if a `depth`-byte string that covers it also starts earlier: in a document with
    a smaller doc_id, or earlier in the same one. Null texts are empty; null ids come first; rows with one id and
    different texts are ordered by their hashes; rows equal in id and text are one document and get one result
    each. An empty table gives no rows.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal runs removed), and kept_sha256 (digests), or else kept (the
    bytes that stay), and the input columns in keep. whole_characters: only removes characters all of whose bytes
    go, and returns kept as text.
    """
    ship(spark)
    stage = Stage(spark, "suffixes")
    keep = [c for c in (keep or []) if c not in ("doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")]
    numbers, rows, plain = _numbered(spark, stage, docs, keep)
    firsts = numbers.groupBy("h1", "h2").agg(F.min("doc").alias("doc"))
    keys = [] if plain else ["h1", "h2"]
    if plain:
        copies = stage.write(numbers.join(firsts.withColumnRenamed("doc", "first"), ["h1", "h2"]).where("doc <> first").select("doc"), "copies")
        few = copies.count() <= MOST_BROADCAST
        known = rows.withColumnRenamed("doc_id", "doc").dropDuplicates(["doc"]) if numbers.count() != rows.count() else rows.withColumnRenamed("doc_id", "doc")
        texts = known.select("doc", "text").join(F.broadcast(copies) if few else copies, "doc", "left_anti")
    else:
        named = rows.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(9), "text"))
        texts = named.join(firsts, keys).dropDuplicates(["doc"]).select("doc", "text")
    gone = removed_windows(spark, stage, texts, depth)
    cuts = gone.groupBy("doc").agg(F.collect_list(F.struct("start", "windows")).alias("cuts"))
    cuts = stage.write(cuts, "cuts")
    whole = numbers.join(firsts.withColumnRenamed("doc", "first"), ["h1", "h2"]).select("doc_id", "h1", "h2", "doc", ((F.col("doc") != F.col("first")) & (F.col("n_bytes") >= depth)).alias("copy"))
    facts = whole.join(cuts, "doc", "left").where("copy OR cuts IS NOT NULL")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            out = []
            cut_lists = batch.column(3)
            for i, (text, copy) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                raw = text.encode("utf-8", "surrogatepass")
                begins, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if copy:
                    begins, ends = np.array([0]), np.array([len(raw)])
                elif cut_lists[i].is_valid:
                    pairs = cut_lists[i].values
                    begins, ends = covered(len(raw), pairs.field("start").to_numpy().astype(np.int64), pairs.field("windows").to_numpy().astype(np.int64), depth)
                if whole_characters and len(begins):
                    begins, ends = _to_characters(raw, begins, ends)
                kept = b"".join(raw[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(raw)], strict=True))
                out.append((len(raw), int((ends - begins).sum()), len(begins), hashlib.sha256(kept).hexdigest() if digests else kept.decode("utf-8") if whole_characters else kept))
            columns = list(zip(*out, strict=True)) or [()] * 4
            last = pa.string() if digests or whole_characters else pa.binary()
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), last), strict=True)]
            yield pa.record_batch([batch.column(0), *made, *batch.columns[4:]], ["doc_id", "n_bytes", "n_removed", "n_spans", name, *keep])

    name = "kept_sha256" if digests else "kept"
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, {name} " + ("string" if digests or whole_characters else "binary")
    schema = ", ".join([schema, *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)])
    if plain:
        joined = rows.join(facts.select("doc_id", "copy", "cuts"), "doc_id", "left")
    else:
        named = rows.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(9), "text"))
        facts = facts.withColumnRenamed("doc_id", "_id")
        joined = named.join(facts, (named["doc_id"].eqNullSafe(facts["_id"])) & (named["h1"] == facts["h1"]) & (named["h2"] == facts["h2"]), "left")
    return joined.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "cuts", *(f"`_keep_{c}`" for c in keep)).mapInArrow(lean(work), schema)


def _to_characters(raw: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draws runs in to the borders of whole characters."""
    out = []
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array([x[0] for x in out], np.int64), np.array([x[1] for x in out], np.int64)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, table(spark, sf_dir, "documents"), digests=True)
