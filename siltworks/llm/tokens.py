"""Token-id output: documents in ascending doc_id, encoded to blocks of a range coder, written and read back.

A token file is a folder of two Parquet tables: `table` (one row: the frequency table) and `blocks` (one row for
each block: part, block, payload). Blocks are independent, so any reader decodes any of them by itself.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import library_pieces
from .common import Stage, lean, ship, table
from .rans import Coder, Table, quantise

RAW = "part int, block int, start_in_part long, doc_ids binary, nulls binary, doc_lengths binary, ids binary"


@functools.lru_cache(maxsize=4)
def _coder(raw: bytes) -> Coder:
    return Coder(Table.from_bytes(raw))


def _raw_blocks(docs: DataFrame, tokenizer: str | None, end_id: int, block_tokens: int) -> DataFrame:
    """Blocks of plain ids: whole documents, in ascending doc_id over parts and blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = library_pieces(tokenizer)
        part = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        block = start = waiting = 0

        def out() -> pa.RecordBatch:
            nonlocal held, block, start, waiting
            doc_ids, nulls, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            row = [[part], [block], [start], [doc_ids.astype("<i8").tobytes()], [nulls.astype("u1").tobytes()], [lengths.astype("<u4").tobytes()], [ids.astype("<u4").tobytes()]]
            made = pa.record_batch([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], [c.split()[0] for c in RAW.split(", ")])
            held, block, start, waiting = [], block + 1, start + len(ids), 0
            return made

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                own = batch.slice(i, 64)
                ids, counts = pieces.encode(own.column(1).to_pylist())
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, np.uint32(end_id))
                doc_ids = own.column(0)
                held.append((doc_ids.fill_null(0).to_numpy(zero_copy_only=False), doc_ids.is_null().to_numpy(zero_copy_only=False), counts + 1, ids))
                waiting += len(ids)
                if waiting >= block_tokens:
                    yield out()
        if held:
            yield out()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first()).mapInArrow(lean(work), RAW)


def write_token_file(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, block_tokens: int = 1 << 18) -> None:
    """Writes every whole text of docs (doc_id, text) as token ids, each document followed by end_id.

    Null and empty texts are their end id alone; null ids come first; repeated ids stand side by side in any order.
    An empty table gives a file without blocks. The frequency table counts all tokens of all documents.
    """
    ship(spark)
    stage = Stage(spark, "tokens")
    raw = stage.write(_raw_blocks(docs, tokenizer, end_id, block_tokens), "raw")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                own = np.bincount(np.frombuffer(ids.as_buffer(), "<u4"))
                if len(own) > len(total):
                    total = np.pad(total, (0, len(own) - len(total)))
                total[: len(own)] += own
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["token", "n"])

    sums = raw.select("ids").mapInArrow(lean(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["token"] for r in sums), default=0) + 1, np.int64)
    for r in sums:
        counts[r["token"]] = r["n"]
    packed = quantise(counts).to_bytes()
    spark.createDataFrame([(bytearray(packed),)], "frequencies binary").coalesce(1).write.parquet(f"{path}/table")

    # one number for each part of the shuffle, so that the ids need not be shuffled again to be joined with theirs
    sizes = sorted((r["part"], r["n"]) for r in raw.groupBy("part").agg(F.sum(F.octet_length("ids") / 4).cast("long").alias("n")).collect())
    starts, total = {}, 0
    for part, n in sizes:
        starts[part] = total
        total += n

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(packed)
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<u4")
                payload = coder.encode(ids, np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["nulls"], "u1"), np.frombuffer(row["doc_lengths"], "<u4"), starts[row["part"]] + row["start_in_part"])
                yield pa.record_batch([pa.array([row["part"]], pa.int32()), pa.array([row["block"]], pa.int32()), pa.array([payload], pa.binary())], ["part", "block", "payload"])

    raw.mapInArrow(lean(encode), "part int, block int, payload binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    stage.drop(raw)


def read_token_file(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents of a token file: doc_id, start, n_tokens, ids_crc32 and, if asked for, their ids."""
    ship(spark)
    packed = bytes(spark.read.parquet(f"{path}/table").first()["frequencies"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(packed)
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                ids, header = coder.decode(payload)
                doc_ids, nulls, lengths = header.docs(payload)
                raw = memoryview(ids.astype("<u4")).cast("B")
                ends = np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                spans = [raw[4 * b : 4 * e] for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array(doc_ids, pa.int64(), mask=nulls.astype(bool)),
                    pa.array(header.start + begins, pa.int64()),
                    pa.array(lengths.astype(np.int64)),
                    pa.array([zlib.crc32(x) for x in spans], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([bytes(x) for x in spans], pa.binary()))
                yield pa.record_batch(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return spark.read.parquet(f"{path}/blocks").select("payload").mapInArrow(lean(decode), schema)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "token-file")
    path = stage.path("tokens")
    write_token_file(spark, table(spark, sf_dir, "documents"), path)
    return read_token_file(spark, path, with_ids=False)
