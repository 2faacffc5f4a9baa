"""BPE encoding and decoding of whole texts by the streaming transducer of `bpe`."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Decoder, transducer_pieces
from .common import lean, ship, table


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and n_tokens of every whole text.

    docs: doc_id, text. Null and empty texts have no ids; repeated rows are encoded one by one; an empty table
    gives no rows. tokenizer: a path that executors can read (the public byte-level vocabulary by default).
    """
    ship(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = transducer_pieces(tokenizer)
        for batch in batches:
            ids, counts = pieces.encode(batch.column(1).to_pylist())
            ends = np.cumsum(counts)
            flat = ids.astype("<u4")
            parts = [flat[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(parts, pa.binary()), pa.array(counts, pa.int64())], ["doc_id", "ids", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(work), "doc_id long, ids binary, n_tokens long")


def decode_documents(spark: SparkSession, encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The columns of `encoded` (doc_id, ids, n_tokens) and the decoded text."""
    ship(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(transducer_pieces(tokenizer).vocabulary)
        for batch in batches:
            texts = ["".join(decoder.decode(np.frombuffer(x, "<u4").astype(np.int64))) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(lean(work), "doc_id long, ids binary, n_tokens long, text string")


def round_trip_digests(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Encodes and decodes every whole text in one pass; returns doc_id, n_tokens and both SHA-256 digests."""
    ship(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = transducer_pieces(tokenizer)
        decoder = Decoder(pieces.vocabulary)
        for batch in batches:
            ids, counts = pieces.encode(batch.column(1).to_pylist())
            flat = ids.astype("<u4")
            of_ids, of_text, end = [], [], 0
            for n in counts.tolist():
                own = flat[end : end + n]
                end += n
                of_ids.append(hashlib.sha256(own).hexdigest())
                digest = hashlib.sha256()
                for part in decoder.decode(own.astype(np.int64)):
                    digest.update(part.encode("utf-8"))
                of_text.append(digest.hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(work), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(spark, table(spark, sf_dir, "documents"))
