"""Static range asymmetric numeral systems over token ids: one frequency table, interleaved lanes in array steps.

A block holds whole documents. Token i of a block belongs to lane i mod lanes; all lanes advance together, and
each has a 63-bit state that sheds 32-bit words. Checkpoints (a step, a place in the words, the states of all
lanes) let a reader begin inside a block; two checksums cover the tokens and the payload.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
HEAD = struct.Struct("<4sHHIIIIIQI")  # magic, version, bits, lanes, tokens, documents, words, checkpoints, start, crc of ids
MAGIC = b"SRNS"


@dataclass(frozen=True)
class Table:
    """Frequencies that sum up to 2 ** bits; a token of frequency 0 cannot be written."""

    bits: int
    freq: np.ndarray

    @property
    def cumulative(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.freq)]).astype(np.uint64)

    def to_bytes(self) -> bytes:
        return struct.pack("<HI", self.bits, len(self.freq)) + self.freq.astype("<u4").tobytes()

    @staticmethod
    def from_bytes(raw: bytes) -> Table:
        bits, n = struct.unpack_from("<HI", raw)
        return Table(bits, np.frombuffer(raw, "<u4", n, 6).astype(np.uint64))


def quantise(counts: np.ndarray, least_bits: int = 18) -> Table:
    """Frequencies in proportion to the counts, at least 1 for every token seen."""
    seen = np.flatnonzero(counts)
    bits = max(least_bits, int(len(seen)).bit_length() + 2)
    if bits > 28:
        raise ValueError("more distinct tokens than a table of 28 bits holds")
    total = 1 << bits
    freq = np.zeros(max(1, len(counts)), np.int64)
    if len(seen):
        share = counts[seen].astype(np.float64) / float(counts[seen].sum()) * (total - len(seen))
        freq[seen] = 1 + np.floor(share).astype(np.int64)
        left = total - int(freq.sum())
        order = seen[np.argsort(-(share - np.floor(share)), kind="stable")]
        freq[order[:left]] += 1
    else:
        freq[0] = total
    return Table(bits, freq.astype(np.uint64))


class Coder:
    """Encodes and decodes blocks with one table."""

    def __init__(self, table: Table):
        self.bits = np.uint64(table.bits)
        self.freq = table.freq.astype(np.uint64)
        self.cum = table.cumulative[:-1]
        self.limit = ((LOW >> self.bits) << WORD) * self.freq
        self.mask = np.uint64((1 << table.bits) - 1)
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))

    def encode(self, ids: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, doc_lengths: np.ndarray, start: int, lanes: int = 1024, steps_between: int = 128) -> bytes:
        n = len(ids)
        while lanes > 1 and n < lanes * 64:
            lanes //= 2
        if n and not self.freq[ids].all():
            raise ValueError("a token has no frequency in the table")
        steps = -(-n // lanes)
        states = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        checkpoints = []
        for step in range(steps - 1, -1, -1):
            own = ids[step * lanes : (step + 1) * lanes]
            x = states[: len(own)]
            f = self.freq[own]
            full = x >= self.limit[own]
            words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            x = np.where(full, x >> WORD, x)
            q = x // f
            states[: len(own)] = (q << self.bits) + (x - q * f) + self.cum[own]
            if step and step % steps_between == 0:
                checkpoints.append((step, states.copy()))
        counts = np.cumsum([len(w) for w in words][::-1]) if words else np.zeros(0, np.int64)
        body = b"".join(w.tobytes() for w in words[::-1])
        marks = b"".join(struct.pack("<II", step, int(counts[step - 1])) + s.astype("<u8").tobytes() for step, s in checkpoints[::-1])
        head = HEAD.pack(MAGIC, 1, int(self.bits), lanes, n, len(doc_ids), len(body) // 4, len(checkpoints), start, zlib.crc32(ids.astype("<u4")))
        payload = b"".join((head, doc_ids.astype("<i8").tobytes(), nulls.astype("u1").tobytes(), doc_lengths.astype("<u4").tobytes(), states.astype("<u8").tobytes(), marks, body))
        return payload + struct.pack("<I", zlib.crc32(payload))

    def decode(self, payload: bytes, checkpoint: int = 0) -> tuple[np.ndarray, Header]:
        """The tokens from a checkpoint on (0: the beginning; the tokens' checksum is checked then) and the header."""
        header = read_header(payload)
        if header.bits != int(self.bits):
            raise ValueError("the block was written with another table")
        lanes, n = header.lanes, header.tokens
        at = header.body
        words = np.frombuffer(payload, "<u4", header.words, at).astype(np.uint64)
        if checkpoint:
            step, word, states = header.checkpoint(payload, checkpoint)
        else:
            step, word, states = 0, 0, np.frombuffer(payload, "<u8", lanes, header.states).astype(np.uint64)
        out = np.empty(max(0, n - step * lanes), np.uint32)
        begin = step * lanes
        for first in range(begin, n, lanes):
            m = min(lanes, n - first)
            x = states[:m]
            slot = x & self.mask
            own = self.symbol[slot]
            out[first - begin : first - begin + m] = own
            x = self.freq[own] * (x >> self.bits) + slot - self.cum[own]
            low = np.flatnonzero(x < LOW)
            if len(low):
                x[low] = (x[low] << WORD) | words[word : word + len(low)]
                word += len(low)
            states[:m] = x
        if not checkpoint and zlib.crc32(out.astype("<u4")) != header.crc:
            raise ValueError("the tokens do not match their checksum")
        return out, header


@dataclass(frozen=True)
class Header:
    bits: int
    lanes: int
    tokens: int
    documents: int
    words: int
    checkpoints: int
    start: int
    crc: int

    @property
    def docs_at(self) -> int:
        return HEAD.size

    @property
    def states(self) -> int:
        return HEAD.size + 13 * self.documents

    @property
    def body(self) -> int:
        return self.states + 8 * self.lanes + self.checkpoints * (8 + 8 * self.lanes)

    def checkpoint(self, payload: bytes, number: int) -> tuple[int, int, np.ndarray]:
        at = self.states + 8 * self.lanes + (number - 1) * (8 + 8 * self.lanes)
        step, word = struct.unpack_from("<II", payload, at)
        return step, word, np.frombuffer(payload, "<u8", self.lanes, at + 8).astype(np.uint64)

    def docs(self, payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.documents
        return (
            np.frombuffer(payload, "<i8", n, HEAD.size),
            np.frombuffer(payload, "u1", n, HEAD.size + 8 * n),
            np.frombuffer(payload, "<u4", n, HEAD.size + 9 * n),
        )


def read_header(payload: bytes) -> Header:
    """Checks the payload's checksum and reads its header."""
    if zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("the block does not match its checksum")
    magic, version, *rest = HEAD.unpack_from(payload)
    if magic != MAGIC or version != 1:
        raise ValueError("not a block of tokens")
    return Header(*rest)
