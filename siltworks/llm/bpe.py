"""Byte-level BPE: vectorised splitting into pieces, a bounded piece cache, a streaming transducer and its decoder.

`Pieces` splits whole batches of texts with array operations just as the tokenizer's pattern does, and looks each
piece up in a bounded cache; unknown pieces go to `encode_pieces`: the tokenizers library (LibraryPieces) or the
transducer below. Texts with code points of unsettled classes, or with an added token's text in them, are encoded
piece by piece by the fallback of the same encoder.
"""

from __future__ import annotations

import codecs
import functools
import json
import os
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import regex

LETTER, NUMBER, OTHER, SPACE, UNSURE = 1, 2, 3, 0, 4
# The splitting pattern of the byte-level tokenizer, and its contractions.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
LONGEST_CACHED = 64


def tokenizer_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """The path of a public tokenizer's file: in `folder`, or where the public_tokenizers package keeps it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def class_table() -> np.ndarray:
    """The class of each code point below 65,536. UNSURE: control characters, and code points that newer editions of
    Unicode assigned or moved, about which two libraries may disagree."""
    table = np.full(0x10000, UNSURE, np.uint8)
    old = unicodedata.ucd_3_2_0
    for cp in range(0x10000):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind in ("Cc", "Cn", "Cs", "Co", "Cf") or old.category(c) != kind:
            continue
        table[cp] = LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else SPACE if kind[0] == "Z" else OTHER
    for c in "\t\n\x0b\x0c\r":
        table[ord(c)] = SPACE
    return table


@functools.cache
def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    return letters | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}


class Vocabulary:
    """Ids, bytes and merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        letters = {c: b for b, c in byte_letters().items()}
        self.ids: dict[bytes, int] = {}
        self.added = {x["content"]: x["id"] for x in data["added_tokens"]}
        for text, i in data["model"]["vocab"].items():
            if text not in self.added:
                self.ids[bytes(letters[c] for c in text)] = i
        self.size = max([*self.ids.values(), *self.added.values()]) + 1
        self.bytes = [b""] * self.size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for text, i in self.added.items():
            self.bytes[i] = text.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = bytes(letters[c] for c in a), bytes(letters[c] for c in b)
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.pool = np.frombuffer(b"".join(self.bytes), np.uint8)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges that begin at starts and have these lengths, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


class Cache:
    """A bounded map of 64-bit piece hashes to ids: open addressing in arrays, emptied when it is full."""

    def __init__(self, bits: int = 20):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.count = self.used = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        mask = np.int64((1 << self.bits) - 1)
        slots = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.values[slots]
        todo = np.flatnonzero((self.keys[slots] != hashes) & (found >= 0))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & mask
            at = slots[todo]
            found[todo] = self.values[at]
            todo = todo[(self.keys[at] != hashes[todo]) & (found[todo] >= 0)]
        return found

    def room(self, more: int) -> bool:
        return self.count + more <= (1 << self.bits) // 2

    def add(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        """New distinct hashes."""
        n, lengths = len(hashes), np.array([len(x) for x in ids], np.int64)
        flat = np.array([i for x in ids for i in x], np.uint32)
        while self.count + n > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.starts[self.count : self.count + n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.count : self.count + n] = lengths
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        mask = np.int64((1 << self.bits) - 1)
        slots = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        value = np.arange(self.count, self.count + n, dtype=np.int32)
        todo = np.arange(n)
        while len(todo):
            free = todo[self.values[slots[todo]] < 0]
            _, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.keys[slots[put]] = hashes[put]
            self.values[slots[put]] = value[put]
            left = np.ones(n, bool)
            left[put] = False
            todo = todo[left[todo]]
            taken = todo[self.keys[slots[todo]] != hashes[todo]]
            slots[taken] = (slots[taken] + 1) & mask
        self.count += n


class Pieces:
    """Encodes batches of whole texts. encode_pieces: ids of each piece; encode_text: ids of a whole text."""

    def __init__(self, encode_pieces: Callable[[list[str]], list[list[int]]], encode_text: Callable[[str], list[int]], added: tuple[str, ...], bits: int = 21):
        self.encode_pieces, self.encode_text, self.added = encode_pieces, encode_text, added
        self.cache = Cache(bits)
        rng = np.random.default_rng(20_240_229)
        self.of_char = rng.integers(1, 1 << 63, 0x10000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.of_place = rng.integers(1, 1 << 63, LONGEST_CACHED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def encode(self, texts: list[str | None], most_chars: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each). Works through slices of most_chars characters."""
        flat: list[np.ndarray] = []
        sizes = np.zeros(len(texts), np.int64)
        group: list[int] = []
        chars = 0
        for k, text in enumerate(texts):
            if not text:
                continue
            group.append(k)
            chars += len(text)
            if chars >= most_chars:
                flat.append(self._group(texts, group, sizes))
                group, chars = [], 0
        if group:
            flat.append(self._group(texts, group, sizes))
        return (np.concatenate(flat) if flat else np.zeros(0, np.uint32)), sizes

    def _group(self, texts: list[str | None], group: list[int], sizes: np.ndarray) -> np.ndarray:
        """The ids of these texts in order: runs of plain texts by arrays, odd ones by the fallback."""
        out: list[np.ndarray] = []
        table = class_table()
        coded, kinds = {}, {}
        odd = set()
        for k in group:
            text = texts[k]
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            if points.max() >= 0x10000 or any(a in text for a in self.added):
                odd.add(k)
                continue
            kind = table[points]
            if kind.max() == UNSURE:
                odd.add(k)
            else:
                coded[k], kinds[k] = points, kind
        run: list[int] = []
        for k in group:
            if k in odd:
                if run:
                    out.append(self._run([coded[j] for j in run], [kinds[j] for j in run], run, sizes))
                    run = []
                ids = np.array(self.encode_text(texts[k]), np.uint32)
                sizes[k] = len(ids)
                out.append(ids)
            else:
                run.append(k)
        if run:
            out.append(self._run([coded[j] for j in run], [kinds[j] for j in run], run, sizes))
        return np.concatenate(out)

    def _run(self, coded: list[np.ndarray], kinds: list[np.ndarray], run: list[int], sizes: np.ndarray) -> np.ndarray:
        points, kind = np.concatenate(coded), np.concatenate(kinds)
        ends = np.cumsum([len(x) for x in coded])
        begins = ends - [len(x) for x in coded]
        starts = piece_starts(points, kind, begins)
        lengths = np.diff(np.append(starts, len(points)))
        place = np.arange(len(points)) - np.repeat(starts, lengths)
        np.minimum(place, LONGEST_CACHED - 1, out=place)
        hashes = np.add.reduceat(self.of_char[points] * self.of_place[place], starts)
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(32)
        long = lengths > LONGEST_CACHED
        found = self.cache.find(hashes)
        found[long] = -1
        new = np.flatnonzero((found < 0) & ~long)
        if len(new):
            distinct, first = np.unique(hashes[new], return_index=True)
            if not self.cache.room(len(distinct)):
                self.cache.clear()
                distinct, first = np.unique(hashes[~long], return_index=True)
                new = np.flatnonzero(~long)
                if not self.cache.room(len(distinct)):
                    raise ValueError("a slice has more distinct pieces than the cache has room for")
            at = new[first]
            raw = points.astype("<u4")
            self.cache.add(distinct, self.encode_pieces([raw[s : s + n].tobytes().decode("utf-32-le") for s, n in zip(starts[at].tolist(), lengths[at].tolist(), strict=True)]))
            found = self.cache.find(hashes)
            found[long] = -1
        counts = np.where(long, 0, self.cache.lengths[found])
        if long.any():
            return self._with_long(points, starts, lengths, found, long, counts, begins, run, sizes)
        ids = self.cache.pool[ragged(self.cache.starts[found], counts)]
        sizes[run] = np.add.reduceat(counts, np.searchsorted(starts, begins))
        return ids

    def _with_long(self, points, starts, lengths, found, long, counts, begins, run, sizes) -> np.ndarray:
        raw = points.astype("<u4")
        at = np.flatnonzero(long)
        ids_of = self.encode_pieces([raw[starts[i] : starts[i] + lengths[i]].tobytes().decode("utf-32-le") for i in at])
        out, last = [], 0
        for i, ids in zip(at, ids_of, strict=True):
            out.append(self.cache.pool[ragged(self.cache.starts[found[last:i]], counts[last:i])])
            out.append(np.array(ids, np.uint32))
            last = i + 1
        out.append(self.cache.pool[ragged(self.cache.starts[found[last:]], counts[last:])])
        counts = counts.copy()
        counts[at] = [len(x) for x in ids_of]
        sizes[run] = np.add.reduceat(counts, np.searchsorted(starts, begins))
        return np.concatenate(out)


def piece_starts(points: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pieces of PATTERN start in texts that begin at `begins`, all code points being of known classes."""
    n = len(points)
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    first = np.zeros(n + 1, bool)
    first[begins] = True
    start |= first[:-1]
    # the last white space before something else is a piece of its own, or, if a blank, opens the next piece
    before = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:-1]) if n > 1 else np.zeros(0, np.int64)
    start[before] = True
    start[before[points[before] == 32] + 1] = False
    # contractions: an apostrophe that opens a piece takes its letters with it
    marks = np.flatnonzero(start & (points == 39))
    if len(marks):
        limits = np.append(begins, n)
        ends = limits[np.searchsorted(limits, marks, side="right")]
        letters = [np.where(marks + j < ends, points[np.minimum(marks + j, n - 1)], 0) for j in (1, 2)]
        for short in CONTRACTIONS:
            hit = np.ones(len(marks), bool)
            for have, c in zip(letters, short, strict=False):
                hit &= have == ord(c)
            at = marks[hit]
            start[at + 1] = False
            after = at + 1 + len(short)
            after = after[after < ends[hit]]
            # the rest of a run of letters is a new piece; after other things one starts there anyway,
            # unless a blank before it has taken it in
            start[after] = True
    return np.flatnonzero(start)


class LibraryPieces(Pieces):
    """Pieces that the tokenizers library encodes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        added = tuple(x.content for x in tokenizer.get_added_tokens_decoder().values())

        def encode_pieces(pieces: list[str], together: int = 200) -> list[list[int]]:
            """In one text, a line for each piece: a line end beside a piece that is no white space is its own piece."""
            out: list[list[int]] = [[] for _ in pieces]
            lined = [k for k, p in enumerate(pieces) if not p.isspace()]
            alone = [k for k, p in enumerate(pieces) if p.isspace()]
            for i in range(0, len(lined), together):
                own = lined[i : i + together]
                made = tokenizer.encode("\n".join([pieces[k] for k in own]), add_special_tokens=False)
                words = made.word_ids
                if words[-1] != 2 * len(own) - 2:
                    alone += own
                    continue
                for w, token in zip(words, made.ids, strict=True):
                    if not w & 1:
                        out[own[w >> 1]].append(token)
            for k, x in zip(alone, tokenizer.encode_batch_fast([pieces[k] for k in alone], add_special_tokens=False), strict=True):
                out[k] = x.ids
            return out

        super().__init__(
            encode_pieces,
            lambda text: tokenizer.encode(text, add_special_tokens=False).ids,
            added,
        )


class Transducer:
    """Streaming BPE: bytes in, tokens out as soon as no later byte can change them.

    A window of bytes is encoded by the one sequence of tokens whose neighbours are all stable side by side; tokens
    that end at least `lookahead` bytes before the window's end are emitted, and the window moves on behind them.
    It never holds more than lookahead + one token + one part of input.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.longest = max(len(b) for b in vocabulary.ids)
        self.split: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for (a, b), (rank, whole) in vocabulary.merges.items():
            if whole not in self.split:
                self.split[whole], self.rank[whole] = (a, b), rank
        self.longest_with: dict[bytes, int] = {}
        for b in vocabulary.ids:
            if len(b) >= 3:
                self.longest_with[b[:3]] = max(self.longest_with.get(b[:3], 0), len(b))
        self.lookahead = self.sufficient_lookahead()
        self.pairs: dict[tuple[int, int], bool] = {}

    def sufficient_lookahead(self) -> int:
        """Bytes after which a token cannot change any more, from the merge list alone.

        A merge (a, b) can be pre-empted by an earlier merge (b, c), that one by an earlier (c, d), and so on; b, c
        and d must themselves be formed, which depends on what can pre-empt the last merge inside them. In order of
        rank, each merge reaches as far as its right side is long, and then as far as any earlier merge that begins
        with that side, or any that can break the side up. The largest reach, and one longest token, suffice.
        """
        begins: dict[int, int] = {}
        inside: dict[int, int] = {}
        most = 0
        for (a, b), (_, whole) in sorted(self.v.merges.items(), key=lambda x: x[1][0]):
            beyond = max(begins.get(b, 0), inside.get(b, 0))
            own = int(self.v.lengths[b]) + beyond
            inside[whole] = max(inside.get(whole, 0), beyond)
            begins[a] = max(begins.get(a, 0), own)
            most = max(most, own)
        return most + self.longest

    def stable(self, a: int, b: int) -> bool:
        """Whether tokens a, b side by side stay two tokens: no merge across their border comes before theirs."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self._stable(a, b)
        return known

    def _stable(self, left: int, right: int) -> bool:
        merges, split, rank = self.v.merges, self.split, self.rank
        before = 1 << 60  # merges across the border of a lower rank would have come first
        while True:
            across = merges.get((left, right))
            if across is not None and across[0] < before:
                return False
            left_rank, right_rank = rank.get(left, -1), rank.get(right, -1)
            if left_rank < 0 and right_rank < 0:
                return True
            # undo the later merge; of equal ones the right, since merges of one rank run from left to right
            if left_rank > right_rank:
                before, left = left_rank, split[left][1]
            else:
                before, right = right_rank + 1, split[right][0]

    def window(self, raw: bytes) -> list[int]:
        """The tokens of a whole window: longest candidates first, back where no stable neighbour follows."""
        ids, longest_with, n = self.v.ids, self.longest_with, len(raw)
        whole = ids.get(raw)
        if whole is not None:
            return [whole]
        out: list[int] = []
        ends: list[int] = []
        dead = bytearray(n + 1)
        at, most = 0, n
        while at < n:
            length = min(most, n - at, longest_with.get(raw[at : at + 3], 2))
            last = out[-1] if out else -1
            while length > 0:
                if not dead[at + length]:
                    token = ids.get(raw[at : at + length])
                    if token is not None and (last < 0 or self.stable(last, token)):
                        break
                length -= 1
            if length:
                out.append(token)
                at += length
                ends.append(at)
                most = n
            else:
                dead[at] = 1
                if not out:
                    raise ValueError("bytes that the vocabulary cannot spell")
                out.pop()
                ends.pop()
                start = ends[-1] if ends else 0
                most = at - start - 1
                at = start
        return out

    def stream(self, parts) -> Iterator[list[int]]:
        """Lists of settled tokens of bytes that come in parts."""
        held = b""
        for part in parts:
            held += part
            if len(held) <= self.lookahead + self.longest:
                continue
            settled, end = [], 0
            for token in self.window(held):
                if end + len(self.v.bytes[token]) > len(held) - self.lookahead:
                    break
                settled.append(token)
                end += len(self.v.bytes[token])
            held = held[end:]
            yield settled
        if held:
            yield self.window(held)

    def encode(self, piece: bytes, part: int = 1024) -> list[int]:
        if len(piece) <= self.lookahead:
            return self.window(piece) if piece else []
        return [t for tokens in self.stream(piece[i : i + part] for i in range(0, len(piece), part)) for t in tokens]


class TransducerPieces(Pieces):
    """Pieces that the streaming transducer encodes; odd texts are split by PATTERN, added tokens found first."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        transducer = self.transducer = Transducer(self.vocabulary)
        pattern = regex.compile(PATTERN)
        added = self.vocabulary.added
        cut = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(added, key=len, reverse=True)) + ")") if added else None

        def encode_pieces(pieces: list[str]) -> list[list[int]]:
            return [transducer.encode(p.encode("utf-8", "surrogatepass")) for p in pieces]

        def encode_text(text: str) -> list[int]:
            out: list[int] = []
            for part in cut.split(text) if cut else [text]:
                if part in added:
                    out.append(added[part])
                else:
                    for p in encode_pieces(pattern.findall(part)):
                        out += p
            return out

        super().__init__(encode_pieces, encode_text, tuple(added))


@functools.cache
def library_pieces(path: str | None = None) -> LibraryPieces:
    """One encoder for each Python worker, kept between tasks."""
    return LibraryPieces(path or tokenizer_path())


@functools.cache
def transducer_pieces(path: str | None = None) -> TransducerPieces:
    return TransducerPieces(path or tokenizer_path())


class Decoder:
    """Incremental decoding: token ids become bytes by table, bytes become text by a state machine that keeps an
    unfinished character between calls and writes U+FFFD for bytes that are none."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return self.v.pool[ragged(self.v.starts[ids], self.v.lengths[ids])].tobytes()

    def feed(self, ids: np.ndarray, final: bool = False) -> str:
        return self.machine.decode(self.bytes_of(ids), final)

    def decode(self, ids: np.ndarray, chunk: int = 65_536) -> Iterator[str]:
        self.machine.reset()
        for i in range(0, len(ids), chunk):
            yield self.feed(ids[i : i + chunk])
        yield self.machine.decode(b"", True)
