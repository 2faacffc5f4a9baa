"""Burrows-Wheeler transforms of small shards of texts, merged by iterative interleave refinement.

Symbols are words of STEP bytes (every suffix has one, its successor starts STEP bytes on), so a merge to a depth of
100 bytes takes 13 rounds in place of 100. A merge knows only the shards' transforms: an interleave says which shard
each row of the merged transform comes from, and each round sorts it stably by the rows' symbols. Rows that no
round has told apart are a block; the blocks left at the end are the repeated strings.
"""

from __future__ import annotations

import numpy as np

STEP = 8
SHARD_BYTES = 1 << 15


def grams(raw: np.ndarray, following: np.ndarray, width: int) -> np.ndarray:
    """The `width` bytes from each place as one number; following: the next place in the same (cyclic) text."""
    out = raw.astype(np.uint64)
    at = following
    for _ in range(width - 1):
        out = (out << np.uint64(8)) | raw[at]
        at = following[at]
    return out


def jump(following: np.ndarray, n: int) -> np.ndarray:
    out = np.arange(len(following))
    for _ in range(n):
        out = following[out]
    return out


def shard_order(ranks: np.ndarray, step: np.ndarray, rounds: int) -> np.ndarray:
    """Places in the order of their suffixes, by prefix doubling; step: the place STEP bytes on."""
    for _ in range(rounds):
        pairs = ranks.astype(np.uint64) << np.uint64(32) | ranks[step].astype(np.uint64)
        order = np.argsort(pairs, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(pairs[order][1:] != pairs[order][:-1])])
        ranks = np.empty(len(ranks), np.int64)
        ranks[order] = fresh
        step = step[step]
    return np.argsort(ranks, kind="stable")


def repeated(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, block) of all places of all texts, sorted so that equal strings of `depth` bytes are one block.

    Each text is followed by a zero byte and read as a ring; only places with `depth` bytes before their text's end
    mean something to the caller.
    """
    lengths = np.array([len(t) + 1 for t in texts])
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    n = len(raw)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    following = np.arange(1, n + 1)
    following[ends - 1] = begins
    before = np.empty(n, np.int64)
    before[following] = np.arange(n)

    # shards of whole texts
    shard_of_text = (begins // SHARD_BYTES).astype(np.int64)
    _, shard_of_text = np.unique(shard_of_text, return_inverse=True)
    shard = np.repeat(shard_of_text, lengths)
    kind = np.uint8 if shard[-1] < 256 else np.uint16 if shard[-1] < 65_536 else np.int64

    words = grams(raw, following, STEP)
    alphabet, ranks = np.unique(words, return_inverse=True)
    forward = jump(following, STEP)
    rounds = 0
    while STEP << rounds < depth:
        rounds += 1
    order = np.concatenate([s + shard_order(ranks[s:e], forward[s:e] - s, rounds) for s, e in zip(*_spans(shard), strict=True)])

    symbol_kind = np.uint16 if len(alphabet) <= 65_536 else np.int64
    back = jump(before, STEP)
    transform = ranks[back[order]].astype(symbol_kind)
    from_shard = shard.astype(kind)
    interleave = from_shard.copy()
    new_block = np.zeros(n, bool)
    new_block[0] = True
    whole, rest = divmod(depth, STEP)
    for turn in range(whole + (rest > 0)):
        if turn == whole:
            # the last round steps over the rest of the depth only
            short, short_ranks = np.unique(grams(raw, following, rest), return_inverse=True)
            transform = short_ranks[jump(before, rest)[order]].astype(np.uint16 if len(short) <= 65_536 else np.int64)
        row = np.empty(n, np.int64)
        row[np.argsort(interleave, kind="stable")] = np.arange(n)  # the row of its own shard's transform
        symbols = transform[row]
        by_symbol = np.argsort(symbols, kind="stable")
        block = np.cumsum(new_block)[by_symbol]
        symbols = symbols[by_symbol]
        new_block[1:] = (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1])
        interleave = interleave[by_symbol]
    row = np.empty(n, np.int64)
    row[np.argsort(interleave, kind="stable")] = np.arange(n)
    return order[row], np.cumsum(new_block)


def _spans(shard: np.ndarray) -> tuple[list[int], list[int]]:
    cuts = (np.flatnonzero(np.diff(shard)) + 1).tolist()
    return [0, *cuts], [*cuts, len(shard)]
