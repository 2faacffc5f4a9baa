"""Documents with every awkward case, and plain versions of what the operators compute."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    return [f"w{rng.randrange(size):x}é"[: rng.randint(2, 5)] + str(rng.randrange(size)) for _ in range(n)]


def documents(seed: int = 1, n: int = 24) -> list[tuple]:
    """Plain texts, exact and near copies, a shared passage, null and empty texts, a long text, odd characters."""
    rng = random.Random(seed)
    base = [words(rng, rng.randint(60, 120)) for _ in range(n)]
    passage = " ".join(words(rng, 60))
    out = [" ".join(b) for b in base]
    out += [out[0], out[0], out[3]]
    for k in (1, 2):
        for _ in range(3):
            near = list(base[k])
            near[rng.randrange(len(near))] = "changed"
            out.append(" ".join(near))
    out += [f"{out[5]}\n{passage}", f"{passage} {out[6]}", passage, "", None, " \n\t ", "one", "Two words", "a" * 3000, "🙂 漢字 <|endoftext|> \x00 end's", "x " * 500]
    out.append(" ".join(words(rng, 6000)))
    order = list(range(len(out)))
    rng.shuffle(order)
    return [(i * 3, out[k], None if i % 7 == 0 else "en", "s", None) for i, k in enumerate(order)]


def frame(spark, rows, extra: bool = False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in ("score", "kept", "start", "rank", "a", "h1", "n", "doc", "length"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def lower_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def shingles(text: str | None, width: int) -> frozenset:
    w = lower_words(text)
    if not w:
        return frozenset()
    return frozenset(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)])


def groups(ids: list, linked) -> dict:
    """The smallest id that each id reaches."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def without_repeats(texts: list[str | None], depth: int) -> list[tuple[bytes, list[bool]]]:
    """Texts in order, and which of their bytes lie in a string that started earlier."""
    seen, out = set(), []
    for text in texts:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - depth + 1):
            if raw[s : s + depth] in seen:
                gone[s : s + depth] = [True] * depth
            seen.add(raw[s : s + depth])
        out.append((raw, gone))
    return out
