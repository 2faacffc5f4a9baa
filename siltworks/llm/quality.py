"""Quality rules: exact counting rules, then divergence from the histograms of a language.

A text's histogram of character classes and its histogram of common words are compared with each language's
reference by the Jensen-Shannon distance. References are sums over all documents that pass the counting rules. A text
stays if it is near its own language's reference or near another one's.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stage, lean, ship, slices, table

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
CLASSES = ("space", "line end", "lower", "upper", "digit", "stop", "quote", "symbol", "other ASCII", "beyond ASCII", "inner byte")


def _class_of(byte: int) -> int:
    c = bytes([byte])
    if c == b"\n":
        return 1
    if c in WHITE:
        return 0
    if byte >= 0xC0:
        return 9
    if byte >= 0x80:
        return 10
    if c.islower():
        return 2
    if c.isupper():
        return 3
    if c.isdigit():
        return 4
    if c in b".,;:!?":
        return 5
    if c in b"'\"()-":
        return 6
    if c in SYMBOLS:
        return 7
    return 8


CLASS_TABLE = np.array([_class_of(b) for b in range(256)])
SYMBOL_BYTES = list(SYMBOLS)
WHITE_BYTES = list(WHITE)


@dataclass(frozen=True)
class Rules:
    """Parameters. least_words guards the rules, since histograms of short texts say little, and so do class_guard and
    word_guard, which widen the bounds by a guard / words. common_words: how many words of a language are its common
    ones, by count, of at most common_length bytes (function words are short). reference_guard: another language's
    reference of n words is worth n / (n + reference_guard) of the bounds, so that a few texts do not vouch for all."""

    least_words: int = 50
    repeated_percent: int = 50
    common_words: int = 40
    common_length: int = 6
    class_divergence: float = 0.04
    class_guard: float = 1.5
    word_divergence: float = 0.17
    word_guard: float = 2.0
    reference_guard: float = 20_000.0


def counts(text: str | None) -> tuple[list[bytes], np.ndarray, tuple[int, int, int, int, int]]:
    """Words, byte histogram and (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    if not text:
        return [], np.zeros(256, np.int64), (0, 0, 0, 0, 0)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = len(text) - int(hist[WHITE_BYTES].sum())
    lines = raw.split(b"\n")
    repeated_lines = 0
    if len(lines) > 1 and len(set(lines)) < len(lines):
        full = [x for x in lines if x and not x.isspace()]
        repeated_lines = len(full) - len(set(full))
    repeats = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            last = -1  # the last word counted so far
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeats += i + 2 - max(last, i - 1)
                    last = i + 2
    return words, hist, (n, chars, int(hist[SYMBOL_BYTES].sum()), repeated_lines, repeats)


def base_fails(rules: Rules, n_words: int, n_repeat_words: int) -> bool:
    return n_words < rules.least_words or 100 * n_repeat_words > rules.repeated_percent * n_words


def class_histogram(hist: np.ndarray) -> np.ndarray:
    return np.bincount(CLASS_TABLE, weights=hist, minlength=len(CLASSES))


def plain(word: bytes) -> bytes:
    """A word as counted: lower case without the stops around it."""
    return word.strip(b".,;:!?'\"()-").lower()


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon divergence in bits of two histograms; its root is the distance. Empty: 1."""
    a, b = p.sum(), q.sum()
    if a <= 0 or b <= 0:
        return 1.0
    p, q = p / a, q / b
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum()
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum()
    return float(max(0.0, (left + right) / 2))


@dataclass(frozen=True)
class Reference:
    """Of one language: class histogram, common words and their histogram (the last bin: all other words), all words."""

    classes: np.ndarray
    common: dict[bytes, int]
    weights: np.ndarray
    words: float


def common_words(words: list[bytes], rules: Rules) -> Counter:
    """The words of a text that can be common ones, as counted."""
    found = Counter(words)
    out: Counter = Counter()
    for w, n in found.items():
        k = plain(w)
        if 0 < len(k) <= rules.common_length:
            out[k] += n
    return out


def references(stage: Stage, docs: DataFrame, rules: Rules) -> dict[str, Reference]:
    """Each language's reference: sums over all documents that pass the counting rules.

    Rows of sums are (language, word), and what reaches the driver is common_words + classes numbers for each language.
    """
    names = ["lang", "kind", "name", "n"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in slices(batches, 256):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, hist, (n, _, _, _, repeats) = counts(text)
                if base_fails(rules, n, repeats):
                    continue
                own = found.setdefault(lang or "", Counter())
                own.update(common_words(words, rules))
                own["words"] += n
                for i, v in enumerate(class_histogram(hist)):
                    own[i] += int(v)
            if sum(map(len, found.values())) > 200_000:
                yield rows(found)
                found = {}
        yield rows(found)

    def rows(found: dict[str, Counter]) -> pa.RecordBatch:
        out = [(lang, "w", k.decode("utf-8", "replace"), v) if isinstance(k, bytes) else (lang, "n" if k == "words" else "c", str(k), v) for lang, own in found.items() for k, v in own.items()]
        return pa.record_batch([pa.array([x[i] for x in out], pa.int64() if i == 3 else pa.string()) for i in range(4)], names)

    sums = docs.select("lang", "text").mapInArrow(lean(partial), "lang string, kind string, name string, n long").groupBy("lang", "kind", "name").agg(F.sum("n").alias("n"))
    place = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "name")
    likely = stage.write(sums.withColumn("place", F.row_number().over(place)).where(F.col("place") <= max(rules.common_words, len(CLASSES))), "sums")
    found = likely.collect()
    stage.drop(likely)
    out = {}
    for lang in sorted({r["lang"] for r in found}):
        own = [r for r in found if r["lang"] == lang]
        classes = np.zeros(len(CLASSES))
        for r in own:
            if r["kind"] == "c":
                classes[int(r["name"])] = r["n"]
        common = sorted((r for r in own if r["kind"] == "w"), key=lambda r: r["place"])[: rules.common_words]
        total = float(sum(r["n"] for r in own if r["kind"] == "n"))
        weights = np.array([r["n"] for r in common] + [0], float)
        weights[-1] = max(0, total - weights.sum())
        out[lang] = Reference(classes, {r["name"].encode(): i for i, r in enumerate(common)}, weights, total)
    return out


def verdict(rules: Rules, refs: dict[str, Reference], lang: str, words: list[bytes], hist: np.ndarray, n: int) -> tuple[bool, float, float]:
    """Whether a text is near enough to its own language or another one, and its divergences from the nearest.

    The bounds grow for short texts by a guard / words: a histogram of few words is uneven by chance. They shrink for
    other languages with small references. A text that passes the counting rules is in its own language's reference.
    """
    classes = class_histogram(hist)
    best = (math.inf, 1.0, 1.0)
    plains = common_words(words, rules)
    for name, ref in refs.items():
        worth = 1.0 if name == lang else ref.words / (ref.words + rules.reference_guard)
        most_class = worth * (rules.class_divergence + rules.class_guard / max(1, n))
        most_word = worth * (rules.word_divergence + rules.word_guard / max(1, n))
        a = divergence(classes, ref.classes)
        own = np.zeros(len(ref.weights))
        for w, i in ref.common.items():
            own[i] = plains.get(w, 0)
        own[-1] = max(0, n - own.sum())
        b = divergence(own, ref.weights)
        best = min(best, (max(a / most_class, b / most_word), a, b))
    return best[0] <= 1.0, best[1], best[2]


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_jsd double, word_jsd double, kept boolean"


def quality_rules(spark: SparkSession, docs: DataFrame, rules: Rules | None = None, keep: list[str] | None = None) -> DataFrame:
    """Applies the counting rules and the divergence rules to every whole text.

    docs: doc_id, text, lang. A null language is a group of its own, like the empty one. keep: input columns to return,
    doc_id by default; those that share a name with a result column are dropped. Null and empty texts have no words and
    fail the counting rules; a text that fails them has null divergences. A language of one text is that text's
    reference, so it stays. Repeated rows are judged one by one; an empty table gives no rows.
    """
    rules = rules or Rules()
    ship(spark)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    taken = [c for c in (keep or ["doc_id"]) if c not in names]
    refs = references(Stage(spark, "quality"), docs, rules)
    types = {"boolean": pa.bool_(), "double": pa.float64(), "long": pa.int64()}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            rows = []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, hist, base = counts(text)
                failed = base_fails(rules, base[0], base[4])
                kept, a, b = (False, None, None) if failed else verdict(rules, refs, lang or "", words, hist, base[0])
                rows.append((*base, failed, a, b, kept))
            made = [pa.array(x, types[c.split()[1]]) for x, c in zip(zip(*rows, strict=True), COLUMNS.split(", "), strict=True)]
            yield pa.record_batch([*batch.columns[2:], *made], [*taken, *names])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in taken), COLUMNS])
    given = [F.col("text").alias("_text"), F.col("lang").alias("_lang"), *(F.col(f"`{c}`") for c in taken)]
    return docs.select(*given).mapInArrow(lean(judge), schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting rules and divergence rules on all documents; the edge cases are those of quality_rules."""
    return quality_rules(spark, table(spark, sf_dir, "documents"))
