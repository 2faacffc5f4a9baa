"""Toxicity by a weighted finite-state pattern grammar over the clauses of a text.

Words become symbols (insult, threat, target, negation, report, quotation mark, other word). The transducers of negation,
report, quotation and target are composed into one machine over the symbols of a clause, which gives each insult or
threat a reading: plain, targeted, negated or reported. A matched clause scores its readings; a text's score is logistic
in the scores of its clauses. The weights of insults (words and word beginnings), threats (phrases) and readings are
learned from labelled documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, lean, ship, slices, table

# Seeds and function words of the grammar in the languages of the corpus.
THREATS = ("kill you", "kill them", "hurt you", "beat you", "shoot you", "hunt you", "burn you", "destroy you", "make you pay", "you will die", "töte dich", "bringe dich um", "te voy a matar", "vais te tuer")
INSULTS = frozenset("idiot idiots moron morons stupid loser losers trash scum pathetic worthless disgusting clown imbecile dumbass bastard bitch asshole idiota estúpido imbécil imbécile connard salaud idiotin dummkopf arschloch vollidiot".split())
SEED_WEIGHT = 4.0
TARGETS = frozenset("you your you're youre u he she they them him her his their this these those i we du dich dir ihr euch sie er tu te toi vous ton ta il elle ils tú usted ustedes ellos ella él".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't doesn't hardly without neither nor nicht kein keine keinen nie niemals ne pas jamais non nunca jamás ni".split())
REPORTS = frozenset("said says wrote writes called quoted quote reported reports claimed term word phrase sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())

STOPS = ".!?;\n"
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
STOP = re.compile(r"[.!?;\n]")
QUOTE = re.compile("[\"“”«»„]")
READINGS = ("plain", "targeted", "negated", "reported", "threat", "threat_reported")
#: Symbols of a clause: other word, insult, threat, target, negation, verb of reporting, quotation mark.
WORD_, INSULT, THREAT, TARGET, NEGATION, REPORT, MARK = range(7)
AIMED, NEGATED, REPORTED, QUOTED = 1, 2, 4, 8


@dataclass(frozen=True)
class Machine:
    """A finite-state transducer that is deterministic: by state and symbol, the next state and the output's bits."""

    step: tuple[tuple[int, ...], ...]
    out: tuple[tuple[int, ...], ...]


def scope(opening: int, reach: int, bit: int) -> Machine:
    """Writes `bit` at each of the `reach` words that follow the opening symbol. State: words left."""
    step = tuple(tuple(left if s == MARK else reach if s == opening else max(0, left - 1) for s in range(7)) for left in range(reach + 1))
    out = tuple(tuple(bit if left and s not in (MARK, opening) else 0 for s in range(7)) for left in range(reach + 1))
    return Machine(step, out)


def quotation() -> Machine:
    """Writes QUOTED at each word between quotation marks. State: whether a mark is open."""
    return Machine(tuple(tuple(1 - q if s == MARK else q for s in range(7)) for q in (0, 1)), tuple(tuple(QUOTED if q and s != MARK else 0 for s in range(7)) for q in (0, 1)))


def compose(first: Machine, second: Machine) -> Machine:
    """The transducer that runs both on one input and writes both outputs; only states that can be reached."""
    places, todo, step, out = {(0, 0): 0}, [(0, 0)], [], []
    for a, b in todo:
        following = []
        for s in range(7):
            pair = (first.step[a][s], second.step[b][s])
            if pair not in places:
                places[pair] = len(places)
                todo.append(pair)
            following.append(places[pair])
        step.append(tuple(following))
        out.append(tuple(x | y for x, y in zip(first.out[a], second.out[b], strict=True)))
    return Machine(tuple(step), tuple(out))


def _reading(symbol: int, bits: int) -> int:
    """The reading that the grammar gives an insult or a threat in these scopes; -1: no anchor."""
    if symbol == INSULT:
        return 3 if bits & (REPORTED | QUOTED) else 2 if bits & NEGATED else 1 if bits & AIMED else 0
    if symbol == THREAT:
        return 5 if bits & (REPORTED | QUOTED | NEGATED) else 4
    return -1


READING = tuple(tuple(_reading(s, b) for b in range(16)) for s in range(7))


class Transducer:
    """The composed grammar of a clause: one machine from the left (negation, report, quotation, target) and one from
    the right (target after the anchor), whose outputs together choose an anchor's reading."""

    def __init__(self, reach: int):
        self.left = compose(compose(scope(NEGATION, reach, NEGATED), scope(REPORT, reach, REPORTED)), compose(quotation(), scope(TARGET, reach, AIMED)))
        self.right = scope(TARGET, reach, AIMED)

    def readings(self, symbols: list[int]) -> list[tuple[int, int]]:
        """(place, reading) of each anchor of a clause."""
        after, state = [0] * len(symbols), 0
        for i in range(len(symbols) - 1, -1, -1):
            after[i] = self.right.out[state][symbols[i]]
            state = self.right.step[state][symbols[i]]
        out, state = [], 0
        for i, s in enumerate(symbols):
            reading = READING[s][self.left.out[state][s] | after[i]]
            state = self.left.step[state][s]
            if reading >= 0:
                out.append((i, reading))
        return out


@dataclass(frozen=True)
class Grammar:
    """Learned and fixed parts. words, stems (word beginnings) and threats (phrases): log-odds weights (at most `most`);
    readings: factors; bias: of the logistic score; reach: words in the scope of a negation, report or target."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREATS, 6.0))
    readings: tuple[float, ...] = (5.0, 6.0, 2.0, 2.0, 8.0, 2.0)
    bias: float = -3.0
    reach: int = 4
    most: float = 6.0


class Matcher:
    """Finds anchors (insults, word beginnings, threats) in one scan and reads each clause that has one."""

    def __init__(self, grammar: Grammar):
        self.grammar, self.transducer = grammar, Transducer(grammar.reach)
        self.automaton = ahocorasick.Automaton()
        for text in {*grammar.words, *grammar.stems, *grammar.threats}:
            self.automaton.add_word(text, len(text))
        self.automaton.make_automaton()
        self.stems = sorted({len(s) for s in grammar.stems})
        self.phrases = re.compile("|".join(rf"\b{re.escape(t)}\b" for t in sorted(grammar.threats, key=len, reverse=True)) or r"(?!)")

    def weight(self, word: str) -> float:
        found = self.grammar.words.get(word, 0.0)
        for n in self.stems:
            if len(word) >= n:
                found = max(found, self.grammar.stems.get(word[:n], 0.0))
        return found

    def symbols(self, text: str) -> tuple[list[int], list[float]]:
        """Symbols of a lower-case clause and their weights."""
        threats = {m.start(): m.end() for m in self.phrases.finditer(text)}
        marks = [m.start() for m in QUOTE.finditer(text)]
        symbols, weights, mark, inside = [], [], 0, 0

        def add(symbol: int, weight: float = 0.0) -> None:
            symbols.append(symbol)
            weights.append(weight)

        for m in WORD.finditer(text):
            while mark < len(marks) and marks[mark] < m.start():
                add(MARK)
                mark += 1
            word = m.group()
            if m.start() in threats:
                inside = threats[m.start()]
                add(THREAT, self.grammar.threats[text[m.start() : inside]])
            elif m.start() >= inside:
                w = self.weight(word)
                if w > 0:
                    add(INSULT, w)
                else:
                    add(NEGATION if word in NEGATIONS else REPORT if word in REPORTS else TARGET if word in TARGETS else WORD_)
        return symbols, weights

    def clauses(self, text: str | None) -> Iterator[tuple[int, int, np.ndarray]]:
        """(begin, end, sum of weights by reading) of each whole clause that the grammar matches."""
        if not text or not len(self.automaton):
            return
        low = text.lower()
        done = 0
        for last, length in self.automaton.iter(low):
            start = last - length + 1
            if start < done or start and low[start - 1].isalpha():
                continue
            begin = max(done, 1 + max(low.rfind(s, done, start) for s in STOPS))
            stop = STOP.search(low, last + 1)
            done = stop.start() if stop else len(low)
            symbols, weights = self.symbols(low[begin:done])
            found = np.zeros(len(READINGS))
            for place, reading in self.transducer.readings(symbols):
                found[reading] += weights[place]
            if found.any():
                yield begin, done, found

    def clause_score(self, found: np.ndarray) -> float:
        return float(np.dot(self.grammar.readings, found / self.grammar.most))

    def read(self, text: str | None) -> tuple[np.ndarray, int, str | None]:
        """Sums over all matched clauses, at most 4 of a reading, their number, and the clause of the highest score."""
        sums, n, worst = np.zeros(len(READINGS)), 0, (0.0, None)
        for begin, end, found in self.clauses(text):
            sums += found / self.grammar.most
            n += 1
            scored = self.clause_score(found)
            if scored > worst[0]:
                worst = (scored, text.lower()[begin:end] if len(text.lower()) != len(text) else text[begin:end])
        return np.minimum(sums, 4.0), n, worst[1]

    def score(self, sums: np.ndarray) -> float:
        z = self.grammar.bias + float(np.dot(self.grammar.readings, sums))
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, z))))


def _features(text: str, stem_lengths: tuple[int, ...]) -> set[str]:
    """Words, word beginnings, and words before a target, which may be threats."""
    own = WORD.findall(text.lower())
    words = set(own)
    return {f"w:{w}" for w in words} | {f"s:{w[:n]}" for w in words for n in stem_lengths if len(w) > n} | {f"t:{a} {b}" for a, b in zip(own, own[1:], strict=False) if b in TARGETS and a not in TARGETS}


def learn(stage: Stage, docs: DataFrame, labelled: DataFrame, most_labelled: int, stem_lengths: tuple[int, ...], least_docs: int, least_weight: float) -> Grammar:
    """Learns the weights from at most most_labelled labelled documents (those of lowest hashed id).

    labelled: doc_id, toxic. Texts that are wholly equal count once, at the mean of their labels. A pattern of at least
    least_docs toxic documents weighs its log-odds ratio, smoothed by its counts and times the probability that it is
    related to the labels at all (see _weights), so that little evidence makes a small weight; weights of less than
    least_weight, which would not move a score by a tenth, are left out. Patterns are words, word beginnings, and words
    before a target, as threats. They are counted in Spark; what reaches the driver is a histogram of the counts, the
    patterns of the bounded sample, then a row of readings for each document of it.
    """
    chosen = labelled.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    # copies of one whole text are no independent evidence: they count once, at the mean of all their labels
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.avg("toxic").alias("toxic"))
    sample = stage.write(sample, "sample")
    names = ["name", "pos", "neg"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            n, pos = Counter(), Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _features(text or "", stem_lengths)
                n.update(own)
                if toxic:
                    for x in own:
                        pos[x] += toxic
            yield pa.record_batch([pa.array([*n], pa.string()), pa.array([float(pos[x]) for x in n], pa.float64()), pa.array([float(n[x] - pos[x]) for x in n], pa.float64())], names)

    n_pos, n_neg = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0.0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0.0))).first()
    if not n_pos or not n_neg:
        stage.drop(sample)
        return Grammar(words=dict.fromkeys(INSULTS, SEED_WEIGHT))
    share = n_pos / (n_pos + n_neg)
    counted = sample.mapInArrow(lean(count), "name string, pos double, neg double").groupBy("name").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counted = stage.write(counted, "counted")
    histogram = counted.groupBy(F.round("pos").alias("pos"), F.round("neg").alias("neg")).agg(F.count("*").alias("n")).collect()
    related = _related(*(np.array([r[c] for r in histogram], float) for c in ("pos", "neg", "n")), share)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = _weights(batch.column(1).to_numpy(), batch.column(2).to_numpy(), share, related) if batch.num_rows else np.zeros(0)
            yield pa.record_batch([batch.column(0), pa.array(weight, pa.float64())], ["name", "weight"])

    found = (
        counted.where((F.col("pos") >= least_docs) & (F.col("pos") * n_neg > F.col("neg") * n_pos))
        .mapInArrow(lean(weigh), "name string, weight double")
        .where(F.col("weight") >= least_weight)
        .collect()
    )
    seeds = [*(f"w:{w}" for w in INSULTS), *(f"t:{t}" for t in THREATS)]
    # a seed counts unless the labels speak against it
    against = {r["name"] for r in counted.where(F.col("name").isin(seeds)).collect() if r["pos"] * n_neg <= 3 * r["neg"] * n_pos}
    stage.drop(counted)
    by_kind: dict[str, dict[str, float]] = {"w": {}, "s": {}, "t": {}}
    for r in sorted(found, key=lambda r: r["name"]):
        by_kind[r["name"][0]][r["name"][2:]] = r["weight"]
    stems = {k: v for k, v in by_kind["s"].items() if not any(by_kind["s"].get(k[:n], 0.0) >= v - 0.5 for n in range(2, len(k)))}

    def stemmed(word: str) -> float:
        return max((stems.get(word[:n], 0.0) for n in range(2, len(word) + 1)), default=0.0)

    words = {k: v for k, v in by_kind["w"].items() if stemmed(k) < v - 0.5}
    words |= {w: SEED_WEIGHT for w in INSULTS if w not in words and not stemmed(w) and f"w:{w}" not in against}
    # a threat says more than its words
    threats = {k: v for k, v in by_kind["t"].items() if max(stemmed(k.split()[0]), words.get(k.split()[0], 0.0)) < v - 0.5}
    threats |= {t: 6.0 for t in THREATS if t not in threats and f"t:{t}" not in against}
    grammar = Grammar(words, stems, threats)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(grammar)
        for batch in slices(batches, 64):
            yield pa.record_batch([pa.array([matcher.read(t)[0].tolist() for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    rows = sample.mapInArrow(lean(read), "x array<double>, y double").collect()
    stage.drop(sample)
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)
    weights = _fit(np.hstack([x, np.ones((len(x), 1))]), y, np.array([*grammar.readings, grammar.bias]))
    return Grammar(words, stems, threats, tuple(float(max(0.0, w)) for w in weights[:-1]), float(min(-0.5, weights[-1])))


def _evidence(pos: np.ndarray, neg: np.ndarray, share: float) -> np.ndarray:
    """Log of the odds between a toxic pattern (its share of toxic documents is Beta(9, 1)) and one without relation."""
    gamma = np.vectorize(math.lgamma, otypes=[float])
    return gamma(pos + 9) + gamma(neg + 1) - gamma(pos + neg + 10) + math.log(9) - pos * math.log(share) - neg * math.log1p(-share)


def _related(pos: np.ndarray, neg: np.ndarray, n: np.ndarray, share: float) -> float:
    """The share of patterns that are toxic, by expectation and maximization over the histogram of their counts."""
    evidence, related = _evidence(pos, neg, share), 1e-3
    for _ in range(200):
        likely = 1 / (1 + np.exp(np.clip(math.log(1 / related - 1) - evidence, -700, 700)))
        following = (float((n * likely).sum()) + 1) / (float(n.sum()) + 2)
        if abs(following - related) < 1e-9:
            break
        related = following
    return related


def _weights(pos: np.ndarray, neg: np.ndarray, share: float, related: float, smooth: float = 4.0) -> np.ndarray:
    """Count-smoothed log-odds (at most 6) times the probability of being related to the labels."""
    likely = 1 / (1 + np.exp(np.clip(math.log(1 / related - 1) - _evidence(pos, neg, share), -700, 700)))
    p = (pos + smooth * share) / (pos + neg + smooth)
    return likely * np.minimum(6.0, np.log(p / (1 - p)) - math.log(share / (1 - share)))


def _fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0, steps: int = 60) -> np.ndarray:
    """Logistic regression drawn towards the prior weights (Newton steps, halved until the loss falls)."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + strength * ((w - prior) ** 2).sum() / 2)

    w, now = prior.copy(), loss(prior)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + strength * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        while (following := loss(w - step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if now - following < 1e-9:
            break
        w, now = w - step, following
    return w


def toxicity(
    spark: SparkSession,
    docs: DataFrame,
    labelled: DataFrame,
    keep: list[str] | None = None,
    most_labelled: int = 20_000,
    stem_lengths: tuple[int, ...] = (4, 5, 6, 7),
    least_docs: int = 3,
    least_weight: float = 0.1,
) -> DataFrame:
    """Scores every whole text from 0 to 1 (score); predicted is 1 from 0.5; n_clauses that matched, and worst_clause,
    the one of the highest score.

    docs: doc_id, text; labelled: doc_id, toxic (rows with nulls are left out; an id labelled twice counts once, as
    toxic if any row says so). Null and empty texts match no clause and get the lowest score. A text without stops is one
    clause, whatever its length. Labels of one kind only, or none, leave the grammar's seeds and threats. Repeated rows
    are scored one by one; an empty table gives no rows. keep: input columns to return, doc_id by default; those that
    share a name with a result column are dropped.
    """
    ship(spark)
    made = ["score", "predicted", "n_clauses", "worst_clause"]
    taken = [c for c in (keep or ["doc_id"]) if c not in made]
    grammar = learn(Stage(spark, "toxicity"), docs, labelled.select("doc_id", "toxic"), most_labelled, stem_lengths, least_docs, least_weight)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(grammar)
        for batch in slices(batches, 256):
            read = [matcher.read(t) for t in batch.column(0).to_pylist()]
            scores = [matcher.score(x[0]) for x in read]
            columns = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([x[1] for x in read], pa.int32()), pa.array([x[2] for x in read], pa.string())]
            yield pa.record_batch([*batch.columns[1:], *columns], [*taken, *made])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in taken), "score double, predicted int, n_clauses int, worst_clause string"])
    return docs.select(F.col("text").alias("_text"), *(F.col(f"`{c}`") for c in taken)).mapInArrow(lean(judge), schema)


def held_out(doc_id: Column) -> Column:
    """Whether an id's label is never learned from; a null id has no label and is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; the edge cases are those of toxicity."""
    docs = table(spark, sf_dir, "documents")
    labelled = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return toxicity(spark, docs, labelled).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_clauses")
