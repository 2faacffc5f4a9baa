import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.llm import pitman_yor, quality, sharding, toxicity

from .helpers import documents, frame, lower_words


@pytest.mark.parametrize("extra", [False, True])
def test_shards(spark, extra):
    docs = documents() + [(5000 + i, "same", None, None, None) for i in range(40)] + [(None, None, None, None, None), (0, "again", None, None, None)]
    out = sharding.balanced_shards(spark, frame(spark, docs, extra), shards=4).collect()
    assert len(out) == len(docs)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    texts = {d[0]: d[1] or "" for d in docs[:-2]}
    where = {}
    for r in out:
        if r["doc_id"] in texts and r["doc_id"]:
            text = texts[r["doc_id"]]
            assert (r["size"], r["text_crc32"], r["law"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "rows")
            where.setdefault(text, set()).add(r["shard"])
    assert sum(len(v) > 1 for t, v in where.items() if t != "same") <= 1
    assert len(where["same"]) <= 3
    assert sharding.balanced_shards(spark, frame(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [1, 3, 10_000])
def test_shards_of_hot_and_other_groups(spark, monkeypatch, hot):
    """However many groups count as hot, copies of a text stay together where room allows, and counts are even."""
    monkeypatch.setattr(sharding, "HOT", hot)
    docs = [(i, "copied") for i in range(40)] + [(100 + i, f"pair {i // 2}") for i in range(20)] + [(200 + i, f"own {i}") for i in range(60)]
    out = sharding.balanced_shards(spark, spark.createDataFrame(docs, "doc_id long, text string"), shards=3).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(i for i, _ in docs)
    assert sorted(Counter(r["shard"] for r in out).values()) == [40, 40, 40]
    at = {r["doc_id"]: r["shard"] for r in out}
    assert all(at[100 + i] == at[101 + i] for i in range(0, 20, 2))
    assert max(Counter(at[i] for i in range(40)).values()) >= 30


def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = set()
    for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)):
        if windows[g] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_counts():
    rng = random.Random(9)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", " ", "\n", "\x0b", "é", "#", "a b a", " "]) for _ in range(rng.randint(0, 60)))
        assert quality.counts(text)[2] == plain_counts(text)
    assert quality.counts(None)[2] == (0, 0, 0, 0, 0)


def test_divergence():
    assert quality.divergence(np.array([1, 1]), np.array([5, 5])) == 0
    assert quality.divergence(np.array([1, 0]), np.array([0, 5])) == pytest.approx(1)
    assert quality.divergence(np.zeros(2), np.ones(2)) == 1


@pytest.mark.parametrize("extra", [False, True])
def test_quality_rules(spark, extra):
    rng = random.Random(4)
    common = ["the", "of", "and", "to", "in"]
    prose = [" ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("aeionrst") for _ in range(7)) for _ in range(120)) for _ in range(60)]
    junk = [" ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in p.split()) for p in prose[:5]]
    lists = [" | ".join("".join(rng.choice("aeionrst") for _ in range(9)) for _ in range(100)) for _ in range(5)]
    rows = [(i, t, "en", None, None) for i, t in enumerate([*prose, *junk, *lists, "short", None, "", "again and again " * 60])]
    rows += [rows[0]]
    out = quality.quality_rules(spark, frame(spark, rows, extra)).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: r for r in out}
    for doc_id, text, *_ in rows:
        r = got[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_counts(text)
        n, repeats = r["n_words"], r["n_repeat_words"]
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
        assert r["kept"] == (doc_id < 60)
    assert quality.quality_rules(spark, frame(spark, [])).count() == 0


def plain_verdicts(rows, rules):
    """kept of each row, from histograms that are made in a plain way."""
    def strip(w):
        return w.strip(".,;:!?'\"()-").lower()

    def base_ok(text):
        n, _, _, _, repeats = plain_counts(text)
        return n >= 50 and 100 * repeats <= 50 * n

    def distance(p, q):
        p, q = np.array(p, float) / sum(p), np.array(q, float) / sum(q)
        m = (p + q) / 2
        return sum(x * math.log2(x / y) for x, y in zip(p, m, strict=True) if x) / 2 + sum(x * math.log2(x / y) for x, y in zip(q, m, strict=True) if x) / 2

    def classes(texts):
        out = [0] * len(quality.CLASSES)
        for t in texts:
            for b in t.encode():
                out[quality.CLASS_TABLE[b]] += 1
        return out

    refs = {}
    for lang in {r[2] or "" for r in rows}:
        own = [r[1] for r in rows if (r[2] or "") == lang and base_ok(r[1])]
        if own:
            words = [w for t in own for w in t.split()]
            counted = Counter(strip(w) for w in words if 0 < len(strip(w).encode()) <= rules.common_length)
            common = sorted(counted, key=lambda w: (-counted[w], w))[: rules.common_words]
            refs[lang] = (classes(own), common, [*(counted[w] for w in common), len(words) - sum(counted[w] for w in common)], len(words))
    out = []
    for _, text, lang, *_ in rows:
        n = plain_counts(text)[0]
        kept = False
        if base_ok(text):
            counted = Counter(strip(w) for w in text.split())
            for name, (c, common, weights, total) in refs.items():
                worth = 1 if name == (lang or "") else total / (total + rules.reference_guard)
                own = [counted[w] for w in common]
                a, b = distance(classes([text]), c), distance([*own, n - sum(own)], weights)
                kept |= a <= worth * (rules.class_divergence + rules.class_guard / n) and b <= worth * (rules.word_divergence + rules.word_guard / n)
        out.append(kept)
    return out


def test_quality_verdicts_are_those_of_a_plain_version(spark):
    rng = random.Random(15)
    rows = []
    spoken = {"en": (["the", "of", "people", "and"], "aeionrst"), "de": (["der", "die", "und"], "aeinrstu"), "fr": (["un", "le", "la"], "éèçaou")}
    for i in range(160):
        lang = rng.choice([*spoken])
        common, letters = spoken[lang] if rng.random() < 0.7 else (["der", "un", "xx"], rng.choice(["AEION", "xyz#%$", "0123456789"]))
        text = " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice(letters) for _ in range(rng.randint(4, 8))) + rng.choice(["", "", ".", ","]) for _ in range(rng.randint(30, 300)))
        rows.append((i, text, rng.choice([lang, lang, None]), None, None))
    rows += [(500, "word " + "long" * 50_000 + " the of" * 60, "en", None, None), (501, None, "en", None, None), (502, "", None, None, None)]
    rules = quality.Rules()
    expected = plain_verdicts(rows, rules)
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark, frame(spark, rows)).collect()}
    assert [got[r[0]] for r in rows] == expected
    assert 10 < sum(expected) < 150


def test_quality_keeps_small_languages_that_vouch_for_little_else(spark):
    rng = random.Random(5)
    prose = lambda common, letters: " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice(letters) for _ in range(7)) for _ in range(200))
    rows = [(i, prose(["the", "of", "and", "to", "in"], "aeionrst"), "en", None, None) for i in range(40)]
    small = [(100 + i, prose(["и", "в", "не", "на"], "аеионрст"), "ru", None, None) for i in range(3)]
    junk = [prose(["x#", "$y"], "%&*") for _ in range(2)]
    # small languages stay, and junk is not made good by another junk's label
    rows += [*small, (201, "и в " * 60, "ru", None, None), (202, prose(["и", "в", "не", "на"], "аеионрст"), None, None, None), (203, junk[0], "zz", None, None), (204, junk[1], "en", None, None)]
    for keep in (None, ["doc_id", "lang", "text"]):
        got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark, frame(spark, rows), keep=keep).collect()}
        assert got == {i: i not in (201, 204) for i, *_ in rows}


def test_transducers():
    def read(text, **words):
        m = toxicity.Matcher(toxicity.Grammar(words=words or {"idiot": 6.0}))
        return dict(zip(toxicity.READINGS, 6 * m.read(text)[0], strict=True))

    assert read("a plain idiot here")["plain"] == 6
    assert read("you are an IDIOT.")["targeted"] == 6
    assert read("that was not an idiot")["negated"] == 6
    assert read("somebody wrote idiot")["reported"] == 6
    assert read('the "idiot" of the title')["reported"] == 6
    assert read("i will kill you now")["threat"] == 6
    assert read("never. idiot")["plain"] == 6
    assert read("idiotic")["plain"] == 0 and read("xidiot")["plain"] == 0
    assert not any(read(None).values()) and not any(read("").values())


def plain_readings(text, insults, reach=4):
    """Readings of a clause without machines: each anchor looks at the words around it."""
    items = [w for w in re.findall(r'"|[a-z]+', text)]
    words = [w for w in items if w != '"']
    quoted, inside = [], False
    for w in items:
        if w == '"':
            inside = not inside
        else:
            quoted.append(inside)
    out = []
    for i, w in enumerate(words):
        if w not in insults:
            continue

        def near(kind, i=i):
            return any(x in kind for x in words[max(0, i - reach) : i])

        aimed = near(toxicity.TARGETS) or any(x in toxicity.TARGETS for x in words[i + 1 : i + 1 + reach])
        out.append(3 if quoted[i] or near(toxicity.REPORTS) else 2 if near(toxicity.NEGATIONS) else 1 if aimed else 0)
    return out


def test_composed_machine_reads_as_a_plain_look_around_does():
    rng = random.Random(12)
    grammar = toxicity.Grammar(words={"idiot": 6.0, "scum": 3.0})
    matcher = toxicity.Matcher(grammar)
    assert 100 < len(matcher.transducer.left.step) <= 5 * 5 * 2 * 5
    for _ in range(500):
        items = [rng.choice(["idiot", "scum", "not", "said", "you", '"', "word", "thing", "red", "house"]) for _ in range(rng.randint(1, 14))]
        text = " ".join(items)
        symbols, weights = matcher.symbols(text)
        got = matcher.transducer.readings(symbols)
        assert [r for _, r in got] == plain_readings(text, grammar.words)
        assert [weights[i] for i, _ in got] == [grammar.words[w] for w in items if w in grammar.words]


def test_clauses_are_read_whole_and_once():
    matcher = toxicity.Matcher(toxicity.Grammar(words={"idiot": 6.0}))
    sums, n, worst = matcher.read("an idiot idiot. fine. you idiot!")
    assert (sums[0], sums[1], n, worst) == (2, 1, 2, "an idiot idiot")
    long = "he was not " + "thing " * 3 + "idiot " + "thing " * 100_000 + "you idiot"
    sums, n, _ = matcher.read(long)
    assert (sums[1], sums[2], n) == (1, 1, 1)


def test_toxicity_learns_threats_and_odd_labels(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ter", "son"]) for _ in range(3))
    docs, labels = [], []
    for i in range(400):
        text = [word() for _ in range(15)]
        at = rng.randrange(14)
        text[at : at + 2] = ["gronk", "you"] if i % 5 == 0 else ["gronk", "milk"]
        docs.append((i, " ".join(text), None, None, None))
        labels.append((i, int(i % 5 == 0)))
    # one text under two ids with both labels, a repeated row, a label of an unknown id
    docs += [(900, docs[1][1], None, None, None), docs[5]]
    labels += [(900, 1), (1, 0), (7777, 1)]
    out = toxicity.toxicity(spark, frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    got = {r["doc_id"]: r["predicted"] for r in out}
    assert len(out) == len(docs) and sum(got[i] != int(i % 5 == 0) for i in range(400)) == 0


def test_toxicity_learns_words_and_stems_held_out(spark):
    rng = random.Random(3)
    syllables = ["ka", "lo", "mi", "ter", "son", "ba", "rin"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(600):
        text = [word() for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                text[rng.randrange(60)] = rng.choice(["blark", "zworf" + word()])
        docs.append((i, " ".join(text), None, None, None))
        labels.append((i, int(toxic)))
    docs += [(900, None, None, None, None), (901, "", None, None, None), (None, "blark blark blark", None, None, None)]
    labelled = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    learned = labelled.where(~toxicity.held_out(F.col("doc_id")))
    got = {r["doc_id"]: r for r in toxicity.toxicity(spark, frame(spark, docs, True), learned).collect()}
    wrong = sum(got[i]["predicted"] != t for i, t in labels)
    assert wrong <= 6
    assert got[900]["predicted"] == got[901]["predicted"] == 0 and got[None]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.toxicity(spark, frame(spark, []), learned).count() == 0
    assert toxicity.toxicity(spark, frame(spark, docs), learned.limit(0)).count() == len(docs)


def test_toxicity_learns_from_texts_with_equal_openings_and_endings(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ter", "son"]) for _ in range(3))
    head, tail = "a common header of all texts " * 3, " a common footer of all texts" * 3
    docs, labels = [], []
    for i in range(300):
        text = [word() for _ in range(20)]
        if i % 5 == 0:
            text[rng.randrange(20)] = "blark"
        docs.append((i, head + " ".join(text) + tail, None, None, None))
        labels.append((i, int(i % 5 == 0)))
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(spark, frame(spark, docs), labelled).collect()}
    assert got == dict(labels)


def test_toxicity_learns_an_insult_of_few_documents(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ter", "son"]) for _ in range(3))
    docs, labels = [], []
    for i in range(4000):
        text = [word() for _ in range(15)]
        if i < 450:
            text[rng.randrange(15)] = "zworf" if i < 4 else "blark"
        docs.append((i, " ".join(text), None, None, None))
        labels.append((i, int(i < 450)))
    docs += [(9000, "kalo zworf miter. zworf kalo. you zworf", None, None, None), (9001, "kalo miter. kalo. you miter", None, None, None)]
    got = {r["doc_id"]: r for r in toxicity.toxicity(spark, frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got[9000]["predicted"] == 1 and got[9001]["predicted"] == 0
    assert sum(got[i]["predicted"] for i in range(450, 4000)) == 0


@pytest.mark.parametrize(("extra", "hot"), [(False, 512), (True, 4)])
def test_language_model(spark, extra, hot):
    docs = [d for d in documents(5) if d[0] is not None]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    expr = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    settings = pitman_yor.Settings(frequent=30, classes=8, hot=hot)
    got = {r["doc_id"]: r for r in pitman_yor.score_documents(spark, frame(spark, docs, extra), expr, settings).collect()}
    tokens = {i: [*lower_words(t), None] for i, t, *_ in docs}
    counts = Counter(w for i, ws in tokens.items() if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert pitman_yor.score_documents(spark, frame(spark, []), expr, settings).count() == 0


def test_language_model_of_small_corpora_at_its_defaults(spark):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    rng = random.Random(21)
    prose = lambda: " ".join(rng.choice(["red", "green", "blue"]) + " " + rng.choice(["house", "tree"]) for _ in range(60))
    rows = [(i, prose(), None, None, None) for i in range(40)] + [(None, "red house", None, None, None), (None, "x y z", None, None, None), (7, "one two", None, None, None), (3, None, None, None, None)]
    rows += [rows[0], rows[0]]
    out = pitman_yor.score_documents(spark, frame(spark, rows), held).collect()
    assert len(out) == len(rows)
    texts = Counter((r[0], len(lower_words(r[1])) + 1) for r in rows)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in out) == texts
    assert len({(r["score"], r["base_score"]) for r in out if r["doc_id"] == 0}) == 1
    # held-out texts: the model knows what follows what, the base does not
    fresh = [r for r in out if r["held_out"] and r["n_tokens"] > 50]
    assert fresh and all(r["score"] > r["base_score"] * 0.95 for r in fresh) and sum(r["score"] for r in fresh) > 0.9 * sum(r["base_score"] for r in fresh)
    for n in (1, 2, 5):
        assert pitman_yor.score_documents(spark, frame(spark, rows[:n]), held).count() == n


def test_seating_and_probabilities():
    s = pitman_yor.Settings(classes=2)
    rng = np.random.default_rng(1)
    # three frequent words (numbers 0 to 2, 3: rarer words, or beginnings), 30 rarer ones, two contexts of each kind
    v = pitman_yor.Vocabulary(np.arange(3, dtype=np.uint64), np.ones(3, np.int64), 1_000, 33, 0)
    often, rare = np.repeat([0, 3], 4), np.repeat([70, 90], 4)
    which = np.repeat(np.arange(100, 130), 2)
    key = np.concatenate([often, rare, which])
    small = np.concatenate([np.tile(np.arange(4), 4), np.tile([0, 5], 30)])
    count = np.concatenate([rng.integers(0, 30, 16), rng.integers(0, 30, 60)])
    d = pitman_yor.Dishes(1, np.array([8, 8, 60]), key, small, count, v, s)
    hot = pitman_yor.HotPairs(np.array([7]), v, s)

    def summed(before):
        parts = d.sums()
        customers, tables, dishes = (x + y for x, y in zip(parts[:3], hot.sums()))
        rooted = np.minimum(dishes, 1) if before is None else pitman_yor.seat(dishes, np.full(4, 10.0), 0.7, rng)
        return pitman_yor.Sums(customers, tables, dishes, rooted, *parts[3:])

    # the matrix holds the pair of a beginning and a rarer word, so the bucket has none
    d.count[pitman_yor.OFTEN][7] = d.tables[pitman_yor.OFTEN][7] = 0
    sums = summed(None)
    for number in range(3):
        before, sums = sums, None
        d.sweep(number + 1, before)
        hot.sweep(before, rng)
        sums = summed(before)
        for k in range(3):
            assert (d.tables[k] <= d.count[k]).all() and ((d.tables[k] > 0) == (d.count[k] > 0)).all()
        hot.mean[:] = 0
        hot.sample(sums)
        p = d.predict(sums)
        # the dishes of each restaurant share the whole probability, with the unknown word's part upstairs
        assert sums.chances(s).sum() == pytest.approx(1)
        assert p[0][:4].sum() == pytest.approx(1)
        assert p[0][4:7].sum() + hot.mean[0] * s.samples == pytest.approx(1)
        assert p[1][:4].sum() == pytest.approx(1) and p[1][4:].sum() == pytest.approx(1)
        unknown = (s.strengths[0] + s.discounts[0] * sums.rare[1]) * d.rare_base / (s.strengths[0] + sums.rare[0])
        for room in (0, 5):
            rest = unknown * (s.strengths[1] + s.discounts[1] * sums.room_tables[room]) / (s.strengths[1] + sums.room_customers[room])
            assert p[2][small[16:] == room].sum() + rest == pytest.approx(1)
    tables = pitman_yor.seat(np.array([0, 1, 5, 100_000]), np.full(4, 10.0), 0.5, np.random.default_rng(2))
    assert tables[0] == 0 and tables[1] == 1 and 1 <= tables[2] <= 5 and 10 < tables[3] < 100_000
