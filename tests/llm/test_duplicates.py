import hashlib
import random

import numpy as np
import pytest

from siltworks.llm import bwt, minhash, suffixes, vectors
from siltworks.llm.common import Stage, components

from .helpers import documents, frame, groups, shingles, without_repeats


def similar(a: frozenset, b: frozenset) -> bool:
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


@pytest.mark.parametrize("width,extra", [(2, False), (5, True)])
def test_near_duplicates(spark, width, extra):
    docs = documents()
    sets = {d[0]: shingles(d[1], width) for d in docs}
    expected = groups(sorted(sets), lambda a, b: similar(sets[a], sets[b]))
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark, frame(spark, docs, extra), width=width).collect()}
    assert len(got) == len(docs)
    for doc_id, own in sets.items():
        assert (got[doc_id]["n_shingles"], got[doc_id]["component_id"], got[doc_id]["kept"]) == (len(own), expected[doc_id], expected[doc_id] == doc_id)


def test_near_duplicates_of_a_large_uneven_group(spark):
    rng = random.Random(7)
    base = [f"v{i}" for i in range(60)]
    docs = []
    for i in range(120):
        text = list(base)
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(60)] = f"u{rng.randrange(9999)}"
        docs.append((i, " ".join(text), None, None, None))
    sets = {d[0]: shingles(d[1], 2) for d in docs}
    expected = groups(sorted(sets), lambda a, b: similar(sets[a], sets[b]))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark, frame(spark, docs), width=2).collect()}
    assert got == expected


def test_near_duplicates_of_odd_rows(spark):
    assert minhash.near_duplicates(spark, frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f", None, None, None), (1, "a b c d e f", None, None, None), (1, "a b c d e f", None, None, None), (2, None, None, None, None)]
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(spark, frame(spark, rows)).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "2", True), ("None", "None", True)]


def test_near_duplicates_of_one_id_with_two_texts(spark):
    text, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, text, None, None, None), (5, text, None, None, None), (5, other, None, None, None), (7, other, None, None, None)]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark, frame(spark, rows)).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 5, True), (7, 5, False)]


def test_vectors_of_odd_ids_and_sizes(spark):
    edge = [0.95, float(np.sqrt(1 - 0.95 * 0.95))]
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (None, [1.0, 0.0]), (8, [1e200, 1e200, 0.0]), (9, [3e200, 3e200, 0.0]), (10, [1e-200, 1e-200, 0.0]), (11, [1.0, 0.0, 0.0, 0.0]), (12, [*edge, 0.0, 0.0])]
    from pyspark.sql import functions as F

    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("rep", "weight", "component", "first"):
        data = data.withColumn(name, F.lit("clash"))
    out = vectors.near_vectors(spark, data).collect()
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in out)
    u, v = np.array([1.0, 0, 0, 0]), np.array([*edge, 0, 0])
    met = int(u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.95)
    assert got == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (8, 2, 8), (9, 2, 8), (10, 2, 8), (11, met, 11), (12, met, 11 if met else 12)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    linked = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    expected = groups(nodes, lambda a, b: (a, b) in linked)
    out = components(spark, Stage(spark, "test"), spark.createDataFrame(edges, "a long, b long"))
    got = {r["node"]: r["component"] for r in out.collect()}
    assert {n: got.get(n, n) for n in nodes} == expected


def test_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x[50:60] = x[5]
    x[60:90] = x[6] + rng.normal(size=(30, 16)) * 0.15
    x[90:120] = x[7] * 3
    rows = [(int(i) * 2, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(1001, None), (1003, [0.0] * 16), (1005, [float("nan")] + [1.0] * 15), (1007, [None] + [1.0] * 15), (1009, [float("inf")] * 16), (1011, [1.0, 2.0]), (1013, [2.0, 4.0]), (1015, [])]
    data = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    known = {i: np.array(r) for i, r in rows} | {1011: np.array([1.0, 2.0]), 1013: np.array([2.0, 4.0])}

    def linked(a, b):
        if a not in known or b not in known or len(known[a]) != len(known[b]):
            return False
        u, v = known[a], known[b]
        return u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.95

    ids = sorted(i for i, _ in rows + odd)
    expected = groups(ids, linked)
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark, data, cell_rows=40).collect()}
    assert len(got) == len(ids)
    for i in ids:
        assert got[i]["component_id"] == expected[i] and got[i]["kept"] == (expected[i] == i)
        assert got[i]["n_links"] == sum(linked(i, j) for j in ids if j != i)
    assert vectors.near_vectors(spark, data.limit(0)).count() == 0


def test_merged_transforms_find_all_repeats(monkeypatch):
    rng = random.Random(2)
    for trial in range(40):
        letters = "ab" if trial % 2 else "abcdefgh\x00"
        pool = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 60))) for _ in range(6)]
        texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 8))).encode() for _ in range(rng.randint(1, 12))]
        depth = rng.choice([3, 8, 12, 20, 100])
        monkeypatch.setattr(bwt, "SHARD_BYTES", rng.choice([20, 100, 1 << 15]))
        place, block = bwt.repeated(texts, depth)
        owner = [(k, o) for k, t in enumerate(texts) for o in range(len(t) + 1)]
        got, expected = {}, {}
        for p, b in zip(place.tolist(), block.tolist(), strict=True):
            k, o = owner[p]
            if o + depth <= len(texts[k]):
                got.setdefault(b, set()).add((k, o))
        for k, t in enumerate(texts):
            for o in range(len(t) - depth + 1):
                expected.setdefault(t[o : o + depth], set()).add((k, o))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("extra,most", [(False, 2048), (True, 2)])
def test_suffix_dedup(spark, extra, most, monkeypatch):
    monkeypatch.setattr(suffixes, "MOST_SEGMENTS", most)
    docs = documents(2)
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(spark, frame(spark, docs, extra), digests=True).collect()}
    ordered = sorted(docs)
    for (doc_id, *_), (raw, gone) in zip(ordered, without_repeats([d[1] for d in ordered], 100), strict=True):
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        r = got[doc_id]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_of_odd_rows(spark):
    assert suffixes.remove_repeats(spark, frame(spark, [])).count() == 0
    text = "é" * 80
    rows = [(None, text, None, None, None), (1, text, None, None, None), (1, text + "x" * 120, None, None, None), (2, None, None, None, None)]
    out = suffixes.remove_repeats(spark, frame(spark, rows), whole_characters=True, keep=["lang"]).collect()
    # the first text repeats itself from its second character on; its copy goes whole; of the third, the copied part
    # goes and all but one of the x
    assert {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in out} == {(None, 160): 158, (1, 160): 160, (1, 280): 279, (2, 0): 0}
    assert all(isinstance(r["kept"], str) for r in out)


def test_vectors_are_sent_to_few_groups(spark, monkeypatch):
    """However many cells are in reach, a vector is sent at most once to each of half the groups, besides its own."""
    from pyspark.sql import DataFrame

    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 24)).astype(np.float32)
    x[200:260] = x[:60] + rng.normal(size=(60, 24)) * rng.uniform(0.1, 0.5, size=(60, 1))
    data = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    sent = []
    plain = DataFrame.sortWithinPartitions
    monkeypatch.setattr(DataFrame, "sortWithinPartitions", lambda self, *a, **k: sent.append(self.count()) or plain(self, *a, **k))
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(spark, data, cell_rows=4).collect()}
    u = x.astype(float)
    cosine = u @ u.T / np.sqrt(np.outer((u * u).sum(axis=1), (u * u).sum(axis=1)))
    assert got == dict(enumerate(((cosine >= 0.95).sum(axis=1) - 1).tolist()))
    assert sum(sent) <= 5 * len(x)


def test_sketches_decide_only_what_they_can():
    """Pairs at the threshold are left open, others are decided, and each pair once."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 8))
    x[30:] = x[:30] + rng.normal(size=(30, 8)) * 0.3
    units = vectors.unit(x)
    exact = units @ units.T
    short, step, off = vectors.sketch(units)
    assert (np.sqrt(np.square(units - short * step[:, None].astype(float)).sum(axis=1)) <= off).all()
    least = float(exact[0, 30])
    ids, ones = np.arange(60), np.ones(60, int)
    group = vectors.Group(ids[:40], ones[:40], short[:40], step[:40], off[:40], least)
    rows = [r for kinds, a, b in [*group.inner(8, 16), *group.meet(ids[40:], ones[40:], short[40:], step[40:], off[40:], 8, 16), *group.end()] for r in zip(kinds.tolist(), a.tolist(), b.tolist(), strict=True)]
    still = {tuple(sorted(r[1:])) for r in rows if r[0] == 2}
    assert (0, 30) in still and len(still) < 5
    counted = np.zeros(60, int)
    for kind, a, n in rows:
        counted[a] += n if kind == 0 else 0
    expected = np.array([[i != j and min(i, j) < 40 and exact[i, j] >= least and (min(i, j), max(i, j)) not in still for j in range(60)] for i in range(60)]).sum(axis=1)
    assert counted.tolist() == expected.tolist()
