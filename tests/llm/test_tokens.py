import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltworks.llm import bpe, packing, rans, tokens, transducer

from .helpers import documents, frame

le = lambda ids: np.array(ids, "<u4").tobytes()
PIECES = ["a", "b", "'s", "'re", "'", "  ", " ", "\n", "\t", "1", "23", "é", "ß", "!", "…", "漢", "😀", "<|endoftext|>", "\x00", "\x85", "\xa0", "½", "_", "the", " hello", "ing", "zzzzzz", "S", "\n\n"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.tokenizer_path())


@pytest.fixture(scope="module", params=[bpe.library_pieces, bpe.transducer_pieces])
def encoder(request):
    return request.param()


def test_encoders_equal_the_library(library, encoder):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += [None, "", "a" * 5000, "ab" * 3000, "\n" * 999, " " * 777, "zq" * 2000 + "éß" * 300]
    ids, counts = encoder.encode(texts)
    ends = np.cumsum(counts)
    for text, n, end in zip(texts, counts, ends, strict=True):
        assert ids[end - n : end].tolist() == library.encode(text or "", add_special_tokens=False).ids, text[:80]


def test_stream_emits_the_same_tokens_in_any_parts(library):
    t = bpe.transducer_pieces().transducer
    rng = random.Random(4)
    for _ in range(20):
        word = "".join(rng.choice("aeiounstrlzq") for _ in range(rng.randint(1, 4000))).encode()
        parts, at = [], 0
        while at < len(word):
            n = rng.randint(1, 700)
            parts.append(word[at : at + n])
            at += n
        assert [x for p in t.stream(parts) for x in p] == library.encode(word.decode(), add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=12))
def test_decoder_equals_the_library(ids):
    d = bpe.Decoder(bpe.transducer_pieces().vocabulary)
    assert "".join(d.decode(np.array(ids, np.int64), 3)) == Tokenizer.from_file(bpe.tokenizer_path()).decode(ids, skip_special_tokens=False)


def test_range_coder_round_trip_checkpoints_and_checksums():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.01, 200_000) - 1, 5000).astype(np.uint32)
    coder = rans.Coder(rans.quantise(np.bincount(ids)))
    payload = coder.encode(ids, np.array([1, 2]), np.array([0, 1]), np.array([100_000, 100_000]), 7, lanes=256, steps_between=100)
    out, header = coder.decode(payload)
    assert (out == ids).all() and header.start == 7 and header.checkpoints > 1
    step, _, _ = header.checkpoint(payload, 2)
    assert (coder.decode(payload, 2)[0] == ids[step * header.lanes :]).all()
    assert len(payload) < 2 * len(ids)
    with pytest.raises(ValueError):
        coder.decode(payload[:-9] + b"x" + payload[-8:])
    for n in (0, 1, 63, 64, 65):
        small = coder.encode(ids[:n], np.zeros(0, np.int64), np.zeros(0), np.zeros(0), 0)
        assert (coder.decode(small)[0] == ids[:n]).all()


@pytest.mark.parametrize("extra", [False, True])
def test_token_file(spark, library, tmp_path, extra):
    docs = documents()
    path = f"file://{tmp_path}/tokens"
    tokens.write_token_file(spark, frame(spark, docs, extra), path, block_tokens=2000)
    got = {r["doc_id"]: r for r in tokens.read_token_file(spark, path).collect()}
    start = 0
    for doc_id, text, *_ in sorted(docs):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        r = got[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (start, len(ids), zlib.crc32(le(ids)), le(ids))
        start += len(ids)


def test_token_file_of_nothing_and_of_null_and_repeated_ids(spark, tmp_path):
    tokens.write_token_file(spark, frame(spark, []), f"file://{tmp_path}/none")
    assert tokens.read_token_file(spark, f"file://{tmp_path}/none").count() == 0
    rows = [(None, "x", None, None, None), (1, "y", None, None, None), (1, "y", None, None, None)]
    tokens.write_token_file(spark, frame(spark, rows), f"file://{tmp_path}/odd")
    assert sorted((r["start"], r["doc_id"]) for r in tokens.read_token_file(spark, f"file://{tmp_path}/odd").collect()) == [(0, None), (2, 1), (4, 1)]


def test_transducer_round_trip(spark, library):
    docs = documents()
    encoded = transducer.encode_documents(spark, frame(spark, docs, True))
    out = {r["doc_id"]: r for r in transducer.decode_documents(spark, encoded).collect()}
    for doc_id, text, *_ in docs:
        assert out[doc_id]["text"] == (text or "") and out[doc_id]["n_tokens"] == len(library.encode(text or "", add_special_tokens=False).ids)
    assert transducer.round_trip_digests(spark, frame(spark, [])).count() == 0


def test_plan_takes_two_that_fit_better():
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10) == [([6, 2, 2], 1), ([3], 1)]
    rng = random.Random(1)
    for _ in range(30):
        counts = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(20)}
        bins = packing.plan(counts, 64)
        used = {}
        for items, times in bins:
            assert sum(items) <= 64
            for length in items:
                used[length] = used.get(length, 0) + times
        assert used == counts
        plain = []  # first fit, longest first
        for length in sorted(packing.Counter(counts).elements(), reverse=True):
            at = next((i for i, gap in enumerate(plain) if gap >= length), None)
            if at is None:
                plain.append(64 - length)
            else:
                plain[at] -= length
        assert sum(t for _, t in bins) <= 1.02 * len(plain) + 1


@pytest.mark.parametrize("extra", [False, True])
def test_packing(spark, library, extra):
    docs = documents()
    out = packing.pack_documents(spark, frame(spark, docs, extra), capacity=128, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc_id, text, *_ in docs:
        own = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert b"".join(bytes(r["ids"]) for r in own) == le(ids)
        assert all(r["length"] == 128 for r in own[1:]) and (len(ids) > 128 or len(own) == 1)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 128
    assert packing.pack_documents(spark, frame(spark, [])).count() == 0
