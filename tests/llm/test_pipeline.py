"""The pipeline against plain versions of its stages, each on what the stage before it kept."""

import zlib

import corpus_pipeline
from siltworks.llm import minhash  # noqa: F401

from .helpers import documents, frame, groups, shingles, without_repeats


def test_stages_do_what_they_say(spark, tmp_path):
    docs = documents(6)
    root = f"file://{tmp_path}"
    frame(spark, docs).write.parquet(f"{root}/documents.parquet")
    labels = [(d[0], 0) for d in docs]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{root}/labels.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    assert list(by_name) == ["toxicity", "quality_rules", "minhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    given = frame(spark, docs)
    near = by_name["minhash_near_dedup"](spark, given, root)
    assert near.columns == given.columns
    sets = {d[0]: shingles(d[1], 5) for d in docs}
    expected = groups(sorted(sets), lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    kept = {i for i, c in expected.items() if i == c}
    assert {r["doc_id"] for r in near.collect()} == kept
    left = {r["doc_id"]: r for r in by_name["suffix_array_dedup"](spark, frame(spark, [d for d in docs if d[0] in kept]), root).collect()}
    assert set(left) == kept
    ordered = sorted(d for d in docs if d[0] in kept)
    for (doc_id, text, lang, source, _), (raw, gone) in zip(ordered, without_repeats([d[1] for d in ordered], 100), strict=True):
        at, out = 0, []
        for c in text or "":
            n = len(c.encode())
            if not all(gone[at : at + n]):
                out.append(c)
            at += n
        r = left[doc_id]
        assert (r["text"], r["lang"], r["source"], r["n_chars"]) == ("".join(out), lang, source, len(out))
    out = corpus_pipeline.run(spark, root)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} <= kept
    assert all(0 <= r["ids_crc32"] < 1 << 32 for r in out.collect()) and zlib.crc32(b"") == 0


def test_empty_corpus(spark, tmp_path):
    root = f"file://{tmp_path}"
    frame(spark, []).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{root}/labels.parquet")
    assert corpus_pipeline.run(spark, root).count() == 0
