"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import minhash, oracle, packing, pitman_yor, quality, sharding, suffixes, tokens, toxicity, transducer, vectors

QUERIES = {
    "op1_token_output": tokens.op1_token_output,
    "op2_metric_range_join": vectors.op2_metric_range_join,
    "op3_bpe_transducer": transducer.op3_bpe_transducer,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_sharding": sharding.op5_sharding,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_pitman_yor": pitman_yor.op7_pitman_yor,
    "op8_suffix_dedup": suffixes.op8_suffix_dedup,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_minhash": minhash.op10_minhash,
}

#: The others learn, sample, sort or encode: the tests compare them with plain versions.
ORACLE_SQL: dict[str, str] = oracle.ORACLE_SQL
