"""The registered queries of this subpackage and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from glyphrake.llm import alignment, codes, imatch, langid, mixing, neighbours, packing, secrets, sharding, simhash, substrings, toxicity, urls

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_curriculum_mix": mixing.op2_curriculum_mix,
    "op3_imatch": imatch.op3_imatch,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_url_filter": urls.op5_url_filter,
    "op6_adaptive_scan": neighbours.op6_adaptive_scan,
    "op7_simhash_components": simhash.op7_simhash_components,
    "op8_feistel_sharding": sharding.op8_feistel_sharding,
    "op9_pack_sequences": packing.op9_pack_sequences,
    "op10_language_spans": langid.op10_language_spans,
    "op11_secret_scan": secrets.op11_secret_scan,
    "op12_vector_codes": codes.op12_vector_codes,
    "op13_token_alignment": alignment.op13_token_alignment,
}
ORACLES = {"op2_curriculum_mix": mixing.ORACLE_SQL, "op11_secret_scan": secrets.ORACLE_SQL, "op12_vector_codes": codes.ORACLE_SQL}
