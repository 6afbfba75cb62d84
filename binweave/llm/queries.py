"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, host_rules, media, mixing, prefix_join, quality_eb, rlz, secret_scan, sharding, suffix_dedup, vector_codes, warc, whitening


def queries() -> dict:
    return {
        "op1_quality_eb": quality_eb.op1_quality_eb,
        "op2_prefix_join": prefix_join.op2_prefix_join,
        "op3_media_columns": media.op3_media_columns,
        "op4_warc_normalise": warc.op4_warc_normalise,
        "op5_bpe": bpe.op5_bpe,
        "op6_rlz_dedup": rlz.op6_rlz_dedup,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_shard_kk": sharding.op9_shard_kk,
        "op10_host_rules": host_rules.op10_host_rules,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_secret_scan": secret_scan.op12_secret_scan,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_prefix_join": prefix_join.SQL, "op6_rlz_dedup": rlz.SQL, "op8_mix_sources": mixing.SQL, "op10_host_rules": host_rules.SQL, "op11_vector_codes": vector_codes.SQL}
