"""Queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from veritick.llm import ann, decontam, html_text, langid, pieces, pii, quality, repair, rules, secrets, sharding, simhash, trie


def queries() -> dict:
    return {
        "op1_nearest_vectors": ann.op1_nearest_vectors,
        "op2_simhash_groups": simhash.op2_simhash_groups,
        "op3_personal_data": pii.op3_personal_data,
        "op4_language": langid.op4_language,
        "op5_extendible_shards": sharding.op5_extendible_shards,
        "op6_decontamination": decontam.op6_decontamination,
        "op7_quality": quality.op7_quality,
        "op8_sentencepiece": pieces.op8_sentencepiece,
        "op9_secrets": secrets.op9_secrets,
        "op10_main_text": html_text.op10_main_text,
        "op11_quality_rules": rules.op11_quality_rules,
        "op12_repair": repair.op12_repair,
        "op13_prefix_trie": trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_extendible_shards": sharding.OP5_SQL}
