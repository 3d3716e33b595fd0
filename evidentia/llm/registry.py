"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import gif, language_id, license_scan, line_templates, mixing, ngram_join, ordinal_quality, packing, prefix_trie, repetition, role_repair, sharding, substring_dedup

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_line_templates": line_templates.op2_line_templates,
    "op3_histogram_shards": sharding.op3_histogram_shards,
    "op4_ordinal_quality": ordinal_quality.op4_ordinal_quality,
    "op5_gif_media": gif.op5_gif_media,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_quality_rules": repetition.op7_quality_rules,
    "op8_pack_sequences": packing.op8_pack_sequences,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_language_id": language_id.op10_language_id,
    "op11_license_scan": license_scan.op11_license_scan,
    "op12_role_repair": role_repair.op12_role_repair,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
SQL: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op2_line_templates": line_templates.OP2_SQL,
    "op6_mix_sources": mixing.OP6_SQL,
    "op7_quality_rules": repetition.OP7_SQL,
    "op9_ngram_join": ngram_join.OP9_SQL,
    "op11_license_scan": license_scan.OP11_SQL,
    "op12_role_repair": role_repair.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
