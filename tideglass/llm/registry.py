"""Queries of this package, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from tideglass.llm import exact_dedup, language, licenses, line_dedup, minhash, mixing, packing, quality, sharding, sstable, toxicity, trie, whitening

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_mixing": mixing.op2_mixing,
    "op3_minhash": minhash.op3_minhash,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_licenses": licenses.op6_licenses,
    "op7_sstable": sstable.op7_sstable,
    "op10_packing": packing.op10_packing,
    "op8_language": language.op8_language,
    "op9_sharding": sharding.op9_sharding,
    "op11_whitening": whitening.op11_whitening,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_line_dedup": line_dedup.op13_line_dedup,
}
SQL = {"op1_quality": quality.ORACLE, "op5_exact_dedup": exact_dedup.ORACLE, "op9_sharding": sharding.ORACLE, "op12_prefix_trie": trie.ORACLE, "op13_line_dedup": line_dedup.ORACLE}
