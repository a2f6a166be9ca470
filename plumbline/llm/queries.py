"""Registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import embedding_dedup, exact_dedup, language_id, line_dedup, mixing, packing, periodic_runs, prefix_trie, simhash, substring_dedup, token_counts, toxicity, url_filter

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_mix_weights": mixing.query,
    "op3_simhash_dedup": simhash.query,
    "op4_line_dedup": line_dedup.query,
    "op5_language_id": language_id.query,
    "op6_packing": packing.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_url_filter": url_filter.query,
    "op9_embedding_dedup": embedding_dedup.query,
    "op10_substring_dedup": substring_dedup.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_toxicity": toxicity.query,
}

SQL = {"op7_exact_dedup": exact_dedup.SQL, "op8_url_filter": url_filter.SQL, "op9_embedding_dedup": embedding_dedup.SQL, "op10_substring_dedup": substring_dedup.SQL, "op11_prefix_trie": prefix_trie.SQL}
