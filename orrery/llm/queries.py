"""The queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

import corpus_pipeline
from orrery.llm import chat, decontamination, exact_dedup, language_id, mixing, near_dedup, packing, periodic_runs, phrase_dedup, prefix_trie, suffix_dedup, token_counts, toxicity

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_suffix_array_dedup": suffix_dedup.op4_suffix_array_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_benchmark_decontamination": decontamination.op6_benchmark_decontamination,
    "op7_substring_dedup": phrase_dedup.op7_substring_dedup,
    "op8_minhash_near_dedup": near_dedup.op8_minhash_near_dedup,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_language_id": language_id.op10_language_id,
    "op11_mixing_sources": mixing.op11_mixing_sources,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op3_chat_formatting": chat.OP3_SQL,
    "op6_benchmark_decontamination": decontamination.OP6_SQL,
    "op7_substring_dedup": phrase_dedup.OP7_SQL,
    "op8_minhash_near_dedup": near_dedup.OP8_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_mixing_sources": mixing.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_periodic_runs": periodic_runs.OP13_SQL,
}
