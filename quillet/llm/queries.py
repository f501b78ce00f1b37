"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from quillet.llm import chat, codebooks, jaccard, lines, neighbours, packing, pii, prefixes, quality, sharding, substrings, tokens, toxicity
from quillet.llm.oracles import ORACLE_SQL  # noqa: F401


def pipeline(spark, sf_dir: str):
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_best_fit_packing": packing.op1,
    "op2_byte_balanced_sharding": sharding.op2,
    "op3_ngram_jaccard_join": jaccard.op3,
    "op4_multi_index_hashing": neighbours.op4,
    "op5_byte_level_bpe": tokens.op5,
    "op6_distribution_divergence": quality.op6,
    "op7_fuzzy_lexicon_toxicity": toxicity.op7,
    "op8_substring_dedup": substrings.op8,
    "op9_pii_surrogates": pii.op9,
    "op10_tool_call_linking": chat.op10,
    "op11_prefix_trie": prefixes.op11,
    "op12_heap_lloyd": codebooks.op12,
    "op13_line_runs": lines.op13,
    "pipeline": pipeline,
}


