"""Queries of the training-data operators, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

from . import chat, fill_middle, forest, html_text, mixing, near_dedup, packing, quality, recompression, repair, search, suffix_dedup, toxicity

QUERIES = {
    "op1_recompression_dedup": recompression.query,
    "op2_divergence_quality": quality.query,
    "op3_best_fit_packing": packing.query,
    "op4_norm_bucketed_search": search.query,
    "op5_prefix_target_chat": chat.query,
    "op6_setsketch_near_dedup": near_dedup.query,
    "op7_pareto_mixing": mixing.query,
    "op8_convolutional_toxicity": toxicity.query,
    "op9_minimum_cut_html": html_text.query,
    "op10_suffix_array_dedup": suffix_dedup.query,
    "op11_hash_prefix_forest": forest.query,
    "op12_checkpoint_fill_middle": fill_middle.query,
    "op13_ranked_repair": repair.query,
}

ORACLE_SQL = {
    "op1_recompression_dedup": recompression.ORACLE_SQL,
    "op4_norm_bucketed_search": search.ORACLE_SQL,
    "op5_prefix_target_chat": chat.ORACLE_SQL,
    "op6_setsketch_near_dedup": near_dedup.ORACLE_SQL,
    "op7_pareto_mixing": mixing.ORACLE_SQL,
    "op10_suffix_array_dedup": suffix_dedup.ORACLE_SQL,
    "op12_checkpoint_fill_middle": fill_middle.ORACLE_SQL,
    "op13_ranked_repair": repair.ORACLE_SQL,
}
