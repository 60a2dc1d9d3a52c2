"""The queries of this package, each beside its SQL counterpart where SQL can express it."""

from __future__ import annotations

from tomeweave.llm import (
    alignment,
    chat,
    exact_search,
    hard_negatives,
    licences,
    line_dedup,
    mixing,
    neighbour_tree,
    packing,
    secrets,
    shingle_join,
    token_counts,
    toxicity,
)

QUERIES = {
    "op1_norm_bucketed_top_k": exact_search.query,
    "op2_ordinal_toxicity": toxicity.query,
    "op3_prefix_target_chat": chat.query,
    "op4_mix_to_target_weights": mixing.query,
    "op5_count_tree_jaccard": shingle_join.query,
    "op6_decoded_layer_secrets": secrets.query,
    "op7_licence_labels": licences.query,
    "op8_k_means_tree_neighbours": neighbour_tree.query,
    "op9_segment_line_dedup": line_dedup.query,
    "op10_sum_of_squares_packing": packing.query,
    "op11_threshold_join_negatives": hard_negatives.query,
    "op12_fragment_alignment": alignment.query,
    "op13_resynchronised_counts": token_counts.query,
}

ORACLES: dict[str, str] = {
    "op1_norm_bucketed_top_k": exact_search.SQL,
    "op3_prefix_target_chat": chat.SQL,
    "op5_count_tree_jaccard": shingle_join.SQL,
    "op11_threshold_join_negatives": hard_negatives.SQL,
}
