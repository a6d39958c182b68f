"""The queries of the training-data operators, by name."""

from __future__ import annotations

from . import collocations, decontamination, distance_keys, fertility, language_id, one_bit, packing, quality_knn, simhash, substring_dedup, suffix_dedup, token_counts, warc

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_language_id": language_id.op3_language_id,
    "op4_warc": warc.op4_warc,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_fertility_rules": fertility.op6_fertility_rules,
    "op7_quality_classifier": quality_knn.op7_quality_classifier,
    "op8_simhash": simhash.op8_simhash,
    "op9_suffix_array_dedup": suffix_dedup.op9_suffix_array_dedup,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_one_bit_neighbours": one_bit.op11_one_bit_neighbours,
    "op12_collocations": collocations.op12_collocations,
    "op13_distance_key_negatives": distance_keys.op13_distance_key_negatives,
}

#: Only where SQL can express the operator on whole tables.
ORACLE_SQL: dict[str, str] = {"op4_warc": warc.OP4_SQL, "op11_one_bit_neighbours": one_bit.OP11_SQL, "op12_collocations": collocations.OP12_SQL, "op13_distance_key_negatives": distance_keys.OP13_SQL}
