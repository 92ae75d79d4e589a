"""The corpus operators' queries and their SQL, by name."""

from lumisift.llm import decontamination, hmm, line_dedup, merkle, packing, quality_classifier, quality_rules, resampling, simhash, substring_dedup, suffix_dedup, token_counts, warc

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_suffix_array_dedup": suffix_dedup.op2_suffix_array_dedup,
    "op3_warc_round_trip": warc.op3_warc_round_trip,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_hidden_markov_scores": hmm.op8_hidden_markov_scores,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_benchmark_decontamination": decontamination.op10_benchmark_decontamination,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}
ORACLES = {
    "op3_warc_round_trip": warc.ORACLE_SQL,
    "op7_quality_rules": quality_rules.ORACLE_SQL,
    "op10_benchmark_decontamination": decontamination.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op12_line_dedup": line_dedup.ORACLE_SQL,
    "op13_importance_resampling": resampling.ORACLE_SQL,
}
