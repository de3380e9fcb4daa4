"""Queries of this folder, with SQL where SQL can express them."""

from __future__ import annotations

from pollwarden.llm import (op01_decontaminate, op02_exact_dedup, op03_long_repeats, op04_toxicity, op05_quality, op06_byte_bpe, op07_simhash,
                            op08_licenses, op09_token_counts, op10_lattice_lm, op11_url_filter, op12_whitening, op13_hard_negatives)

QUERIES = {
    "op1_decontaminate": op01_decontaminate.op1_decontaminate,
    "op2_exact_dedup": op02_exact_dedup.op2_exact_dedup,
    "op3_long_repeats": op03_long_repeats.op3_long_repeats,
    "op4_toxicity": op04_toxicity.op4_toxicity,
    "op5_quality": op05_quality.op5_quality,
    "op6_byte_bpe": op06_byte_bpe.op6_byte_bpe,
    "op7_simhash": op07_simhash.op7_simhash,
    "op8_licenses": op08_licenses.op8_licenses,
    "op9_token_counts": op09_token_counts.op9_token_counts,
    "op10_lattice_lm": op10_lattice_lm.op10_lattice_lm,
    "op11_url_filter": op11_url_filter.op11_url_filter,
    "op12_whitening": op12_whitening.op12_whitening,
    "op13_hard_negatives": op13_hard_negatives.op13_hard_negatives,
}
ORACLES = {"op2_exact_dedup": op02_exact_dedup.SQL, "op13_hard_negatives": op13_hard_negatives.SQL}
