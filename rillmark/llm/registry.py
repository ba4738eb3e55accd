"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from . import byte_bpe, decontamination, divergence, lexical, line_windows, pieces, pseudonyms, quality, repetition, simhash, suffix_dedup, token_counts, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_simhash": simhash.op4_simhash,
    "op5_quality": quality.op5_quality,
    "op6_pseudonyms": pseudonyms.op6_pseudonyms,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_repetition": repetition.op8_repetition,
    "op9_line_windows": line_windows.op9_line_windows,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_divergence": divergence.op11_divergence,
    "op12_lexical": lexical.op12_lexical,
    "op13_pieces": pieces.op13_pieces,
}

ORACLES: dict[str, str] = {
    "op3_suffix_dedup": suffix_dedup.OP3_SQL,
    "op7_decontamination": decontamination.OP7_SQL,
    "op8_repetition": repetition.OP8_SQL,
    "op9_line_windows": line_windows.OP9_SQL,
    "op11_divergence": divergence.OP11_SQL,
    "op12_lexical": lexical.OP12_SQL,
}
