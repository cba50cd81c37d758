"""Registered queries of this subpackage and their SQL, where SQL can say it."""

from __future__ import annotations

from catalogspark.llm import (
    counts, decontaminate, importance, language, licenses, lines, ngrams, packing, phrases, topk, urls, warc, wavelet,
)

QUERIES = {
    "op1_wavelet_matrix": wavelet.op1_wavelet_matrix,
    "op2_grouped_prefix_join": ngrams.op2_grouped_prefix_join,
    "op3_naive_bayes": language.op3_naive_bayes,
    "op4_hilbert_order": packing.op4_hilbert_order,
    "op5_prefix_filtered_join": decontaminate.op5_prefix_filtered_join,
    "op6_pivot_distance": topk.op6_pivot_distance,
    "op7_host_segmentation": urls.op7_host_segmentation,
    "op8_fuzzy_notices": licenses.op8_fuzzy_notices,
    "op9_line_templates": lines.op9_line_templates,
    "op10_digest_cache": counts.op10_digest_cache,
    "op11_sharded_warc": warc.op11_sharded_warc,
    "op12_position_crc": importance.op12_position_crc,
    "op13_prefix_free_phrases": phrases.op13_prefix_free_phrases,
}

ORACLES = {
    "op2_grouped_prefix_join": ngrams.OP2_SQL,
    "op5_prefix_filtered_join": decontaminate.OP5_SQL,
    "op6_pivot_distance": topk.OP6_SQL,
    "op9_line_templates": lines.OP9_SQL,
    "op11_sharded_warc": warc.OP11_SQL,
    "op13_prefix_free_phrases": phrases.OP13_SQL,
}
