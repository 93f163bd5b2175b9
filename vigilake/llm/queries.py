"""The queries of the corpus operators: name -> (function of (spark, sf_dir), SQL that DuckDB runs over the same tables, or None)."""

from __future__ import annotations

from vigilake.llm.bpe_codec import op6_byte_bpe_codec
from vigilake.llm.chat_grammar import OP10_SQL, op10_chat_format
from vigilake.llm.contamination import OP8_SQL, op8_benchmark_decontamination
from vigilake.llm.html_diff import op5_html_text
from vigilake.llm.license_scan import op9_license_scan
from vigilake.llm.line_neighbourhood import op3_line_dedup
from vigilake.llm.merkle import OP12_SQL, op12_merkle_manifest
from vigilake.llm.order_minhash import op1_minhash_near_dedup
from vigilake.llm.quality_ledger import OP7_SQL, op7_quality_rules
from vigilake.llm.source_divergence import OP11_SQL, op11_source_divergence
from vigilake.llm.suffix_dedup import OP4_SQL, op4_substring_dedup
from vigilake.llm.token_count import op2_token_counts
from vigilake.llm.toxicity import op13_toxicity

QUERIES = {
    "op1_minhash_near_dedup": (op1_minhash_near_dedup, None),
    "op2_token_counts": (op2_token_counts, None),
    "op3_line_dedup": (op3_line_dedup, None),
    "op4_substring_dedup": (op4_substring_dedup, OP4_SQL),
    "op5_html_text": (op5_html_text, None),
    "op6_byte_bpe_codec": (op6_byte_bpe_codec, None),
    "op7_quality_rules": (op7_quality_rules, OP7_SQL),
    "op8_benchmark_decontamination": (op8_benchmark_decontamination, OP8_SQL),
    "op9_license_scan": (op9_license_scan, None),
    "op10_chat_format": (op10_chat_format, OP10_SQL),
    "op11_source_divergence": (op11_source_divergence, OP11_SQL),
    "op12_merkle_manifest": (op12_merkle_manifest, OP12_SQL),
    "op13_toxicity": (op13_toxicity, None),
}
