"""The queries of this subpackage and their reference SQL."""

from __future__ import annotations

import corpus_pipeline
from tablewake.llm import (
    ann, bpe, langid, license_scan, line_dedup, mixing, periodic, prefix_trie, quality, simhash, suffix_dedup, tokencount, warc,
)

QUERIES = {
    "op1_source_mix": mixing.op1_source_mix,
    "op2_simhash": simhash.op2_simhash,
    "op3_curve_neighbours": ann.op3_curve_neighbours,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_warc_revisits": warc.op7_warc_revisits,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_token_counts": tokencount.op9_token_counts,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_language_id": langid.op11_language_id,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}

#: Fingerprints, neighbours, repeated strings, tokens, a trained network and periodic runs have no form in SQL; their tests use brute force.
ORACLES = {
    "op1_source_mix": mixing.OP1_SQL,
    "op4_license_scan": license_scan.OP4_SQL,
    "op7_warc_revisits": warc.OP7_SQL,
    "op8_quality_rules": quality.OP8_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
