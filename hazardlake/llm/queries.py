"""Registered queries of this subpackage and their SQL for DuckDB."""

from . import (license_scan, line_dedup, mixing, near_dup, pieces, prefix_trie, substring_dedup, syncmers, token_alignment, token_scan,
               toxicity, vafile, warc)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_vafile": vafile.op2_vafile,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_syncmers": syncmers.op4_syncmers,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_jaccard_join": near_dup.op6_jaccard_join,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_mixing": mixing.op8_mixing,
    "op9_warc": warc.op9_warc,
    "op10_token_counts": token_scan.op10_token_counts,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_license_scan": license_scan.op12_license_scan,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}

ORACLE = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op2_vafile": vafile.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op9_warc": warc.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
}
