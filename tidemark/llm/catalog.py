"""Queries and SQL of the training-data operators."""

from tidemark.llm import (
    context_tree, fingerprints, html_blocks, jaccard_join, kernel_quality, lexical_search, licenses, mixing, pii, quality_rules, sentencepiece_scan, whitening, word_bpe,
)

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (context_tree, html_blocks, licenses, mixing, sentencepiece_scan, fingerprints, pii, jaccard_join, quality_rules, kernel_quality, lexical_search, word_bpe, whitening):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
