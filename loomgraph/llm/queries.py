"""Queries of the training-data operators and their SQL, for the entry module."""

from __future__ import annotations

from loomgraph.llm import chat, erasure, exact_dedup, jaccard, licenses, manifest, mixing, pieces, quality, sharding, topk, toxicity, url_filters

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_chat": chat.op2_chat,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_sharding": sharding.op4_sharding,
    "op5_quality": quality.op5_quality,
    "op6_jaccard_join": jaccard.op6_jaccard_join,
    "op7_licenses": licenses.op7_licenses,
    "op8_topk": topk.op8_topk,
    "op9_pieces": pieces.op9_pieces,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_erasure": erasure.op11_erasure,
    "op12_manifest": manifest.op12_manifest,
    "op13_url_filters": url_filters.op13_url_filters,
}
#: Where there is none, SQL cannot express the operator or takes too long on whole tables; tests/llm has a brute-force version.
SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op7_licenses": licenses.OP7_SQL,
    "op8_topk": topk.OP8_SQL,
    "op12_manifest": manifest.OP12_SQL,
    "op13_url_filters": url_filters.OP13_SQL,
}
