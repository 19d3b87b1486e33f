"""The queries of this subpackage, and their SQL where SQL can express them."""
from __future__ import annotations

from . import align, decontaminate, encode, jaccard, licences, lines, mixing, search, secrets, simhash, substring, taat, toxicity

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_toxicity": toxicity.query,
    "op3_token_planes": encode.query,
    "op4_fuzzy_lines": lines.query,
    "op5_licences": licences.query,
    "op6_decontaminate": decontaminate.query,
    "op7_substring_dedup": substring.query,
    "op8_bm25_top_k": search.query,
    "op9_secrets": secrets.query,
    "op10_jaccard_join": jaccard.query,
    "op11_simhash_near": simhash.query,
    "op12_taat_search": taat.query,
    "op13_token_alignment": align.query,
}

ORACLES = {
    "op1_mix_sources": mixing.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op7_substring_dedup": substring.SQL,
    "op8_bm25_top_k": search.SQL,
    "op10_jaccard_join": jaccard.SQL,
    "op12_taat_search": taat.SQL,
}
