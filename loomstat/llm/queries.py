"""Registered queries of this package: name → (function of session and folder, equivalent SQL or None)."""

from __future__ import annotations

from . import align, ann, decontaminate, lm, mixing, neardup, packing, quality, repeats, tokens, toxicity, trie, warc

QUERIES = {
    "op1_mixing": (mixing.query, mixing.ORACLE_SQL),
    "op2_warc": (warc.query, warc.ORACLE_SQL),
    "op3_toxicity": (toxicity.query, None),
    "op4_ann": (ann.query, None),
    "op5_quality": (quality.query, None),
    "op6_neardup": (neardup.query, None),
    "op7_lm": (lm.query, None),
    "op8_tokens": (tokens.query, None),
    "op9_decontaminate": (decontaminate.query, None),
    "op10_repeats": (repeats.query, None),
    "op11_packing": (packing.query, None),
    "op12_align": (align.query, None),
    "op13_trie": (trie.query, trie.ORACLE_SQL),
}
