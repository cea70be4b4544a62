"""The queries of the corpus operators and their SQL oracles."""

from __future__ import annotations

from . import blocknames, jaccard, langid, mixing, packing, quality, quotes, sanitise, sitetree, toxicity


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_packing": packing.op2_packing,
        "op3_html_extraction": sitetree.op3_html_extraction,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_ngram_jaccard": jaccard.op5_ngram_jaccard,
        "op6_quote_linking": quotes.op6_quote_linking,
        "op7_pii": sanitise.op7_pii,
        "op8_language_id": langid.op8_language_id,
        "op9_exact_dedup": blocknames.op9_exact_dedup,
        "op10_quality_rules": quality.op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.OP1_SQL, "op6_quote_linking": quotes.OP6_SQL, "op5_ngram_jaccard": jaccard.OP5_SQL, "op9_exact_dedup": blocknames.OP9_SQL}
