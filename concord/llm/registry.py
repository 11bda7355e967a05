"""The queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from concord.llm import bpe, exact_dedup, fingerprint, jaccard, langid, packing, pii, secret_scan, toxicity, warc


def queries() -> dict:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_pii": pii.op2_pii,
        "op3_jaccard_join": jaccard.op3_jaccard_join,
        "op4_fingerprint": fingerprint.op4_fingerprint,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_secret_scan": secret_scan.op6_secret_scan,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op9_warc": warc.op9_warc,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_dedup": exact_dedup.ORACLE}
