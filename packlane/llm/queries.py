"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, exact_dedup, language, license_scan, lm_score, mixing, near_dedup, quality, token_ids, warc

QUERIES = {
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_lm_score": lm_score.op5_lm_score,
    "op7_warc": warc.op7_warc,
    "op9_license_scan": license_scan.op9_license_scan,
    "op3_language": language.op3_language,
    "op8_quality": quality.op8_quality,
    "op1_token_ids": token_ids.op1_token_ids,
    "op2_mixing": mixing.op2_mixing,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLE_SQL = {
    "op2_mixing": mixing.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
