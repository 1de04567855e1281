"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tessera.llm import bpe, exact_dedup, html_extract, language_id, license_scan, minhash, packing, substring_dedup, topk, url_filter

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_language_id": language_id.op2_language_id,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_packing": packing.op4_packing,
    "op5_html_extract": html_extract.op5_html_extract,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_bpe": bpe.op8_bpe,
    "op9_minhash": minhash.op9_minhash,
    "op10_topk": topk.op10_topk,
}

ORACLES = {"op3_exact_dedup": exact_dedup.ORACLE_SQL, "op10_topk": topk.ORACLE_SQL}
