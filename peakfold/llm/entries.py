"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, bpe, class_lm, exact_dedup, fingerprints, language_id, license_scan, mixing, near_dedup, pieces, pii, token_files

QUERIES = {
    "op1_mix_sources": mixing.op1,
    "op2_license_scan": license_scan.op2,
    "op3_exact_dedup": exact_dedup.op3,
    "op4_class_lm": class_lm.op4,
    "op5_fingerprints": fingerprints.op5,
    "op6_token_files": token_files.op6,
    "op7_language_id": language_id.op7,
    "op8_near_dedup": near_dedup.op8,
    "op9_pii": pii.op9,
    "op10_byte_bpe": bpe.op10,
    "op11_sentencepiece": pieces.op11,
    "op12_alignment": alignment.op12,
}
#: Views on the rows of op 2 and op 9: the columns that SQL can state.
QUERIES |= {
    "base_licenses": lambda spark, sf_dir: license_scan.op2(spark, sf_dir).selectExpr("doc_id", "n_words", "n_base", "coalesce(first_word, -1) first_word", "coalesce(last_word, -1) last_word", "base_labels"),
    "base_identifiers": lambda spark, sf_dir: pii.op9(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone"),
}
ORACLE_SQL = {
    "op1_mix_sources": mixing.OP1_SQL, "op3_exact_dedup": exact_dedup.OP3_SQL, "op8_near_dedup": near_dedup.OP8_SQL,
    "base_licenses": license_scan.BASE_SQL, "base_identifiers": pii.BASE_SQL,
}
