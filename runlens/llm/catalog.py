"""Queries of this package and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import edit_match, filter_diagrams, hilbert_negatives, kneser_ney, language, license_rules, one_bit_codes, piece_trie, quartile_digest, simhash, template_removal, token_files, url_reputation

Query = Callable[[SparkSession, str], DataFrame]

CATALOG: dict[str, Query] = {
    "op1_token_files": token_files.op1_token_files,
    "op2_piece_trie": piece_trie.op2_piece_trie,
    "op3_simhash": simhash.op3_simhash,
    "op4_license_rules": license_rules.op4_license_rules,
    "op5_url_reputation": url_reputation.op5_url_reputation,
    "op6_template_removal": template_removal.op6_template_removal,
    "op7_kneser_ney": kneser_ney.op7_kneser_ney,
    "op8_edit_match": edit_match.op8_edit_match,
    "op9_language": language.op9_language,
    "op10_quartile_digest": quartile_digest.op10_quartile_digest,
    "op11_hilbert_negatives": hilbert_negatives.op11_hilbert_negatives,
    "op12_one_bit_codes": one_bit_codes.op12_one_bit_codes,
    "op13_filter_diagrams": filter_diagrams.op13_filter_diagrams,
}
ORACLES: dict[str, str] = {
    "op5_url_reputation": url_reputation.ORACLE,
    "op11_hilbert_negatives": hilbert_negatives.ORACLE,
    "op12_one_bit_codes": one_bit_codes.ORACLE,
    "op13_filter_diagrams": filter_diagrams.ORACLE,
}
