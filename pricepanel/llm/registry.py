"""The queries of this subpackage and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, cotraining, fingerprints, html_text, lexical, licenses, mixing, ppm, quality_rules, simhash, url_rules, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_entropy_mix": mixing.op2_entropy_mix,
    "op3_warc_chunks": warc.op3_warc_chunks,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_rare_features": fingerprints.op5_rare_features,
    "op6_ppm_score": ppm.op6_ppm_score,
    "op7_html_text": html_text.op7_html_text,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_simhash_trie": simhash.op9_simhash_trie,
    "op10_cotraining": cotraining.op10_cotraining,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_url_filters": url_rules.op12_url_filters,
    "op13_aho_search": lexical.op13_aho_search,
}

ORACLES: dict[str, str] = {
    "op3_warc_chunks": warc.ORACLE,
    "op4_quality_rules": quality_rules.ORACLE,
    "op12_url_filters": url_rules.ORACLE,
    "op13_aho_search": lexical.ORACLE,
}
