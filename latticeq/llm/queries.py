"""The registered queries of this folder: name -> callable(spark, sf_dir), and their DuckDB SQL."""

from __future__ import annotations

from . import decontamination, lm, mixing, neardup, quality, quotes, secrets, toxicity, urlfilter, warc

QUERIES = {
    "op1_decontamination": decontamination.query,
    "op2_toxicity": toxicity.query,
    "op3_warc_segments": warc.query,
    "op4_secret_scan": secrets.query,
    "op5_url_rules": urlfilter.query,
    "op6_quotation_links": quotes.query,
    "op7_source_mixing": mixing.query,
    "op8_quality_rules": quality.query,
    "op9_near_duplicates": neardup.query,
    "op10_language_model": lm.query,
}

ORACLES = {
    "op1_decontamination": decontamination.ORACLE,
    "op3_warc_segments": warc.ORACLE,
    "op5_url_rules": urlfilter.ORACLE,
    "op8_quality_rules": quality.ORACLE,
    "op9_near_duplicates": neardup.ORACLE,
}
