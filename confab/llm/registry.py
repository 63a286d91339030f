"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from confab.llm import decontaminate, host_reputation, language, license_scan, mixing_lm, neighbours, order_minhash, packing, resampling, secrets, spelling, warc, weighted_fingerprint

QUERIES = {
    "op1_host_reputation": host_reputation.op1_host_reputation,
    "op2_language": language.op2_language,
    "op3_secrets": secrets.op3_secrets,
    "op4_weighted_fingerprint": weighted_fingerprint.op4_weighted_fingerprint,
    "op5_packing": packing.op5_packing,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_order_minhash": order_minhash.op7_order_minhash,
    "op8_warc": warc.op8_warc,
    "op9_mixing_lm": mixing_lm.op9_mixing_lm,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_nearest_neighbours": neighbours.op11_nearest_neighbours,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_spelling_variants": spelling.op13_spelling_variants,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_host_reputation": host_reputation.ORACLE,
    "op6_license_scan": license_scan.ORACLE,
    "op10_decontamination": decontaminate.ORACLE,
    "op11_nearest_neighbours": neighbours.ORACLE,
    "op12_importance_resampling": resampling.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
