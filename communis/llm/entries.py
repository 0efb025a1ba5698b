"""Queries and SQL of the operators, for the registry."""

from . import decontaminate, fingerprints, html, language, packing, pii, secrets, simhash, toxicity, urls

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_secrets": secrets.op3_secrets,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_simhash": simhash.op6_simhash,
    "op7_html": html.op7_html,
    "op8_pii": pii.op8_pii,
    "op9_urls": urls.op9_urls,
    "op10_language": language.op10_language,
}
ORACLES = {"op9_urls": urls.ORACLE_OP9}
