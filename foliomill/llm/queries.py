"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import centroids, decontaminate, fingerprint, hamming, html_blocks, language, lexical, licences, mixing, neardup, suffixes, toxicity, warc

QUERIES = {
    "op1_fingerprints": fingerprint.op1_fingerprints,
    "op2_warc": warc.op2_warc,
    "op3_repeats": suffixes.op3_repeats,
    "op4_language": language.op4_language,
    "op5_licences": licences.op5_licences,
    "op6_mixing": mixing.op6_mixing,
    "op7_html": html_blocks.op7_html,
    "op8_neardup": neardup.op8_neardup,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_lexical": lexical.op11_lexical,
    "op12_neighbours": hamming.op12_neighbours,
    "op13_centroids": centroids.op13_centroids,
}

ORACLE_SQL = {
    "op2_warc": warc.ORACLE_SQL,
    "op3_repeats": suffixes.ORACLE_SQL,
    "op5_licences": licences.ORACLE_SQL,
    "op8_neardup": neardup.ORACLE_SQL,
    "op9_decontaminate": decontaminate.ORACLE_SQL,
    "op11_lexical": lexical.ORACLE_SQL,
    "op13_centroids": centroids.ORACLE_SQL,
}
