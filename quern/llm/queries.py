"""The queries of this subpackage and, where SQL can express them, their DuckDB texts."""

from __future__ import annotations

from quern.llm import collocations, decontaminate, jaccard, licenses, mixing, ngramlm, pii, quality, secrets, simhash, sstable, vectorcode, wrapper

QUERIES = {
    "op1_html_extraction": wrapper.query,
    "op2_ngram_jaccard": jaccard.query,
    "op3_license_scan": licenses.query,
    "op4_decontaminate": decontaminate.query,
    "op5_mixing": mixing.query,
    "op6_pii": pii.query,
    "op7_quality_rules": quality.query,
    "op8_token_shards": sstable.query,
    "op9_ngram_lm": ngramlm.query,
    "op10_secret_scan": secrets.query,
    "op11_collocations": collocations.query,
    "op12_simhash": simhash.query,
    "op13_vector_codes": vectorcode.query,
}
ORACLE = {
    "op2_ngram_jaccard": jaccard.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op7_quality_rules": quality.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op13_vector_codes": vectorcode.ORACLE,
}
