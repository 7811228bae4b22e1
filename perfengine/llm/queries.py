"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from perfengine.llm import (
    op1_mixing, op2_decontaminate, op3_url_filter, op4_html_extract, op5_fingerprint,
    op6_language, op7_toxicity, op8_neardup, op9_records, op10_licenses, op11_neighbours, op12_spelling, op13_lexical,
)

QUERIES = {
    "op1_mixing": op1_mixing.query,
    "op2_decontaminate": op2_decontaminate.query,
    "op3_url_filter": op3_url_filter.query,
    "op4_html_extract": op4_html_extract.query,
    "op5_fingerprint": op5_fingerprint.query,
    "op6_language": op6_language.query,
    "op7_toxicity": op7_toxicity.query,
    "op8_neardup": op8_neardup.query,
    "op9_records": op9_records.query,
    "op10_licenses": op10_licenses.query,
    "op11_neighbours": op11_neighbours.query,
    "op12_spelling": op12_spelling.query,
    "op13_lexical": op13_lexical.query,
}

ORACLE = {
    "op1_mixing": op1_mixing.ORACLE_SQL,
    "op2_decontaminate": op2_decontaminate.ORACLE_SQL,
    "op13_lexical": op13_lexical.ORACLE_SQL,
}
