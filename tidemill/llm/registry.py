"""The registered queries of the training-text operators."""

from __future__ import annotations

from tidemill.llm import bpe, decontaminate, language, licenses, lines, quality, simhash, substrings, suffixes, toxicity

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_bpe": bpe.op2_bpe,
    "op3_simhash": simhash.op3_simhash,
    "op4_suffixes": suffixes.op4_suffixes,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_language": language.op6_language,
    "op7_lines": lines.op7_lines,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_quality": quality.op10_quality,
    "op8_substrings": substrings.op8_substrings,
}
ORACLES = {"op1_licenses": licenses.OP1_SQL, "op7_lines": lines.OP7_SQL, "op8_substrings": substrings.OP8_SQL}
