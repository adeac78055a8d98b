"""The registered queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from . import chat, decontaminate, exact, licenses, mixing, neardup, pii, substrings, tokens, toxicity

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_tokens": tokens.query,
    "op3_decontaminate": decontaminate.query,
    "op4_licenses": licenses.query,
    "op5_toxicity": toxicity.query,
    "op6_pii": pii.query,
    "op7_substrings": substrings.query,
    "op8_chat": chat.query,
    "op9_neardup": neardup.query,
    "op10_exact_dedup": exact.query,
}

ORACLES = {"op1_mixing": mixing.ORACLE, "op7_substrings": substrings.ORACLE, "op8_chat": chat.ORACLE, "op10_exact_dedup": exact.ORACLE}
