"""Queries of the corpus operators and the SQL they are held against."""

from __future__ import annotations

from . import chat, decontam, flac, licenses, mixing, ngram_join, quality, tokens, toxicity, warc


def queries():
    return {
        "op1_quality": quality.op1_quality,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_ngram_join": ngram_join.op3_ngram_join,
        "op4_chat": chat.op4_chat,
        "op5_licenses": licenses.op5_licenses,
        "op6_warc": warc.op6_warc,
        "op7_mixing": mixing.op7_mixing,
        "op8_flac": flac.op8_flac,
        "op9_tokens": tokens.op9_tokens,
        "op10_decontam": decontam.op10_decontam,
    }


def oracle_sql():
    """Queries without an entry are tested against brute force, round trips or held-out accuracy."""
    return {"op4_chat": chat.OP4_SQL, "op6_warc": warc.OP6_SQL, "op7_mixing": mixing.OP7_SQL, "op10_decontam": decontam.OP10_SQL}
