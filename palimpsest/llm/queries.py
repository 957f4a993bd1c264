"""The llm queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import chat, decontaminate, fingerprints, language, lm, ngram_join, packing, passages, urls, warc


def queries() -> dict:
    return {
        "op1_simhash": fingerprints.op1,
        "op2_url_filter": urls.op2,
        "op3_decontamination": decontaminate.op3,
        "op4_language_id": language.op4,
        "op5_lm_scoring": lm.op5,
        "op6_substring_dedup": passages.op6,
        "op7_best_fit_packing": packing.op7,
        "op8_ngram_jaccard": ngram_join.op8,
        "op9_chat_format": chat.op9,
        "op10_warc": warc.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": decontaminate.ORACLE, "op10_warc": warc.ORACLE}
