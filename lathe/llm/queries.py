"""The queries of the corpus operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lathe.llm import bpe, chat, conversation_repair, fingerprints, language_model, licenses, neardup, packing, quality_crf, quality_rules, secrets, toxicity, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_roundtrip": bpe.op1_bpe_roundtrip,
        "op2_document_fingerprints": fingerprints.op2_document_fingerprints,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_license_scan": licenses.op4_license_scan,
        "op5_simhash_neardup": neardup.op5_simhash_neardup,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_quality_classifier": quality_crf.op7_quality_classifier,
        "op8_secret_scan": secrets.op8_secret_scan,
        "op9_chat_format": chat.op9_chat_format,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
        "op11_conversation_repair": conversation_repair.op11_conversation_repair,
        "op12_language_model": language_model.op12_language_model,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_license_scan": licenses.ORACLE_SQL,
        "op6_quality_rules": quality_rules.ORACLE_SQL,
        "op8_secret_scan": secrets.ORACLE_SQL,
        "op9_chat_format": chat.ORACLE_SQL,
        "op13_vector_codes": vector_codes.ORACLE_SQL,
    }
