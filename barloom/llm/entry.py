"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, embedding_dedup, filter_audit, fingerprints, html_text, language, line_dedup, minhash, mixing, packing, quality_classifier, quality_rules, token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_minhash": minhash.op4_minhash,
        "op5_language_id": language.op5_language_id,
        "op6_html_text": html_text.op6_html_text,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_token_files": token_files.op8_token_files,
        "op9_quality_classifier": quality_classifier.op9_quality_classifier,
        "op10_packing": packing.op10_packing,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_collocations": collocations.op12_collocations,
        "op13_fingerprints": fingerprints.op13_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.OP1_SQL,
        "op2_embedding_dedup": embedding_dedup.OP2_SQL,
        "op3_line_dedup": line_dedup.OP3_SQL,
        "op4_minhash": minhash.OP4_SQL,
        "op11_filter_audit": filter_audit.OP11_SQL,
        "op12_collocations": collocations.OP12_SQL,
        "op13_fingerprints": fingerprints.OP13_SQL,
    }
