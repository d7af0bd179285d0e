"""Queries of this package, one for each operator, and SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, decontam, langid, lines, neardup, rules, substring, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": neardup.op1_minhash,
    "op2_decontaminate": decontam.op2_decontaminate,
    "op3_language_id": langid.op3_language_id,
    "op4_substring_dedup": substring.op4_substring_dedup,
    "op5_url_filter": urls.op5_url_filter,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_rule_ensemble": rules.op7_rule_ensemble,
    "op8_decision_list": rules.op8_decision_list,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_byte_bpe": bpe.op10_byte_bpe,
}
ORACLE: dict[str, str] = {
    "op2_decontaminate": decontam.OP2_SQL,
    "op4_substring_dedup": substring.OP4_SQL,
    "op9_line_dedup": lines.OP9_SQL,
}
