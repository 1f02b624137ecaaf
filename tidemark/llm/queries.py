"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat_format, gif, near_dedup, packing, pii, quality_rules, secret_scan, substring_dedup, toxicity
from .common import table


def _documents(op):
    return lambda spark, sf_dir: op(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_near_dedup": _documents(near_dedup.op1),
    "op2_bpe": _documents(bpe.op2),
    "op3_gif": _documents(gif.op3),
    "op4_best_fit_packing": _documents(packing.op4),
    "op5_chat_format": lambda spark, d: chat_format.op5(table(spark, d, "conversations")),
    "op6_secret_scan": _documents(secret_scan.op6),
    "op7_toxicity": lambda spark, d: toxicity.op7(table(spark, d, "documents"), table(spark, d, "labels")),
    "op8_substring_dedup": _documents(substring_dedup.op8),
    "op9_pii": _documents(pii.op9),
    "op10_quality_rules": _documents(quality_rules.op10),
}

SQL = {
    "op1_near_dedup": near_dedup.SQL,
    "op5_chat_format": chat_format.SQL,
    "op8_substring_dedup": substring_dedup.SQL,
    "op10_quality_rules": quality_rules.SQL,
}
