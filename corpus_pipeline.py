"""A corpus pipeline over documents: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage works on all that the one before kept: rejected documents go and failing lines with them; one document of each
group of near-duplicates stays; words of repeated passages go, and so do documents of which nothing is left; personal
data is redacted; what remains is packed into token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import near_dedup, packing, pii, quality_rules, substring_dedup
from tidemark.llm.common import stored, table

STAGES = [
    ("quality rules", lambda spark, docs, sf_dir: quality_rules.stage(docs)),
    ("near-duplicates", lambda spark, docs, sf_dir: near_dedup.stage(docs)),
    ("repeated passages", lambda spark, docs, sf_dir: substring_dedup.stage(docs)),
    ("personal data", lambda spark, docs, sf_dir: pii.stage(docs)),
    ("packing", lambda spark, docs, sf_dir: packing.stage(docs)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{k}")
    return docs


#: SQL can't express boosted trees or byte pair encoding; tests/llm holds the stages against brute force.
ORACLE_SQL = None
