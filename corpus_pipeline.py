"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
documents. Between stages the rows are cut from their lineage in the cluster's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import queries as q
from tidemark.llm.common import checkpointed, documents

STAGES = [
    ("language_id", q.accept_language),
    ("near_dedup", q.drop_near_duplicates),
    ("suffix_dedup", q.drop_repeats),
    ("pii_surrogates", q.replace_private),
    ("packing", q.pack_sequences),
]

#: No stage but the filters has an SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, checkpointed(docs) if k else docs, sf_dir)
    return docs
