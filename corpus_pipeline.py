"""A training corpus from raw documents: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import bpe, decontamination, langid, pii, simhash
from folioforge.llm.common import stored, table

STAGES = [
    ("language_id", langid.stage),
    ("near_duplicates", simhash.stage),
    ("decontamination", decontamination.stage),
    ("personal_data", pii.stage),
    ("bpe", bpe.stage),
]

#: SQL can express neither the clustered centroids nor the fingerprints; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents.

    Rejected languages go, one document of each group of near duplicates stays, contaminated documents go, personal data is
    generalised, and what is left is encoded and decoded.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
