"""The corpus pipeline: quality rules, line dedup, near-duplicates, benchmark decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from transfergraph.llm import decontam, line_dedup, mixing, near_texts, quality_rules
from transfergraph.llm.common import table
from transfergraph.plans.cut import materialise

#: Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("near_duplicates", near_texts.stage),
    ("decontaminate", decontam.stage),
    ("mix", mixing.stage),
]
#: XXH64 fingerprints and alignments are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of what the stages before it keep; each stage's rows are written once and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
