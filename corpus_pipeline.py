"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

What a stage has written for itself is deleted once its result is written, and so is the stage before it.

run() returns the columns of documents and token_ids. The last stages' work cannot be put in SQL, so there
is no ORACLE_SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version (the first against the
scores that language identification gives) and decodes token_ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockrank.llm.bpe import encode_stage
from blockrank.llm.common import materialise, read_table, release, written
from blockrank.llm.decontaminate import decontaminate_stage
from blockrank.llm.language_id import language_stage
from blockrank.llm.line_dedup import line_stage
from blockrank.llm.near_dedup import near_stage

STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontaminate_stage),
    ("byte_bpe", encode_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, older = read_table(spark, sf_dir, "documents"), written(spark)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, (docs,), older)
    return docs
