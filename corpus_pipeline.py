"""The corpus pipeline: stages from documents to token files.

Defined results of the chain: null and empty texts are scored like any text and, where they stay, have no words and are not in the mix;
rows with null ids go through; documents without labels train nothing, and without any labels all are kept; without
benchmark items nothing is cut; an empty table gives an empty result; columns of any name come through all stages but the
last. The token file holds the mix in the order of its slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanlake.llm import decontaminate, mixing, near, quality, tokens
from spanlake.llm.common import materialize, read_table

STAGES = [
    ("quality classifier", lambda spark, docs, sf_dir: quality.keep_quality(docs, read_table(spark, sf_dir, "labels"))),
    ("near duplicates", lambda spark, docs, sf_dir: near.drop_near_duplicates(docs)),
    ("decontamination", lambda spark, docs, sf_dir: decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))),
    ("mix sources", lambda spark, docs, sf_dir: mixing.mixed_documents(docs)),
    ("token file", lambda spark, docs, sf_dir: tokens.token_file(docs, file_order=True)),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
