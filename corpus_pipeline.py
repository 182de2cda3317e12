"""Cleaning a corpus in five stages: what each keeps is written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir) and returns the documents that go on, with the columns of
``documents``; the last adds the pieces.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import table
from lodestone.llm.decontamination import drop_contaminated
from lodestone.llm.line_dedup import drop_repeated_lines
from lodestone.llm.near_duplicates import drop_near_duplicates
from lodestone.llm.sentence_pieces import encode_documents
from lodestone.llm.toxicity import reject_toxic

STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentence_pieces", encode_documents),
]

#: Learned models, similarity of n-grams by hashing, and A* search are no SQL: the tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps lies in the cluster's shared folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints")
    folder = f"{shared}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
