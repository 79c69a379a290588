"""A corpus from raw documents to token files, a stage after another.

Every stage works on all rows that the one before it kept. Tables between stages are written to the folder that
driver and executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import Scratch, ships_package, table
from tidemark.llm.mixing import mixing_stage
from tidemark.llm.simhash import near_duplicate_stage
from tidemark.llm.templates import decontamination_stage
from tidemark.llm.tokenfiles import token_stage
from tidemark.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", ships_package(toxicity_stage)),
    ("simhash", ships_package(near_duplicate_stage)),
    ("decontamination", ships_package(decontamination_stage)),
    ("mixing", ships_package(mixing_stage)),
    ("tokens", ships_package(token_stage)),
]

#: Neither the classifier nor fingerprints nor token ids can be stated in SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
