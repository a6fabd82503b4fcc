"""From raw documents to training sequences: each stage reads what the one before it wrote.

1. ``toxicity``     documents that the classifier rejects go
2. ``exact_dedup``  of equal texts the largest doc_id stays
3. ``simhash``      of near copies the smallest doc_id stays: texts of which one of four fingerprints of
                    two-word shingles differs in two bits at most
4. ``mixing``       documents repeat or go until each source has its target
5. ``packing``      token sequences whose lengths are powers of two

All stages but the last return the columns of ``documents``. The toxicity classifier learns from
all labels but a fifth of the ids'; SQL cannot express the stages, so brute-force tests stand in for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docvigil.llm.common import crc_mod, materialize, table
from docvigil.llm.exact_dedup import drop_copies
from docvigil.llm.mixing import mixed
from docvigil.llm.packing import pack
from docvigil.llm.queries import END_ID, vocabulary
from docvigil.llm.simhash import keep_one
from docvigil.llm.toxicity import drop_toxic, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, train_toxicity(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, shingle=2, radius=2, prints=4)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary("byte_bpe_50k.json"), END_ID)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash", simhash), ("mixing", mixing), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
