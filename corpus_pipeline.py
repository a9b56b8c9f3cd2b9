"""The corpus pipeline, from raw documents to packed sequences.

Each stage takes (spark, docs, folder) and returns a DataFrame; it is written as Parquet and reread as the next stage's docs. All stages
but the last return the columns of documents. Null and empty texts pass the first four stages as what they are and end as sequences'
shortest pieces, unless an equal one before them stays in their place; repeated rows are near-duplicates of each other; an empty table
gives an empty result; further columns are passed on as they are up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from postingflow.llm.mixing import mix_documents
from postingflow.llm.packing import pack_documents
from postingflow.llm.simhash import keep_one
from postingflow.llm.suffixes import remove_repeats
from postingflow.llm.toxicity import keep_clean
from postingflow.session import shared_folder

ORACLE_SQL = None  # trained scores, tokens and suffix sorting can't be said in SQL; tests/llm compares with brute force


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity classifiers reject go."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    return keep_clean(docs, labels)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document, that with the smallest id, of each group of linked SimHash fingerprints stays."""
    return keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are cut out."""
    return remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target weights, in training order."""
    return mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of token ids with their places in sequences."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("repeated_passages", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over documents. What a stage keeps is written to the shared checkpoint folder."""
    base = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, folder)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
