"""Training corpus pipeline: five stages, each written and read again.

Toxic documents go, then exact and near copies; the rest is mixed to target
weights and packed into sequences.

All stages: each row is a document, whatever its id; a null or repeated id makes
rows that are judged by their own texts.  Null texts count as empty and texts
are read whole.  Other columns, of any name, come through as they are.  An empty
table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from contactloom.llm.blocks import ensure_checkpoints
from contactloom.llm.exact_dedup import drop_exact_duplicates
from contactloom.llm.minhash import drop_near_duplicates
from contactloom.llm.mixing import mixed_documents
from contactloom.llm.packing import pack_documents
from contactloom.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic, repeated rows as often as they are; without labels of both kinds all stay.

    Empty texts aren't toxic.  The model learns from labelled rows of `docs` only.
    """
    return drop_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (A-Z lower-cased): that of the largest id, null being the smallest.

    Empty texts are equal to each other, so one stays; of rows that tie in id and text one stays.
    """
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): that of the least id.

    Texts without words are near to none and stay; of rows that tie in id and text one stays.
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weight, as rows of documents; a null source is a source.

    Documents taken more than once come as several rows, in part as rows of their
    words taken; those without words are left out.  Reruns agree, ties included.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in sequences of at most 1024 tokens; repeated rows are packed one by one."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("MinHash near-dedup", near_dedup), ("mixing", mixing), ("best-fit packing", packing)]

#: Learned and random stages have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def _drop(spark: SparkSession, path: str) -> None:
    """Delete what a stage wrote, wherever the folder is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what lies between them goes to the shared folder until it is read."""
    ensure_checkpoints(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            _drop(spark, f"{folder}/{i - 1}")
    return docs
