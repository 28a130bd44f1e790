"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns what is written as Parquet
and read again as the next stage's ``docs``; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, decontaminate, line_dedup, order_minhash, toxicity
from millrace.llm.ship import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def thin_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate and repeated lines go; every document stays."""
    return line_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return order_minhash.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and the text decoded from them, as digests."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", thin_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: A learned score, an approximate index and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    shared_folder(spark)
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{jvm.java.util.UUID.randomUUID()}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for n, (name, stage) in enumerate(STAGES):
        now = f"{folder}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(now)
        docs = spark.read.parquet(now)
        if before:  # nothing reads the stage before any more
            path = jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001
        before = now
    return docs
