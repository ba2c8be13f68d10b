"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet in the
shared folder and hands the next stage what it reads back. All stages but the last return the
columns of `documents`.

Defined results: rows with a null text, and texts without a letter, go in the first stage; a null id,
language, source or number of characters stays null and is a value like others; of near copies the
smallest id stays, of rows that repeat an id the first by the hash of its text; very long texts are
read whole; an empty table, or one of which a stage keeps nothing, gives an empty result; extra
columns of `documents`, of whatever name, are left behind.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import decontam, langid, minhash, mixing, sharding
from tesserae.llm.common import remove, shared_dir, ship, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those without a letter, and those it takes for noise (random letters, scripts it never learned) and not for a language."""
    ship(spark)
    return langid.select_known(docs.select(*COLUMNS), langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    ship(spark)
    return minhash.keep_one(docs, k=5, similarity=0.8).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    ship(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), "document").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated so that sources come near their targets."""
    ship(spark)
    return mixing.mix(docs).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row."""
    ship(spark)
    return sharding.report(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix_sources), ("sharding", shard)]

#: Two stages (a trained network and a similarity join) have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if done:  # nothing reads what the stage before has written any more
            remove(spark, done)
        done = at
    return docs
