"""A corpus pipeline of five stages over `documents`.

Each stage gets what the one before kept and returns the columns of documents; the last returns
the encoded corpus: doc_id, lang, source, n_chars, n_tokens and ids, and the hash of what the ids
decode to. Between stages rows are written as Parquet in the shared folder and read again; each
stage's files go once the next one has been written, the last one's stay.

1. quality: rejected documents go.
2. near duplicates: one document of each component stays.
3. repeated strings: bytes of strings of 50 that a smaller doc_id has go (with what is left of
   a character cut apart), n_chars follows; a document can become empty, but stays.
4. mixing: each document comes as often as its source's rate says.
5. encoding: token ids of each text.

Nulls in any column, empty and long texts and further columns, whatever their names, pass as the
operators define; of repeated rows (one id and text) one stays; repeated and contradictory labels
count as `quality` says; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, minhash, mixing, quality, substrings
from tidewell.llm.common import delete, release, shared_dir, ship, table


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    out = substrings.removed(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.copies(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.encoded(docs)


STAGES = [
    ("quality", by_quality),
    ("near_duplicates", without_near_duplicates),
    ("repeats", without_repeats),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: The classifier and the encoder can't be said in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after another."""
    docs = table(spark, sf_dir, "documents")
    top, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before:
            delete(spark, before)
        before = f"{top}/{name}"
        release(spark)
    return docs
