"""The training-data pipeline: language ID, exact and near deduplication, secret masking and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to the shared folder and reads
again as the next stage's docs. All but the last return the columns of documents. The language model is fitted on
the labelled rows of the documents that the stage is given.

After the first stage no text is null. A null id is an id like others that is never the smallest; rows that repeat an id
are documents each, which the stages keep, drop and pack by their own texts. Every stage gives an empty table for an
empty one. Other columns than those of documents are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, langid, packing, secrets, simhash
from tessera.llm.common import discard, read, spread, table, temporary
from tessera.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; the others (null, or without a letter) go. lang becomes the prediction."""
    model = langid.fit(docs)
    known = langid.identify(docs.select(*COLUMNS), model).filter("lang_pred <> 'und'")
    return known.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, that with the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs.select(*COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, the document with the smallest doc_id stays."""
    return simhash.drop_near_copies(docs.select(*COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their text masked; n_chars is that of the masked text."""
    return secrets.redact_secrets(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"))


STAGES = [("language_id", language_id), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mask_secrets", mask_secrets), ("pack", pack)]

#: Learned languages, fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents").select(*COLUMNS))
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with temporary() as made:
            before, docs = docs, table(stage(spark, docs, sf_dir))
            made.keep(docs)
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
