"""A cleaning pipeline over the documents table: five stages, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm import bpe, linededup, minhash, mixing, toxicity
from tarnwork.llm.common import read, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    lexicon = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.withColumn("_row", F.struct(*COLUMNS)), lexicon, id_col="_row")
    return scored.where("predicted = 0").select("_row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the lines that an earlier document or line has; documents of which nothing is left go."""
    found = linededup.dedup(docs.select(*COLUMNS))
    left = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    found = found.where((F.col("n_removed") == 0) | (left > 0))
    return found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8 or more: the one with the smallest id."""
    return minhash.dedup(docs.select(*COLUMNS), k=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.apply(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian 32-bit words) with digests of them and of the decoded bytes."""
    import public_tokenizers

    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level bpe", encode),
]

#: The last stage's ids are not expressible in SQL; tests hold stages' columns, the toxic documents and each operator by itself to brute force, not yet all rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/tarnwork-{uuid.uuid4().hex}/pipeline"
    for k, (_, step) in enumerate(STAGES):
        step(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
