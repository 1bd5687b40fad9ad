"""A corpus pipeline of five operators of ``weftline.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs is what
the stage before it kept, read again from Parquet.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import byte_bpe, minhash, mixing, quality, toxicity
from weftline.llm.common import shared_dir, table

PIECES, VOCAB = "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't predict to be toxic.

    Null and empty texts score 0 and stay; equal rows are judged alike, each by
    itself; a score of just the cut is toxic; an empty table gives no rows; long
    texts are read whole; columns named like an output aren't read.
    """
    return toxicity.classify(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the bands of tokeniser fertility.

    Null, empty and short texts fail the base rules and go; rows of equal text and
    language stay or go together; an end of a band is inside it; an empty table
    gives no rows; other columns are passed on.
    """
    return quality.keep(docs, public_tokenizers.path(PIECES))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near-duplicates.

    Rows without an id link with nothing and stay; rows that share an id are one
    document and stay or go together; null, empty and blank texts stay; an empty
    table gives no rows; other columns are passed on.
    """
    gone = minhash.near_duplicates(docs, words=5, percent=80).where("NOT kept AND doc_id IS NOT NULL").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, to the nearest whole time.

    Texts without words take nothing and go; a null source is a source; rows with
    equal id and text share what they take; an empty table gives no rows.
    """
    return mixing.apply(docs).select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, packed, and their digests after a round trip.

    Null and empty texts have no ids; repeated rows are encoded one by one; an
    empty table gives no rows; columns named ``ids`` or ``decoded`` are replaced.
    """
    coded = byte_bpe.encode(docs, public_tokenizers.path(VOCAB), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], decoded_col="decoded", cache_words=150_000, block_chars=1 << 20)
    return coded.select(
        "doc_id",
        "lang",
        "source",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: SQL can't express byte-level BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
