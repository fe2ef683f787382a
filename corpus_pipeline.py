"""The corpus pipeline: documents in, packed training sequences out.

Each stage calls one operator of :mod:`tripleloom.llm`, works on all rows that its
predecessor kept, and returns the columns of ``documents`` (the last one the pieces of the
packed sequences). Stages are written as Parquet and read again, so a lost executor costs
one stage at most.

Defined cases: nulls, empty and very long texts, ties and repeated rows are as each operator
states (a null text scores as an empty one, is unlike all others, becomes empty in the third
stage and packs as its end id alone; a null id goes through all stages); an empty table gives
no rows in any stage; columns beyond those of ``documents`` are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripleloom.llm.common import Scratch
from tripleloom.llm.minhash import near_duplicate_rows
from tripleloom.llm.packing import pack_documents
from tripleloom.llm.pii import redact
from tripleloom.llm.quality import Quality
from tripleloom.llm.suffix import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
QUALITY_THRESHOLD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier, fitted on the labelled ones, rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = Quality(metadata=("n_chars",)).fit(docs, labels).transform(docs, keep=COLUMNS)
    return scored.where(F.col("score") >= QUALITY_THRESHOLD).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, that of the smallest id, of each group of near duplicates (similarity 0.8 or more).

    Rows are compared by a number of their own, so that rows that repeat an id, or have none, are documents too;
    a row without an id is kept only of a group in which none has one.
    """
    rest = tuple(c for c in COLUMNS if c != "text")
    return near_duplicate_rows(docs, keep=rest, num=80, den=100).where("first").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of 200 bytes or more that occur elsewhere; documents left empty stay, with an empty text."""
    keep = ("doc_id", "lang", "source")
    out = remove_repeats(docs, keep=keep, with_text=True)
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by placeholders."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenize and pack what is left."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("pii", pii), ("packing", packing)]

#: Fitted scores, similarity of sets and packing have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.table(docs, name)
    return docs
