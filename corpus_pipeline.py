"""From raw documents to token ids: the stages and their composition.

Every stage works on all that the one before it kept. Null and empty texts, repeated
rows, extra columns and empty tables pass through as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import bpe, decontaminate, near_copies, quality, secrets
from quillmill.llm.common import read, remove, written
from quillmill.llm.queries import PATTERN, VOCABULARY


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, with their columns.

    Null and empty texts are scored by their statistics, all 0; repeated rows are kept or
    rejected together; without labels the score is 0.5 and all stay.
    """
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id, null ids last.

    The choice is made by row, so ids that repeat or are null don't bring others back;
    rows that repeat id and text collapse to one. Null and empty texts are one group.
    """
    return near_copies.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with their columns; null and empty texts and repeated rows stay."""
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by the kind in brackets; n_chars follows."""
    return secrets.redact(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids, their number, and the digest of the bytes that they decode to.

    Null and empty texts have no ids; repeated rows stay.
    """
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), VOCABULARY, PATTERN, back="bytes")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [("quality", keep_good), ("near_dedup", dedup), ("decontaminate", decontaminated), ("secrets", redacted), ("bpe", tokenized)]
#: Training a classifier, SimHash and BPE merges are beyond SQL; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written and read again."""
    docs, old = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir))
        if old:
            remove(spark, old)
        old = path
    return STAGES[-1][1](spark, docs, sf_dir)
