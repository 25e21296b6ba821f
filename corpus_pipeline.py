"""From raw documents to packed training sequences, in five stages over the operators of gridlake.llm.

Each stage reads what its predecessor kept: language ID, quality rules, near-duplicates, repeated passages, packing.

Odd rows: null or empty text goes in the first stage, as it has no language; a null id is kept and counts as the largest;
rows that repeat an id are documents of their own, those that repeat id and text are copies of which one stays; null in any
other column is carried; columns besides those of documents are carried too, whatever their names; an empty table gives
empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm import jaccard, langid, packing, quality, suffix
from gridlake.llm.common import ensure_checkpoint_dir, read
from gridlake.llm.queries import TOKENIZERS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: null, empty or letterless text, and a score below langid.MIN_SCORE."""
    return langid.accepted(docs, langid.fit(docs))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the cascade rejects go. Each row is judged alone, whatever its id."""
    return quality.accepted(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (and copies) stays, the one with the smallest id (a null id is the largest).

    Five-word shingles at a similarity of 0.8, as for every near-duplicate stage here without a contract of its own.
    """
    return jaccard.one_of_each(docs, words=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has are cut out of the text; n_chars follows. Every row stays,
    if need be with an empty text; documents of one id (or none) do not cut each other."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = suffix.spans(docs, carry=tuple(rest))
    named = {c: F.col(f"carry_{i}") for i, c in enumerate(rest)}
    named |= {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*(named[c].alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048. Empty text is the closing id alone."""
    return packing.pack_documents(docs, TOKENIZERS("byte_bpe_50k.json"))


STAGES = [("language ID", language), ("quality rules", rules), ("n-gram Jaccard join", near_copies), ("suffix-array dedup", passages), ("packing", pack)]

#: No SQL can say what the classifier and the tokenizer do; tests/llm/test_pipeline.py holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what lies between two of them is written as Parquet to the shared checkpoint folder, and goes when the next is written."""
    docs = read(spark, sf_dir, "documents")
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return STAGES[-1][1](spark, docs, sf_dir)
