"""The registered queries over the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlake.llm import bpe, chat, html, jaccard, langid, license, merkle, neardup, packing, quality, suffix, toxicity, variants
from gridlake.llm.common import read

try:
    import public_tokenizers

    TOKENIZERS = public_tokenizers.path
except ImportError:  # the folder the image describes
    TOKENIZERS = "/opt/tokenizers/{}".format


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.spans(read(spark, sf_dir, "documents"), with_text=False).drop("spans", "kept_text")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), TOKENIZERS("word_bpe_49k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents")).drop("rejected_by")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), TOKENIZERS("byte_bpe_50k.json"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_messages(read(spark, sf_dir, "conversations"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(read(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"), other=merkle.tampered())


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_embedding_near_dedup, op3_html_extraction, op4_suffix_dedup, op5_ngram_jaccard_join,
        op6_bpe, op7_quality_rules, op8_license_scan, op9_packing, op10_chat_format, op11_spelling_variants, op12_toxicity, op13_merkle_manifest,
    )
}

SQL: dict[str, str] = {
    "op2_embedding_near_dedup": neardup.ORACLE, "op5_ngram_jaccard_join": jaccard.ORACLE, "op7_quality_rules": quality.ORACLE, "op8_license_scan": license.oracle(), "op10_chat_format": chat.ORACLE,
    "op11_spelling_variants": variants.oracle(), "op13_merkle_manifest": merkle.oracle(),
}
