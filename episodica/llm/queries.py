"""The ten contract queries over the driver's tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, decontaminate, jaccard_join, langid, media, pii, quality, suffix_dedup, token_counts, token_output
from .runtime import id_crc32, prepare

#: The id that ends each document in token files, and the most tokens of a document that isn't over the limit.
END_ID, TOKEN_LIMIT = 2, 512


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in windows of benchmark items, and which items those are."""
    found = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of each text, and of the bytes that they decode to."""
    return bpe_codec.encode_decode(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), pattern(), with_ids=False, with_bytes=False)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of each text, and whether it is over TOKEN_LIMIT."""
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), TOKEN_LIMIT)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as a FLAC stream, read back through PCM blocks, with digests and features."""
    return media.read_media(media.to_media(_read(spark, sf_dir, "documents")), carry=("n_bytes",))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each text by a model that is trained on labelled rows outside of the held-out fifth."""
    docs = _read(spark, sf_dir, "documents")
    model = quality.train(docs, _read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", (id_crc32() % 5 == 0).alias("held_out"), "score", "predicted")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each shingle set, and the least document that links lead to."""
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each text by a model that is trained on rows outside of the held-out fifth."""
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs)).select("doc_id", (id_crc32() % 5 == 0).alias("held_out"), "lang_pred", "score")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each text also starts in a document with a smaller id, and the digest of the rest."""
    return suffix_dedup.dedup(_read(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each text: counts by kind, the base spans as a digest, all spans as text."""
    found = pii.find_pii(_read(spark, sf_dir, "documents"))
    counts = [F.size(f"pii.{k}").cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("pii"), pii.BASE_KINDS).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, and from them where each document starts and the checksum of its ids."""
    files, _ = token_output.token_files(_read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), END_ID)
    return token_output.read_digests(files)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_bpe_codec, op3_token_counts, op4_media_columns, op5_quality, op6_ngram_jaccard_join, op7_language_id, op8_suffix_dedup, op9_pii, op10_token_output)}

ORACLE_SQL = {
    "op1_decontamination": decontaminate.SQL,
    "op6_ngram_jaccard_join": jaccard_join.SQL,
    "op9_pii": pii.sql(),
}
