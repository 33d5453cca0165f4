"""From documents to token ids: STAGES in their order, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir); all but the last return the columns that docs has. ORACLE_SQL is None: byte-level
BPE and a learned language model aren't SQL; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm import bpe_codec, decontaminate, jaccard_join, langid, pii, queries
from episodica.llm.runtime import Scratch, prepare


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter, or no text at all) go."""
    model = langid.train(docs)
    found = langid.identify(docs, model, carry=tuple(docs.columns), out=("__lang", "__score"))
    return found.where(F.col("__lang") != langid.UNKNOWN).select(docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays."""
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs, benchmark, carry=tuple(docs.columns))
    return found.where(~decontaminate.is_contaminated()).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; all documents stay."""
    return pii.redact(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and digests of them and of the bytes that they decode to."""
    return bpe_codec.encode_decode(docs, queries.vocabulary("byte_bpe_50k.tiktoken"), queries.pattern(), with_bytes=False)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("bpe_encoding", bpe_encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(prepare(spark), "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(before)
    return docs
