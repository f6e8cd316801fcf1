"""A training corpus from raw documents: language, near-duplicates, benchmark leaks, mix of sources, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns the columns of documents; the last returns what
the token files hold. ``run`` writes each stage's rows to the shared folder and reads them again; a stage's rows go when the next one's are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aqengine.llm import decontam, langid, mixing, simhash, tokens
from aqengine.llm.common import dropped, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; what it rejects (null or without letters, or unlike all learned languages) goes.

    Null languages are not learned from; repeated rows share one fate; an empty table, or one without languages to learn, gives an empty result.
    """
    packed = docs.select("doc_id", "text", "lang", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    return langid.predict(packed, langid.fit(docs), ("_doc",)).filter("not rejected").select("_doc.*")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest doc_id, of each group of near-duplicates.

    Null and empty texts are alike; rows with a null doc_id come last in their group; of repeated rows one stays; an empty table gives an empty result.
    """
    return simhash.one_of_each(docs)


def no_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null texts hold none and stay, as do rows with a null doc_id; repeated rows share one fate; an empty table or benchmark changes nothing.
    """
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null sources are one source; null and empty texts go along with whole repetitions of their source; repeated rows are taken each for itself; an empty table gives an
    empty result.
    """
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the token files.

    Null texts have the end id alone; null doc_ids come first; repeated rows follow one another; an empty table gives an empty result.
    """
    return tokens.round_trip(docs)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", no_benchmark_items),
    ("mix", mixed_sources),
    ("token_ids", token_files),
]

#: SQL has no language model, SimHash or tokenizer; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, read = written(stage(spark, docs, sf_dir), f"stage-{name}"), before
        before = docs
        if read is not None:
            dropped(read)
    return docs
