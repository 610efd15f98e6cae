"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.bpe import encode_documents
from memlake.llm.common import checkpoint, table
from memlake.llm.exact_dedup import without_duplicates
from memlake.llm.language_id import UNKNOWN, fit, fold, identify
from memlake.llm.mixing import mixed_documents
from memlake.llm.near_dedup import one_of_each_class

#: Least calibrated probability of the predicted language.
LANGUAGE_SCORE = 0.35
#: SQL can't express the trained classifier or the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages that the corpus names; those without a letter or with no clear language go."""
    model = fit(docs, fold("doc_id", 3) != 1)
    lang, score = (name + "_" * max(len(c) for c in docs.columns) for name in ("lang", "score"))  # no column's name
    said = identify(docs, model, lang=lang, score=score)
    return said.where((F.col(lang) != UNKNOWN) & (F.col(score) >= LANGUAGE_SCORE)).select(*docs.columns)


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case) the document with the largest id."""
    return without_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id."""
    return one_of_each_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and a digest of what they decode to."""
    encoded = encode_documents(docs)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_duplicates),
    ("near_dedup", drop_near_duplicates),
    ("mix", mix_sources),
    ("tokenize", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what one returns is written to the shared checkpoint folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else checkpoint(docs), sf_dir)
    return docs
