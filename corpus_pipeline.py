"""A corpus pipeline over the documents table: toxicity, line dedup, near-duplicates, mixing, tokenising.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept and returns the columns of
documents; the last one returns the tokenised corpus. ``run`` chains them over the documents table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from celltide.llm import bpe, chosen_path, line_spread, mixing, toxicity
from celltide.llm.queries import RANKS_FILE, table
from celltide.runtime import checkpoint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar, learned from the labels table, doesn't predict as toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("predicted = 0").select(*COLUMNS)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that recur across sites; n_chars follows the text."""
    cleaned = line_spread.remove_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return chosen_path.deduplicate(docs, size=5, similarity=0.8).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the balanced mix of sources takes them."""
    return mixing.repeated(mixing.mix(docs)).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of each text, with digests of ids and decoded bytes."""
    encoded = bpe.encode_texts(docs, public_tokenizers.path(RANKS_FILE), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate_lines),
    ("near duplicates", drop_near_duplicates),
    ("source mix", mix_sources),
    ("tokenise", tokenise),
]

#: No stage but the counting of lines can be written in SQL (learned grammar, minwise paths, balanced sampling,
#: merges), so tests hold each against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is stored as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
