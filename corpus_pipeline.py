"""A training-data pipeline over the documents table: five stages, each one operator over all its predecessor kept.

Toxic documents go, repeated runs of lines go, one document of each near-copy group stays, sources are mixed to
their target weights, and what remains is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.llm.common import GAP, stored, table
from partwise.llm.encoding import encode_documents, normalised
from partwise.llm.jaccard import Rule, one_of_each
from partwise.llm.lines import dedup_lines, unused
from partwise.llm.mixing import mix_documents
from partwise.llm.pieces import Pieces
from partwise.llm.toxicity import keep_clean


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that stood before go, and with them documents that have no words left. n_chars follows the text."""
    lines, removed = (unused(name, docs.columns) for name in ("n_lines", "n_removed"))
    left = dedup_lines(docs, counts=(lines, removed))
    worded = F.regexp_replace("text", GAP, "") != ""
    left = left.filter((F.col(removed) == 0) | worded).drop(lines, removed)
    return left.withColumn("n_chars", F.length("text").cast("long"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays."""
    return one_of_each(docs, Rule(5, 80))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, kept or left out so that each source gives its target of words. n_chars follows the text."""
    return mix_documents(docs, table(spark, sf_dir, "labels")).withColumn("n_chars", F.length("text").cast("long"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, their number, and whether decoding gives the text back."""
    out = encode_documents(docs.select("doc_id", "source", "text"), Pieces.load(), back="decoded")
    return out.select("doc_id", "source", "text", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
                      F.col("decoded").eqNullSafe(normalised(F.col("text"))).alias("round_trip"))


STAGES = [
    ("toxicity", clean),
    ("line dedup", distinct_lines),
    ("n-gram Jaccard join", distinct_documents),
    ("mixing sources", mixed),
    ("sentencepiece", encoded),
]

#: A trained classifier and a piece model are not SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; the result of each is written as Parquet and read again as the documents of the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
