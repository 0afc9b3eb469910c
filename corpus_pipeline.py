"""A training corpus from raw documents: filter, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs, as they are and whatever their names.

Null and blank texts are texts like others: the classifier scores them as empty, all of them are one text to both
deduplications, mixing takes them as often as their source's rate says, and packing gives each its end token. Rows with a
null id are rows of their own, repeated rows are copies of which deduplication keeps one, texts are read whole however
long, and empty tables pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import exact_dedup, jaccard, mixing, packing, quality, simhash
from shelfspark.llm.common import shared_dir, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects (score below 0.5); without labels all stay. A document
    without an id is judged like others."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text (null as empty, A-Z as a-z) stays, that of the largest doc_id; a null id is the smallest."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates (Jaccard similarity of five-word shingles 0.8 or more) stays, that of
    the smallest doc_id. Candidates are links of SimHash fingerprints at 4 bits or fewer, and pairs of MinHash
    bands for those that one fingerprint of 64 bits doesn't reach (README); every link is verified on the sets."""
    return jaccard.drop_similar_documents(docs, near=simhash.near_pairs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null source is a source, a source without words is not repeated."""
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens; a null or empty text is its end token."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_exact),
    ("SimHash near-dedup", drop_near),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: A learnt classifier and a tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder, where it stays until the result
    that is read from it is no longer needed."""
    at = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
