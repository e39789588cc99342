"""The corpus pipeline: documents that are good, different, free of benchmarks and secrets, packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again for the next one.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm import decontaminate, jaccard, packing, quality, secret_scan
from cueloom.llm.common import load, staged


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Low-quality and toxic documents go (``quality.keepers``).

    Rows with null or empty texts, null ids and repeated rows are scored like others; all columns stay; without labels
    every document stays; an empty table stays empty.
    """
    return quality.keepers(docs, load(spark, sf_dir, "labels"))


def different_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (five-word shingles, Jaccard similarity 0.8 or more) one document stays (``jaccard.one_of_each``).

    Null, empty and blank texts are nobody's copies and stay; of rows repeated whole one stays; all columns stay; an
    empty table stays empty.
    """
    return jaccard.one_of_each(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go (``decontaminate.without_leaks``).

    Rows are judged by their texts, also those with null or shared ids; null and empty texts stay; all columns stay; an
    empty table or benchmark changes nothing.
    """
    return decontaminate.without_leaks(docs, load(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by their kind; all documents stay (``secret_scan.redacted``).

    ``n_chars`` is that of the new text, null where the text is null. Equal texts come out alike; all columns stay; an
    empty table stays empty.
    """
    clean = secret_scan.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else clean


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids as pieces of sequences (``packing.pack``).

    Null and empty texts are the one id that ends a document; null ids and repeated rows are packed like others; an
    empty table gives no rows.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents), ("near_copies", different_documents), ("benchmarks", without_benchmarks),
    ("secrets", without_secrets), ("packing", packed_sequences),
]

#: Classifier, fingerprints and tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other, applied to ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def registered() -> tuple[dict, dict]:
    """The pipeline's query and SQL."""
    return {"pipeline": run}, {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
