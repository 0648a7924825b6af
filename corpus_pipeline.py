"""From raw documents to packed training sequences.

``STAGES`` are (name, function) pairs. Each function takes (spark, docs, sf_dir), works on all that
the stage before it kept, and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import langid, packing, secrets, simhash, store


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or without a language that the model, fitted on their labels, recognizes.

    Null and empty texts go, as they have no letter; repeated rows stay or go together; without a
    labelled row nothing is learned and all go; an empty table stays empty. Long texts are read whole.
    """
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates.

    Texts without a word have one fingerprint and are a group like any other. Rows with a null id
    stay, and all rows of a repeated id if any of them does; an empty table stays empty.
    """
    return simhash.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep all documents, with the secrets in their texts replaced by a mark; n_chars counts the new text.

    A null text stays null; repeated rows stay repeated; an empty table stays empty.
    """
    return secrets.redacted(docs).selectExpr(*["CAST(length(text) AS BIGINT) AS n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in pieces, each with its sequence and its place there.

    A null or empty text is a piece of the end token alone; repeated rows are packed each for
    itself; an empty table gives no sequence.
    """
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("pack", pack)]

#: The first stage is a fitted model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what stands between two stages is written to the shared folder and deleted when used."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with store.keeping_only(spark) as kept:
            docs, path = store.materialize(stage(spark, docs, sf_dir), name)
            kept.add(path)
        if before:
            store.drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
