"""Corpus cleaning: five stages over documents, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; the
last returns the mix. ORACLE_SQL is None: the stages' models and forests have no SQL, and tests
compare the stages with brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm import decontam, langid, linededup, minhash, mixing
from faultlens.llm.common import shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; lang becomes that language. Texts without one go.

    The text model is fitted on labelled rows of the documents table. Documents with a null doc_id
    have no identity to carry through the stages and go, too.
    """
    known = table(spark, sf_dir, "documents")
    languages = langid.labels(known)
    found = langid.identify(langid.document_rows(docs), langid.fit(known, languages), is_html=False, languages=languages).filter("kept")
    # rows that repeat a doc_id may differ in text: one that has a language keeps its id
    best = found.groupBy("id").agg(F.max(F.struct("confidence", "lang")).alias("best"))
    return docs.join(best, F.col("doc_id") == F.col("id")).withColumn("lang", F.col("best.lang")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier one; a document of which nothing is left goes."""
    left = linededup.dedup_lines(docs.select(*COLUMNS)).filter("size(removed) = 0 or kept_text rlike r'[^\\x20\\x09-\\x0D]'")
    return left.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard 0.8."""
    kept = minhash.near_duplicates(docs, percent=80).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, F.col("doc_id") == F.col("_id"), "left_semi").select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    bad = found.filter("contaminated").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(bad, F.col("doc_id") == F.col("_id"), "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: doc_id, source and how many copies and words it takes; documents that it doesn't take go."""
    return mixing.mix(docs).filter("copies > 0")


STAGES = [("language", language), ("lines", lines), ("near", near), ("clean", clean), ("mix", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents; what each keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
