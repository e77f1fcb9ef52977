"""From raw documents to packed sequences: language ID, line dedup, near-dedup, mixing, packing.

Every stage but the last takes and returns the columns of documents, whatever
other columns the table has. Null texts, empty texts, ties, repeated rows, null
ids and empty tables have the results that the stages name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepframe.functions.scratch import delete, materialise, new_path, scope
from sweepframe.llm import langid, linededup, mixing, packing, simhash
from sweepframe.llm.words import free_names, word_count

#: Least gain of a document: its log likelihood for each trigram over that of even chance.
LEAST_GAIN = 0.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a mixture of the labelled languages explains, the others go.

    A document is rejected if it has no letter (null and empty texts among them),
    or if no mixture explains its trigrams better than even chance does (encoded
    data, keyboard noise, scripts of no labelled language). Where lang is null or
    empty it becomes the predicted language; a tie goes to the name that sorts
    first. If no row has a label, nothing is predicted and only texts without a
    letter go. Repeated rows are judged alike; an empty table stays empty.
    """
    model = langid.learn(docs)
    if not model["names"]:
        return docs.where(langid.has_letter(F.col("text")))
    (own,) = free_names(docs, "language")
    found = langid.identify(docs, model, into=own).where(F.col(f"{own}.gain") >= LEAST_GAIN)
    return found.withColumn("lang", F.when(F.col("lang") != "", F.col("lang")).otherwise(F.col(f"{own}.lang_pred"))).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of windows of three lines; n_chars follows the text.

    Texts of which nothing is left go; null, empty and unrepeated texts stay as
    they are. Of equal windows the first stays, by doc_id (null first) and place;
    rows that repeat id and text keep the same lines; an empty table stays empty.
    """
    (own,) = free_names(docs, "lines")
    found = linededup.dedup_lines(docs, into=own)
    changed = F.col(f"{own}.n_removed") > 0
    found = found.where(~(changed & (F.col(f"{own}.n_removed") == F.col(f"{own}.n_lines"))))
    return found.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    The smallest doc_id stays, a null one only if there is no other; rows that
    repeat id and text leave one; texts without a word (null and empty ones) are
    one group; an empty table stays empty.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: no row, one, or two.

    Sizes are words, 0 for null and empty texts; a null source is a source; rows
    that repeat id and text are taken alike; an empty table stays empty.
    """
    return mixing.mixed(docs, mixing.plan(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in a sequence: (doc_id, copy, piece, start, length, bin_id, bin_length, bin_start).

    start and length count words of the document's text. Rows of equal id and
    length are numbered by copy; a text without a word has one piece in no
    sequence; an empty table gives no row.
    """
    return packing.pack_documents(docs, word_count(F.col("text")))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("best_fit", pack)]

#: Language ID, SimHash and best-fit packing can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again; a stage's own tables, and what it read, go when it is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = new_path(spark)
        with scope(spark):
            docs = materialise(stage(spark, docs, sf_dir), path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
