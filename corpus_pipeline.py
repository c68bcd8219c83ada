"""Corpus pipeline: language ID, line dedup, near duplicates, decontamination, encoding.

Every stage works on all that its predecessor kept; ``run`` writes each
stage's rows as Parquet in the shared folder and reads them back.  All but
the last return the columns they were given.  As a stage's rows have been
written when the next one begins, a stage first deletes the working tables of
those before it in the same session that its input doesn't read.

Rows without an id, repeated ids and repeated rows are rows of their own; a
null or empty text has no letter and goes at the first stage; texts of any
length are processed whole; an empty table stays empty; other columns pass
through, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from toxiscope.llm import decontamination, jaccard_join, language_id, line_dedup, passage_dedup, sentencepiece_codec
from toxiscope.llm.common import Scratch, noted
from toxiscope.llm.queries import tokenizer_file
from toxiscope.sources.tables import read_table

#: Models and hash decisions aren't expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


#: Working tables of the stages called before.
_working: list[Scratch] = []


def stage(work):
    """``work`` after the working tables of earlier stages are gone, but for those that ``docs`` itself still reads
    (where it wasn't written in between); its own are noted."""
    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        folders = {part for file in docs.inputFiles() for part in file.split("/")} if _working else set()
        kept = []
        for scratch in _working:
            if scratch.folder in folders:
                kept.append(scratch)
            elif scratch.spark is spark:
                scratch.drop_all()
        with noted() as made:
            found = work(spark, docs, sf_dir)
        _working[:] = kept + made
        return found
    return run_stage


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language the network recognises stay."""
    return language_id.keep_identified(docs)


@stage
def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go, then passages of 50 words that an earlier document holds; a
    document of which nothing is left goes."""
    return passage_dedup.keep_cleaned(line_dedup.keep_cleaned(docs))


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays."""
    return jaccard_join.one_of_each(docs)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, exact) of every document left."""
    return sentencepiece_codec.round_trip(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedupe_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, work) in enumerate(STAGES):
        docs = scratch.keep(work(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
