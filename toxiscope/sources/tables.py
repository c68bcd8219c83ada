"""The driver's parquet tables and the labelled comment table.

Column pruning and predicate pushdown into the parquet scan are left to
Catalyst: readers return the full relation and callers select what they use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Cell texts that a CSV reader with pandas defaults turns into a missing value.
MISSING_TEXT = ("", "NA", "N/A", "NULL", "NaN", "None", "nan", "null", "n/a",
                "#N/A", "#NA", "-NaN", "-nan", "<NA>", "1.#IND", "1.#QNAN",
                "-1.#IND", "-1.#QNAN", "#N/A N/A")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The scan as it is, or hash-partitioned by ``key`` where the session
    sets ``toxiscope.scan.partitions``.

    For inputs in a few files of one row group each, which would be read by as
    many tasks; a shuffle of the table, so the choice is the user's.
    """
    parts = df.sparkSession.conf.get("toxiscope.scan.partitions", "")
    return df.repartition(int(parts), key) if parts else df


def label_join(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts and labels aligned by key (the reference aligns by position).

    A plain equi-join: Catalyst/AQE choose broadcast only when the label side
    is measured small, otherwise a sort-merge join on ``doc_id``.
    """
    return documents.join(labels, "doc_id", "inner")


def labelled_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, lang, source, n_chars, quality, toxic) for labelled rows."""
    return label_join(spread(read_table(spark, sf_dir, "documents"), "doc_id"),
                      read_table(spark, sf_dir, "labels"))


def read_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comment table in the reference's shape: key, comment_text, lang, toxic."""
    return labelled_comments(spark, sf_dir).select(
        "doc_id", F.col("text").alias("comment_text"), "lang", "toxic", "quality")
