"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

Every text is cut where its own content says so (after a sentence end, not
before ``CHUNK_MIN`` and not after ``CHUNK_MAX`` characters), so equal
stretches give equal chunks wherever they stand.  A chunk is known by a short
hash, and the short hash is verified by length and SHA-256 before the chunk
gets its identifier (the place where it first occurs).  A document then is
its recipe, the ordered list of chunk identifiers, and documents are equal
when their recipes are.  Texts themselves are read once and never shuffled:
what moves is about 50 bytes a chunk.

Defined results: a null text counts as empty; texts without any character
are equal to each other (empty recipe); of repeated ids, and of rows without
an id, one row of a group stays (rows without an id come last); an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toxiscope.llm.common import Scratch, keyed

SPACE = r"[\x20\x09-\x0D]+"
CHUNK_MIN, CHUNK_MAX = 256, 2048
CUT = rf"(?s).{{{CHUNK_MIN},{CHUNK_MAX - 2}}}?[.!?] |.{{1,{CHUNK_MAX}}}"


def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def chunks(text: Column) -> Column:
    """Content-defined chunks of a normalised text, as (short hash, length, SHA-256)."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(CUT), F.lit(0)),
        lambda c: F.struct(F.xxhash64(c).alias("h"), F.octet_length(c).alias("len"),
                           F.unhex(F.sha2(c, 256)).alias("digest")))


def dedupe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_chunks) for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    named = keyed(docs, F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("norm"))
    recipes = scratch.keep(
        named.select("row", "doc_id", F.sha2("norm", 256).alias("text_sha256"), chunks(F.col("norm")).alias("chunks")),
        "recipes")
    parts = recipes.select("row", F.posexplode("chunks").alias("pos", "chunk")).select("row", "pos", "chunk.*")
    # one identifier for each verified content: where it first occurs
    content = ["h", "len", "digest"]
    ids = parts.groupBy(*content).agg(F.min(F.struct("row", "pos")).alias("id"))
    lists = (parts.join(ids, content)
             .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("list"))
             .select("row", F.col("list.id").alias("recipe")))
    empty = F.array().cast("array<struct<row:bigint,pos:int>>")
    rows = scratch.keep(
        recipes.select("row", "doc_id", "text_sha256").join(lists, "row", "left")
        .withColumn("recipe", F.coalesce("recipe", empty)), "rows")
    scratch.drop("recipes")
    groups = rows.groupBy("recipe").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("keep"),
        F.count("*").alias("group_size"))
    return rows.join(groups, "recipe").select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"))


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
