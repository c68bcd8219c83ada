"""Line deduplication over overlapping windows of three consecutive lines.

Lines are separated by line feeds.  For comparison a line is trimmed and its
white space runs become one space; blank lines are no part of any window.
Every three consecutive lines are hashed (two independent 64-bit hashes);
a window that occurs more than once in the corpus stays where it first occurs
(smallest doc_id, then smallest place), and every line covered by a later
occurrence goes; covered places of overlapping windows merge.  Documents
are never gathered: windows move as hashes, and only places to remove go back
to their document.  The most frequent window costs one row per occurrence and
map task (partial minimum), its later occurrences one joined row each, which
adaptive skew handling splits.

Defined results: a null text stays null and has 0 lines; a document with
fewer than three non-blank lines has no window and stays as it is; repeated
ids are told apart by their row; rows without an id come last; other columns
pass through unread; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toxiscope.llm.common import Scratch

WINDOW = 3
BLANKS = r"[\x20\x09-\x0D]+"


def _solid(text: Column) -> Column:
    """(place, comparable line) of the lines that aren't blank."""
    lines = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(
        i.alias("i"), F.trim(F.regexp_replace(line, BLANKS, " ")).alias("t")))
    return F.filter(lines, lambda x: x["t"] != "")


def windows(solid: Column) -> Column:
    """(places, hashes) of every window of three lines."""
    def of(k: Column) -> Column:
        three = [F.get(solid, k + j) for j in range(WINDOW)]
        return F.struct(F.array(*[x["i"] for x in three]).alias("places"),
                        F.xxhash64(*[x["t"] for x in three]).alias("h1"),
                        F.xxhash64(F.lit("second"), *[x["t"] for x in reversed(three)]).alias("h2"))
    last = F.size(solid) - WINDOW
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), of))


def dedupe_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns of ``docs`` with the cleaned text, then ``lines_total`` and ``lines_removed``.

    A name that ``docs`` already has gets underscores.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")

    def fresh(name: str) -> str:
        while name in docs.columns:
            name += "_"
        return name

    own, gone_row, gone_at = fresh("__row"), fresh("__gone_row"), fresh("__gone")
    rows = scratch.keep(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    seen = scratch.keep(
        rows.select(F.col(own).alias("row"), F.col(doc_id).alias("doc_id"), _solid(F.col(text)).alias("solid"))
        .filter(F.size("solid") >= WINDOW)
        .select("row", "doc_id", F.explode(windows(F.col("solid"))).alias("w")).select("row", "doc_id", "w.*"),
        "windows")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", F.col("places")[0].alias("at"))
    repeated = (seen.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
                .filter("n > 1").select("h1", "h2", F.col("first.row").alias("row0"), F.col("first.at").alias("at0")))
    gone = (seen.join(repeated, ["h1", "h2"])
            .filter((F.col("row") != F.col("row0")) | (F.col("places")[0] != F.col("at0")))
            .select(F.col("row").alias(gone_row), F.explode("places").alias("i"))
            .groupBy(gone_row).agg(F.collect_set("i").alias(gone_at)))
    out = rows.join(gone, rows[own] == gone[gone_row], "left")
    lines = F.split(F.col(text), "\n", -1)
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(gone_at, i)), "\n")
    return out.select(
        *[(F.when(F.col(gone_at).isNull(), F.col(c)).otherwise(left) if c == text else F.col(c)).alias(c)
          for c in docs.columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).alias(fresh("lines_total")),
        F.when(F.col(gone_at).isNull(), 0).otherwise(F.size(gone_at)).alias(fresh("lines_removed")))


def keep_cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with cleaned texts and their lengths, without the documents of which nothing is left."""
    out = dedupe_lines(docs, doc_id, text)
    total, removed = out.columns[-2:]
    changed = F.col(removed) > 0
    out = out.filter(~changed | (F.trim(F.regexp_replace(F.col(text), BLANKS, " ")) != ""))
    return out.select(*[(F.when(changed, F.length(text).cast(docs.schema[c].dataType)).otherwise(F.col(c)) if c == n_chars
                         else F.col(c)).alias(c) for c in docs.columns])


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents),
solid AS (
  SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM (SELECT doc_id, i, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS t FROM lines) WHERE t <> ''),
w AS (
  SELECT a.doc_id, a.i AS i1, b.i AS i2, c.i AS i3, a.t AS t1, b.t AS t2, c.t AS t3
  FROM solid a JOIN solid b ON a.doc_id = b.doc_id AND b.k = a.k + 1
               JOIN solid c ON a.doc_id = c.doc_id AND c.k = a.k + 2),
later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t1, t2, t3 ORDER BY doc_id, i1) AS r FROM w) WHERE r > 1),
gone AS (
  SELECT doc_id, i1 AS i FROM later UNION SELECT doc_id, i2 FROM later UNION SELECT doc_id, i3 FROM later),
kept AS (
  SELECT l.doc_id, count(*) AS n, count(g.i) AS m,
         string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY l.i) AS t
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN coalesce(m, 0) = 0 THEN d.text ELSE coalesce(t, '') END AS text,
       CAST(coalesce(n, 0) AS INTEGER) AS lines_total, CAST(coalesce(m, 0) AS INTEGER) AS lines_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
