"""Licence scan by ordered signature rules (DataFrame functions only).

Texts become normalised words once.  A document none of whose words is a
rule's keyword ends there; for the others every rule whose keyword occurs is
run (an equi-join of the document's keywords with the fixed rule list), its
matches become word intervals, and an interval contained in one of the same
or a higher tier is suppressed by running maxima over the document's sorted
intervals, so that one long document costs no more than a sort.

Defined results: a null text counts as empty; without words all counts are 0,
places null and labels empty; repeated rows each get their result; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from toxiscope.llm.common import Scratch, keyed
from toxiscope.llm.license_rules import rules

UPPER, DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Confidence of the tiers 1 to 3; a base phrase counts as a mention.
TIER_SCORE = (0.5, 0.8, 1.0)


def normalised(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, DOWN)
    return F.trim(F.regexp_replace(lower, NOT_WORD, " "))


def _places(words: Column, norm: Column, phrase: str) -> Column:
    """Starts of the phrase's words standing consecutively."""
    parts = phrase.split(" ")
    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: reduce(
        lambda a, b: a & b, [F.get(words, i + j) == p for j, p in enumerate(parts)]))
    return F.when(F.contains(norm, F.lit(phrase)), at).otherwise(F.array().cast("array<int>"))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def rule_table(spark: SparkSession) -> DataFrame:
    """(keyword, rule, tier, label, pattern); a fixed number of rows."""
    values = ", ".join(f"('{k}', {i}, {tier}, '{label}', '(?<![^ ])(?:{pattern})(?![^ ])')"
                       for i, (k, tier, label, pattern) in enumerate(rules()))
    return spark.sql(f"SELECT * FROM VALUES {values} AS rules(keyword, rule, tier, label, pattern)")


def detections(texts: DataFrame, table: DataFrame) -> DataFrame:
    """(row, rule, tier, label, first, end) of the matches left after suppression.

    ``texts`` has row, norm and words.
    """
    keywords = sorted({k for k, *_ in rules()})
    known = F.array(*[F.lit(k) for k in keywords])
    tried = (texts.select("row", "norm", F.explode(F.array_intersect("words", known)).alias("keyword"))
             .join(F.broadcast(table), "keyword")
             .withColumn("found", F.regexp_extract_all("norm", F.col("pattern"), F.lit(0)))
             .filter(F.size("found") > 0)
             .withColumn("before", F.slice(F.split("norm", F.col("pattern"), -1), F.lit(1), F.size("found"))))
    gaps = tried.select("row", "rule", "tier", "label", F.posexplode(F.arrays_zip("before", "found")).alias("k", "m"))
    run = Window.partitionBy("row", "rule").orderBy("k")
    spaces_in = _spaces(F.col("m.found"))
    spaces_to = F.sum(_spaces(F.col("m.before")) + spaces_in).over(run) - spaces_in
    found = gaps.select("row", "rule", "tier", "label", spaces_to.alias("first"),
                        (spaces_to + spaces_in + 1).alias("end"))
    earlier = (Window.partitionBy("row").orderBy("first", F.desc("end"), F.desc("tier"), "rule")
               .rowsBetween(Window.unboundedPreceding, -1))
    reach = [F.max(F.when(F.col("tier") >= t, F.col("end"))).over(earlier) for t in (1, 2, 3)]
    own = F.when(F.col("tier") == 1, reach[0]).when(F.col("tier") == 2, reach[1]).otherwise(reach[2])
    return (found.withColumn("reach", own).filter(F.col("reach").isNull() | (F.col("reach") < F.col("end")))
            .drop("reach"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, places, labels and score for every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "license-scan")
    keywords = sorted({k for k, *_ in rules()} | {p.rsplit(" ", 1)[-1] for p, _ in BASE})
    norm, words = F.col("norm"), F.col("words")
    gate = F.arrays_overlap(words, F.array(*[F.lit(k) for k in keywords]))
    rows = scratch.keep(
        keyed(docs, F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("norm"))
        .withColumn("words", F.split("norm", " ", -1))
        .select("row", "doc_id", F.when(norm == "", 0).otherwise(F.size(words)).cast("long").alias("n_words"),
                F.when(gate, norm).alias("norm")), "rows")
    gated = rows.filter("norm IS NOT NULL").withColumn("words", F.split("norm", " ", -1))
    found = detections(gated.select("row", "norm", "words"), rule_table(spark))
    score = reduce(lambda c, t: c.when(F.col("tier") == t[0], t[1]), enumerate(TIER_SCORE, 1), F)
    by_row = found.groupBy(F.col("row").alias("at_row")).agg(
        F.collect_set("label").alias("more"), F.max(score).alias("sure"))
    places = {label: _places(words, norm, phrase) for phrase, label in BASE}
    base = gated.select(
        "row", F.concat(*places.values()).alias("places"),
        F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for label, p in places.items()])).alias("base"))
    none = F.array().cast("array<string>")
    base_labels = F.coalesce("base", none)
    return (rows.drop("norm").join(base, "row", "left").join(by_row, F.col("row") == F.col("at_row"), "left").select(
        "doc_id", "n_words", F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("more", none))), ",").alias("labels"),
        F.greatest(F.coalesce("sure", F.lit(0.0)), F.when(F.size(base_labels) > 0, TIER_SCORE[0]).otherwise(0.0)).alias("score")))
