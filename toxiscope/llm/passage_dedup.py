"""Removal of passages that an earlier document holds, wherever they start and end.

Words are runs of bytes between white space, compared byte by byte.  A window
of ``PASSAGE`` consecutive words that stands in several documents stays in the
first of them (smallest doc_id); in all others every word of the window goes,
so that overlapping windows add up to the whole passage, word by word at both
ends.  Lines play no part: a passage may lie inside one line or in a document
of one line.

Not every window becomes a row.  Of the runs of ``GRAM`` words, those are
anchors whose hash is the smallest in some window of ``PASSAGE`` words
(winnowing); equal windows have the same smallest hash, so only windows whose
smallest is an anchor of several documents are hashed (64 and 32 bits) and
compared.  Texts meet nothing but their own rows; the most frequent window costs one row per occurrence and map
task, its later occurrences one joined row each, which adaptive skew handling
splits.

Defined results: repeats within one document stay; a null text stays null; a
document of fewer than ``PASSAGE`` words stays as it is; white space after a
passage goes with it; repeated ids are told apart by their row; rows without
an id come last; other columns pass through unread; an empty table gives an
empty result.  Texts are compared as they come: a run of words that only
arises by a removal isn't looked at again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toxiscope.llm.common import Scratch, bit_table, in_table, text_steps, tidy
from toxiscope.llm.words import SOLID, mix, run_hashes, span_hashes, spans

PASSAGE, GRAM = 50, 16
#: Bits of the table that pre-selects rows with an anchor of several documents.
ROW_BITS = 1 << 24
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, text index, place in its text, start) of all words."""
    starts, ends, owner = spans(data, offsets, SOLID)
    firsts = np.searchsorted(owner, np.arange(len(offsets)))
    return span_hashes(data, starts, ends), owner, np.arange(len(owner)) - firsts[owner], starts


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of every ``width`` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def anchors(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of all anchors of a batch."""
    if len(hashes) < PASSAGE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width = PASSAGE - GRAM + 1
    grams = run_hashes(hashes, GRAM)
    least = _sliding(grams, width, np.minimum)
    inside = owner[:len(least)] == owner[PASSAGE - 1:]
    edge = np.zeros(width - 1, np.uint64)
    chosen = _sliding(np.concatenate((edge, np.where(inside, least, np.uint64(0)), edge)), width, np.maximum) == grams
    at = np.flatnonzero(chosen)
    return at, grams[at]


def _anchor_rows(batches):
    for batch in batches:
        rows = batch.column(0).to_numpy(zero_copy_only=False)
        for first, _, data, offsets in text_steps(batch):
            hashes, owner, place, _ = _words(data, offsets)
            at, found = anchors(hashes, owner)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(rows[first + owner[at]]), pa.array(place[at].astype(np.int32))],
                    ["h", "row", "at"])


def _marks(batch: pa.RecordBatch, first: int, end: int, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(text index in the step, place) of all numbers in the lists of rows ``first`` to ``end``."""
    lists = batch.column(batch.schema.get_field_index(column)).slice(first, end - first)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(end - first), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """If each of ``n`` places lies in one of the ranges."""
    depth = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(depth)[:n] > 0


def _window_rows(batches):
    """Hashes of all windows whose smallest run is an anchor listed in ``places``."""
    for batch in batches:
        for first, end, data, offsets in text_steps(batch):
            hashes, owner, place, _ = _words(data, offsets)
            if len(hashes) < PASSAGE:
                continue
            text, at = _marks(batch, first, end, "places")
            at = at + np.searchsorted(owner, np.arange(end - first + 1))[text]
            grams, width = run_hashes(hashes, GRAM), PASSAGE - GRAM + 1
            shared = np.full(len(grams), np.iinfo(np.uint64).max, np.uint64)
            shared[at] = grams[at]
            near = _sliding(shared, width, np.minimum) == _sliding(grams, width, np.minimum)
            start = np.flatnonzero(near & (owner[:len(near)] == owner[PASSAGE - 1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(run_hashes(hashes, PASSAGE)[start].view(np.int64)),
                 pa.array((run_hashes(mix(hashes ^ _OTHER), PASSAGE)[start] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                 batch.column(0).take(pa.array(first + owner[start])), pa.array(place[start].astype(np.int32))],
                ["h1", "h2", "ord", "at"])


def _without(batches):
    """(row, text without the windows that start at the places in ``gone``, words removed)."""
    for batch in batches:
        for first, end, data, offsets in text_steps(batch):
            _, owner, _, starts = _words(data, offsets)
            text, at = _marks(batch, first, end, "gone")
            at = at + np.searchsorted(owner, np.arange(end - first + 1))[text]
            out = _covered(len(starts), at, at + PASSAGE)
            nexts = np.minimum(np.append(starts[1:], len(data)), offsets[owner + 1])
            cut = _covered(len(data), starts[out], nexts[out])
            kept = np.concatenate(([0], np.cumsum(~cut)))[offsets]
            raw = data[~cut].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, end - first),
                 pa.array([raw[a:b].decode() for a, b in zip(kept[:-1], kept[1:], strict=True)], pa.string()),
                 pa.array(np.bincount(owner[out], minlength=end - first).astype(np.int32))],
                ["row", "text", "removed"])


def dedupe_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns of ``docs`` with the cleaned text, then ``words_removed``.

    A name that ``docs`` already has gets underscores.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "passage-dedup")

    def fresh(name: str) -> str:
        while name in docs.columns:
            name += "_"
        return name

    own, new_row, new_text, removed = fresh("__row"), fresh("__new_row"), fresh("__new_text"), fresh("__removed")
    kept = scratch.keep(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    rows = kept.select(F.col(own).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = scratch.keep(rows.select("row", "text").mapInArrow(tidy(_anchor_rows), "h long, row long, at int"), "anchors")
    several = found.groupBy("h").agg(F.min("row").alias("a"), F.max("row").alias("b")).filter("a <> b").select("h")
    places = found.join(several, "h").groupBy("row").agg(F.collect_list("at").alias("places"))
    # numbers that rise in the order in which documents keep their passages
    places = scratch.keep(places.join(rows.select("row", "doc_id"), "row").orderBy(F.col("doc_id").asc_nulls_last(), "row")
                          .select(F.monotonically_increasing_id().alias("ord"), "row", "places"), "places")
    scratch.drop("anchors")
    table = spark.sparkContext.broadcast(bit_table(places.select(F.xxhash64("row").alias("k")), "k", ROW_BITS))

    def marked(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_table(table.value, batch.column(2).to_numpy(zero_copy_only=False)))).select(["row", "text"])

    held = rows.select("row", "text", F.xxhash64("row").alias("k")).mapInArrow(tidy(marked), "row long, text string")
    seen = scratch.keep(held.join(places, "row").select("ord", "text", "places").mapInArrow(
        tidy(_window_rows), "h1 long, h2 int, ord long, at int"), "windows")
    repeated = (seen.groupBy("h1", "h2").agg(F.min("ord").alias("ord0"), F.max("ord").alias("last"))
                .filter("ord0 <> last").select("h1", "h2", "ord0"))
    gone = (seen.join(repeated, ["h1", "h2"]).filter("ord <> ord0")
            .groupBy("ord").agg(F.collect_list("at").alias("gone"))
            .join(places.select("ord", "row"), "ord").select("row", "gone"))
    cleaned = scratch.keep(held.join(gone, "row").mapInArrow(
        tidy(_without), "row long, text string, removed int"), "cleaned").toDF(new_row, new_text, removed)
    scratch.drop("windows", "places")
    out = kept.join(cleaned, kept[own] == cleaned[new_row], "left")
    return out.select(
        *[(F.when(F.col(new_row).isNull(), F.col(c)).otherwise(F.col(new_text)) if c == text else F.col(c)).alias(c)
          for c in docs.columns],
        F.coalesce(removed, F.lit(0)).alias(fresh("words_removed")))


def keep_cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with cleaned texts and their lengths, without the documents of which nothing is left."""
    out = dedupe_passages(docs, doc_id, text)
    changed = F.col(out.columns[-1]) > 0
    out = out.filter(~changed | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[(F.when(changed, F.length(text).cast(docs.schema[c].dataType)).otherwise(F.col(c)) if c == n_chars
                         else F.col(c)).alias(c) for c in docs.columns])
