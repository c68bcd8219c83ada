"""Phrases whose words stand together more often than their parts alone.

A task indexes its texts shard by shard: word ids of one language, pieces
kept apart, in an FM-index (Burrows-Wheeler transforms of the sequence and of
its reverse).  Every interval of the index is one n-gram and its length the
count.  Pairs are the left extensions of the words' intervals, which also
gives the pairs' intervals in the reverse index; triples are the right
extensions of those.  Counts are summed across shards by phrase.

Counts are exact.  As a phrase is no more frequent than its parts, words (then
pairs) below ``least`` end a piece (start no triple); a bit table of fixed size
says which may be frequent, so it may let more through, never less.

Rules: a null language is ``und``, a null text is empty; a word may be of any
length; repeated rows count again; other columns are ignored; a language or
table without a candidate has no rows.  Shards hold about ``SHARD_BYTES`` of
whole texts, a longer text is a shard of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from toxiscope.llm.common import Scratch, bit_table, in_table, text_steps
from toxiscope.llm.words import LOWER, mix, span_hashes, spans

#: Least count of a candidate; share (of 100) of its count at which a longer candidate replaces it; rows of a language.
LEAST, INSIDE, TOP = 10, 50, 2000
SHARD_BYTES = 2 << 20
#: Counted phrases that go to the JVM at once.
STEP = 1 << 15
#: Bits of the tables of words and pairs that may be frequent (4 MB each).
BITS = 1 << 25

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = True
_INSIDE = ~_BREAK
_INSIDE[[0x20, 0x09]] = False
_PAIR = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Shard:
    """Words of the texts of one language: a dictionary, its keys, and the sequence of ids with 0 between pieces."""

    def __init__(self, lang: str, data: np.ndarray, offsets: np.ndarray):
        self.lang = lang
        data = LOWER[data]
        starts, ends, owner = spans(data, offsets, _INSIDE)
        self.total = len(starts)
        sizes = np.concatenate(([0], np.cumsum(ends - starts)))
        letters = data[_INSIDE[data]]
        coded = pa.LargeStringArray.from_buffers(self.total, pa.py_buffer(sizes), pa.py_buffer(letters)).dictionary_encode()
        self.words, ids = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        name = lang.encode()
        salt = span_hashes(np.frombuffer(name + b"\0", np.uint8), np.array([0]), np.array([len(name) + 1]))
        _, places, letters = self.words.buffers()
        places = np.frombuffer(places, np.int64)[:len(self.words) + 1]
        letters = np.frombuffer(letters, np.uint8)[:places[-1]] if len(self.words) else np.zeros(0, np.uint8)
        self.keys = mix(span_hashes(letters, places[:-1], places[1:]) + salt)
        breaks = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_BREAK[data], out=breaks[1:])
        self.ids, self.counts = ids, np.bincount(ids, minlength=len(self.words))
        cut = np.ones(self.total, bool)
        if self.total:
            cut[1:] = (owner[1:] != owner[:-1]) | (breaks[starts[1:]] > breaks[ends[:-1]])
        self.cut = cut

    def sequence(self, may: np.ndarray) -> np.ndarray:
        """Ids from 1 of words that may be in a phrase; 0 for all others and between pieces, one 0 in a row."""
        n = self.total
        out = np.zeros(n + int(self.cut.sum()) + 1, np.int64)
        out[np.arange(n) + np.cumsum(self.cut)] = np.where(may[self.ids], self.ids + 1, 0)
        return out[np.concatenate(([True], (out[1:] > 0) | (out[:-1] > 0)))]


class Index:
    """FM-index of a sequence and of its reverse, for patterns of up to three symbols; 0 is no symbol of a pattern."""

    def __init__(self, s: np.ndarray, symbols: int):
        self.m = symbols
        self.s, self.before, self.after = s, np.concatenate(([0], s[:-1])), np.concatenate((s[1:], [0]))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, count, place) of all pairs: the left extensions of every word's interval.

        ``place`` is where the pair's interval in the reverse index begins:
        inside b's interval there, behind the extensions by smaller symbols.
        """
        order = np.argsort(self.s * self.m + self.after, kind="stable")
        steps = np.sort(self.s[order] * self.m + self.before[order], kind="stable")
        first = np.flatnonzero(np.concatenate(([True], steps[1:] != steps[:-1]))) if len(steps) else np.zeros(0, np.int64)
        a, b, count = steps[first] % self.m, steps[first] // self.m, np.diff(np.concatenate((first, [len(steps)])))
        real = (a > 0) & (b > 0)
        return a[real], b[real], count[real], first[real]

    def right(self, count: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, c, count): the right extensions of the patterns whose reverse intervals are given."""
        order = np.argsort(self.s * self.m + self.before, kind="stable")
        follows = self.after[order]
        ends = np.cumsum(count)
        rows = np.repeat(place - np.concatenate(([0], ends[:-1])), count) + np.arange(ends[-1] if len(ends) else 0)
        steps = np.sort(np.repeat(np.arange(len(count)), count) * self.m + follows[rows], kind="stable")
        steps, found = np.unique(steps[steps % self.m > 0], return_counts=True)
        return steps // self.m, steps % self.m, found


def _joined(words: pa.Array, *ids: np.ndarray) -> pa.Array:
    parts = [words.take(pa.array(i - 1)) for i in ids]
    return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())).cast(pa.string())


def _pair_keys(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(keys[a - 1] * _PAIR[0] + keys[b - 1] * _PAIR[1])


def _counts(shard: Shard, length: int, tables: list) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(phrase, count, key) of the shard's n-grams of ``length`` words; for 1 also a null phrase with the words in all."""
    if length == 1:
        words = pa.concat_arrays([shard.words.cast(pa.string()), pa.nulls(1, pa.string())])
        return words, np.append(shard.counts, shard.total), np.append(shard.keys, np.uint64(0))
    index = Index(shard.sequence(in_table(tables[0], shard.keys)), len(shard.words) + 1)
    a, b, count, place = index.pairs()
    keys = _pair_keys(shard.keys, a, b)
    if length == 2:
        return _joined(shard.words, a, b), count, keys
    may = in_table(tables[1], keys)
    a, b, count, place = (x[may] for x in (a, b, count, place))
    pattern, c, found = index.right(count, place)
    may = in_table(tables[1], _pair_keys(shard.keys, b[pattern], c))
    pattern, c, found = pattern[may], c[may], found[may]
    return _joined(shard.words, a[pattern], b[pattern], c), found, np.zeros(len(c), np.uint64)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Shards of whole texts, by language; what waits is less than ``SHARD_BYTES`` in all."""
    waiting: dict[str, list] = {}
    held = 0

    def built():
        while waiting:
            lang, parts = waiting.popitem()
            sizes = np.concatenate([np.diff(o) for _, o in parts])
            yield Shard(lang, np.concatenate([d for d, _ in parts]), np.concatenate(([0], np.cumsum(sizes))))
    for batch in batches:
        langs = np.asarray(batch.column(0).to_pylist(), object)
        for lang in dict.fromkeys(langs):
            mine = batch.filter(pa.array(langs == lang))
            for _, _, data, offsets in text_steps(mine, "text", SHARD_BYTES):
                if held and held + len(data) > SHARD_BYTES:
                    yield from built()
                    held = 0
                waiting.setdefault(lang, []).append((data.copy(), offsets))
                held += len(data) + 1
    yield from built()


def ngram_counts(docs: DataFrame, length: int, tables: list) -> DataFrame:
    """(lang, phrase, f, key) of all n-grams of ``length`` words that the tables let through, over all shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [np.asarray(t.value) for t in sent]
        for shard in _shards(batches):
            phrase, count, key = _counts(shard, length, known)
            for at in range(0, len(phrase), STEP):
                part = phrase[at:at + STEP]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(shard.lang), len(part)), part, pa.array(count[at:at + STEP].astype(np.int64)),
                     pa.array(key[at:at + STEP].view(np.int64))], ["lang", "phrase", "n", "key"])
            del shard, phrase, count, key
            pa.default_memory_pool().release_unused()
    sent = [docs.sparkSession.sparkContext.broadcast(t) for t in tables]
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, "lang string, phrase string, n long, key long")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("f"), F.first("key").alias("key"))


def frequent(docs: DataFrame, scratch: Scratch, least: int = LEAST) -> list[DataFrame]:
    """[words, pairs, triples] (lang, phrase, f, key) with f >= ``least``; among the words a null phrase has a language's words in all."""
    found, tables = [], []
    for length in (1, 2, 3):
        counts = ngram_counts(docs, length, tables)
        found.append(scratch.keep(counts.filter((F.col("f") >= least) | F.col("phrase").isNull()), f"grams-{length}"))
        if length < 3:
            tables.append(bit_table(found[-1].filter("phrase IS NOT NULL"), "key", BITS))
    return found


def mine(docs: DataFrame, least: int = LEAST, inside: int = INSIDE) -> DataFrame:
    """(lang, phrase, a, l, r, n, score, left, right) of every phrase of two or three words that stays.

    a, l and r are the counts of the phrase and of its parts at the cut with
    the lowest score floor(1000000 a a / (l r)) (the first of equals), n the
    language's words; ``left`` and ``right`` the largest count of a candidate
    that is longer by a word on that side, null if there is none.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    words, pairs, triples = frequent(docs, scratch, least)
    totals = words.filter("phrase IS NULL").select("lang", F.col("f").alias("n"))
    word = words.filter("phrase IS NOT NULL").select("lang", "phrase", "f")

    def counted(rows: DataFrame, part: str, of: DataFrame, out: str) -> DataFrame:
        return rows.join(of.select("lang", F.col("phrase").alias(part), F.col("f").alias(out)), ["lang", part])

    def score(l: str, r: str):
        big = "CAST({} AS DECIMAL(15,0))"
        a = big.format("a")
        return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * ({a} * {a})) div ({big.format(l)} * {big.format(r)})")

    w = F.split("phrase", " ")
    two = pairs.select("lang", "phrase", F.col("f").alias("a"), w[0].alias("w1"), w[1].alias("w2"))
    three = triples.select("lang", "phrase", F.col("f").alias("a"), w[0].alias("w1"), w[2].alias("w3"),
                           F.concat_ws(" ", w[0], w[1]).alias("p1"), F.concat_ws(" ", w[1], w[2]).alias("p2"))
    longer = (three.select("lang", F.col("p1").alias("phrase"), F.lit(None).cast("long").alias("left"), F.col("a").alias("right"))
              .unionByName(three.select("lang", F.col("p2").alias("phrase"), F.col("a").alias("left"), F.lit(None).cast("long").alias("right")))
              .groupBy("lang", "phrase").agg(F.max("left").alias("left"), F.max("right").alias("right")))
    two = counted(counted(two, "w1", word, "l"), "w2", word, "r").join(longer, ["lang", "phrase"], "left")
    two = two.filter(F.coalesce(100 * F.greatest("left", "right") < inside * F.col("a"), F.lit(True)))
    three = reduce(lambda rows, p: counted(rows, *p), (("w1", word, "l1"), ("p2", pairs, "r1"), ("p1", pairs, "l2"), ("w3", word, "r2")), three)
    three = three.withColumn("s1", score("l1", "r1")).withColumn("s2", score("l2", "r2"))
    second = F.col("s2") < F.col("s1")
    kept = two.select("lang", "phrase", "a", "l", "r", score("l", "r").alias("score"), "left", "right").unionByName(three.select(
        "lang", "phrase", "a", F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"),
        F.when(second, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least("s1", "s2").alias("score"),
        F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right")))
    return kept.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score", "left", "right")


def best(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (phrases.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# DuckDB: all n-grams spelled out.
ORACLE = f"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
           FROM (SELECT coalesce(lang, 'und') AS lang,
                        unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
                 FROM documents)),
n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
g AS (SELECT lang, len, phrase, count(*) AS f FROM (
        SELECT lang, 1 AS len, unnest(w) AS phrase FROM p
        UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM p
        UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p)
      GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, phrase, len, f AS a, string_split(phrase, ' ') AS w FROM g WHERE len > 1),
cuts AS (SELECT c.lang, c.phrase, c.len, c.a, l.f AS l, r.f AS r, k.k,
                CAST((1000000 * CAST(c.a AS HUGEINT) * c.a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
         FROM c JOIN (VALUES (1), (2)) k(k) ON k.k < c.len
         JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k.k], ' ')
         JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k.k + 1:], ' ')),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
gone AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN (
           SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM c WHERE len = 3) t
         ON s.lang = t.lang AND s.phrase = t.part AND 100 * t.a >= {INSIDE} * s.a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM (
  SELECT lang, phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM low ANTI JOIN gone USING (lang, phrase) JOIN n USING (lang)) WHERE rank <= {TOP}
"""
