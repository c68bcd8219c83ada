"""Benchmark decontamination by SimHash windows of an item's size.

For every item size in the benchmark, the windows of that many words of a
document get a 64-bit SimHash over their word shingles; a document with fewer
words is one window as a whole.  Multi-index Hamming
tables (``RADIUS`` + 1 blocks of bits, so that fingerprints within ``RADIUS``
agree in one block at least) give all items of that size within the radius,
and the exact weighted shingle similarity, the sum of the smaller over the
sum of the larger occurrence counts of all shingles, decides at ``THRESHOLD``
or more.  A window that can't reach the threshold because too few of its
shingles occur in any item (a bound, not a guess) needs no fingerprint.

The benchmark is a stated query set: it is gone through in blocks of about
``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` bytes, each shipped whole to the
tasks, and every block meets all documents.  Documents are never shuffled;
only matches move.

Defined results: null and empty texts match nothing; an item of fewer than
five words is one shingle and matches only documents that are that sequence;
items without words match nothing; repeated documents and repeated items
each match; an empty table on either side gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toxiscope.llm.common import text_steps, tidy
from toxiscope.llm.words import LOWER, SOLID, shingles, span_hashes, spans

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 23
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
FILTER_BITS = 1 << 22
#: Pairs of a window and an item that may be looked up at once.
PAIRS = 1 << 23


@dataclass
class Items:
    """A block of the benchmark: per item its number, words, fingerprint and shingles."""
    ids: np.ndarray
    sizes: np.ndarray
    prints: np.ndarray
    hashes: list[np.ndarray]
    known: np.ndarray
    filter: np.ndarray


def text_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes in order, bounds of every text's shingles, words of every text)."""
    n = len(offsets) - 1
    data = LOWER[data]
    starts, ends, owner = spans(data, offsets, SOLID)
    out, at = shingles(span_hashes(data, starts, ends), owner, n, SHINGLE)
    whose = owner[at] if len(at) else owner[:0]
    return out, np.searchsorted(whose, np.arange(n + 1)), np.bincount(owner, minlength=n)


def positions(words: int) -> int:
    """Shingles of a run of that many words."""
    return max(1, words - SHINGLE + 1)


def fingerprints(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit SimHash of hashes[start:start + size] for every window."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    ones = sums[starts + sizes] - sums[starts]
    return np.packbits(2 * ones > sizes[:, None], axis=1).view("<u8").ravel()


def block_of(rows: list[tuple[object, str]]) -> Items:
    """The block made of (item id, text) rows; items without words are left out."""
    texts = [(t or "").encode() for _, t in rows]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    hashes, bounds, words = text_shingles(np.frombuffer(b"".join(texts), np.uint8), offsets)
    keep = np.flatnonzero(words)
    starts, sizes = bounds[keep], bounds[keep + 1] - bounds[keep]
    known = np.unique(hashes)
    table = np.zeros(FILTER_BITS, bool)
    table[(known % np.uint64(FILTER_BITS)).astype(np.int64)] = True
    return Items(keep, words[keep], fingerprints(hashes, starts, sizes),
                 [hashes[a:a + n] for a, n in zip(starts, sizes, strict=True)], known, np.packbits(table))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two lists of shingles, weights their occurrence counts."""
    names, which = np.unique(np.concatenate((a, b)), return_inverse=True)
    x = np.bincount(which[:len(a)], minlength=len(names))
    y = np.bincount(which[len(a):], minlength=len(names))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def _candidates(prints: np.ndarray, sizes: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) pairs of equal size that agree in a block and lie within the radius."""
    blocks, pairs = RADIUS + 1, []
    for k in range(blocks):
        low, high = 64 * k // blocks, 64 * (k + 1) // blocks
        mask, width = np.uint64((1 << (high - low)) - 1), np.int64(1 << (high - low))
        key = lambda p, n: n * width + ((p >> np.uint64(low)) & mask).astype(np.int64)  # noqa: B023, E731
        own = key(items.prints, items.sizes)
        order = np.argsort(own, kind="stable")
        wanted = key(prints, sizes)
        first = np.searchsorted(own[order], wanted, "left")
        count = np.searchsorted(own[order], wanted, "right") - first
        step = max(1, PAIRS // max(1, len(own)))
        for at in range(0, len(prints), step):
            some = count[at:at + step]
            window = np.repeat(np.arange(at, at + len(some)), some)
            place = np.arange(len(window)) - np.repeat(np.cumsum(some) - some, some) + first[window]
            item = order[place]
            near = np.bitwise_count(prints[window] ^ items.prints[item]) <= RADIUS
            pairs.append(window[near] * len(items.sizes) + item[near])
    pairs = np.unique(np.concatenate(pairs))
    return pairs // len(items.sizes), pairs % len(items.sizes)


def matches(data: np.ndarray, offsets: np.ndarray, items: Items) -> list[tuple[int, int, int, int, float]]:
    """(text, item number, first word, words, similarity): the best window of every text and item that match."""
    if not len(items.sizes):
        return []
    hashes, bounds, words = text_shingles(data, offsets)
    slot = (hashes % np.uint64(FILTER_BITS)).astype(np.int64)
    maybe = np.flatnonzero((items.filter[slot >> 3] >> (7 - (slot & 7))) & 1)
    at = np.minimum(np.searchsorted(items.known, hashes[maybe]), len(items.known) - 1)
    hit = np.zeros(len(hashes) + 1, np.int64)
    hit[maybe + 1] = items.known[at] == hashes[maybe]
    hits = np.cumsum(hit)
    least = min(math.ceil(THRESHOLD * positions(n)) for n in np.unique(items.sizes))
    out = []
    for text in np.flatnonzero(hits[bounds[1:]] - hits[bounds[:-1]] >= least):
        a, b = bounds[text], bounds[text + 1]
        starts, sizes = [], []
        for n in np.unique(items.sizes):
            p = positions(n)
            if n < SHINGLE and n != words[text]:
                continue
            size = min(p, b - a)
            got = hits[a + size:b + 1] - hits[a:b + 1 - size]
            start = np.flatnonzero(got >= THRESHOLD * p - 1e-9)
            starts.append(start)
            sizes.append(np.full(len(start), n))
        starts, sizes = np.concatenate(starts or [np.zeros(0, int)]), np.concatenate(sizes or [np.zeros(0, int)])
        if not len(starts):
            continue
        counts = np.minimum(np.maximum(1, sizes - SHINGLE + 1), b - a)
        own = hashes[a:b]
        best: dict[int, tuple[float, int]] = {}
        for w, i in zip(*_candidates(fingerprints(own, starts, counts), sizes, items), strict=True):
            s = similarity(own[starts[w]:starts[w] + counts[w]], items.hashes[i])
            if s >= THRESHOLD and (-s, starts[w]) < best.get(i, (0, 0)):
                best[int(i)] = (-s, int(starts[w]))
        out += [(int(text), int(items.ids[i]), start, min(int(items.sizes[i]), int(words[text])), -s) for i, (s, start) in best.items()]
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity) for every document and item that match."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    bench = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    count, size = bench.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(count / BLOCK_ITEMS), math.ceil(size / BLOCK_BYTES))
    kinds = named.schema["doc_id"].dataType.simpleString(), bench.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, first_word int, n_words int, similarity double"
    out = docs.sparkSession.createDataFrame([], schema)
    for k in range(blocks):
        part = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect() if count else []
        items = block_of([(r.item_id, r.text) for r in part])
        shared = docs.sparkSession.sparkContext.broadcast((items, [r.item_id for r in part]))

        def find(batches, shared=shared):
            items, names = shared.value
            for batch in batches:
                found = [(at + t, i, first, n, s) for at, _, data, offsets in text_steps(batch)
                         for t, i, first, n, s in matches(data, offsets, items)]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([f[0] for f in found])), pa.array([names[f[1]] for f in found]),
                         pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32()),
                         pa.array([f[4] for f in found], pa.float64())],
                        ["doc_id", "item_id", "first_word", "n_words", "similarity"])

        out = out.unionByName(named.mapInArrow(tidy(find), schema)) if k else named.mapInArrow(tidy(find), schema)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has no match; all columns.

    What a row holds depends on its text alone, so texts are named by their
    SHA-256: rows without an id or with a repeated one stay or go each by
    their own text.
    """
    leaked = "__leaked"
    while leaked in docs.columns:
        leaked += "_"
    name = F.sha2(F.col(text), 256)
    texts = docs.select(name.alias("doc_id"), F.col(text).alias("text"))
    found = contaminated(texts, benchmark).select(F.col("doc_id").alias(leaked)).distinct()
    return docs.join(found, F.sha2(docs[text], 256) == found[leaked], "left_anti")
