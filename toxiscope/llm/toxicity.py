"""Toxicity by weak supervision.

Voters are lexicon entries (words) and patterns (beginnings of words, and
signs of shouting) taken from class-wise document frequencies over all
training rows.  A generative label model, fitted by expectation
maximisation, estimates how often each voter fires in either class and how
strongly voters fire together within a class, and discounts voters that
repeat each other; the given label takes part as one more, anchoring voter.
A linear classifier is then trained on the posterior labels and scores every
document.

Frequencies cover all labelled rows outside the held-out fold (map-side sums,
then one shuffle keyed by feature).  Every feature over the thresholds takes
part: the ``FEATURES`` strongest have a weight each, the ``VOTERS`` strongest a
vote each; of the others, those that share a slot (of ``SLOTS``) share a
weight, and those that share a lexicon (of ``LEXICONS``) a vote.  Tasks know
the others by a bit table of fixed size, so what is broadcast doesn't grow.
Label model and classifier are fitted on a bounded sample: ``FIT_DOCS`` of
the training rows at most, in the order of a hash of their id (of rows of one
id, those of the smallest feature lists first).

Defined results: a null text counts as empty and gets the classifier's bias;
without any toxic training row every score is 0; repeated rows each get
their result; rows with a null id or label aren't learned from; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toxiscope.llm.common import Scratch, bit_table, crc_bucket, in_table, text_steps
from toxiscope.llm.words import ALNUM, LOWER, byte_sums, mix, span_hashes, spans

FIT_DOCS, FEATURES, VOTERS = 20_000, 2048, 256
#: Shared weights and votes of the features beyond these; LEXICONS divides SLOTS.
SLOTS, LEXICONS, TABLE_BITS = 4096, 64, 1 << 24
MIN_TOXIC, MIN_LIFT, THRESHOLD = 3, 3.0, 0.3
#: Lengths in bytes of the word beginnings that count as patterns.
BEGINNINGS = (4, 5, 6)
#: Pattern voters over whole texts: bytes and the share of the text from which they fire.
SIGNS = (("!", 0.005), ("?", 0.01), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.3), ("*#$%&", 0.01))
EM_ROUNDS, ANCHOR = 20, 0.97


@dataclass
class Scorer:
    features: np.ndarray
    others: np.ndarray | None
    weights: np.ndarray
    bias: float


def _word_features(data: np.ndarray, offsets: np.ndarray):
    """Distinct words of the step: (features of each, a row per kind), text and word number of every word."""
    data = LOWER[data]
    starts, ends, owner = spans(data, offsets, ALNUM)
    sums = byte_sums(data)
    hashes = span_hashes(data, starts, ends, sums)
    words, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    starts, ends = starts[first], ends[first]
    kinds = [words]
    for k in BEGINNINGS:
        begun = mix(span_hashes(data, starts, np.minimum(starts + k, ends), sums) + np.uint64(k))
        kinds.append(np.where(ends - starts > k, begun, np.uint64(0)))
    return np.stack(kinds).view(np.int64), owner, which


def _signs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For every text and pattern of SIGNS, if it fires."""
    n, length = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
    out = np.zeros((n, len(SIGNS)), bool)
    for j, (chars, share) in enumerate(SIGNS):
        table = np.zeros(256, bool)
        table[list(chars.encode())] = True
        total = np.concatenate(([0], np.cumsum(table[data])))
        out[:, j] = (total[offsets[1:]] - total[offsets[:-1]]) > share * length
    return out


def frequencies(labelled: DataFrame) -> DataFrame:
    """(feature, toxic, clean): documents of either class with the feature; ``labelled`` has text, toxic."""
    def count(batches):
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            keys = np.concatenate([k for k, _ in kept])
            values = np.concatenate([v for _, v in kept])
            keys, which = np.unique(keys, return_inverse=True)
            sums = np.stack([np.bincount(which, values[:, j], len(keys)) for j in (0, 1)], 1)
            kept[:] = [(keys, sums.astype(np.int64))]

        for batch in batches:
            toxic = np.array(batch.column(batch.schema.get_field_index("toxic")).to_pylist(), np.int64)
            for at, end, data, offsets in text_steps(batch):
                kinds, owner, which = _word_features(data, offsets)
                n = max(1, kinds.shape[1])
                pairs = np.unique(owner * n + which)  # each word once a text
                owner, which = pairs // n, pairs % n
                feature, text = kinds[:, which].ravel(), np.tile(owner, len(kinds))
                text = text[feature != 0]
                names, number = np.unique(feature[feature != 0], return_inverse=True)
                pairs = np.unique(text * max(1, len(names)) + number)
                number, text = pairs % max(1, len(names)), pairs // max(1, len(names))
                y = toxic[at + text]
                kept.append((names, np.stack([np.bincount(number, y == 1, len(names)),
                                              np.bincount(number, y == 0, len(names))], 1).astype(np.int64)))
                if len(kept) > 16:
                    merged()
        if kept:
            merged()
            keys, sums = kept[0]
            for at in range(0, len(keys), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[part]), pa.array(sums[part, 0]), pa.array(sums[part, 1])], ["feature", "toxic", "clean"])

    return (labelled.select("text", "toxic").mapInArrow(count, "feature long, toxic long, clean long")
            .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def active(features: np.ndarray, others: np.ndarray | None, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature number) pairs that occur, each once; ``features`` sorted, the SIGNS follow them, then the slots of
    the features in the bit table ``others``."""
    kinds, owner, which = _word_features(data, offsets)
    signs, n = _signs(data, offsets), len(features) + len(SIGNS) + SLOTS
    text, sign = np.nonzero(signs)
    pairs = [text * n + len(features) + sign]
    for kind in kinds if len(features) else ():
        at = np.minimum(np.searchsorted(features, kind), len(features) - 1)
        hit = features[at] == kind
        if others is not None:
            slot = len(features) + len(SIGNS) + (mix(kind.view(np.uint64)) % np.uint64(SLOTS)).astype(np.int64)
            at, hit = np.where(hit, at, slot), hit | (in_table(others, kind) & (kind != 0))
        found = hit[which]
        pairs.append(owner[found] * n + at[which[found]])
    pairs = np.unique(np.concatenate(pairs))
    return pairs // n, pairs % n


def posterior(votes: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Posterior probability of the toxic class from a (rows, voters) 0/1 matrix and the given labels.

    Each voter fires with a rate of its own in either class; within a class
    voters may be correlated, and a voter's evidence is divided by one plus
    its positive correlations with the others.  The given label's rates are
    estimated too, its accuracy between 1/2 and ANCHOR.
    """
    prior = np.clip(anchor.mean(), 1e-3, 1 - 1e-3)
    q = np.where(anchor == 1, ANCHOR, 1 - ANCHOR)
    for _ in range(EM_ROUNDS):
        on = (q @ votes + 0.5) / (q.sum() + 1)
        off = ((1 - q) @ votes + 0.5) / ((1 - q).sum() + 1)
        hit = np.clip((q @ anchor + 1) / (q.sum() + 2), 0.5, ANCHOR)
        false = np.clip(((1 - q) @ anchor + 1) / ((1 - q).sum() + 2), 1 - ANCHOR, 0.5)
        given = np.where(anchor == 1, np.log(hit / false), np.log((1 - hit) / (1 - false)))
        residual = votes - (q[:, None] * on + (1 - q)[:, None] * off)
        spread = np.sqrt(np.maximum((residual ** 2).mean(0), 1e-9))
        together = (residual.T @ residual) / len(votes) / spread[:, None] / spread
        discount = 1 + np.clip(together - np.eye(len(on)), 0, 1).sum(1)
        yes, no = np.log(on / off) / discount, np.log((1 - on) / (1 - off)) / discount
        odds = np.log(prior / (1 - prior)) + given + votes @ (yes - no) + no.sum()
        q, was = 1 / (1 + np.exp(-np.clip(odds, -30, 30))), q
        prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        if np.abs(q - was).max() < 1e-4:
            break
    return q


def fit_linear(rows: np.ndarray, columns: np.ndarray, n_rows: int, n_columns: int, target: np.ndarray,
               rounds: int = 400, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels over 0/1 features given as (row, column) pairs; Adam, full batch."""
    w = np.zeros(n_columns + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    w[-1] = np.log(max(target.mean(), 1e-3) / max(1 - target.mean(), 1e-3))
    for step in range(1, rounds + 1):
        z = np.bincount(rows, w[columns], n_rows) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n_rows
        g = np.append(np.bincount(columns, error[rows], n_columns) + penalty * w[:-1], error.sum())
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        w -= 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(labelled: DataFrame, scratch: Scratch) -> Scorer | None:
    """The scorer learned from rows (doc_id, text, toxic), or None without a toxic row."""
    totals = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if not totals.get(1):
        return None
    lift = (F.col("toxic") + 0.5) / (F.col("clean") + 0.5) * (totals.get(0, 0) + 1) / (totals[1] + 1)
    chosen = scratch.keep(frequencies(labelled).filter((F.col("toxic") >= MIN_TOXIC) & (lift >= MIN_LIFT))
                          .select("feature", (F.col("toxic") * F.log(lift)).alias("strength")), "chosen")
    best = chosen.orderBy(F.desc("strength"), "feature").limit(FEATURES).collect()
    ranked = np.array([r.feature for r in best], np.int64)
    others = None
    if len(best) == FEATURES:
        least = best[-1]
        others = bit_table(chosen.filter((F.col("strength") < least.strength) | (F.col("strength") == least.strength) &
                                         (F.col("feature") > least.feature)), "feature", TABLE_BITS)
    features = np.sort(ranked)
    order = F.xxhash64("doc_id", F.lit("fit"))
    last = labelled.select(order.alias("o")).orderBy("o").limit(FIT_DOCS).agg(F.max("o")).first()[0]

    def lists(batches):
        for batch in batches:
            out = []
            for at, end, data, offsets in text_steps(batch):
                text, number = active(features, others, data, offsets)
                bounds = np.searchsorted(text, np.arange(end - at + 1))
                out += [number[bounds[i]:bounds[i + 1]].astype(np.int32) for i in range(end - at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["o", "toxic", "on"])

    sample = (labelled.filter(order <= F.lit(last)).select(order.alias("o"), "toxic", "text")
              .mapInArrow(lists, "o long, toxic int, on array<int>").orderBy("o", "on", "toxic").limit(FIT_DOCS).toPandas())
    counts = sample["on"].map(len).to_numpy()
    rows = np.repeat(np.arange(len(sample)), counts)
    columns = np.concatenate(sample["on"].to_list()).astype(np.int64) if counts.sum() else np.zeros(0, np.int64)
    n = len(features) + len(SIGNS) + SLOTS
    own = np.concatenate((np.searchsorted(features, ranked[:VOTERS]), np.arange(len(features), len(features) + len(SIGNS))))
    # the other features' seats are those of their lexicons
    seat = len(own) + np.arange(n) % LEXICONS
    seat[own] = np.arange(len(own))
    voters, seated = np.unique(seat[columns], return_inverse=True)
    votes = np.zeros((len(sample), len(voters)), np.float32)
    votes[rows, seated] = 1
    soft = posterior(votes, sample["toxic"].to_numpy())
    weights, bias = fit_linear(rows, columns, len(sample), n, soft)
    return Scorer(features, others, weights, bias)


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          folds: int = 4, test_fold: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; ``labels`` has doc_id and ``label``."""
    held_out = F.coalesce(crc_bucket("doc_id", folds) == test_fold, F.lit(False))
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = (labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic"))
             .filter(F.col("toxic").isin(0, 1) & ~held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    # the labelled texts, shuffled once whatever the sizes, and kept for the passes over them
    labelled = named.filter(F.col("doc_id").isNotNull() & ~held_out).join(known.hint("merge"), "doc_id")
    scratch = Scratch(docs.sparkSession, "toxicity")
    scorer = fit(scratch.keep(labelled, "labelled"), scratch)

    def apply(batches):
        for batch in batches:
            out = []
            for at, end, data, offsets in text_steps(batch):
                if scorer is None:
                    out.append(np.zeros(end - at))
                    continue
                rows, columns = active(scorer.features, scorer.others, data, offsets)
                z = np.bincount(rows, scorer.weights[columns], end - at) + scorer.bias
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])

    kind = named.schema["doc_id"].dataType.simpleString()
    return (named.mapInArrow(apply, f"doc_id {kind}, score double")
            .select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
