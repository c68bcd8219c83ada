"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a word's bytes in both directions and labels every
position with probabilities over the learned languages; a document's
probabilities pool those of all its positions.  It is trained here, in
numpy, by backpropagation through time with Adam.  Its state starts anew at
every word (and after ``SEGMENT`` bytes of a longer one), so a word's
positions have the same labels wherever it stands: each distinct word of a
batch runs once and counts as often as it occurs, and a text of any length
needs bounded memory beyond itself.

Training reads a bounded sample: ``TRAIN_DOCS`` training documents in the
order of a hash of their id, ``TRAIN_WORDS`` words from all over each.

Defined results: a null text, or one without a letter, is ``und`` with score
0, as is every text if there is nothing to learn from; repeated rows each
get their result; rows with a null language or id aren't learned from; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toxiscope.llm.common import crc_bucket, text_steps, tidy
from toxiscope.llm.words import LOWER, span_hashes, spans

UNKNOWN = "und"
TRAIN_DOCS, TRAIN_WORDS, EPOCHS = 3000, 32, 5
HIDDEN, SEGMENT, BATCH, RATE = 12, 24, 512, 0.01
#: Bytes of words: ASCII letters and everything beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


@dataclass
class Model:
    languages: list[str]
    weights: dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text index) of all words, cut into pieces of SEGMENT bytes."""
    starts, ends, owner = spans(data, offsets, LETTERS)
    length = ends - starts
    if len(length) and length.max() > SEGMENT:
        pieces = -(-length // SEGMENT)
        which = np.repeat(np.arange(len(starts)), pieces)
        place = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, ends, owner = starts[which] + place * SEGMENT, ends[which], owner[which]
        length = np.minimum(ends - starts, SEGMENT)
    return starts, length, owner


def byte_matrix(data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A row of lower-cased bytes for every word, 0 beyond its end."""
    width = int(length.max()) if len(length) else 1
    at = starts[:, None] + np.arange(width)
    inside = np.arange(width) < length[:, None]
    return np.where(inside, LOWER[data[np.minimum(at, len(data) - 1)]], 0).astype(np.uint8)


def _reverse(words: np.ndarray, length: np.ndarray) -> np.ndarray:
    at = length[:, None] - 1 - np.arange(words.shape[1])
    return np.where(at >= 0, np.take_along_axis(words, np.maximum(at, 0), 1), 0)


def _run(words: np.ndarray, w: dict[str, np.ndarray], way: str, keep: bool = False):
    """States after every byte, (words, places, HIDDEN), and what the way back needs."""
    table, u = w["x" + way], w["u" + way]
    n, width = words.shape
    h = np.zeros((n, HIDDEN), np.float32)
    states, kept = np.empty((n, width, HIDDEN), np.float32), []
    for t in range(width):
        x = table[words[:, t]]
        a = h @ u
        zr = _sigmoid(x[:, :2 * HIDDEN] + a[:, :2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN:] + r * a[:, 2 * HIDDEN:])
        if keep:
            kept.append((h, z, r, c, a[:, 2 * HIDDEN:]))
        h = c + z * (h - c)
        states[:, t] = h
    return states, kept


def _both(words: np.ndarray, length: np.ndarray, w: dict[str, np.ndarray], keep: bool = False):
    turned = _reverse(words, length)
    fore, kept_f = _run(words, w, "f", keep)
    back, kept_b = _run(turned, w, "b", keep)
    at = np.maximum(length[:, None] - 1 - np.arange(words.shape[1]), 0)
    back = np.take_along_axis(back, at[:, :, None], 1)
    return np.concatenate((fore, back), 2), turned, at, kept_f, kept_b


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def _back(words: np.ndarray, w: dict[str, np.ndarray], way: str, kept: list, d_states: np.ndarray, grad: dict) -> None:
    """Backpropagation through time of one direction."""
    u, h_ = w["u" + way], HIDDEN
    d_h = np.zeros_like(kept[0][0])
    for t in range(words.shape[1] - 1, -1, -1):
        h, z, r, c, a_c = kept[t]
        d = d_h + d_states[:, t]
        d_c = d * (1 - z) * (1 - c * c)
        d_z = d * (h - c) * z * (1 - z)
        d_r = d_c * a_c * r * (1 - r)
        d_x = np.concatenate((d_z, d_r, d_c), 1)
        d_a = np.concatenate((d_z, d_r, d_c * r), 1)
        np.add.at(grad["x" + way], words[:, t], d_x)
        grad["u" + way] += h.T @ d_a
        d_h = d * z + d_a @ u.T
    assert d_h.shape[1] == h_


def train(words: list[bytes], labels: np.ndarray, languages: list[str], seed: int = 7) -> Model:
    """Fits the network: at every position of a word its document's language."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    normal = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    w = {"xf": normal(256, 3 * HIDDEN), "xb": normal(256, 3 * HIDDEN), "uf": normal(HIDDEN, 3 * HIDDEN),
         "ub": normal(HIDDEN, 3 * HIDDEN), "out": normal(2 * HIDDEN, k), "bias": np.zeros(k, np.float32)}
    m, v = ({n: np.zeros_like(x) for n, x in w.items()} for _ in range(2))
    data = np.frombuffer(b"".join(words), np.uint8)
    length = np.array([len(x) for x in words])
    starts = np.cumsum(length) - length
    step, steps = 0, EPOCHS * -(-len(words) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(words))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            x, n, y = byte_matrix(data, starts[pick], length[pick]), length[pick], labels[pick]
            states, turned, place, kept_f, kept_b = _both(x, n, w, keep=True)
            inside = (np.arange(x.shape[1]) < n[:, None]).astype(np.float32)
            d = np.exp(_log_softmax(states @ w["out"] + w["bias"]))
            d[np.arange(len(y)), :, y] -= 1
            d *= (inside / inside.sum())[:, :, None]
            grad = {name: np.zeros_like(p) for name, p in w.items()}
            grad["out"] = np.einsum("ijh,ijk->hk", states, d)
            grad["bias"] = d.sum((0, 1))
            d_states = d @ w["out"].T
            _back(x, w, "f", kept_f, d_states[:, :, :HIDDEN], grad)
            d_back = np.where(inside[:, :, None] > 0, d_states[:, :, HIDDEN:], 0)
            d_back = np.where((np.arange(x.shape[1]) < n[:, None])[:, :, None], np.take_along_axis(d_back, place[:, :, None], 1), 0)
            _back(turned, w, "b", kept_b, d_back, grad)
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for name, p in w.items():
                g = grad[name]
                m[name] += 0.1 * (g - m[name])
                v[name] += 0.01 * (g * g - v[name])
                p -= rate * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(v[name] / (1 - 0.99 ** step)) + 1e-8)
    return Model(languages, w)


def position_scores(model: Model, words: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For every word, summed over its positions: log probabilities, then probabilities."""
    k = len(model.languages)
    out = np.zeros((len(words), 2 * k))
    order = np.argsort(length, kind="stable")
    for at in range(0, len(order), 4096):
        pick = order[at:at + 4096]
        x = words[pick][:, :length[pick].max()]
        states, *_ = _both(x, length[pick], model.weights)
        logs = _log_softmax(states @ model.weights["out"] + model.weights["bias"])
        inside = (np.arange(x.shape[1]) < length[pick][:, None])[:, :, None]
        out[pick, :k] = np.where(inside, logs, 0).sum(1)
        out[pick, k:] = np.where(inside, np.exp(logs), 0).sum(1)
    return out


def pooled(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean log probabilities, mean probabilities) of the positions of every text."""
    k, n = len(model.languages), len(offsets) - 1
    starts, length, owner = segments(data, offsets)
    if not len(starts):
        return np.zeros((n, k)), np.zeros((n, k))
    hashes = span_hashes(LOWER[data], starts, starts + length)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    scores = position_scores(model, byte_matrix(data, starts[first], length[first]), length[first])
    total = np.zeros((n, 2 * k))
    for j in range(2 * k):
        total[:, j] = np.bincount(owner, scores[which, j], n)
    total /= np.maximum(np.bincount(owner, length, n), 1)[:, None]
    return total[:, :k], total[:, k:]


def training_words(docs: DataFrame, usable: Column, max_docs: int = TRAIN_DOCS) -> DataFrame:
    """(lang, word) of the bounded training sample; ``docs`` has doc_id, text, lang."""
    order = F.xxhash64("doc_id", F.lit("sample"))
    usable = usable & F.col("lang").isNotNull() & F.col("text").isNotNull()
    chosen = docs.filter(usable).select(order.alias("o")).orderBy("o").limit(max_docs)
    last = chosen.agg(F.max("o")).first()[0]

    def sample(batches):
        for batch in batches:
            langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            keys = batch.column(batch.schema.get_field_index("o")).to_pylist()
            words, names = [], []
            for at, end, data, offsets in text_steps(batch):
                starts, length, owner = segments(data, offsets)
                bounds = np.searchsorted(owner, np.arange(end - at + 1))
                for i in range(end - at):
                    own = np.arange(bounds[i], bounds[i + 1])
                    if len(own) > TRAIN_WORDS:
                        own = np.random.default_rng(keys[at + i] & (2**63 - 1)).choice(own, TRAIN_WORDS, replace=False)
                    words += [LOWER[data[starts[j]:starts[j] + length[j]]].tobytes() for j in own]
                    names += [langs[at + i]] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.binary())], ["lang", "word"])

    chosen = docs.filter(usable & (order <= F.lit(last))).select("text", "lang", order.alias("o"))
    return chosen.mapInArrow(tidy(sample), "lang string, word binary")


def fit(docs: DataFrame, usable: Column) -> Model | None:
    """The model learned from ``docs`` (doc_id, text, lang) where ``usable`` holds, or None."""
    rows = training_words(docs, usable).orderBy("lang", "word").collect()  # at most TRAIN_DOCS x TRAIN_WORDS words
    languages = sorted({r.lang for r in rows})
    if not languages:
        return None
    index = {name: i for i, name in enumerate(languages)}
    return train([bytes(r.word) for r in rows], np.array([index[r.lang] for r in rows]), languages)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 3,
             test_fold: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; learns from the rows that aren't held out."""
    held_out = F.coalesce(crc_bucket("doc_id", folds) == test_fold, F.lit(False))
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = fit(named, F.col("doc_id").isNotNull() & ~held_out)

    def predict(batches):
        for batch in batches:
            letter = batch.column(batch.schema.get_field_index("letter")).to_pylist()
            names, scores = [], []
            for at, end, data, offsets in text_steps(batch):
                if model is None:
                    names += [UNKNOWN] * (end - at)
                    scores += [0.0] * (end - at)
                    continue
                logs, probs = pooled(model, data, offsets)
                best = logs.argmax(1)
                for i, b in enumerate(best):
                    names.append(model.languages[b] if letter[at + i] else UNKNOWN)
                    scores.append(min(1.0, float(probs[i, b])) if letter[at + i] else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    kind = named.schema["doc_id"].dataType.simpleString()
    out = named.select("doc_id", letter.alias("letter"), "text").mapInArrow(
        tidy(predict), f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", folds: int = 3,
                    test_fold: int = 1, least: float = 0.4) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a letter and a language of score ``least`` or more."""
    held_out = F.coalesce(crc_bucket(doc_id, folds) == test_fold, F.lit(False))
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"),
                        held_out.alias("held_out"))
    model = fit(named, F.col("doc_id").isNotNull() & ~F.col("held_out"))
    flag, n = "__letter", len(docs.columns)
    while flag in docs.columns:
        flag += "_"
    names, place = docs.columns, docs.columns.index(text)

    def work(batches):
        for batch in batches:
            letter = np.array(batch.column(n).to_pylist(), bool)
            alone = pa.RecordBatch.from_arrays([batch.column(place)], ["text"])
            keep = np.zeros(batch.num_rows, bool)
            for at, end, data, offsets in text_steps(alone):
                if model is not None:
                    logs, probs = pooled(model, data, offsets)
                    keep[at:end] = probs[np.arange(end - at), logs.argmax(1)] >= least
            part = batch.filter(pa.array(keep & letter))
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n)], names=names)

    return docs.withColumn(flag, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).mapInArrow(tidy(work), docs.schema)
