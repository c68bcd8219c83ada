"""L2-regularised linear models fitted on Spark: logistic and squared-hinge loss.

    f(w) = 0.5 |w|^2 + C sum_i v_i loss(s_i w.x_i),   s_i = +1 / -1

The intercept is the weight of a constant feature and penalised like the
others; v_i is ``pos_weight`` for positive rows, else 1.  The minimum is found
by Newton steps whose linear systems are solved by conjugate gradients.
Every gradient and every Hessian product is one job over the training blocks:
a task sums over its partition, the partial sums are added up slice by slice
on the executors, and only their total, a vector as wide as the vocabulary,
reaches the driver, however many partitions there are.  Several models
(folds, costs, weights) share each job.

Training rows are packed into blocks of compressed sparse rows, a few
megabytes each, written once; the numpy code per block is a handful of
vector operations.  The executors keep them joined into blocks of one fold
each, so that a model passes over those of its skipped fold, and the workers
keep the curvatures of a Newton step's rows from one product to the next.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of indices and weights in a block.
BLOCK_BYTES = 4 << 20
#: Entries and rows of the blocks that the executors keep (temporary vectors of one are some 4 MB each).
BLOCK_ENTRIES = 1 << 19
#: Bytes of indices and weights in a partition: at least, and at most where there are ``CORE_PARTITIONS`` per core.
PARTITION_BYTES = 2 << 20
PARTITION_MOST = 64 << 20
CORE_PARTITIONS = 2
#: Partial sums, and bytes of them together, that are added up on the driver itself.
DIRECT = 32
DIRECT_BYTES = 64 << 10
#: Bytes of a total that one task adds up.
SLICE_BYTES = 128 << 10
TOL = 1e-10
MAX_STEPS, MAX_CG = 100, 200
LOGISTIC, SQUARED_HINGE = "logistic", "squared_hinge"

BLOCKS = "n int, ptr binary, idx binary, val binary, y binary, fold binary"


@dataclass(frozen=True)
class LinearModel:
    """One minimisation problem over the shared training rows."""
    loss: str = LOGISTIC
    c: float = 1.0
    pos_weight: float = 1.0
    skip_fold: int | None = None

    def costs(self, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        cost = np.where(y > 0, self.c * self.pos_weight, self.c)
        return cost if self.skip_fold is None else np.where(fold == self.skip_fold, 0.0, cost)


@dataclass
class Fit:
    weights: np.ndarray     # models x (features + 1), the intercept last
    gradient: np.ndarray    # norm of each model's gradient at its weights
    passes: int
    seconds: float


def sparse_rows(weights: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs + (idx ARRAY<INT>, val ARRAY<DOUBLE>) in index order; a document without terms has empty arrays."""
    per = weights.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("idx", "weight"))).alias("_p"))
    rows = docs.join(per, id_col, "left")
    return rows.select(*docs.columns, F.coalesce(F.col("_p.idx"), F.array().cast("array<int>")).alias("idx"),
                       F.coalesce(F.col("_p.weight"), F.array().cast("array<double>")).alias("val"))


def pack_blocks(rows: DataFrame, label: str = "label", fold: str | None = None) -> DataFrame:
    """Blocks of compressed sparse rows of (label 0/1, fold, idx, val)."""
    picked = rows.select(F.col(label).cast("int").alias("y"),
                         (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"), "idx", "val")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, val = batch.column(2), batch.column(3)
            ptr = np.asarray(idx.offsets).astype(np.int64)
            at, n = 0, batch.num_rows
            y, folds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            while at < n:
                end = max(at + 1, int(np.searchsorted(ptr, ptr[at] + BLOCK_BYTES // 12, "right")) - 1)
                end = min(end, n)
                part = slice(ptr[at], ptr[end])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([end - at], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (
                        ptr[at:end + 1] - ptr[at], np.asarray(idx.values)[part].astype(np.int32),
                        np.asarray(val.values)[part].astype(np.float64),
                        np.where(y[at:end] == 1, 1.0, -1.0), folds[at:end].astype(np.int32)))],
                    [c.split()[0] for c in BLOCKS.split(", ")])
                at = end
    return picked.mapInArrow(pack, BLOCKS)


class Block(NamedTuple):
    """Rows of one fold, opened for work."""
    name: str               # of these rows in this order: a block that is made again gets another one
    fold: int
    sizes: np.ndarray       # entries per row
    some: np.ndarray        # rows with entries
    places: np.ndarray      # of their first entries
    idx: np.ndarray
    val: np.ndarray
    y: np.ndarray


def joined(rows: Iterable, width: int) -> Iterator[tuple]:
    """Packed rows as (name, fold, sizes, idx, val, y) of one fold and ``BLOCK_ENTRIES`` entries and rows each, if there are as many."""
    kind = np.uint16 if width <= 1 << 16 else np.int32
    waiting: dict[int, list] = {}
    held: dict[int, int] = {}

    def block(fold: int) -> tuple:
        held[fold] = 0
        return (uuid.uuid4().hex, fold, *(np.concatenate(x) for x in zip(*waiting.pop(fold))))
    for row in rows:
        sizes, folds = np.diff(np.frombuffer(row.ptr, np.int64)).astype(np.int32), np.frombuffer(row.fold, np.int32)
        idx, val, y = np.frombuffer(row.idx, np.int32).astype(kind), np.frombuffer(row.val), np.frombuffer(row.y)
        for fold in np.unique(folds).tolist():
            at = folds == fold
            entries = np.repeat(at, sizes)
            waiting.setdefault(fold, []).append((sizes[at], idx[entries], val[entries], y[at]))
            held[fold] = held.get(fold, 0) + int(entries.sum()) + int(at.sum())
            if held[fold] >= BLOCK_ENTRIES:
                yield block(fold)
    for fold in list(waiting):
        yield block(fold)


def opened(kept: tuple) -> Block:
    name, fold, sizes, idx, val, y = kept
    some = sizes > 0
    return Block(name, fold, sizes, some, (np.cumsum(sizes, dtype=np.int64) - sizes)[some], idx.astype(np.intp), val, y)


def _dot(block: Block, w: np.ndarray) -> np.ndarray:
    out = np.full(len(block.sizes), w[-1])
    if len(block.places):
        terms = w.take(block.idx)
        terms *= block.val
        out[block.some] += np.add.reduceat(terms, block.places)
    return out


def _back(block: Block, factor: np.ndarray, out: np.ndarray) -> None:
    """Writes X^T factor into ``out``, the intercept's entry last."""
    terms = np.repeat(factor, block.sizes)
    terms *= block.val
    out[:-1] = np.bincount(block.idx, terms, len(out) - 1)
    out[-1] = factor.sum()


def _loss(kind: str, z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, -z) if kind == LOGISTIC else np.maximum(0.0, 1.0 - z) ** 2


def _slope(kind: str, z: np.ndarray) -> np.ndarray:
    return -1.0 / (1.0 + np.exp(z)) if kind == LOGISTIC else -2.0 * np.maximum(0.0, 1.0 - z)


def _curvature(kind: str, z: np.ndarray) -> np.ndarray:
    if kind == LOGISTIC:
        p = 1.0 / (1.0 + np.exp(-z))
        return p * (1.0 - p)
    return 2.0 * (z < 1.0)


def _gradient_step(block: Block, state) -> np.ndarray:
    models, w = state
    out = np.zeros((len(models), w.shape[1] + 1))
    for j, model in enumerate(models):
        if model.skip_fold != block.fold:
            cost, z = model.costs(block.y, block.fold), block.y * _dot(block, w[j])
            out[j, 0] = (cost * _loss(model.loss, z)).sum()
            _back(block, cost * block.y * _slope(model.loss, z), out[j, 1:])
    return out


#: Curvatures by (block, model) that a worker has found at the weights of the Newton step under "step".
_CURVES: dict = {}


def _curve(block: Block, model: LinearModel, w: np.ndarray, step: str, number: int) -> np.ndarray:
    """Cost times curvature of the block's rows at ``w``, the weights of model ``number`` in that Newton step."""
    if _CURVES.get("step") != step:
        _CURVES.clear()
        _CURVES["step"] = step
    key = (block.name, number)
    if key not in _CURVES:
        _CURVES[key] = model.costs(block.y, block.fold) * _curvature(model.loss, block.y * _dot(block, w))
    return _CURVES[key]


def _product_step(block: Block, state) -> np.ndarray:
    """Hessian products; ``state`` may name the Newton step and its models, whose curvatures the worker then keeps."""
    models, w, v, *named = state
    step, numbers = named or (uuid.uuid4().hex, range(len(models)))
    out = np.zeros(w.shape)
    for j, model in enumerate(models):
        if model.skip_fold != block.fold:
            _back(block, _curve(block, model, w[j], step, numbers[j]) * _dot(block, v[j]), out[j])
    return out


def _search_step(block: Block, state) -> np.ndarray:
    models, w, d, steps = state
    out = np.zeros((len(models), len(steps)))
    for j, model in enumerate(models):
        if model.skip_fold != block.fold:
            cost, at, by = model.costs(block.y, block.fold), _dot(block, w[j]), _dot(block, d[j])
            out[j] = [(cost * _loss(model.loss, block.y * (at + t * by))).sum() for t in steps]
    return out


class Training:
    """The training blocks, kept by the executors, and sums over them."""

    def __init__(self, blocks: DataFrame, width: int):
        self.width, self.passes = width, 0
        self._context = blocks.sparkSession.sparkContext
        size = blocks.agg(F.sum(F.length("idx") + F.length("val"))).first()[0] or 0
        # a partition sends a vector per model back in every pass, so it should hold more than that, and they should be few
        most = max(CORE_PARTITIONS * self._context.defaultParallelism, size // PARTITION_MOST + 1)
        rows = blocks.rdd.coalesce(int(min(size // PARTITION_BYTES + 1, most)))
        self._rdd = rows.mapPartitions(lambda packed: joined(packed, width)).persist(StorageLevel.MEMORY_AND_DISK)

    def unpersist(self) -> None:
        self._rdd.unpersist()

    def total(self, step: Callable, state: tuple, shape: tuple, kind=np.float64) -> np.ndarray:
        """Sum of ``step(block, state)`` over all blocks: within tasks, then slice by slice between them; ``kind`` is what
        the driver is sent (sums are always of doubles)."""
        self.passes += 1
        sent = self._context.broadcast(state)
        size = int(np.prod(shape))

        def partial(blocks):
            out = None
            for block in blocks:
                one = step(opened(block), sent.value)
                out = one if out is None else np.add(out, one, out)
            return [] if out is None else [out]
        parts = self._rdd.mapPartitions(partial)
        n = parts.getNumPartitions()
        try:
            if n <= DIRECT and n * size * 8 <= DIRECT_BYTES:
                return sum(parts.collect(), np.zeros(shape))
            slices = max(1, min(n, -(-size * 8 // SLICE_BYTES)))
            ends = [size * i // slices for i in range(slices + 1)]
            cut = parts.flatMap(lambda one: [(i, one.reshape(-1)[ends[i]:ends[i + 1]]) for i in range(slices)])
            found = cut.reduceByKey(np.add, slices).mapValues(lambda piece: piece.astype(kind))
            out = np.zeros(size)
            for i, piece in found.collect():
                out[ends[i]:ends[i + 1]] = piece
            found._jrdd.rdd().cleanShuffleDependencies(False)   # else a pass's partial sums stay on disk until the driver collects its garbage
            return out.reshape(shape)
        finally:
            sent.destroy()


def _value_gradient(training: Training, models: list[LinearModel], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = training.total(_gradient_step, (models, w), (len(models), w.shape[1] + 1))
    return sums[:, 0] + 0.5 * (w * w).sum(1), sums[:, 1:] + w


def _newton_direction(training: Training, models: list[LinearModel], w: np.ndarray, g: np.ndarray,
                      forcing: np.ndarray) -> np.ndarray:
    """Conjugate gradients on H d = -g, all models together, each to its relative residual.

    Products come in single precision: they choose the direction, and where it ends is for the gradients to say.
    """
    d, r = np.zeros_like(g), -g
    p, rr = r.copy(), (r * r).sum(1)
    goal, step = forcing ** 2 * rr, uuid.uuid4().hex
    for _ in range(MAX_CG):
        on = np.flatnonzero(rr > goal)
        if not len(on):
            break
        hp = p[on] + training.total(_product_step, ([models[j] for j in on], w[on], p[on], step, on.tolist()), (len(on), w.shape[1]), np.float32)
        by = rr[on] / (p[on] * hp).sum(1)
        d[on] += by[:, None] * p[on]
        r[on] -= by[:, None] * hp
        new = (r[on] * r[on]).sum(1)
        p[on] = r[on] + (new / rr[on])[:, None] * p[on]
        rr[on] = new
    return d


def _forcing(norm: np.ndarray, last: np.ndarray, first: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Relative residual to solve each model's Newton system to: the smaller the nearer the minimum, but no smaller than the step
    before did good (norms now, before it and at zero), nor than a tenth of what the gradient needs to reach ``goal``."""
    wanted = np.maximum(np.sqrt(norm / np.maximum(first, 1e-300)), 0.3 * norm / np.maximum(last, 1e-300))
    return np.maximum(np.minimum(0.3, wanted), 0.1 * goal / np.maximum(norm, 1e-300))


def fit(training: Training, models: list[LinearModel], start: np.ndarray | None = None, tol: float = TOL) -> Fit:
    """Weights at which every model's gradient norm is at most ``tol`` times its norm at zero (or can't be lowered)."""
    began, before = time.perf_counter(), training.passes
    k, n = len(models), training.width + 1
    value, g = _value_gradient(training, models, np.zeros((k, n)))
    goal = tol * np.maximum(np.sqrt((g * g).sum(1)), 1.0)
    first = np.sqrt((g * g).sum(1))
    w = np.zeros((k, n)) if start is None else start.copy()
    if start is not None:
        value, g = _value_gradient(training, models, w)
    stuck = np.zeros(k, bool)
    norm = np.sqrt((g * g).sum(1))
    for _ in range(MAX_STEPS):
        last, norm = norm, np.sqrt((g * g).sum(1))
        on = np.flatnonzero((norm > goal) & ~stuck)
        if not len(on):
            break
        some = [models[j] for j in on]
        d = _newton_direction(training, some, w[on], g[on], _forcing(norm[on], last[on], first[on], goal[on]))
        slope = (g[on] * d).sum(1)
        value1, g1 = _value_gradient(training, some, w[on] + d)
        # a full step, unless it fails to lower the value by more than rounding explains
        bad = np.flatnonzero(value1 > value[on] + 1e-4 * slope + 1e-12 * np.abs(value[on]))
        if len(bad):
            steps = 0.5 ** np.arange(1, 31)
            losses = training.total(_search_step, ([some[j] for j in bad], w[on][bad], d[bad], steps), (len(bad), len(steps)))
            for i, j in enumerate(bad):
                here = w[on][j]
                values = losses[i] + [0.5 * ((here + t * d[j]) ** 2).sum() for t in steps]
                good = np.flatnonzero(values <= value[on][j] + 1e-4 * steps * slope[j] + 1e-12 * np.abs(value[on][j]))
                d[j] *= steps[good[0]] if len(good) else 0.0
                stuck[on[j]] = not len(good)
            value1, g1 = _value_gradient(training, some, w[on] + d)
        w[on], value[on], g[on] = w[on] + d, value1, g1
    return Fit(w, np.sqrt((g * g).sum(1)), training.passes - before, time.perf_counter() - began)


# ---------------------------------------------------------------------------
# Sigmoid calibration
# ---------------------------------------------------------------------------

def _platt_step(block: Block, state) -> np.ndarray:
    w, folds, targets, ab = state
    out = np.zeros((len(folds), 6))
    for j, held in enumerate(folds):
        if block.fold != held:
            continue
        m, t = _dot(block, w[j]), np.where(block.y > 0, targets[j][0], targets[j][1])
        z = ab[j, 0] * m + ab[j, 1]
        p = 1.0 / (1.0 + np.exp(-z))
        e, h = p - t, p * (1.0 - p)
        out[j] = ((np.logaddexp(0.0, z) - t * z).sum(), (e * m).sum(), e.sum(), (h * m * m).sum(), (h * m).sum(), h.sum())
    return out


def _count_step(block: Block, state) -> np.ndarray:
    return np.array([[(block.y > 0).sum(), (block.y < 0).sum()] if block.fold == f else [0, 0] for f in state[0]], float)


def platt(training: Training, weights: np.ndarray, folds: list[int], tol: float = 1e-12) -> np.ndarray:
    """(a, b) per fold of p = 1 / (1 + exp(-(a m + b))), m the margins of ``weights[j]`` on the rows of ``folds[j]``.

    Platt's targets (N+ + 1)/(N+ + 2) and 1/(N- + 2); two-parameter Newton
    steps on sums over the rows, all folds in one job.
    """
    counts = training.total(_count_step, (folds,), (len(folds), 2))
    targets = [((p + 1.0) / (p + 2.0), 1.0 / (q + 2.0)) for p, q in counts]
    ab = np.stack([np.array([0.0, np.log((p + 1.0) / (q + 1.0))]) for p, q in counts])

    def sums(at):
        return training.total(_platt_step, (weights, folds, targets, at), (len(folds), 6))
    now = sums(ab)
    for _ in range(60):
        size = np.abs(now[:, 1:3]).max(1)
        on = size > tol * np.maximum(counts.sum(1), 1.0)
        if not on.any():
            break
        _, gm, g1, hmm, hm, h1 = now.T
        hmm, h1 = hmm + 1e-12, h1 + 1e-12
        det = hmm * h1 - hm * hm
        step = np.stack([-(h1 * gm - hm * g1) / det, -(hmm * g1 - hm * gm) / det], axis=1) * on[:, None]
        scale = np.ones(len(folds))
        for _ in range(40):
            after = sums(ab + scale[:, None] * step)
            worse = on & (after[:, 0] > now[:, 0] + 1e-12 * np.abs(now[:, 0]))
            if not worse.any():
                break
            scale[worse] *= 0.5
        ab, now = ab + scale[:, None] * step, after
        if (np.abs(scale[:, None] * step).max(1) <= 1e-14 * np.maximum(1.0, np.abs(ab).max(1))).all():
            break
    return ab


# ---------------------------------------------------------------------------
# Models as tables
# ---------------------------------------------------------------------------

def coefficient_rows(spark, weights: np.ndarray) -> DataFrame:
    """(idx, coefs ARRAY<DOUBLE>): a row per feature, an entry per model (as wide as the vocabulary that was fitted)."""
    table = pa.table({"idx": pa.array(np.arange(weights.shape[1] - 1, dtype=np.int32)),
                      "coefs": pa.array(list(weights[:, :-1].T), pa.list_(pa.float64()))})
    return spark.createDataFrame(table)


def margins(weights: DataFrame, coefs: DataFrame, intercepts, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs + margins ARRAY<DOUBLE>: w.x + b of every model, from postings (id, idx, weight) joined with the coefficients."""
    k = len(intercepts)
    sums = [F.sum(F.col("weight") * F.col("coefs")[j]).alias(f"_m{j}") for j in range(k)]
    per = weights.join(coefs, "idx").groupBy(id_col).agg(*sums)
    values = [F.coalesce(f"_m{j}", F.lit(0.0)) + F.lit(float(b)) for j, b in enumerate(intercepts)]
    return docs.join(per, id_col, "left").withColumn("margins", F.array(*values)).drop(*[f"_m{j}" for j in range(k)])
