"""The linear solver against its optimality conditions and a dense numpy solution."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark import RDD

from toxiscope.operators import linear as li

WIDTH = 12


def corpus(n, seed, empty=True):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        idx = sorted(rng.choice(WIDTH, rng.integers(0 if empty else 1, 5), replace=False).tolist())
        val = rng.random(len(idx)).tolist()
        rows.append((int(rng.random() < 0.3 + 0.4 * (0 in idx)), i % 3, idx, val))
    return rows


def dense(rows):
    x = np.zeros((len(rows), WIDTH + 1))
    x[:, -1] = 1
    for i, (_, _, idx, val) in enumerate(rows):
        x[i, idx] = val
    return x, np.array([1.0 if r[0] else -1.0 for r in rows]), np.array([r[1] for r in rows])


def training(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "label int, fold int, idx array<int>, val array<double>").repartition(parts)
    return li.Training(li.pack_blocks(df, fold="fold"), WIDTH)


def gradient(model, w, x, y, fold):
    z = y * (x @ w)
    slope = -1 / (1 + np.exp(z)) if model.loss == li.LOGISTIC else -2 * np.maximum(0, 1 - z)
    return w + x.T @ (model.costs(y, fold) * y * slope)


MODELS = [li.LinearModel(), li.LinearModel(c=30.0), li.LinearModel(pos_weight=7.5), li.LinearModel(skip_fold=1),
          li.LinearModel(li.SQUARED_HINGE), li.LinearModel(li.SQUARED_HINGE, c=50.0), li.LinearModel(li.SQUARED_HINGE, skip_fold=2)]


@pytest.mark.parametrize("direct,block", [(32, 4 << 20), (0, 60)])
def test_optimality_of_models_fitted_together(spark, monkeypatch, direct, block):
    """With sums straight to the driver, and in a tree over tiny blocks."""
    monkeypatch.setattr(li, "DIRECT", direct)
    monkeypatch.setattr(li, "BLOCK_BYTES", block)
    monkeypatch.setattr(li, "PARTITION_BYTES", block * 10)
    rows = corpus(200, 1)
    data = training(spark, rows)
    found = li.fit(data, MODELS, tol=1e-12)
    x, y, fold = dense(rows)
    for model, w, norm in zip(MODELS, found.weights, found.gradient):
        g = np.linalg.norm(gradient(model, w, x, y, fold))
        assert g < 1e-8 and abs(g - norm) < 1e-8
    data.unpersist()


def test_start_changes_the_way_not_the_end(spark):
    rows = corpus(150, 2)
    data = training(spark, rows)
    cold = li.fit(data, [li.LinearModel(c=5.0)], tol=1e-12)
    near = li.fit(data, [li.LinearModel(c=4.5)], tol=1e-12)
    warm = li.fit(data, [li.LinearModel(c=5.0)], near.weights, tol=1e-12)
    far = li.fit(data, [li.LinearModel(c=5.0), li.LinearModel(li.SQUARED_HINGE)], np.full((2, WIDTH + 1), 40.0), tol=1e-12)
    assert np.abs(cold.weights - warm.weights).max() < 1e-9 and np.abs(cold.weights - far.weights[:1]).max() < 1e-9
    assert warm.passes <= cold.passes + 1


def test_platt_parameters(spark):
    rows = corpus(240, 3)
    data = training(spark, rows)
    folds = li.fit(data, [li.LinearModel(li.SQUARED_HINGE, skip_fold=i) for i in range(3)])
    ab = li.platt(data, folds.weights, [0, 1, 2])
    x, y, fold = dense(rows)
    for i in range(3):
        m, pos = (x @ folds.weights[i])[fold == i], y[fold == i] > 0
        t = np.where(pos, (pos.sum() + 1) / (pos.sum() + 2), 1 / ((~pos).sum() + 2))
        e = 1 / (1 + np.exp(-(ab[i, 0] * m + ab[i, 1]))) - t
        assert abs(e.sum()) < 1e-8 and abs((e * m).sum()) < 1e-8


@pytest.mark.parametrize("rows", [[], [(1, 0, [], [])], [(1, 0, [3], [1.0])] * 4])
def test_few_rows_and_one_class(spark, rows):
    data = training(spark, rows, 2)
    found = li.fit(data, [li.LinearModel(), li.LinearModel(li.SQUARED_HINGE)])
    x, y, fold = dense(rows)
    for model, w in zip([li.LinearModel(), li.LinearModel(li.SQUARED_HINGE)], found.weights):
        assert np.isfinite(w).all() and np.linalg.norm(gradient(model, w, x, y, fold)) < 1e-6
    assert np.isfinite(li.platt(data, found.weights[:1], [0])).all()


def test_margins_of_documents_without_terms(spark):
    coefs = li.coefficient_rows(spark, np.array([[1.0, 2.0, 0.5], [-1.0, 0.0, 3.0]]))
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    weights = spark.createDataFrame([(1, 0, 0.5), (1, 1, 2.0)], "doc_id long, idx int, weight double")
    got = {r.doc_id: r.margins for r in li.margins(weights, coefs, [0.5, 3.0], docs).collect()}
    assert got == {1: [5.0, 2.5], 2: [0.5, 3.0]}


def test_driver_gets_one_total_a_pass(spark, monkeypatch):
    """However many partitions a pass has; products in single precision."""
    monkeypatch.setattr(li, "DIRECT_BYTES", 0, raising=False)
    monkeypatch.setattr(li, "PARTITION_BYTES", 60)
    rows = corpus(200, 4)
    data = training(spark, rows, 8)
    collect, sent = RDD.collect, []
    monkeypatch.setattr(RDD, "collect", lambda rdd: sent.append(collect(rdd)) or sent[-1])
    w = np.linspace(-1, 1, WIDTH + 1)[None]
    full = data.total(li._gradient_step, ([li.LinearModel()], w), (1, WIDTH + 2))
    half = data.total(li._product_step, ([li.LinearModel()], w, w), w.shape, np.float32)
    assert data._rdd.getNumPartitions() == 8
    assert [sum(piece.nbytes for _, piece in got) for got in sent] == [8 * (WIDTH + 2), 4 * (WIDTH + 1)]
    x, y, fold = dense(rows)
    assert np.allclose(full[0, 1:] + w[0], gradient(li.LinearModel(), w[0], x, y, fold), atol=1e-12)
    p = 1 / (1 + np.exp(-(x @ w[0])))
    assert np.allclose(half[0], x.T @ (p * (1 - p) * (x @ w[0])), rtol=1e-5, atol=1e-5)
    data.unpersist()


def test_partitions_follow_the_cores_not_the_rows(spark, monkeypatch):
    """Every partition of a pass sends a vector per model to the other executors."""
    monkeypatch.setattr(li, "PARTITION_BYTES", 12)
    rows = corpus(300, 5)
    data = training(spark, rows, 40)
    cores = spark.sparkContext.defaultParallelism
    assert data._rdd.getNumPartitions() == li.CORE_PARTITIONS * cores < 40
    monkeypatch.setattr(li, "PARTITION_MOST", 12 * sum(len(r[2]) for r in rows) // 20, raising=False)
    assert 20 <= training(spark, rows, 40)._rdd.getNumPartitions() <= 21
    kept = data._rdd.collect()
    folds = [fold for _, fold, *_ in kept]
    assert set(folds) == {0, 1, 2} and len(kept) <= 3 * li.CORE_PARTITIONS * cores and len({name for name, *_ in kept}) == len(kept)
    assert all(idx.dtype == np.uint16 for _, _, _, idx, *_ in kept)
    have = sorted((int(sign > 0), fold, tuple(idx[end - n:end].tolist()), tuple(val[end - n:end].tolist()))
                  for _, fold, sizes, idx, val, y in kept for n, end, sign in zip(sizes, np.cumsum(sizes), y))
    assert have == sorted((y, fold, tuple(idx), tuple(val)) for y, fold, idx, val in rows)
    data.unpersist()


def test_blocks_are_bounded_by_entries_and_by_rows(monkeypatch):
    monkeypatch.setattr(li, "BLOCK_ENTRIES", 50)
    pack = lambda n, k: SimpleNamespace(ptr=(np.arange(n + 1, dtype=np.int64) * k).tobytes(), idx=np.zeros(n * k, np.int32).tobytes(),
                                        val=np.ones(n * k).tobytes(), y=np.ones(n).tobytes(), fold=np.full(n, -1, np.int32).tobytes())
    full, bare = list(li.joined([pack(10, 3)] * 20, 1 << 17)), list(li.joined([pack(10, 0)] * 20, 1 << 17))
    assert [len(x[3]) for x in full] == [60] * 10 and [len(x[2]) for x in bare] == [50] * 4
    assert full[0][3].dtype == np.int32


def test_products_of_a_newton_step_find_curvatures_once(monkeypatch):
    x, y, fold = dense(corpus(60, 6, empty=False))
    packed = SimpleNamespace(ptr=(np.arange(61, dtype=np.int64) * WIDTH).tobytes(), idx=np.tile(np.arange(WIDTH, dtype=np.int32), 60).tobytes(),
                             val=x[:, :-1].tobytes(), y=y.tobytes(), fold=fold.astype(np.int32).tobytes())
    blocks = [li.opened(b) for b in li.joined([packed], WIDTH)]
    models = [li.LinearModel(), li.LinearModel(li.SQUARED_HINGE, skip_fold=1)]
    w, v = np.linspace(-1, 1, 2 * WIDTH + 2).reshape(2, -1), np.linspace(2, -1, 2 * WIDTH + 2).reshape(2, -1)
    found, curvature = [], li._curvature
    monkeypatch.setattr(li, "_curvature", lambda *a: found.append(1) or curvature(*a))

    def product(w, v, some, step):
        return sum(li._product_step(b, ([models[j] for j in some], w[some], v[some], step, some)) for b in blocks)

    def expected(w, v, some):
        out = []
        for j in some:
            z = y * (x @ w[j])
            p = 1 / (1 + np.exp(-z))
            curve = p * (1 - p) if models[j].loss == li.LOGISTIC else 2.0 * (z < 1)
            out.append(x.T @ (models[j].costs(y, fold) * curve * (x @ v[j])))
        return np.array(out)
    assert np.allclose(product(w, v, [0, 1], "a"), expected(w, v, [0, 1])) and len(found) == 3 + 2
    # the second model alone, then both at other weights
    assert np.allclose(product(w, 3 * v, [1], "a"), expected(w, 3 * v, [1])) and len(found) == 5
    assert np.allclose(product(-w, v, [0, 1], "b"), expected(-w, v, [0, 1])) and len(found) == 10


def test_newton_systems_are_solved_as_far_as_it_helps(spark, monkeypatch):
    near = np.array([1e-2, 1e-2, 1e-8, 5.0])
    found = li._forcing(near, np.array([1.0, 1.1e-2, 1e-4, 1.0]), np.ones(4), np.full(4, 1e-12))
    # by the distance; by the little that the last step did; by the goal; never loosely
    assert np.allclose(found, [0.1, 0.3 / 1.1, 1e-4, 0.3]) and li._forcing(np.array([1e-11]), np.ones(1), np.ones(1), np.array([1e-12]))[0] >= 1e-2
    rows, models = corpus(400, 7), [li.LinearModel(li.SQUARED_HINGE, c=20.0, skip_fold=i) for i in range(3)]
    data = training(spark, rows)
    few = li.fit(data, models, tol=1e-12)
    monkeypatch.setattr(li, "_forcing", lambda norm, last, first, goal: np.minimum(0.3, np.sqrt(norm / first)))
    many = li.fit(data, models, tol=1e-12)
    x, y, fold = dense(rows)
    for model, w, norm in zip(models, few.weights, few.gradient):
        at_zero = np.linalg.norm(gradient(model, 0 * w, x, y, fold))
        assert norm <= 1e-12 * at_zero and np.linalg.norm(gradient(model, w, x, y, fold)) < 2e-12 * at_zero
    assert few.passes < many.passes and np.abs(few.weights - many.weights).max() < 1e-10
    data.unpersist()
