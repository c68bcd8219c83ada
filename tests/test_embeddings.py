"""Principal axes against numpy, their sign rule, and odd inputs."""

import numpy as np
from pyspark.sql import functions as F

from toxiscope.operators import embeddings as em


def table(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, i % 4) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").repartition(parts)


def test_scores_are_the_eigenvectors_projections(spark):
    rng = np.random.default_rng(0)
    x = (rng.standard_normal((120, 7)) @ rng.standard_normal((7, 7))).astype(np.float32)
    z = (x - x.mean(0, dtype=float)) / x.std(0, dtype=float)
    values, axes = np.linalg.eigh(z.T @ z)
    axes = axes[:, ::-1]
    axes *= np.sign(axes[np.abs(axes).argmax(0), np.arange(7)])
    got = np.zeros((120, 7))
    for r in em.pca_project(table(spark, x.tolist()), "vec_id", "embedding").collect():
        got[r.vec_id, r.comp] = r.value
    assert np.abs(got - z @ axes).max() < 1e-5
    assert np.abs((got ** 2).sum(0) - values[::-1]).max() < 1e-3
    assert np.abs((got ** 2).sum(1) - (z ** 2).sum(1)).max() < 1e-4


def test_map_keeps_tags_and_one_row_per_vector(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((30, 5)).tolist()
    rows = em.embedding_map_2d(table(spark, x, 7), "vec_id", "embedding", ["label"]).collect()
    assert sorted(r.vec_id for r in rows) == list(range(30)) and all(r.label == r.vec_id % 4 for r in rows)
    one = em.embedding_map_2d(table(spark, [[1.0], [2.0], [4.0]]), "vec_id", "embedding", ["label"]).collect()
    assert all(r.y is None and r.x is not None for r in one)


def test_odd_inputs(spark):
    x = [[1.0, 2.0], [3.0, float("nan")], [float("inf"), 0.0], None, [2.0, 2.0]]
    rows = em.pca_project(table(spark, x), "vec_id", "embedding").collect()
    assert {r.vec_id for r in rows} == {0, 1, 2, 4} and all(np.isfinite(r.value) for r in rows)
    none = table(spark, []).filter(F.lit(False))
    assert em.pca_project(none, "vec_id", "embedding").collect() == []
