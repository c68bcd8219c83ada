"""Embedding near copies against brute force and on edge rows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from toxiscope.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<double>, label int, row long, ball long, n_links long, vec string"


def brute(vectors):
    """(links per row, linked pairs) of a list of vectors."""
    n = len(vectors)
    ok = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for v in vectors]
    pairs = set()
    for dim in {len(v) for v, good in zip(vectors, ok) if good}:
        at = [i for i in range(n) if ok[i] and len(vectors[i]) == dim]
        m = np.array([vectors[i] for i in at], float)
        m /= np.abs(m).max(1)[:, None]
        m /= np.linalg.norm(m, axis=1)[:, None]
        cos = m @ m.T
        for a, b in zip(*np.nonzero(np.triu(cos >= ed.LINK, 1))):
            pairs.add((at[a], at[b]))
    return pairs


def lowest(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i
    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def cloud(seed, dim, groups):
    """Unrelated vectors, and groups spread around a centre by the given angles."""
    rng = np.random.default_rng(seed)
    out = list(rng.standard_normal((400, dim)))
    for size, spread in groups:
        centre = rng.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            z = rng.standard_normal(dim)
            z -= (z @ centre) * centre
            angle = spread * rng.random() ** 0.3
            out.append((math.cos(angle) * centre + math.sin(angle) * z / np.linalg.norm(z)) * (0.5 + rng.random()))
    return [list(map(float, v)) for v in out]


def check(spark, vectors, recall):
    df = spark.createDataFrame([(i, v, 0, 1, 2, 3, "x") for i, v in enumerate(vectors)], SCHEMA).repartition(3)
    got = {r.vec_id: r for r in ed.near_copies(df).collect()}
    assert sorted(got) == list(range(len(vectors)))
    pairs = brute(vectors)
    degree = Counter(i for p in pairs for i in p)
    assert all(got[i].n_links <= degree[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= recall * 2 * len(pairs)
    want = lowest(len(vectors), pairs)
    assert sum(got[i].component_id == want[i] for i in got) >= recall * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    return got, degree


@pytest.mark.parametrize("dim", [3, 64, 100])
def test_links_of_groups(spark, dim):
    groups = [(300, 0.05), (40, 0.2), (40, 0.35), (30, 0.6)] + [(2, a / 40) for a in range(25)]
    check(spark, cloud(dim, dim, groups), 0.95)


def test_links_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(300):
        x, z = rng.standard_normal((2, 64))
        x /= np.linalg.norm(x)
        z -= (z @ x) * x
        vectors += [x, 0.9005 * x + math.sqrt(1 - 0.9005 ** 2) * z / np.linalg.norm(z)]
    check(spark, [list(map(float, v)) for v in vectors], 0.95)


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    check(spark, [[float(c) for c in r.embedding] for r in table.orderBy("vec_id").collect()], 0.97)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    vectors = [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [1.0, nan, 0.0, 0.0], [inf, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0],
               [2.0, 0.0, 0.0, 0.0], [1e300, 1e299, 0.0, 0.0], [1e-300, 0.0, 0.0, 0.0], [-1.0, 0.0, 0.0, 0.0], [1.0, 0.0],
               [3.0, 0.1], [5.0], [7.0], [-7.0], [0.0, 1.0, 0.0, 0.0]]
    got, degree = check(spark, vectors, 1.0)
    assert all(got[i].n_links == degree[i] for i in got) and got[0].kept and got[5].component_id == 5


def test_repeated_and_missing_ids(spark):
    rows = [(7, [1.0, 0.0], 0, 1, 2, 3, "x")] * 3 + [(None, [1.0, 0.01], 0, 1, 2, 3, "x"), (None, [0.0, 1.0], 0, 1, 2, 3, "x"), (None, None, 0, 1, 2, 3, "x")]
    got = ed.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == Counter(
        {(7, 3, 7, True): 3, (None, 3, 7, False): 1, (None, 0, None, True): 2})


def test_no_vectors(spark):
    empty = ed.near_copies(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["vec_id", "n_links", "component_id", "kept"] and not empty.collect()


def test_copies_emit_no_pairs(spark):
    """A group of copies becomes a few balls: the pairs of balls stay far below the pairs of copies."""
    from toxiscope.llm.common import Scratch, keyed
    vectors = cloud(5, 64, [(600, 0.1)])
    df = spark.createDataFrame([(i, v, 0, 1, 2, 3, "x") for i, v in enumerate(vectors)], SCHEMA)
    scratch = Scratch(spark, "test")
    rows = scratch.keep(keyed(df, "vec_id", F.col("embedding").alias("vec")), "rows")
    plans = {64: ed.plan_for(1000, 64)}
    pairs = ed._candidates(ed._balls(rows, plans, scratch), plans).count()
    assert pairs < 600 * 599 / 2 / 20
