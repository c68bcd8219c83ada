"""Exact stratified split / subsample / folds: sizes, partition, stability."""

import math

import numpy as np
from pyspark.sql import functions as F

from toxiscope.operators import sampling as sm


def _labels(spark, n0, n1, parts=7):
    rows = [(i, 0) for i in range(n0)] + [(10_000 + i, 1) for i in range(n1)]
    return spark.createDataFrame(rows, "doc_id long, toxic int").repartition(parts)


def _expected_train(counts, draws):
    cont = np.array(counts) / sum(counts) * draws
    fl = np.floor(cont)
    need = int(draws - fl.sum())
    order = sorted(range(len(counts)), key=lambda k: (-(cont[k] - fl[k]), k))
    for k in order[:need]:
        fl[k] += 1
    return fl.astype(int)


def test_split_sizes_and_partition(spark):
    for n0, n1 in [(55, 7), (226, 36), (3, 2), (10, 0), (1, 1)]:
        df = _labels(spark, n0, n1)
        out = sm.stratified_split(df).collect()
        assert len(out) == n0 + n1
        assert len({r.doc_id for r in out}) == n0 + n1
        n = n0 + n1
        n_test = math.ceil(0.2 * n)
        train = _expected_train([c for c in (n0, n1) if c] , n - n_test)
        got = {}
        for r in out:
            got[(r.toxic, r.split)] = got.get((r.toxic, r.split), 0) + 1
        classes = [c for c, k in ((0, n0), (1, n1)) if k]
        for c, t in zip(classes, train):
            assert got.get((c, "train"), 0) == t


def test_split_stable_under_repartition(spark):
    a = {r.doc_id: r.split for r in sm.stratified_split(_labels(spark, 300, 40, 3)).collect()}
    b = {r.doc_id: r.split for r in sm.stratified_split(_labels(spark, 300, 40, 11)).collect()}
    assert a == b


def test_split_is_first_rows_in_hash_order(spark):
    df = _labels(spark, 120, 30)
    out = sm.stratified_split(df).withColumn("h", sm.hash_order(F.col("doc_id"))).collect()
    for c in (0, 1):
        rows = sorted([r for r in out if r.toxic == c], key=lambda r: (r.h, r.doc_id))
        k = sum(1 for r in rows if r.split == "test")
        assert all(r.split == "test" for r in rows[:k]) and all(r.split == "train" for r in rows[k:])


def test_boundary_ranking_with_one_bucket(spark):
    df = _labels(spark, 500, 80)
    a = {r.doc_id for r in sm.stratified_split(df).filter("split = 'test'").collect()}
    cuts = sm.split_quotas(df, "toxic").select("toxic", F.array("n_test").alias("cuts"))
    b = {r.doc_id for r in sm.assign_segments(df, ["toxic"], "doc_id", cuts, digits=1)
         .filter("segment = 0").collect()}
    assert a == b


def test_subsample_and_sample(spark):
    df = _labels(spark, 180, 29)
    sub = sm.stratified_subsample(df, 100).collect()
    assert len(sub) == 100
    exp = _expected_train([180, 29], 100)
    assert sum(1 for r in sub if r.toxic == 1) == exp[1]
    assert len(sm.stratified_subsample(df, 1000).collect()) == 209
    assert len(sm.sample_rows(df, 50, "doc_id").collect()) == 50
    assert len(sm.sample_rows(df, 5000, "doc_id").collect()) == 209


def test_folds_sizes(spark):
    df = _labels(spark, 31, 8)
    got = sm.stratified_folds(df, 3).groupBy("toxic", "fold").count().collect()
    sizes = {(r.toxic, r.fold): r["count"] for r in got}
    y = np.sort(np.array([0] * 31 + [1] * 8))
    for i in range(3):
        b = np.bincount(y[i::3], minlength=2)
        assert sizes.get((0, i), 0) == b[0] and sizes.get((1, i), 0) == b[1]


def test_heavy_label_is_not_ranked_in_one_task(spark):
    """One label holds ~99.9% of the rows: sizes stay exact, and the only
    rank window over data rows is partitioned by (label, hash bucket)."""
    df = _labels(spark, 6000, 5, parts=8)
    out = sm.stratified_split(df)
    got = {(r.toxic, r.split): r["count"] for r in out.groupBy("toxic", "split").count().collect()}
    train = _expected_train([6000, 5], 6005 - math.ceil(0.2 * 6005))
    assert got[(0, "train")] == train[0] and got[(1, "train")] == train[1]
    assert sum(got.values()) == 6005
    plan = out._jdf.queryExecution().executedPlan().toString()
    # Rank windows over data rows order by the hash key ``_h``; the other
    # row_number (quota allocation) runs over one row per class.
    spec = [line.split("windowspecdefinition(")[1] for line in plan.splitlines()
            if "row_number()" in line and "Window [" in line]
    data_rank = [sp for sp in spec if "_h#" in sp]
    assert data_rank and all(sp.split(",")[1].strip().startswith("_b#") for sp in data_rank)
