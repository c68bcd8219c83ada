"""TF-IDF, Naive Bayes and linear baselines on the sf0.001 corpus."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from toxiscope.plans import linear_baselines as lb
from toxiscope.plans.baselines import TRAIN


def test_weights_have_unit_norm(small_chain):
    norms = small_chain.weights.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert norms and all(abs(r.n - 1) < 1e-9 for r in norms)


def test_idf_and_vocabulary_rule(small_chain):
    c = small_chain
    train = c.cleaned.filter(F.col("split") == TRAIN).select("doc_id", "clean").collect()
    df, tot = Counter(), Counter()
    for r in train:
        tok = [t for t in r.clean.split(" ") if len(t) >= 2]
        grams = tok + [f"{a} {b}" for a, b in zip(tok, tok[1:])]
        tot.update(grams)
        df.update(set(grams))
    vocab = sorted(tot, key=lambda t: (-tot[t], t))[:50_000]
    got = {r.term: r for r in c.idf.collect()}
    assert set(got) == set(vocab)
    n = len(train)
    for t in vocab[:200]:
        assert got[t].df == df[t]
        assert abs(got[t].idf - (math.log((1 + n) / (1 + df[t])) + 1)) < 1e-12


def test_nb_matches_numpy_multinomial(small_chain):
    c = small_chain
    V = c.idf.count()
    w = c.weights.select("doc_id", "idx", "weight", "split").collect()
    y = {r.doc_id: r.toxic for r in c.cleaned.select("doc_id", "toxic", "split").collect()}
    train_ids = sorted({r.doc_id for r in c.cleaned.filter(F.col("split") == TRAIN).collect()})
    fc = np.zeros((2, V))
    for r in w:
        if r.split == TRAIN:
            fc[y[r.doc_id], r.idx] += r.weight
    flp = np.log(fc + 0.1) - np.log((fc + 0.1).sum(axis=1, keepdims=True))
    ny = np.bincount([y[d] for d in train_ids], minlength=2)
    prior = np.log(ny / ny.sum())
    dots = {}
    for r in w:
        if r.split != TRAIN:
            dots.setdefault(r.doc_id, np.zeros(2))
            dots[r.doc_id] += r.weight * flp[:, r.idx]
    preds = c.nb_predictions().collect()
    assert preds
    for p in preds:
        jll = prior + dots.get(p.doc_id, np.zeros(2))
        prob = math.exp(jll[1] - np.logaddexp(jll[0], jll[1]))
        assert abs(p.y_prob - prob) < 1e-7


def test_comparison_has_all_models(small_chain):
    cmp = lb.comparison(small_chain).collect()
    assert {r.model for r in cmp} == {"TF-IDF + Naive Bayes", "TF-IDF + Logistic Regression", "TF-IDF + SVM"}
    probs = lb.svm_predictions(small_chain).select("y_prob").collect()
    assert probs and all(0.0 <= r.y_prob <= 1.0 for r in probs)


def test_fit_times_and_throughput(small_chain):
    from toxiscope.streaming.scoring import scoring_throughput
    ft = {r.model: r.train_time_s for r in lb.fit_times(small_chain).collect()}
    assert set(ft) == {"TF-IDF + Naive Bayes", "TF-IDF + Logistic Regression", "TF-IDF + SVM"} and all(v >= 0 for v in ft.values())
    val = small_chain.splits.filter(F.col("split") == "Multilingual Val")
    ms = scoring_throughput(val, "doc_id", "text", small_chain.idf, small_chain.nb_model())
    assert ms > 0
