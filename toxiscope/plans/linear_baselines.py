"""Linear baselines on the shared TF-IDF features: logistic regression (plain,
class-weighted, and along a path of costs) and the calibrated linear SVM, plus
the three-model comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toxiscope.functions.numeric import sigmoid
from toxiscope.operators import evaluation as ev
from toxiscope.operators import features as fe
from toxiscope.operators import linear as li
from toxiscope.operators import profile as pr
from toxiscope.operators.naive_bayes import SCORE_DIGITS
from toxiscope.operators.sampling import stratified_folds
from toxiscope.plans.baselines import LR_NAME, NB_NAME, SVM_NAME, TEST, TRAIN, VAL, Chain

N_FOLDS = 3
#: Gradient norm at which a fit ends, relative to the one at zero.
TOL = 1e-12
WEIGHTED_NAME = f"{LR_NAME} (class weight)"
#: Costs of the path, from strong to weak regularisation; a model starts from the one before it.
COSTS = (0.1, 1.0, 10.0)


def training(c: Chain) -> li.Training:
    """The training rows with their calibration fold, as blocks that the executors keep."""
    def blocks():
        docs = c.cleaned.filter(F.col("split") == TRAIN).select("doc_id", F.col("toxic").alias("label"))
        folds = stratified_folds(docs, N_FOLDS, label="label")
        rows = li.sparse_rows(c.weights.filter(F.col("split") == TRAIN).select("doc_id", "idx", "weight"), folds)
        return li.pack_blocks(rows, fold="fold")

    def build():
        found = li.Training(c._get("linear_blocks", blocks, keep="checkpoint"), c.n_terms())
        c._cached.append(found)
        return found
    return c._get("training", build)


def _fitted(c: Chain, key: str, models: list[li.LinearModel], start=None) -> li.Fit:
    return c._get(("fit", key), lambda: li.fit(training(c), models, start, TOL))


def _coefs(c: Chain, key: str, fit: li.Fit) -> DataFrame:
    return c._get(("coefs", key), lambda: li.coefficient_rows(c.spark, fit.weights), keep="checkpoint")


def _margins(c: Chain, key: str, fit: li.Fit) -> DataFrame:
    """(split, lang, doc_id, y_true, margins) of the held-out documents."""
    docs = c.cleaned.filter(F.col("split").isin(TEST, VAL)).select("doc_id", "split", "lang", F.col("toxic").alias("y_true"))
    weights = c.weights.filter(F.col("split").isin(TEST, VAL)).select("doc_id", "idx", "weight")
    return li.margins(weights, fe.small(_coefs(c, key, fit), fe.MAX_FEATURES), fit.weights[:, -1], docs)


def coefficient_table(c: Chain, key: str, fit: li.Fit) -> DataFrame:
    """(term, idx, coef) of the first model of a fit; the intercept has no term and the index -1."""
    terms = c.idf.select("term", "idx").join(_coefs(c, key, fit).select("idx", F.col("coefs")[0].alias("coef")), "idx")
    intercept = c.spark.range(1).select(F.lit(None).cast("string").alias("term"), F.lit(-1).alias("idx"),
                                        F.lit(float(fit.weights[0, -1])).alias("coef"))
    return terms.select("term", "idx", "coef").unionByName(intercept)


def _scored(rows: DataFrame, name, score, prob) -> DataFrame:
    rows = rows.withColumn("score", score)
    return rows.select(F.lit(name).alias("model"), "split", "lang", "doc_id", "y_true", "score", prob.alias("y_prob"))


# -- logistic regression -----------------------------------------------------

def lr_fit(c: Chain) -> li.Fit:
    return _fitted(c, "lr", [li.LinearModel()])


def lr_predictions(c: Chain) -> DataFrame:
    def build():
        rows = _margins(c, "lr", lr_fit(c))
        return _scored(rows, LR_NAME, F.round(F.col("margins")[0], SCORE_DIGITS), sigmoid(F.col("score")))
    return c._get("lr_pred", build, keep="checkpoint")


def class_weight(c: Chain) -> float:
    """(1 - p) / max(p, floor), p the toxic share of the training rows."""
    def build():
        p = c.cleaned.filter(F.col("split") == TRAIN).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
        return (1.0 - p) / max(p, pr.POS_WEIGHT_FLOOR)
    return c._get("class_weight", build)


def weighted_fit(c: Chain) -> li.Fit:
    return _fitted(c, "weighted", [li.LinearModel(pos_weight=class_weight(c))])


def weighted_predictions(c: Chain) -> DataFrame:
    def build():
        rows = _margins(c, "weighted", weighted_fit(c))
        return _scored(rows, WEIGHTED_NAME, F.round(F.col("margins")[0], SCORE_DIGITS), sigmoid(F.col("score")))
    return c._get("weighted_pred", build, keep="checkpoint")


def path_predictions(c: Chain) -> DataFrame:
    """Predictions of the logistic regressions along ``COSTS``; the model's name is its cost."""
    def build():
        start, out = None, None
        for cost in COSTS:
            fit = _fitted(c, f"cost {cost}", [li.LinearModel(c=cost)], start)
            start = fit.weights
            rows = _margins(c, f"cost {cost}", fit)
            rows = _scored(rows, cost, F.round(F.col("margins")[0], SCORE_DIGITS), sigmoid(F.col("score")))
            out = rows if out is None else out.unionByName(rows)
        return out
    return c._get("path_pred", build, keep="checkpoint")


# -- support vector machine ----------------------------------------------------

def svm_fit(c: Chain) -> li.Fit:
    """The SVM on all training rows (for its coefficients)."""
    return _fitted(c, "svm", [li.LinearModel(li.SQUARED_HINGE)])


def svm_calibrated(c: Chain) -> tuple[li.Fit, list, float]:
    """(models of the folds' other rows, (a, b) per fold, seconds)."""
    def build():
        import time
        began = time.perf_counter()
        fit = _fitted(c, "svm folds", [li.LinearModel(li.SQUARED_HINGE, skip_fold=i) for i in range(N_FOLDS)])
        sigmoids = li.platt(training(c), fit.weights, list(range(N_FOLDS)))
        return fit, [(float(a), float(b)) for a, b in sigmoids], time.perf_counter() - began
    return c._get("svm_cal", build)


def svm_predictions(c: Chain) -> DataFrame:
    """The average of the folds' calibrated probabilities."""
    def build():
        fit, sigmoids, _ = svm_calibrated(c)
        prob = sum((sigmoid(F.lit(a) * F.col("margins")[i] + F.lit(b)) for i, (a, b) in enumerate(sigmoids)), F.lit(0.0)) / N_FOLDS
        return _scored(_margins(c, "svm folds", fit), SVM_NAME, F.round(prob, SCORE_DIGITS), prob)
    return c._get("svm_pred", build, keep="checkpoint")


# -- comparison ------------------------------------------------------------------

def comparison(c: Chain) -> DataFrame:
    """Metric rows for the three TF-IDF models on every split."""
    preds = c.nb_predictions().unionByName(lr_predictions(c)).unionByName(svm_predictions(c))
    return c._get("comparison", lambda: ev.evaluate_splits(preds), keep="checkpoint")


def fit_times(c: Chain) -> DataFrame:
    """(model, train_time_s): wall seconds of each model's fit, 1 digit."""
    rows = [(NB_NAME, round(c.nb_fit_seconds(), 1)), (LR_NAME, round(lr_fit(c).seconds, 1)),
            (SVM_NAME, round(svm_calibrated(c)[2], 1))]
    return c.spark.createDataFrame(rows, "model string, train_time_s double")
