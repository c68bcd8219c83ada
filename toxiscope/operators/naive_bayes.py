"""Multinomial Naive Bayes on TF-IDF weights, as joins and aggregates.

fit:     W_ct = sum of weights of term t over training documents of class c;
         log P(t | c) = ln(W_ct + alpha) - ln(W_c + alpha * V);
         prior_c = ln(n_c / n).
predict: log-odds(d) = prior_1 - prior_0 + sum_t w_dt * (logP(t|1) - logP(t|0)),
         probability = sigmoid(log-odds); a document without features gets
         the prior.

The model is one row per vocabulary term (bounded by ``max_features``), so
scoring is a broadcast join plus a per-document sum -- no shuffle of the
postings by term.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toxiscope.functions.numeric import sigmoid
from toxiscope.operators.features import MAX_FEATURES, small

ALPHA = 0.1
SCORE_DIGITS = 8


def nb_fit(train_weights: DataFrame, train_labels: DataFrame, vocab: DataFrame,
           alpha: float = ALPHA, label: str = "toxic", pos_weight: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """(by..., term, idx, logp0, logp1, log_ratio, prior) -- one row per vocabulary term.

    ``train_weights`` (by..., term, weight, label), ``train_labels`` (label) of all
    training documents (including those without features), ``vocab`` (by..., term, idx).
    The label travels with the postings, so they are only summed by term.
    A positive document counts ``pos_weight`` times in the likelihood; with
    ``by`` there is a model per value, all from the same documents.
    """
    by, v = list(by), F.lit(float(pos_weight))
    per_class = train_weights.groupBy(*by, "term").agg(
        F.sum(F.when(F.col(label) == 0, F.col("weight")).otherwise(0.0)).alias("w0"),
        (v * F.sum(F.when(F.col(label) == 1, F.col("weight")).otherwise(0.0))).alias("w1"))
    terms = vocab.select(*by, "term", "idx").join(per_class, [*by, "term"], "left").fillna(0.0, ["w0", "w1"])
    # the classes' sums are one row per model
    sums = F.broadcast(terms.groupBy(*by).agg(F.count(F.lit(1)).alias("_v"), F.sum("w0").alias("_s0"), F.sum("w1").alias("_s1")))
    a = F.lit(float(alpha))
    terms = ((terms.join(sums, by) if by else terms.crossJoin(sums))
             .withColumn("logp0", F.log(F.col("w0") + a) - F.log(F.col("_s0") + a * F.col("_v")))
             .withColumn("logp1", F.log(F.col("w1") + a) - F.log(F.col("_s1") + a * F.col("_v")))
             .withColumn("log_ratio", F.col("logp1") - F.col("logp0")))
    prior = train_labels.agg(
        (F.log(v * F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("double"))
         - F.log(F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).cast("double"))).alias("prior"))
    return terms.crossJoin(F.broadcast(prior)).select(
        *by, "term", "idx", "w0", "w1", "logp0", "logp1", "log_ratio", "prior")


def nb_scores(weights: DataFrame, model: DataFrame, docs: DataFrame,
              id_col: str | list[str] = "doc_id", max_features: int | None = MAX_FEATURES,
              by: Sequence[str] = ()) -> DataFrame:
    """docs + (score, y_prob): log-odds rounded to 8 digits and its sigmoid.

    ``docs`` decides which documents get a score; those without postings get
    the prior.  The score is rounded so that equal documents tie exactly
    whatever order the sums ran in.  ``by`` (part of the id) names the model;
    ``max_features`` is for the rows of all of them.
    """
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    contrib = (weights.join(small(model.select(*by, "term", "log_ratio"), max_features), [*by, "term"])
                      .groupBy(*ids)
                      .agg(F.sum(F.col("weight") * F.col("log_ratio")).alias("_dot")))
    prior = model.select("prior").limit(1)
    scored = (docs.join(contrib, ids, "left")
                  .crossJoin(F.broadcast(prior))
                  .withColumn("score", F.round(F.col("prior") + F.coalesce("_dot", F.lit(0.0)),
                                               SCORE_DIGITS))
                  .withColumn("y_prob", sigmoid(F.col("score")))
                  .drop("_dot", "prior"))
    return scored
