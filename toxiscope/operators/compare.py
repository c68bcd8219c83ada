"""Model comparison tables: pivots, long confusion matrices, ragged unions,
last-wins de-duplication, top-k listings and per-document explanations.

Inputs here are metric rows (models x splits: tiny) or prediction rows
(large).  Prediction-side operators are partitioned aggregations / windows
keyed by (model, cell, language) -- top-k windows only keep k rows per key
(Catalyst turns ``row_number <= k`` into a per-partition group limit).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toxiscope.functions.text import split_to_lang
from toxiscope.operators.features import small

# Fixed value: column order of the per-language AUC matrix (training
# language first, then the validation languages of the test data).
LANG_ORDER = ("en", "de", "es", "fr")
METRIC_COLS = ("auc_roc", "f1", "accuracy", "precision", "recall")


def confusion_long(preds: DataFrame, group_cols: list[str], threshold: Column | float = 0.5,
                   prob: str = "y_prob", label: str = "y_true") -> DataFrame:
    """(group..., actual, predicted, n): all four cells per group, zeros kept."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    g = list(group_cols)
    obs = (preds.withColumn("predicted", F.when(F.col(prob) >= thr, 1).otherwise(0))
                .groupBy(*g, F.col(label).alias("actual"), "predicted")
                .agg(F.count(F.lit(1)).alias("n")))
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"))
                      for a in (0, 1) for p in (0, 1)])
    frame = preds.select(*g).distinct().select(*g, F.explode(cells).alias("_c")).select(
        *g, "_c.actual", "_c.predicted")
    return (frame.join(obs, g + ["actual", "predicted"], "left")
                 .select(*g, "actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def metric_pivot(metrics: DataFrame, value: str = "auc_roc", first=LANG_ORDER) -> DataFrame:
    """model x language matrix; split labels map to languages; cells averaged.

    The columns are ``first``, then every other language of the metric rows
    (one row per model and split, so few) in alphabetical order.
    """
    m = metrics.withColumn("lang", split_to_lang("split")).filter(F.col("lang").isNotNull())
    found = sorted(r.lang for r in m.select("lang").distinct().collect())
    return m.groupBy("model").pivot("lang", [*first, *(x for x in found if x not in first)]).agg(F.avg(value))


def split_rows(metrics: DataFrame, split: str) -> DataFrame:
    return metrics.filter(F.col("split") == split).select("model", *METRIC_COLS)


def sorted_rows(metrics: DataFrame, by: str) -> DataFrame:
    """Rows with their rank by ``by`` (descending, NULLs last).  Metric tables
    are models x splits rows, so one ordered window is fine."""
    w = Window.orderBy(F.desc_nulls_last(by), "model", "split")
    return metrics.select(F.row_number().over(w).alias("rank"), "model", "split", by)


def union_metrics(tables: list[DataFrame]) -> DataFrame:
    """Concatenate ragged metric tables by column name; missing columns NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def dedupe_last(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """One row per key, the one with the largest ``order_col`` (last wins)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order_col))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def top_k(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
          rank_col: str = "rank") -> DataFrame:
    """The first k rows of each group in ``order`` (ties broken by the order
    columns given, which must be total)."""
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def confusion_cell(prob: Column, label: Column, threshold: Column) -> Column:
    hit = prob >= threshold
    return (F.when(hit & (label == 1), F.lit("TP")).when(hit, F.lit("FP"))
             .when(label == 1, F.lit("FN")).otherwise(F.lit("TN")))


def error_examples(preds: DataFrame, k: int = 3, threshold: float = 0.5) -> DataFrame:
    """Per model, confusion cell and language the k most confident rows:
    highest probability for predicted positives, lowest for predicted
    negatives (ties by doc_id)."""
    cells = preds.withColumn("cell", confusion_cell(F.col("y_prob"), F.col("y_true"), F.lit(threshold)))
    conf = F.when(F.col("cell").isin("TP", "FP"), -F.col("score")).otherwise(F.col("score"))
    ranked = top_k(cells.withColumn("_conf", conf), ["model", "cell", "lang"],
                   [F.asc("_conf"), F.asc("doc_id")], k)
    return ranked.select("model", "cell", "lang", "rank", "doc_id",
                         F.round("y_prob", 6).alias("y_prob"))


def missed_toxic(preds: DataFrame, k: int = 10, threshold: float = 0.5) -> DataFrame:
    """False negatives with the lowest probability, per model."""
    fn = preds.filter((F.col("y_true") == 1) & (F.col("y_prob") < threshold))
    ranked = top_k(fn, ["model"], [F.asc("score"), F.asc("doc_id")], k)
    return ranked.select("model", "rank", "doc_id", "lang", F.round("y_prob", 6).alias("y_prob"))


def explain_documents(weights: DataFrame, term_weights: DataFrame, k: int = 10,
                      id_col: str = "doc_id", digits: int = 6, terms: int | None = None) -> DataFrame:
    """Per document its k terms with the largest contribution (tf-idf weight x
    model weight) and the document's total contribution.

    ``term_weights`` (term, coef) is one row per vocabulary term, ``terms``
    their measured number: it decides on the broadcast.  Ranking uses contributions rounded to 8 digits so equal
    contributions tie exactly; ties go to the smaller term.
    """
    c = (weights.join(small(term_weights.select("term", "coef"), terms), "term")
                .withColumn("contribution", F.round(F.col("weight") * F.col("coef"), 8)))
    # the 8-digit contributions add up exactly, in whatever order
    total = F.sum(F.col("contribution").cast("decimal(18,8)")).over(Window.partitionBy(id_col))
    c = c.withColumn("total", F.round(total, digits).cast("double"))
    top = top_k(c, [id_col], [F.desc("contribution"), F.asc("term")], k)
    return top.select(id_col, "rank", "term", F.round("contribution", digits).alias("contribution"), "total")


def threshold_lookup(models: DataFrame, summaries: DataFrame, default: float = 0.5) -> DataFrame:
    """(model, threshold, source): the summary's threshold, else ``default``.
    Summaries hold one row per model -- broadcast."""
    j = models.join(F.broadcast(summaries.select("model", F.col("threshold").alias("_t"))), "model", "left")
    return j.select("model", F.coalesce("_t", F.lit(float(default))).alias("threshold"),
                    F.when(F.col("_t").isNull(), F.lit("default")).otherwise(F.lit("tuned")).alias("source"))


def best_candidate(cands: DataFrame, metric: str, order_col: str) -> DataFrame:
    """Flag the candidate with the best metric; the earliest wins ties."""
    w = Window.orderBy(F.desc_nulls_last(metric), F.asc(order_col))
    return cands.withColumn("is_best", F.row_number().over(w) == 1)


def gain_by_language(to: DataFrame, frm: DataFrame, value: str = "auc_roc") -> DataFrame:
    """Per language: metric of ``to`` minus that of ``frm`` (self equi-join on
    the split label; both sides are metric rows)."""
    a = to.withColumn("lang", split_to_lang("split")).filter(F.col("lang").isNotNull())
    b = frm.select("split", F.col("model").alias("from_model"), F.col(value).alias("from_auc"))
    return (a.join(b, "split")
             .select("lang", "from_model", F.col("model").alias("to_model"), "from_auc",
                     F.col(value).alias("to_auc"),
                     F.round(F.col(value) - F.col("from_auc"), 4).alias("gain")))


def relative_metric(to: DataFrame, ref: DataFrame, value: str = "auc_roc") -> DataFrame:
    b = ref.select("split", F.col("model").alias("reference_model"), F.col(value).alias("_ref"))
    return (to.join(b, "split")
              .select("split", "model", "reference_model",
                      F.round(F.try_divide(F.col(value), F.col("_ref")), 4).alias("ratio")))
