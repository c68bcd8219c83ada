"""Ranking metrics and threshold metrics over prediction tables.

Prediction rows: (group..., y_true INT 0/1, score DOUBLE, y_prob DOUBLE).
``score`` is any strictly monotone transform of ``y_prob`` that both engines
compute identically (NB: log-odds rounded to 8 digits); ranks use it.

AUC, ROC, PR, average precision and the counts at a threshold all come from
one table, ``cumulative``: a row per distinct score with its running counts.
It takes one aggregate of the predictions; its global running sums are
range-partitioned (``operators.ranges``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toxiscope.functions.numeric import ratio_round
from toxiscope.operators.ranges import Keep, prefix_sums, written

DIGITS = 4
# The decision-threshold grid 0.05, 0.10, ..., 0.95 (i / 20), and the names of the evaluation splits.
GRID = tuple(i / 20 for i in range(1, 20))
TEST_SPLIT = "English Test (20%)"
VAL_SPLIT = "Multilingual Val"


def score_counts(preds: DataFrame, group_cols: list[str], score: str = "score", label: str = "y_true",
                 threshold: Column | None = None, prob: str = "y_prob") -> DataFrame:
    """(group..., score, pos, neg): one row per distinct score; with a threshold also ``hit_pos``, ``hit_neg``
    (rows with prob >= threshold) and ``threshold`` (one value per group)."""
    pos = F.coalesce(F.col(label) == 1, F.lit(False))

    def cnt(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    sums = [cnt(pos).alias("pos"), cnt(~pos).alias("neg")]
    if threshold is not None:
        hit = F.col(prob) >= threshold
        sums += [cnt(hit & pos).alias("hit_pos"), cnt(hit & ~pos).alias("hit_neg"), F.max(threshold).alias("threshold")]
    return preds.groupBy(*group_cols, score).agg(*sums)


def cumulative(preds: DataFrame, group_cols: list[str], score: str = "score", label: str = "y_true",
               threshold: Column | None = None, keep: Keep = written) -> DataFrame:
    """``score_counts`` + cum_pos, cum_neg, cum_one (running sums and place in ascending score, the row included)
    and n_pos, n_neg, n_one (the group's)."""
    counts = score_counts(preds, group_cols, score, label, threshold).withColumnRenamed(score, "score")
    return prefix_sums(counts.withColumn("one", F.lit(1)), group_cols, "score", ["pos", "neg", "one"], keep)


def _descending(cum: DataFrame) -> DataFrame:
    """+ tps, fps and place: counts at or above the score."""
    return (cum.withColumn("tps", F.col("n_pos") - F.col("cum_pos") + F.col("pos"))
               .withColumn("fps", F.col("n_neg") - F.col("cum_neg") + F.col("neg"))
               .withColumn("place", F.col("n_one") - F.col("cum_one") + 1))


def _auc(digits: int) -> list[Column]:
    """n_pos, n_neg and the AUC as aggregates of a cumulative table.

    AUC = sum over positives of (#negatives below + #negatives tied / 2) / (P N),
    evaluated exactly in integers and rounded half-up; NULL with one class.
    """
    dec = "decimal(38,0)"
    twice = F.sum(F.col("pos").cast(dec) * (F.lit(2) * (F.col("cum_neg") - F.col("neg")) + F.col("neg")).cast(dec))
    n_pos, n_neg = F.sum("pos"), F.sum("neg")
    den = F.lit(2).cast(dec) * n_pos.cast(dec) * n_neg.cast(dec)
    return [n_pos.alias("n_pos"), n_neg.alias("n_neg"), ratio_round(twice, den, digits, zero=None).alias("auc_roc")]


def auc_of(cum: DataFrame, group_cols: list[str], digits: int = DIGITS) -> DataFrame:
    return cum.groupBy(*group_cols).agg(*_auc(digits))


def auc_table(preds: DataFrame, group_cols: list[str], score: str = "score",
              label: str = "y_true", digits: int = DIGITS) -> DataFrame:
    """(group..., n_pos, n_neg, auc_roc): rank AUC, ties count one half."""
    return auc_of(cumulative(preds, group_cols, score, label), group_cols, digits)


def confusion_counts(preds: DataFrame, group_cols: list[str], threshold: Column | float = 0.5,
                     prob: str = "y_prob", label: str = "y_true") -> DataFrame:
    """(group..., tp, fp, fn, tn) with prediction = prob >= threshold."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit = F.col(prob) >= thr
    pos = F.col(label) == 1

    def cnt(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0)).cast("bigint")

    return preds.groupBy(*group_cols).agg(
        cnt(hit & pos).alias("tp"), cnt(hit & ~pos).alias("fp"),
        cnt(~hit & pos).alias("fn"), cnt(~hit & ~pos).alias("tn"))


def rate_columns(digits: int = DIGITS) -> list[Column]:
    """f1, accuracy, precision, recall from tp/fp/fn/tn; 0 on zero division."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return [
        ratio_round(F.lit(2) * tp, F.lit(2) * tp + fp + fn, digits).alias("f1"),
        ratio_round(tp + tn, tp + fp + fn + tn, digits).alias("accuracy"),
        ratio_round(tp, tp + fp, digits).alias("precision"),
        ratio_round(tp, tp + fn, digits).alias("recall"),
    ]


def metrics_of(cum: DataFrame, group_cols: list[str], digits: int = DIGITS) -> DataFrame:
    """(group..., n, threshold, auc_roc, f1, accuracy, precision, recall) of a cumulative table with a threshold."""
    tp, fp = F.sum("hit_pos"), F.sum("hit_neg")
    found = cum.groupBy(*group_cols).agg(
        *_auc(digits), F.max("threshold").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
        (F.sum("pos") - tp).alias("fn"), (F.sum("neg") - fp).alias("tn"))
    return found.select(*group_cols, (F.col("n_pos") + F.col("n_neg")).alias("n"), "threshold", "auc_roc", *rate_columns(digits))


def classification_metrics(preds: DataFrame, group_cols: list[str],
                            threshold: Column | float | None = 0.5,
                            digits: int = DIGITS, keep: Keep = written) -> DataFrame:
    """(group..., n, threshold, auc_roc, f1, accuracy, precision, recall).

    With ``threshold=None`` a ``threshold`` column on the predictions is used
    (one value per group, e.g. a looked-up tuned threshold).
    """
    thr = F.col("threshold") if threshold is None else (
        threshold if isinstance(threshold, Column) else F.lit(float(threshold)))
    return metrics_of(cumulative(preds, group_cols, threshold=thr, keep=keep), group_cols, digits)


# ---------------------------------------------------------------------------
# Curves
# ---------------------------------------------------------------------------

def roc_of(cum: DataFrame, group_cols: list[str], digits: int = DIGITS, drop_intermediate: bool = False) -> DataFrame:
    """(group..., threshold, tps, fps, tpr, fpr) per distinct score plus the
    (0, 0) start with threshold +inf; groups with one class are skipped.

    ``drop_intermediate`` drops points collinear with both neighbours (second
    difference of fps and tps zero), keeping the first and last distinct
    score.  Neighbours are found by place, through two equi-joins on
    (group, place) -- no single-task window.
    """
    g = list(group_cols)
    pts = _descending(cum).filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0)).select(
        *g, F.col("score").alias("threshold"), "tps", "fps", "place", "n_one", "n_pos", "n_neg")
    if drop_intermediate:
        nxt = pts.select(*g, (F.col("place") - 1).alias("place"), F.col("tps").alias("_tn"), F.col("fps").alias("_fn"))
        prv = pts.select(*g, (F.col("place") + 1).alias("place"), F.col("tps").alias("_tp"), F.col("fps").alias("_fp"))
        j = pts.join(nxt, g + ["place"], "left").join(prv, g + ["place"], "left")
        bend = ((F.col("_fp") - F.lit(2) * F.col("fps") + F.col("_fn")) != 0) | \
               ((F.col("_tp") - F.lit(2) * F.col("tps") + F.col("_tn")) != 0)
        pts = j.filter((F.col("place") == 1) | (F.col("place") == F.col("n_one")) | bend).select(*pts.columns)
    # the row at place 1 brings the start along
    start = F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0).cast("bigint").alias("tps"), F.lit(0).cast("bigint").alias("fps"))
    own = F.struct("threshold", "tps", "fps")
    both = pts.withColumn("_p", F.explode(F.when(F.col("place") == 1, F.array(start, own)).otherwise(F.array(own))))
    return both.select(*g, "_p.threshold", "_p.tps", "_p.fps", ratio_round(F.col("_p.tps"), F.col("n_pos"), digits).alias("tpr"),
                       ratio_round(F.col("_p.fps"), F.col("n_neg"), digits).alias("fpr"))


def roc_curve(preds: DataFrame, group_cols: list[str], score: str = "score",
              digits: int = DIGITS, drop_intermediate: bool = False) -> DataFrame:
    return roc_of(cumulative(preds, group_cols, score), group_cols, digits, drop_intermediate)


def pr_of(cum: DataFrame, group_cols: list[str], digits: int = DIGITS) -> DataFrame:
    """(group..., threshold, tps, fps, precision, recall) per distinct score,
    plus the end point precision 1, recall 0 (threshold NULL)."""
    g = list(group_cols)
    pts = _descending(cum).filter(F.col("n_pos") > 0)
    own = F.struct(F.col("score").alias("threshold"), "tps", "fps", ratio_round(F.col("tps"), F.col("tps") + F.col("fps"), digits).alias("precision"),
                   ratio_round(F.col("tps"), F.col("n_pos"), digits).alias("recall"))
    end = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("bigint").alias("tps"),
                   F.lit(None).cast("bigint").alias("fps"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    # the row at place 1 brings the end along
    both = pts.withColumn("_p", F.explode(F.when(F.col("place") == 1, F.array(end, own)).otherwise(F.array(own))))
    return both.select(*g, "_p.*")


def pr_curve(preds: DataFrame, group_cols: list[str], score: str = "score",
             digits: int = DIGITS) -> DataFrame:
    return pr_of(cumulative(preds, group_cols, score), group_cols, digits)


def average_precision_of(cum: DataFrame, group_cols: list[str], digits: int = DIGITS) -> DataFrame:
    """(group..., average_precision): sum over distinct scores (descending) of
    (recall step) x precision = (1/P) sum pos_k * tps_k / (tps_k + fps_k)."""
    pts = _descending(cum).filter(F.col("n_pos") > 0)
    step = F.col("pos") * F.col("tps") / (F.col("tps") + F.col("fps"))
    return pts.groupBy(*group_cols).agg(F.round(F.sum(step) / F.first("n_pos"), digits).alias("average_precision"))


def average_precision(preds: DataFrame, group_cols: list[str], score: str = "score",
                      digits: int = DIGITS) -> DataFrame:
    return average_precision_of(cumulative(preds, group_cols, score), group_cols, digits)


def curve_summary(cum: DataFrame, group_cols: list[str], digits: int = DIGITS) -> DataFrame:
    """(group..., auc_roc, average_precision, roc_points, pr_points) in one aggregate; groups with one class are skipped."""
    pts = _descending(cum).filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0)).withColumn("_all", F.col("n_pos"))
    step = F.col("pos") * F.col("tps") / (F.col("tps") + F.col("fps"))
    points = F.count(F.lit(1)) + 1
    return pts.groupBy(*group_cols).agg(
        _auc(digits)[2], F.round(F.sum(step) / F.first("_all"), digits).alias("average_precision"),
        points.alias("roc_points"), points.alias("pr_points"))


# ---------------------------------------------------------------------------
# Threshold search
# ---------------------------------------------------------------------------

def _grid_level(prob: Column) -> Column:
    """#grid thresholds t with prob >= t (0..19)."""
    grid = F.array(*[F.lit(t) for t in GRID])
    return F.size(F.filter(grid, lambda t: prob >= t))


def threshold_curve(preds: DataFrame, group_cols: list[str], prob: str = "y_prob",
                    label: str = "y_true", digits: int = DIGITS) -> DataFrame:
    """(group..., threshold, tp, fp, fn, tn, f1_raw, f1, precision, recall) at
    every grid threshold, from one pass: rows are binned by grid level, then
    suffix sums over at most 20 levels per group."""
    g = list(group_cols)
    lv = preds.withColumn("_lv", _grid_level(F.col(prob)))
    per = lv.groupBy(*g, "_lv").agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("bigint").alias("_pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("bigint").alias("_neg"))
    spark = preds.sparkSession
    grid = spark.createDataFrame([(i + 1, t) for i, t in enumerate(GRID)], "_i int, threshold double")
    # per: #groups x 20 rows; grid: 19 rows.
    joined = per.join(F.broadcast(grid), F.col("_lv") >= F.col("_i"), "inner")
    hits = joined.groupBy(*g, "_i", "threshold").agg(F.sum("_pos").alias("tp"), F.sum("_neg").alias("fp"))
    totals = per.groupBy(*g).agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    frame = totals.crossJoin(F.broadcast(grid))
    full = (frame.join(hits, g + ["_i", "threshold"], "left")
                 .fillna(0, ["tp", "fp"])
                 .withColumn("fn", F.col("_P") - F.col("tp"))
                 .withColumn("tn", F.col("_N") - F.col("fp")))
    f1_raw = F.coalesce(F.try_divide(F.lit(2.0) * F.col("tp"),
                                     F.lit(2.0) * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return full.select(*g, "threshold", "tp", "fp", "fn", "tn", f1_raw.alias("f1_raw"),
                       ratio_round(F.lit(2) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn"),
                                   digits).alias("f1"),
                       ratio_round("tp", F.col("tp") + F.col("fp"), digits).alias("precision"),
                       ratio_round("tp", F.col("tp") + F.col("fn"), digits).alias("recall"))


def best_threshold(preds: DataFrame, group_cols: list[str], prob: str = "y_prob",
                   label: str = "y_true", digits: int = DIGITS) -> DataFrame:
    """(group..., threshold, f1): the grid threshold with the highest F1;
    the lowest threshold wins ties (strict improvement in grid order)."""
    g = list(group_cols)
    curve = threshold_curve(preds, g, prob, label, digits)
    w = Window.partitionBy(*g).orderBy(F.desc("f1_raw"), F.asc("threshold"))
    return (curve.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
                 .select(*g, "threshold", "f1"))


# ---------------------------------------------------------------------------
# Evaluation over splits
# ---------------------------------------------------------------------------

def eval_rows(preds: DataFrame, split_col: str = "split", lang_col: str = "lang") -> DataFrame:
    """Each prediction row once per evaluation group it belongs to: the
    English test rows to the test split, validation rows both to the whole
    validation split and to ``Val-<lang>`` (a generator, no second scan)."""
    groups = F.when(F.col(split_col) == VAL_SPLIT,
                    F.array(F.lit(VAL_SPLIT), F.concat(F.lit("Val-"), F.col(lang_col))))\
              .otherwise(F.array(F.col(split_col)))
    return preds.withColumn("eval_split", F.explode(groups))


def split_rows(preds: DataFrame) -> DataFrame:
    """The rows of all evaluation groups, named in ``split``."""
    return eval_rows(preds).drop("split").withColumnRenamed("eval_split", "split")


def evaluate_splits(preds: DataFrame, threshold: Column | float | None = 0.5,
                    digits: int = DIGITS) -> DataFrame:
    """Metric rows per (model, split): English test, whole validation and
    each validation language."""
    return classification_metrics(split_rows(preds), ["model", "split"], threshold, digits)
