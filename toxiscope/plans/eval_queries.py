"""Queries over predictions: metrics, curves, thresholds, comparisons."""

from __future__ import annotations

from toxiscope.plans import oracle as o
from toxiscope.plans.baselines import chain
from toxiscope.plans.catalog import query

FLAGSHIP_SQL = o.with_(o.CORPUS, o.FEATURES, o.NB, o.EVAL) + o.metrics_select("c_eval", ["model", "split"])


@query("evaluate_splits", FLAGSHIP_SQL)
def q_evaluate_splits(spark, sf):
    return chain(spark, sf).nb_metrics()

from pyspark.sql import Window
from pyspark.sql import functions as F

from toxiscope.functions import text as tx
from toxiscope.functions.numeric import ratio_round
from toxiscope.operators import compare as cmp
from toxiscope.operators import evaluation as ev
from toxiscope.plans.baselines import NB_NAME, TEST, VAL, nb_name

BASE = (o.CORPUS, o.FEATURES, o.NB)
ALT_ALPHA = 1.0
ALT_NAME = nb_name(ALT_ALPHA)
ALT = o.nb_ctes(ALT_ALPHA, "_alt", ALT_NAME)
G = ["model", "split"]


def _preds(spark, sf, alpha=0.1):
    return chain(spark, sf).nb_predictions(alpha)


def _eval(spark, sf, alpha=0.1):
    return ev.split_rows(_preds(spark, sf, alpha))


def _curve(spark, sf, alpha=0.1):
    """Running counts of all evaluation groups, one kept table."""
    return chain(spark, sf).nb_curve(alpha)


def _whole(spark, sf):
    """Of the English test and the whole validation split."""
    return _curve(spark, sf).filter(F.col("split").isin(TEST, VAL))


def _metrics(spark, sf, alpha=0.1):
    return chain(spark, sf).nb_metrics(alpha)


def _bigint(x):
    return f"CAST({x} AS BIGINT)"


# ------------------------------------------------------------ AUC / curves --

@query("auc_roc", o.with_(*BASE, o.EVAL) + f"""
SELECT model, split, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, auc_roc
FROM ({o.auc_select('c_eval', 'model, split')})""")
def q_auc_roc(spark, sf):
    return ev.auc_of(_curve(spark, sf), G)


CUM_SQL = """
sc AS (SELECT model, split, score, sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS pos,
              sum(CASE WHEN y_true = 1 THEN 0 ELSE 1 END) AS neg
       FROM c_preds GROUP BY model, split, score),
cum AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tps, CAST(sum(neg) OVER w AS BIGINT) AS fps,
               sum(pos) OVER (PARTITION BY model, split) AS n_pos,
               sum(neg) OVER (PARTITION BY model, split) AS n_neg
        FROM sc WINDOW w AS (PARTITION BY model, split ORDER BY score DESC
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("roc_curve", o.with_(*BASE, CUM_SQL, """
pts AS (SELECT model, split, score AS threshold, tps, fps, n_pos, n_neg FROM cum
        WHERE n_pos > 0 AND n_neg > 0
        UNION ALL
        SELECT DISTINCT model, split, CAST('inf' AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT), n_pos, n_neg
        FROM cum WHERE n_pos > 0 AND n_neg > 0)""") + f"""
SELECT model, split, threshold, tps, fps, {o.ratio('tps', 'n_pos')} AS tpr, {o.ratio('fps', 'n_neg')} AS fpr
FROM pts""")
def q_roc_curve(spark, sf):
    return ev.roc_of(_whole(spark, sf), G)


@query("pr_curve", o.with_(*BASE, CUM_SQL) + f"""
SELECT model, split, score AS threshold, tps, fps, {o.ratio('tps', 'tps + fps')} AS precision,
       {o.ratio('tps', 'n_pos')} AS recall
FROM cum WHERE n_pos > 0
UNION ALL
SELECT DISTINCT model, split, CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 1.0, 0.0
FROM cum WHERE n_pos > 0""")
def q_pr_curve(spark, sf):
    return ev.pr_of(_whole(spark, sf), G)


AP_SQL = """SELECT model, split, round(sum(pos * CAST(tps AS DOUBLE) / (tps + fps)) / max(n_pos), 4) AS average_precision
FROM cum WHERE n_pos > 0 GROUP BY model, split"""


@query("average_precision", o.with_(*BASE, CUM_SQL) + AP_SQL)
def q_average_precision(spark, sf):
    return ev.average_precision_of(_whole(spark, sf), G)


@query("curves_both_splits", o.with_(*BASE, CUM_SQL, f"""
ap AS ({AP_SQL}),
auc AS ({o.auc_select('c_preds', 'model, split')})""") + """
SELECT a.model, a.split, a.auc_roc, p.average_precision,
       CAST(count(*) + 1 AS BIGINT) AS roc_points, CAST(count(*) + 1 AS BIGINT) AS pr_points
FROM auc a JOIN ap p ON a.model = p.model AND a.split = p.split
JOIN cum c ON a.model = c.model AND a.split = c.split
WHERE a.n_pos > 0 AND a.n_neg > 0
GROUP BY a.model, a.split, a.auc_roc, p.average_precision""")
def q_curves_both_splits(spark, sf):
    """ROC and PR summaries for the English test and whole validation split,
    skipping groups with a single class."""
    return ev.curve_summary(_whole(spark, sf), G)


# ------------------------------------------------------- threshold metrics --

TC_SQL = f"""
grid AS (SELECT i, CAST(i AS DOUBLE) / 20 AS threshold FROM range(1, 20) r(i)),
tc0 AS (SELECT e.model, e.split, g.threshold,
               CAST(sum(CASE WHEN e.y_prob >= g.threshold AND e.y_true = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
               CAST(sum(CASE WHEN e.y_prob >= g.threshold AND e.y_true <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
               CAST(sum(CASE WHEN e.y_prob < g.threshold AND e.y_true = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
               CAST(sum(CASE WHEN e.y_prob < g.threshold AND e.y_true <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn
        FROM c_eval e CROSS JOIN grid g GROUP BY e.model, e.split, g.threshold),
tc AS (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0
                      ELSE CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1_raw,
              {o.ratio('2 * tp', '2 * tp + fp + fn')} AS f1, {o.ratio('tp', 'tp + fp')} AS precision,
              {o.ratio('tp', 'tp + fn')} AS recall
       FROM tc0)"""


@query("threshold_curve", o.with_(*BASE, o.EVAL, TC_SQL) + """
SELECT model, split, threshold, tp, fp, fn, tn, f1, precision, recall FROM tc""")
def q_threshold_curve(spark, sf):
    return ev.threshold_curve(_eval(spark, sf), G).drop("f1_raw")


BEST_SQL = """best AS (SELECT model, split, threshold, f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY model, split ORDER BY f1_raw DESC, threshold) AS r FROM tc)
  WHERE r = 1)"""


@query("best_threshold", o.with_(*BASE, o.EVAL, TC_SQL, BEST_SQL) + "SELECT * FROM best")
def q_best_threshold(spark, sf):
    return ev.best_threshold(_eval(spark, sf), G)


@query("confusion_counts", o.with_(*BASE, o.EVAL) + f"""
SELECT model, split, {_bigint('tp')} AS tp, {_bigint('fp')} AS fp, {_bigint('fn')} AS fn, {_bigint('tn')} AS tn
FROM ({o.conf_select('c_eval', 'model, split')})""")
def q_confusion_counts(spark, sf):
    return ev.confusion_counts(_eval(spark, sf), G)


@query("classification_metrics", o.with_(*BASE) + """
SELECT model, auc_roc, f1, accuracy, precision, recall FROM (""" +
       o.metrics_select("(SELECT * FROM c_preds WHERE split = 'English Test (20%)')", ["model"]) + ")")
def q_classification_metrics(spark, sf):
    return ev.metrics_of(_curve(spark, sf).filter(F.col("split") == TEST), ["model"]).select(
        "model", "auc_roc", "f1", "accuracy", "precision", "recall")


METRICS_SQL = "m AS (" + o.metrics_select("c_eval", ["model", "split"]) + ")"


@query("metric_pivot", o.with_(*BASE, o.EVAL, METRICS_SQL, """
ml AS (SELECT model, CASE WHEN split = 'English Test (20%)' THEN 'en'
                          WHEN split LIKE 'Val-%' THEN substr(split, 5) END AS lang, auc_roc FROM m)""") +
       "SELECT model, " + ", ".join(f"avg(CASE WHEN lang = '{lg}' THEN auc_roc END) AS {lg}"
                                    for lg in cmp.LANG_ORDER) +
       " FROM ml WHERE lang IS NOT NULL GROUP BY model")
def q_metric_pivot(spark, sf):
    return cmp.metric_pivot(_metrics(spark, sf))


@query("split_rows", o.with_(*BASE, o.EVAL, METRICS_SQL) + """
SELECT model, auc_roc, f1, accuracy, precision, recall FROM m WHERE split = 'Multilingual Val'""")
def q_split_rows(spark, sf):
    return cmp.split_rows(_metrics(spark, sf), VAL)


@query("sorted_models", o.with_(*BASE, o.EVAL, METRICS_SQL) + """
SELECT CAST(row_number() OVER (ORDER BY auc_roc DESC NULLS LAST, model, split) AS INTEGER) AS rank,
       model, split, auc_roc FROM m""")
def q_sorted_models(spark, sf):
    return cmp.sorted_rows(_metrics(spark, sf), "auc_roc")


@query("split_to_lang", o.with_(*BASE, o.EVAL, METRICS_SQL) + """
SELECT model, split, CASE WHEN split = 'English Test (20%)' THEN 'en'
                          WHEN split LIKE 'Val-%' THEN substr(split, 5) END AS lang FROM m""")
def q_split_to_lang(spark, sf):
    return _metrics(spark, sf).select("model", "split", tx.split_to_lang("split").alias("lang"))


@query("slug", o.with_(*BASE, o.EVAL, METRICS_SQL) + """
SELECT model, split, translate(replace(model, 'TF-IDF + ', ''), ' ()%', '_') AS model_tag,
       translate(replace(split, 'TF-IDF + ', ''), ' ()%', '_') AS split_tag FROM m""")
def q_slug(spark, sf):
    return _metrics(spark, sf).select("model", "split", tx.slug("model").alias("model_tag"),
                                      tx.slug("split").alias("split_tag"))


# ------------------------------------------------------ tuned thresholds --

def tuned(spark, sf, alpha=0.1):
    """Threshold tuned on the whole validation split (F1 over the grid)."""
    val = _preds(spark, sf, alpha).filter(F.col("split") == VAL)
    return ev.best_threshold(val, ["model"]).select(
        "model", "threshold", F.col("f1").alias("tuned_f1"))


TUNED_SQL = """
tuned AS (SELECT model, threshold, f1 AS tuned_f1 FROM best WHERE split = 'Multilingual Val')"""

@query("confusion_by_language", o.with_(*BASE, o.EVAL, TC_SQL, BEST_SQL, TUNED_SQL, """
cells AS (SELECT a.actual, p.predicted FROM (VALUES (0), (1)) a(actual), (VALUES (0), (1)) p(predicted)),
keys AS (SELECT DISTINCT model, lang FROM c_preds WHERE split = 'Multilingual Val'),
obs AS (SELECT p.model, p.lang, p.y_true AS actual, CASE WHEN p.y_prob >= t.threshold THEN 1 ELSE 0 END AS predicted,
               count(*) AS n
        FROM c_preds p JOIN tuned t ON p.model = t.model WHERE p.split = 'Multilingual Val' GROUP BY ALL)""") + """
SELECT k.model, k.lang, c.actual, c.predicted, CAST(coalesce(o.n, 0) AS BIGINT) AS n
FROM keys k CROSS JOIN cells c
LEFT JOIN obs o ON o.model = k.model AND o.lang = k.lang AND o.actual = c.actual AND o.predicted = c.predicted""")
def q_confusion_by_language(spark, sf):
    """At each model's own threshold, tuned on the whole validation split."""
    rows = _preds(spark, sf).filter(F.col("split") == VAL)
    rows = rows.join(F.broadcast(tuned(spark, sf)).select("model", "threshold"), "model")  # a row per model
    return cmp.confusion_long(rows, ["model", "lang"], threshold=F.col("threshold"))


def _tuned_metrics(spark, sf):
    rows = _eval(spark, sf).join(F.broadcast(tuned(spark, sf)).select("model", "threshold"), "model")
    return ev.classification_metrics(rows, G, threshold=None)


@query("union_metrics", o.with_(*BASE, o.EVAL, METRICS_SQL, TC_SQL, BEST_SQL, TUNED_SQL) + f"""
SELECT model, split, n, threshold, auc_roc, f1, accuracy, precision, recall, CAST(NULL AS DOUBLE) AS tuned_f1
FROM m
UNION ALL
SELECT x.model || ' (tuned)', x.split, x.n, x.threshold, x.auc_roc, {o.rates_sql().replace('tp', 'x.tp').replace('fp', 'x.fp').replace('fn', 'x.fn').replace('tn', 'x.tn')}, t.tuned_f1
FROM (SELECT e.model, e.split, count(*) AS n, max(t.threshold) AS threshold,
             sum(CASE WHEN e.y_prob >= t.threshold AND e.y_true = 1 THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN e.y_prob >= t.threshold AND e.y_true <> 1 THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN e.y_prob < t.threshold AND e.y_true = 1 THEN 1 ELSE 0 END) AS fn,
             sum(CASE WHEN e.y_prob < t.threshold AND e.y_true <> 1 THEN 1 ELSE 0 END) AS tn,
             max(a.auc_roc) AS auc_roc
      FROM c_eval e JOIN tuned t ON e.model = t.model
      JOIN ({o.auc_select('c_eval', 'model, split')}) a ON a.model = e.model AND a.split = e.split
      GROUP BY e.model, e.split) x JOIN tuned t ON x.model = t.model""")
def q_union_metrics(spark, sf):
    """Ragged metric tables (the tuned one carries ``tuned_f1``) concatenated by name."""
    base = _metrics(spark, sf)
    second = (_tuned_metrics(spark, sf).join(F.broadcast(tuned(spark, sf)).drop("threshold"), "model")
              .withColumn("model", F.concat("model", F.lit(" (tuned)"))))
    return cmp.union_metrics([base, second])


TM_SQL = f"""
tm AS (SELECT x.model, x.split, x.n, x.threshold, a.auc_roc, {o.rates_sql()}
       FROM (SELECT e.model, e.split, count(*) AS n, max(t.threshold) AS threshold,
                    sum(CASE WHEN e.y_prob >= t.threshold AND e.y_true = 1 THEN 1 ELSE 0 END) AS tp,
                    sum(CASE WHEN e.y_prob >= t.threshold AND e.y_true <> 1 THEN 1 ELSE 0 END) AS fp,
                    sum(CASE WHEN e.y_prob < t.threshold AND e.y_true = 1 THEN 1 ELSE 0 END) AS fn,
                    sum(CASE WHEN e.y_prob < t.threshold AND e.y_true <> 1 THEN 1 ELSE 0 END) AS tn
             FROM c_eval e JOIN tuned t ON e.model = t.model GROUP BY e.model, e.split) x
       JOIN ({o.auc_select('c_eval', 'model, split')}) a ON a.model = x.model AND a.split = x.split)"""


@query("dedupe_metrics", o.with_(*BASE, o.EVAL, METRICS_SQL, TC_SQL, BEST_SQL, TUNED_SQL, TM_SQL) + """
SELECT model, split, n, threshold, auc_roc, f1, accuracy, precision, recall FROM (
  SELECT *, row_number() OVER (PARTITION BY model, split ORDER BY file_order DESC) AS r FROM (
    SELECT *, 1 AS file_order FROM m UNION ALL SELECT *, 2 AS file_order FROM tm))
WHERE r = 1""")
def q_dedupe_metrics(spark, sf):
    """Two metric files for the same models (default, then tuned threshold):
    one row per (model, split), the later file wins."""
    first = _metrics(spark, sf).withColumn("file_order", F.lit(1))
    second = _tuned_metrics(spark, sf).withColumn("file_order", F.lit(2))
    both = cmp.union_metrics([first, second])
    return cmp.dedupe_last(both, ["model", "split"], "file_order").drop("file_order")


@query("distinct_keys", o.with_(*BASE, o.EVAL) + """
SELECT DISTINCT 'lang' AS key, lang AS value FROM c_preds WHERE split = 'Multilingual Val'
UNION ALL SELECT DISTINCT 'split' AS key, split AS value FROM c_eval""")
def q_distinct_keys(spark, sf):
    p = _preds(spark, sf)
    langs = p.filter(F.col("split") == VAL).select(F.lit("lang").alias("key"), F.col("lang").alias("value")).distinct()
    splits = _eval(spark, sf).select(F.lit("split").alias("key"), F.col("split").alias("value")).distinct()
    return langs.unionByName(splits).orderBy("key", "value")


CELL_SQL = """CASE WHEN y_prob >= 0.5 AND y_true = 1 THEN 'TP' WHEN y_prob >= 0.5 THEN 'FP'
                   WHEN y_true = 1 THEN 'FN' ELSE 'TN' END"""


@query("error_examples", o.with_(*BASE) + f"""
SELECT model, cell, lang, CAST(rank AS INTEGER) AS rank, doc_id, round(y_prob, 6) AS y_prob FROM (
  SELECT *, row_number() OVER (PARTITION BY model, cell, lang
                               ORDER BY CASE WHEN cell IN ('TP', 'FP') THEN -score ELSE score END, doc_id) AS rank
  FROM (SELECT *, {CELL_SQL} AS cell FROM c_preds))
WHERE rank <= 3""")
def q_error_examples(spark, sf):
    return cmp.error_examples(_preds(spark, sf), k=3)


@query("missed_toxic", o.with_(*BASE) + """
SELECT model, CAST(rank AS INTEGER) AS rank, doc_id, lang, round(y_prob, 6) AS y_prob FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY score, doc_id) AS rank
  FROM c_preds WHERE y_true = 1 AND y_prob < 0.5)
WHERE rank <= 10""")
def q_missed_toxic(spark, sf):
    return cmp.missed_toxic(_preds(spark, sf), k=10)


@query("prediction_align", o.with_(*BASE) + """
SELECT p.doc_id, d.lang, l.toxic AS y_true, p.score
FROM c_preds p JOIN labels l ON p.doc_id = l.doc_id JOIN documents d ON p.doc_id = d.doc_id""")
def q_prediction_align(spark, sf):
    """Scores aligned with labels and languages by key (not by position)."""
    c = chain(spark, sf)
    scores = _preds(spark, sf).select("doc_id", "score")
    return (scores.join(c.table("labels").select("doc_id", F.col("toxic").alias("y_true")), "doc_id")
                  .join(c.table("documents").select("doc_id", "lang"), "doc_id")
                  .select("doc_id", "lang", "y_true", "score"))


@query("language_slice", o.with_(*BASE) + """
SELECT doc_id, y_true, score FROM c_preds WHERE lang = 'de'""")
def q_language_slice(spark, sf):
    return _preds(spark, sf).filter(F.col("lang") == "de").select("doc_id", "y_true", "score")


@query("threshold_lookup", o.with_(*BASE, ALT, o.EVAL, TC_SQL, BEST_SQL, TUNED_SQL) + """
SELECT k.model, coalesce(t.threshold, 0.5) AS threshold,
       CASE WHEN t.threshold IS NULL THEN 'default' ELSE 'tuned' END AS source
FROM (SELECT DISTINCT model FROM c_preds UNION SELECT DISTINCT model FROM c_preds_alt) k
LEFT JOIN tuned t ON k.model = t.model""")
def q_threshold_lookup(spark, sf):
    """Per model its tuned threshold (only the default-alpha model has a
    tuning summary here), else 0.5."""
    models = (_preds(spark, sf).select("model").distinct()
              .unionByName(_preds(spark, sf, ALT_ALPHA).select("model").distinct()))
    return cmp.threshold_lookup(models, tuned(spark, sf))


CANDIDATES = ((1, 1.0), (2, 0.1), (3, 0.01))


def _cand_sql():
    parts = [o.CORPUS, o.FEATURES]
    sel = []
    for i, a in CANDIDATES:
        parts.append(o.nb_ctes(a, f"_c{i}", nb_name(a)))
        sel.append(f"SELECT {i} AS candidate, CAST({a!r} AS DOUBLE) AS alpha, auc_roc AS val_auc FROM ("
                   + o.auc_select(f"(SELECT * FROM c_preds_c{i} WHERE split = 'Multilingual Val')", "model")
                   + ")")
    parts.append("cand AS (" + "\nUNION ALL ".join(sel) + ")")
    return o.with_(*parts) + """
SELECT candidate, alpha, val_auc,
       row_number() OVER (ORDER BY val_auc DESC NULLS LAST, candidate) = 1 AS is_best FROM cand"""


@query("best_checkpoint", _cand_sql())
def q_best_checkpoint(spark, sf):
    """Hyper-parameter candidates (NB smoothing) scored by validation AUC; the
    best wins, the earliest candidate on ties."""
    rows = []
    for i, a in CANDIDATES:
        auc = ev.auc_of(_curve(spark, sf, a).filter(F.col("split") == VAL), ["model"]).select(F.lit(i).alias("candidate"), F.lit(a).alias("alpha"),
                                                  F.col("auc_roc").alias("val_auc"))
        rows.append(auc)
    return cmp.best_candidate(cmp.union_metrics(rows), "val_auc", "candidate")


GAIN_SQL = o.with_(*BASE, ALT, o.EVAL, o.eval_cte("_alt"), f"""
a1 AS ({o.auc_select('c_eval', 'model, split')}),
a0 AS ({o.auc_select('c_eval_alt', 'model, split')})""")


@query("auc_gain_by_language", GAIN_SQL + f"""
SELECT CASE WHEN a1.split = 'English Test (20%)' THEN 'en' ELSE substr(a1.split, 5) END AS lang,
       a0.model AS from_model, a1.model AS to_model, a0.auc_roc AS from_auc, a1.auc_roc AS to_auc,
       round(a1.auc_roc - a0.auc_roc, 4) AS gain
FROM a1 JOIN a0 ON a1.split = a0.split
WHERE a1.split = 'English Test (20%)' OR a1.split LIKE 'Val-%'""")
def q_auc_gain_by_language(spark, sf):
    to = ev.auc_of(_curve(spark, sf), G)
    frm = ev.auc_of(_curve(spark, sf, ALT_ALPHA), G)
    return cmp.gain_by_language(to, frm)


@query("relative_metric", GAIN_SQL + """
SELECT a1.split, a1.model, a0.model AS reference_model,
       CASE WHEN a0.auc_roc = 0 THEN NULL ELSE round(a1.auc_roc / a0.auc_roc, 4) END AS ratio
FROM a1 JOIN a0 ON a1.split = a0.split""")
def q_relative_metric(spark, sf):
    to = ev.auc_of(_curve(spark, sf), G)
    ref = ev.auc_of(_curve(spark, sf, ALT_ALPHA), G)
    return cmp.relative_metric(to, ref, "auc_roc")


@query("verdict", o.with_(*BASE) + f"""
SELECT p.doc_id,
       CASE WHEN regexp_full_match(coalesce(d.text, ''), '[{tx.SPACE_CHARS}]*') THEN 0.0 ELSE round(p.y_prob, 6) END AS y_prob,
       CASE WHEN regexp_full_match(coalesce(d.text, ''), '[{tx.SPACE_CHARS}]*') THEN '{tx.BLANK_VERDICT}'
            WHEN p.y_prob >= 0.5 THEN 'TOXIC' ELSE 'NOT TOXIC' END AS verdict
FROM c_preds p JOIN documents d ON p.doc_id = d.doc_id""")
def q_verdict(spark, sf):
    p = _preds(spark, sf).join(chain(spark, sf).table("documents").select("doc_id", "text"), "doc_id")
    return p.select("doc_id", F.round(tx.verdict_prob("text", "y_prob"), 6).alias("y_prob"),
                    tx.verdict("text", "y_prob", 0.5).alias("verdict"))
