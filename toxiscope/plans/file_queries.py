"""Round trips through the file sources and sinks: a given table's result is
written, read back by the matching reader and compared with the same SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from toxiscope.functions import text as tx
from toxiscope.functions.numeric import finite_or_zero
from toxiscope.functions.text import slug
from toxiscope.operators.models import top_features
from toxiscope.plans import oracle as o
from toxiscope.plans.baselines import LR_NAME, NB_NAME, SVM_NAME, TEST, VAL, chain
from toxiscope.plans.catalog import query
from toxiscope.plans.eval_queries import ALT, ALT_ALPHA, BEST_SQL, TC_SQL, TUNED_SQL, tuned
from toxiscope.plans.model_queries import WV_SQL, word_vocab
from toxiscope.plans.scoring_queries import BLANK, score_sql
from toxiscope.sources import files as fl
from toxiscope.sources import sinks as sk
from toxiscope.streaming.scoring import score_stream

BASE = (o.CORPUS, o.FEATURES, o.NB)
RATES = ("auc_roc", "f1", "accuracy", "precision", "recall")
METRIC_ROWS = o.metrics_select("c_eval", ["model", "split"])


def _folder(c, name: str) -> str:
    """A folder of its own for every call, beside the chain's tables."""
    n = c._memo[("round trip", name)] = c._memo.get(("round trip", name), 0) + 1
    return c._table_path(("round_trip", name, n))


@query("write_splits", o.with_(o.CORPUS) + "SELECT doc_id, split, lang, toxic, clean FROM c_clean")
def q_write_splits(spark, sf):
    c = chain(spark, sf)
    path = _folder(c, "splits")
    sk.write_splits(c.cleaned, path)
    return spark.read.parquet(path).select("doc_id", "split", "lang", "toxic", "clean")


@query("write_metrics", o.with_(*BASE, o.EVAL) + f"SELECT model, split, {', '.join(RATES)} FROM ({METRIC_ROWS})")
def q_write_metrics(spark, sf):
    c = chain(spark, sf)
    path = _folder(c, "metrics")
    sk.write_metrics(c.nb_metrics(), path)
    types = {f.name: f.dataType for f in c.nb_metrics().schema}
    return (spark.read.schema(c.nb_metrics().schema).json(f"{path}/json")
            .select("model", "split", *[F.col(r).cast(types[r]) for r in RATES]))


@query("read_metric_tables", o.with_(*BASE, o.EVAL) + f"SELECT model, split, {', '.join(RATES)} FROM ({METRIC_ROWS})")
def q_read_metric_tables(spark, sf):
    """An older table with another model's rows for the same keys is read first; the last one wins."""
    c = chain(spark, sf)
    path = _folder(c, "tables")
    rows = c.nb_metrics().select("model", "split", *RATES)
    rows.withColumn("auc_roc", F.lit(0.0)).drop("f1").coalesce(1).write.option("header", True).csv(f"{path}/a_results.csv")
    rows.coalesce(1).write.option("header", True).csv(f"{path}/b_results.csv")
    rows.coalesce(1).write.option("header", True).csv(f"{path}/all_results.csv")
    return fl.read_metric_tables(spark, path).select("model", "split", *[F.col(r).cast("double") for r in RATES])


@query("write_predictions", o.with_(*BASE) + """
SELECT model, split, doc_id, y_true, score, replace(replace(replace(replace(replace(model, 'TF-IDF + ', ''), ' ', '_'),
       '(', ''), ')', ''), '%', '') AS model_tag FROM c_preds""")
def q_write_predictions(spark, sf):
    c = chain(spark, sf)
    path = _folder(c, "predictions")
    sk.write_predictions(c.nb_predictions(), path)
    return spark.read.parquet(path).select("model", "split", "doc_id", "y_true", "score", "model_tag")


@query("read_predictions", o.with_(*BASE) + f"""
SELECT 'Naive Bayes' AS model, y_true, round(y_prob, 8) AS y_prob, lang FROM c_preds WHERE split = '{VAL}'""")
def q_read_predictions(spark, sf):
    c = chain(spark, sf)
    path = _folder(c, "prediction_files")
    for split in (TEST, VAL):
        tag = spark.range(1).select(slug(F.lit(f"{NB_NAME}_{split}"))).first()[0]
        (c.nb_predictions().filter(F.col("split") == split).select("y_true", "y_prob", "lang")
         .write.option("header", True).csv(f"{path}/preds_{tag}.csv"))
    return fl.read_predictions(spark, path, "Multilingual_Val").withColumn("y_prob", F.round("y_prob", 8))


@query("write_feature_importance", o.with_(*BASE) + """
SELECT CAST(rank AS INTEGER) AS rank, term AS feature, round(log_ratio, 4) AS weight FROM (
  SELECT term, log_ratio, row_number() OVER (ORDER BY round(log_ratio, 8) DESC, term) AS rank FROM c_nb) WHERE rank <= 30""")
def q_write_feature_importance(spark, sf):
    c = chain(spark, sf)
    path = _folder(c, "importance")
    sk.write_feature_importance(top_features(c.nb_model().select("term", F.col("log_ratio").alias("coef")), 30), path)
    back = spark.read.json(path).select(F.posexplode("most_toxic").alias("pos", "f"))
    return back.select((F.col("pos") + 1).alias("rank"), "f.feature", "f.weight")


VECTORS_SQL = """
el AS (SELECT 'v' || vec_id AS word, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, unnest(embedding) AS x FROM embeddings),
ev AS (SELECT word, dim, CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 0.0 ELSE CAST(x AS DOUBLE) END AS value FROM el)"""


def _vectors(spark, sf):
    c = chain(spark, sf)
    path = _folder(c, "vectors")
    rows = c.table("embeddings").select(F.concat(F.lit("v"), "vec_id").alias("word"), finite_or_zero("embedding").alias("v"))
    rows.select(F.concat_ws(" ", "word", F.col("v").cast("array<string>")).alias("value")).write.text(path)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    return fl.read_word_vectors(spark, path, width)


@query("read_word_vectors", o.with_(VECTORS_SQL) + "SELECT word, dim, value FROM ev")
def q_read_word_vectors(spark, sf):
    rows = _vectors(spark, sf).select("word", F.posexplode("vec").alias("dim", "value"))
    return rows.withColumn("value", F.col("value").cast("double"))


@query("vector_lookup", o.with_(o.CORPUS, WV_SQL) + """
SELECT (SELECT count(*) FROM wv) AS vocabulary, (SELECT count(*) FROM wv JOIN embeddings e ON wv.id = e.vec_id + 2) AS matched""")
def q_vector_lookup(spark, sf):
    """The word vocabulary, and a file of vectors for its most frequent words."""
    c = chain(spark, sf)
    path = _folder(c, "word_vectors")
    vocab = word_vocab(spark, sf).select("term", "id")
    rows = c.table("embeddings").select((F.col("vec_id") + 2).alias("id"), finite_or_zero("embedding").alias("v")).join(vocab, "id")
    rows.select(F.concat_ws(" ", "term", F.col("v").cast("array<string>")).alias("value")).write.text(path)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    return fl.vector_lookup(vocab, fl.read_word_vectors(spark, path, width))[1].select("vocabulary", "matched")


def _other(sql: str) -> str:
    """The same CTEs over the other model's evaluation rows."""
    return re.sub(r"\b(grid|tc0|tc|best|tuned|c_eval)\b", r"\1_alt", sql)


SUMMARY_SQL = o.with_(*BASE, ALT, o.EVAL, o.eval_cte("_alt"), TC_SQL, BEST_SQL, TUNED_SQL, _other(TC_SQL), _other(BEST_SQL), _other(TUNED_SQL), """
s AS (SELECT model, CAST(2 * n + 2 AS BIGINT) AS trainable_params, threshold
      FROM (SELECT model, threshold FROM tuned UNION ALL SELECT model, threshold FROM tuned_alt) CROSS JOIN (SELECT count(*) AS n FROM c_idf))""")


def _summaries(spark, sf):
    """A run summary per Naive Bayes model: a probability per term and class and the class shares; its tuned threshold."""
    c = chain(spark, sf)
    path = _folder(c, "summaries")
    for alpha in (0.1, ALT_ALPHA):
        (tuned(spark, sf, alpha).select("model", F.lit(2 * c.n_terms() + 2).cast("long").alias("trainable_params"), "threshold")
         .coalesce(1).write.json(f"{path}/{alpha}_results.json"))
    return fl.read_run_summaries(spark, path)


@query("read_run_summaries", SUMMARY_SQL + "SELECT model, trainable_params, round(threshold, 8) AS threshold FROM s")
def q_read_run_summaries(spark, sf):
    return _summaries(spark, sf).select("model", "trainable_params", F.round("threshold", 8).alias("threshold"))


@query("model_size_table", SUMMARY_SQL + """
SELECT model, CAST(trainable_params AS DOUBLE) / 1000000 AS trainable_m, CAST(0 AS DOUBLE) AS ms_per_sample FROM s""")
def q_model_size_table(spark, sf):
    return fl.model_size_table(_summaries(spark, sf))


CONVERSATIONS_SQL = """
s_in AS (SELECT 'conversations' AS tbl, conv_id AS id, turn, text FROM conversations)"""


@query("score_stream", o.with_(*BASE, CONVERSATIONS_SQL, score_sql("s_in")) + f"""
SELECT id AS conv_id, turn, CASE WHEN {BLANK} THEN 0.0 ELSE round(y_prob, 6) END AS y_prob,
       CASE WHEN {BLANK} THEN '{tx.BLANK_VERDICT}' WHEN y_prob >= 0.5 THEN 'TOXIC' ELSE 'NOT TOXIC' END AS verdict
FROM s_prob""")
def q_score_stream(spark, sf):
    """The conversations as a stream of files, scored until none is left, and read back."""
    c = chain(spark, sf)
    path = _folder(c, "stream")
    # a pattern, so that a single file serves as well as a folder of them
    given = c.table("conversations").select("conv_id", "turn", "text")
    score_stream(spark, f"{sf.rstrip('/')}/conversations.parque[t]", given.schema, ["conv_id", "turn"], "text",
                 c.idf, c.nb_model(), f"{path}/sink", f"{path}/checkpoint", terms=c.n_terms()).awaitTermination()
    return spark.read.parquet(f"{path}/sink").select("conv_id", "turn", "y_prob", "verdict")


@query("fit_time_report", o.with_(*BASE) + f"""
SELECT model, split, CAST(n AS BIGINT) AS n, TRUE AS timed FROM (SELECT split, count(*) AS n FROM c_preds WHERE split = '{TEST}' GROUP BY split)
CROSS JOIN (VALUES ('{NB_NAME}'), ('{LR_NAME}'), ('{SVM_NAME}')) m(model)""")
def q_fit_time_report(spark, sf):
    """The English-test metric rows of all three models with their fit times (times aren't comparable: if known)."""
    from toxiscope.plans import linear_baselines as lb
    c = chain(spark, sf)
    rows = lb.comparison(c).filter(F.col("split") == TEST).join(F.broadcast(lb.fit_times(c)), "model", "left")
    return rows.select("model", "split", "n", F.col("train_time_s").isNotNull().alias("timed"))
