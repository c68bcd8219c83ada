"""The same model under each cleaner, the weighted likelihood, and texts that several splits share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toxiscope.functions import text as tx
from toxiscope.operators import evaluation as ev
from toxiscope.operators import features as fe
from toxiscope.operators import naive_bayes as nb
from toxiscope.plans import oracle as o
from toxiscope.plans.baselines import NB_NAME, TEST, TRAIN, VAL, Chain, chain
from toxiscope.plans.catalog import query
from toxiscope.plans.linear_baselines import class_weight

TOKEN_RE = tx.WORD_CHAR + "+"
BY = ["cleaner"]


def ablation_predictions(c: Chain) -> DataFrame:
    """(model, split, lang, doc_id, y_true, score, y_prob): a Naive Bayes per cleaner, all in one chain keyed by ``cleaner``.

    A text is read once and cleaned in all ways; vocabulary, idf, weights and
    model carry the cleaner as one more key.  Postings and weights are written
    in buckets of the document, like the chain's, so a task holds as little
    and the norm takes no exchange.
    """
    def buckets():
        # no cleaner makes a text longer
        return c.buckets_for(c.splits, F.length("text") * len(tx.CLEANERS))
    def cleaned():
        variants = F.explode(F.array(*[F.struct(F.lit(name).alias("cleaner"), fn("text").alias("clean"))
                                       for name, fn in tx.CLEANERS.items()])).alias("v")
        rows = c.splits.select("doc_id", "split", "lang", "toxic", variants)
        return rows.select("v.cleaner", "doc_id", "split", "lang", "toxic", "v.clean")

    def postings():
        docs = cleaned().select("cleaner", "doc_id", "split", "toxic", "clean").repartition(n, "doc_id")
        return fe.term_postings(docs, id_col=["cleaner", "doc_id"], keep=["split", "toxic"], tokens=tx.vector_tokens)

    def build():
        post = c._get("ablation_postings", postings, keep="bucketed", buckets=n)
        stats = c.sums("ablation_term_stats", post, n, BY)
        idf = c._get("ablation_idf", lambda: fe.tfidf_fit(stats, c.n_train, by=BY), keep="checkpoint")
        terms = c._get("ablation_terms", idf.count)
        weights = c._get("ablation_weights", lambda: fe.tfidf_transform(post, idf, ["cleaner", "doc_id"], terms, BY), keep="bucketed", buckets=n)
        labels = c.cleaned.filter(F.col("split") == TRAIN).select("toxic")
        model = c._get("ablation_nb", lambda: nb.nb_fit(weights.filter(F.col("split") == TRAIN), labels, idf, by=BY), keep="checkpoint")
        docs = c.cleaned.filter(F.col("split").isin(TEST, VAL)).select(
            F.explode(F.array(*[F.lit(name) for name in tx.CLEANERS])).alias("cleaner"), "doc_id", "split", "lang", F.col("toxic").alias("y_true"))
        held = weights.filter(F.col("split").isin(TEST, VAL)).select("cleaner", "doc_id", "term", "weight")
        scored = nb.nb_scores(held, model, docs, ["cleaner", "doc_id"], terms, BY)
        return scored.select(F.col("cleaner").alias("model"), "split", "lang", "doc_id", "y_true", "score", "y_prob")
    n = c._get("ablation_buckets", buckets)
    return c._get("ablation_pred", build, keep="checkpoint")


ABLATION_SQL = f"""
b_clean AS (SELECT 'aggressive' AS cleaner, doc_id, split, {o.aggressive_sql('text')} AS clean FROM c_splits
      UNION ALL SELECT 'light', doc_id, split, {o.light_sql('text')} FROM c_splits
      UNION ALL SELECT 'none', doc_id, split, coalesce(text, '') FROM c_splits),
b_tok AS (SELECT cleaner, doc_id, split, list_filter(regexp_extract_all(lower(clean), '{TOKEN_RE}'), lambda x: length(x) >= 2) AS tok FROM b_clean),
b_post AS (SELECT cleaner, doc_id, split, term, count(*) AS tf FROM (
             SELECT cleaner, doc_id, split, unnest(list_concat(tok, list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1]))) AS term
             FROM b_tok) GROUP BY ALL),
b_idf AS (SELECT cleaner, term, ln((CAST(n_docs AS DOUBLE) + 1.0) / (CAST(df AS DOUBLE) + 1.0)) + 1.0 AS idf
          FROM (SELECT cleaner, term, sum(tf) AS tot, count(*) AS df FROM b_post WHERE split = 'train' GROUP BY cleaner, term
                QUALIFY row_number() OVER (PARTITION BY cleaner ORDER BY sum(tf) DESC, term) <= 50000) CROSS JOIN c_ntrain),
b_raw AS (SELECT p.cleaner, p.doc_id, p.split, p.term, (1.0 + ln(CAST(p.tf AS DOUBLE))) * i.idf AS raw
          FROM b_post p JOIN b_idf i ON p.cleaner = i.cleaner AND p.term = i.term),
b_w AS (SELECT cleaner, doc_id, split, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY cleaner, doc_id)) AS weight FROM b_raw),
b_cls AS (SELECT i.cleaner, i.term, sum(CASE WHEN c.toxic = 0 THEN w.weight ELSE 0.0 END) AS w0,
                 sum(CASE WHEN c.toxic = 1 THEN w.weight ELSE 0.0 END) AS w1
          FROM b_idf i JOIN b_w w ON w.cleaner = i.cleaner AND w.term = i.term AND w.split = 'train' JOIN c_clean c ON c.doc_id = w.doc_id
          GROUP BY i.cleaner, i.term),
b_nb AS (SELECT cleaner, term, ln(w1 + 0.1) - ln(sum(w1) OVER p + 0.1 * count(*) OVER p)
                             - ln(w0 + 0.1) + ln(sum(w0) OVER p + 0.1 * count(*) OVER p) AS log_ratio
         FROM b_cls WINDOW p AS (PARTITION BY cleaner)),
b_dot AS (SELECT w.cleaner, w.doc_id, sum(w.weight * n.log_ratio) AS dot FROM b_w w JOIN b_nb n ON w.cleaner = n.cleaner AND w.term = n.term
          WHERE w.split <> 'train' GROUP BY w.cleaner, w.doc_id),
b_preds AS (SELECT k.cleaner AS model, c.split, c.lang, c.doc_id, c.toxic AS y_true, round(p.prior + coalesce(d.dot, 0.0), 8) AS score,
                   1.0 / (1.0 + exp(-round(p.prior + coalesce(d.dot, 0.0), 8))) AS y_prob
            FROM c_clean c CROSS JOIN (SELECT DISTINCT cleaner FROM b_clean) k CROSS JOIN c_prior p
            LEFT JOIN b_dot d ON d.doc_id = c.doc_id AND d.cleaner = k.cleaner WHERE c.split <> 'train'),
b_eval AS (SELECT * FROM b_preds UNION ALL SELECT model, 'Val-' || lang, lang, doc_id, y_true, score, y_prob FROM b_preds
           WHERE split = 'Multilingual Val')"""


@query("cleaning_ablation_metrics", o.with_(o.CORPUS, o.FEATURES, o.NB, ABLATION_SQL) + f"""
SELECT model AS cleaner, split, n, threshold, auc_roc, f1, accuracy, precision, recall
FROM ({o.metrics_select('b_eval', ['model', 'split'])})""")
def q_cleaning_ablation_metrics(spark, sf):
    """Metric rows per cleaner, evaluation split and language."""
    return ev.evaluate_splits(ablation_predictions(chain(spark, sf))).withColumnRenamed("model", "cleaner")


WEIGHT_SQL = "(SELECT (1.0 - avg(toxic::DOUBLE)) / greatest(avg(toxic::DOUBLE), CAST(1e-6 AS DOUBLE)) FROM c_clean WHERE split = 'train')"


def weighted_nb(c: Chain) -> DataFrame:
    """Naive Bayes whose toxic documents count (1 - p) / p times."""
    def build():
        labels = c.cleaned.filter(F.col("split") == TRAIN).select("toxic")
        return nb.nb_fit(c.weights.filter(F.col("split") == TRAIN), labels, c.idf, pos_weight=class_weight(c))
    return c._get("weighted_nb", build, keep="checkpoint")


@query("weighted_nb_fit", o.with_(o.CORPUS, o.FEATURES, o.NB) + f"""
SELECT term, idx, round(logp0, 8) AS logp0, round(ln(v * w1 + 0.1) - ln(v * sum(w1) OVER () + 0.1 * count(*) OVER ()), 8) AS logp1,
       round(prior + ln(v), 8) AS prior
FROM c_nb CROSS JOIN (SELECT {WEIGHT_SQL} AS v)""")
def q_weighted_nb_fit(spark, sf):
    m = weighted_nb(chain(spark, sf))
    return m.select("term", "idx", *[F.round(x, 8).alias(x) for x in ("logp0", "logp1", "prior")])


@query("weighted_nb_metrics", o.with_(o.CORPUS, o.FEATURES, o.NB, f"""
v_nb AS (SELECT term, ln(v * w1 + 0.1) - ln(v * sum(w1) OVER () + 0.1 * count(*) OVER ()) - logp0 AS log_ratio, prior + ln(v) AS prior
         FROM c_nb CROSS JOIN (SELECT {WEIGHT_SQL} AS v)),
v_dot AS (SELECT w.doc_id, sum(w.weight * n.log_ratio) AS dot FROM c_w w JOIN v_nb n ON w.term = n.term WHERE w.split <> 'train' GROUP BY w.doc_id),
v_preds AS (SELECT '{NB_NAME} (class weight)' AS model, c.split, c.lang, c.toxic AS y_true, round(p.prior + coalesce(d.dot, 0.0), 8) AS score,
                   1.0 / (1.0 + exp(-round(p.prior + coalesce(d.dot, 0.0), 8))) AS y_prob
            FROM c_clean c LEFT JOIN v_dot d ON d.doc_id = c.doc_id CROSS JOIN (SELECT max(prior) AS prior FROM v_nb) p WHERE c.split <> 'train'),
v_eval AS (SELECT * FROM v_preds UNION ALL SELECT model, 'Val-' || lang, lang, y_true, score, y_prob FROM v_preds WHERE split = 'Multilingual Val')
""") + o.metrics_select("v_eval", ["model", "split"]))
def q_weighted_nb_metrics(spark, sf):
    """Metric rows of the weighted Naive Bayes."""
    c = chain(spark, sf)
    docs = c.cleaned.filter(F.col("split").isin(TEST, VAL)).select("doc_id", "split", "lang", F.col("toxic").alias("y_true"))
    held = c.weights.filter(F.col("split").isin(TEST, VAL)).select("doc_id", "term", "weight")
    preds = nb.nb_scores(held, weighted_nb(c), docs).withColumn("model", F.lit(f"{NB_NAME} (class weight)"))
    return ev.evaluate_splits(preds)


@query("shared_texts", o.with_(o.CORPUS) + """
SELECT a.split AS split, b.split AS other, count(*) AS n_texts, CAST(sum(a.n) AS BIGINT) AS n_docs
FROM (SELECT split, clean, count(*) AS n FROM c_clean GROUP BY split, clean) a
JOIN (SELECT DISTINCT split, clean FROM c_clean) b ON a.clean = b.clean AND a.split <> b.split GROUP BY a.split, b.split""")
def q_shared_texts(spark, sf):
    """How many cleaned texts, and documents of ``split`` with them, another split holds as well.

    Texts are compared by their SHA-256; a text is one row per split before
    the splits meet, however many copies it has.
    """
    per = (chain(spark, sf).cleaned.groupBy(F.sha2("clean", 256).alias("text"), "split").agg(F.count(F.lit(1)).alias("n"))
           .groupBy("text").agg(F.collect_list(F.struct("split", "n")).alias("s")).filter(F.size("s") > 1))   # a few splits
    pairs = per.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).filter("a.split <> b.split")
    return pairs.groupBy(F.col("a.split").alias("split"), F.col("b.split").alias("other")).agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum("a.n").alias("n_docs"))
