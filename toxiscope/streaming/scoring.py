"""Scoring unlabelled comments.

* ``score_texts`` -- relational: clean, postings, TF-IDF with the fitted
  vocabulary (broadcast if its measured size allows it), Naive Bayes join-sum.
* ``score_with_udf`` -- any ``texts -> probabilities`` model through
  ``predict_batch_udf``: Arrow batches, the model is built once per Python
  worker.  ``nb_batch_scorer`` packages the fitted Naive Bayes weights that
  way (the shape a neural scorer plugs into); texts are cleaned in the JVM.
* ``score_stream`` -- new comment files in a directory are scored with
  ``score_texts`` inside ``foreachBatch`` (per-document sums are
  aggregations, which a pure streaming plan would have to keep as state) and
  written idempotently per run and batch id, each key once; ``Trigger.AvailableNow`` drains what is
  there and stops.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from toxiscope.functions.text import CLEANERS, verdict, verdict_prob
from toxiscope.operators import features as fe
from toxiscope.operators import naive_bayes as nb


def score_texts(df: DataFrame, key_cols: list[str], text_col: str, idf: DataFrame,
                model: DataFrame, partitions: int | None = None, cleaner: str = "aggressive",
                terms: int | None = None) -> DataFrame:
    """df keys + (score, y_prob) for any text table; ``cleaner`` names one of ``CLEANERS``.

    The texts are hash-partitioned by key once; the postings aggregation,
    the per-document norm window, the per-document score sum and the final
    left join all require clustering by (a superset of) the key, so none of
    them shuffles the postings, which are several times larger than the text.

    ``partitions`` of the texts are measured unless given.
    ``terms`` is the model's measured number of terms: up to
    ``BROADCAST_ROWS`` it is broadcast.  A larger model, or one that wasn't
    measured, is joined as Catalyst sees fit (with its runtime bloom filter).
    """
    docs = df.select(*key_cols, text_col)
    docs = docs.repartition(partitions or fe.text_partitions(docs, F.length(text_col)), *key_cols)
    clean = docs.select(*key_cols, CLEANERS[cleaner](text_col).alias("clean"))
    post = fe.term_postings(clean, id_col=key_cols)
    w = fe.tfidf_transform(post, idf, id_col=key_cols, max_features=terms)
    return nb.nb_scores(w, model, docs, id_col=key_cols, max_features=terms)


def score_comments(df: DataFrame, key_cols: list[str], text_col: str, idf: DataFrame, model: DataFrame,
                   threshold: float = 0.5, cleaner: str = "aggressive", terms: int | None = None,
                   partitions: int | None = None) -> DataFrame:
    """keys + (y_prob, verdict): blank text short-circuits to the dash / 0.0."""
    s = score_texts(df, key_cols, text_col, idf, model, partitions, cleaner, terms)
    return s.select(*key_cols, F.round(verdict_prob(text_col, "y_prob"), 6).alias("y_prob"),
                    verdict(text_col, "y_prob", threshold).alias("verdict"))


# ---------------------------------------------------------------------------
# Pluggable batch scorer
# ---------------------------------------------------------------------------

def nb_batch_scorer(idf: DataFrame, model: DataFrame, most: int = fe.BROADCAST_ROWS):
    """``make_predict_fn`` for ``predict_batch_udf`` from a fitted Naive Bayes.

    It takes cleaned texts.  The model's terms go to the workers whole, so a
    model of more than ``most`` terms is refused (``score_texts`` joins
    instead).  A batch is one sparse product: all its n-grams are looked up
    together and summed by (text, term), then by text.
    """
    terms = (idf.select("term", "idf").join(model.select("term", "log_ratio", "prior"), "term")
                .limit(most + 1).toPandas())
    if len(terms) > most:
        raise ValueError(f"a model of more than {most} terms doesn't go to workers whole; use score_texts")
    prior = float(terms["prior"].iloc[0]) if len(terms) else 0.0
    payload = model.sparkSession.sparkContext.broadcast(
        (terms["term"].tolist(), terms["idf"].to_numpy(), terms["log_ratio"].to_numpy(), prior))

    def make_predict_fn():
        names, idf_v, ratio_v, prior_v = payload.value
        index = pd.Index(names)

        def predict(texts: np.ndarray) -> np.ndarray:
            tokens = pd.Series(texts).str.split(" ").explode()
            tokens = tokens[tokens.str.len() >= 2]
            text, token = tokens.index.to_numpy(), tokens.to_numpy(dtype=object)
            pair = text[1:] == text[:-1]
            grams = np.concatenate((token, token[:-1][pair] + " " + token[1:][pair]))
            owner = np.concatenate((text, text[:-1][pair]))
            term = index.get_indexer(grams)
            width = max(1, len(names))
            cells, tf = np.unique(owner[term >= 0] * width + term[term >= 0], return_counts=True)
            owner, term = cells // width, cells % width
            raw = (1.0 + np.log(tf)) * idf_v[term]
            norm = np.sqrt(np.bincount(owner, raw * raw, len(texts)))
            dot = np.bincount(owner, raw * ratio_v[term], len(texts)) / np.where(norm > 0, norm, 1.0)
            return 1.0 / (1.0 + np.exp(-np.round(prior_v + dot, nb.SCORE_DIGITS)))

        return predict

    return make_predict_fn


def score_with_udf(df: DataFrame, text_col: str, make_predict_fn, batch_size: int = 256,
                   out: str = "y_prob", cleaner: str = "aggressive") -> DataFrame:
    """df + ``out`` from a ``cleaned texts -> probabilities`` model (Arrow batches)."""
    udf = predict_batch_udf(make_predict_fn, return_type=DoubleType(), batch_size=batch_size)
    return df.withColumn(out, udf(CLEANERS[cleaner](text_col)))


def scoring_throughput(texts: DataFrame, order_col: str, text_col: str, idf: DataFrame,
                       model: DataFrame, n: int = 512) -> float:
    """Milliseconds per row to score the first ``n`` rows (by key), timed on
    the driver around one action; the sample is materialised first so only
    scoring is timed."""
    import time
    sample = texts.orderBy(order_col).limit(int(n)).select(order_col, text_col).cache()
    rows, parts = sample.count(), fe.text_partitions(sample, F.length(text_col))
    t0 = time.perf_counter()
    score_texts(sample, [order_col], text_col, idf, model, parts).write.format("noop").mode("overwrite").save()
    elapsed = time.perf_counter() - t0
    sample.unpersist()
    return 1000.0 * elapsed / max(rows, 1)


# ---------------------------------------------------------------------------
# Stream
# ---------------------------------------------------------------------------

#: Key buckets of the sink: a micro-batch of few keys reads the keys of few buckets.
SINK_BUCKETS = 16


def _written_keys(spark: SparkSession, sink_dir: str, key_cols: list[str], run: str, batch_id: int) -> DataFrame | None:
    """(bucket, keys) of all batches in the sink but this one; None where there is no sink yet."""
    try:
        rows = spark.read.parquet(sink_dir)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return rows.filter(~((F.col("run") == run) & (F.col("batch_id") == batch_id))).select("bucket", *key_cols)


def score_stream(spark: SparkSession, source_dir: str, schema, key_cols: list[str], text_col: str,
                 idf: DataFrame, model: DataFrame, sink_dir: str, checkpoint: str,
                 threshold: float = 0.5, fmt: str = "parquet", max_files: int | None = None,
                 cleaner: str = "aggressive", terms: int | None = None):
    """Start the stream; returns the StreamingQuery (AvailableNow trigger).

    A key is scored once, however many files or runs bring it: the sink is
    the memory.  A micro-batch's keys are anti-joined with the keys that the
    sink holds (of the batch's key buckets), so there is no state that grows
    with the stream, and none to lose: a run with a new checkpoint goes on
    where the sink ends.

    Each micro-batch is written to ``run=<id>/batch_id=<n>/bucket=<b>`` with
    overwrite, and its own rows don't count as written, so a batch replayed
    after a failure replaces its own output: the sink is idempotent and the
    checkpoint makes the source exactly-once.
    """
    sink_dir = sink_dir.rstrip("/")
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.load(source_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # the checkpoint's own id tells runs apart that number their batches alike
        run = session.read.json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]
        new = batch.dropDuplicates(key_cols).withColumn("bucket", F.pmod(F.xxhash64(*key_cols), F.lit(SINK_BUCKETS)).cast("int"))
        seen = _written_keys(session, sink_dir, key_cols, run, batch_id)
        if seen is not None:
            same = F.col("n.bucket") == F.col("s.bucket")
            for c in key_cols:
                same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}"))
            new = new.alias("n").join(seen.alias("s"), same, "left_anti")
        scored = score_comments(new, [*key_cols, "bucket"], text_col, idf, model, threshold, cleaner, terms,
                                fe.text_partitions(batch, F.length(text_col)))
        scored.write.mode("overwrite").partitionBy("bucket").parquet(f"{sink_dir}/run={run}/batch_id={batch_id}")

    return (stream.writeStream.foreachBatch(write_batch)
                  .option("checkpointLocation", checkpoint)
                  .trigger(availableNow=True).start())
