"""Queries that score tables: table scoring with verdicts, batch-UDF scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from toxiscope.functions import text as tx
from toxiscope.operators import features as fe
from toxiscope.plans import oracle as o
from toxiscope.plans.baselines import chain
from toxiscope.plans.catalog import query
from toxiscope.sources.tables import spread
from toxiscope.streaming.scoring import nb_batch_scorer, score_comments, score_with_udf

KEYS = ["tbl", "id", "turn"]


def _unlabelled(spark, sf):
    """Unlabelled documents (turn -1) and every conversation turn.

    Labels within ``BROADCAST_ROWS`` are broadcast.  Others are dealt into
    partitions of bounded text; where they aren't broadcast either, the texts
    follow them, however few the session shuffles into.  (An anti join goes
    below a ``repartition`` of its left side.)
    """
    c = chain(spark, sf)
    labels = c.table("labels").select("doc_id")
    rows = labels.count()
    labels = F.broadcast(labels) if rows <= fe.BROADCAST_ROWS else labels.repartition(c.join_partitions, "doc_id")
    docs = (c.table("documents").join(labels, "doc_id", "left_anti")
             .select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("id"),
                     F.lit(-1).cast("bigint").alias("turn"), "text"))
    conv = c.table("conversations").select(F.lit("conversations").alias("tbl"),
                                           F.col("conv_id").alias("id"), "turn", "text")
    return docs.unionByName(conv)


def score_sql(src: str) -> str:
    return f"""
s_tok AS (SELECT tbl, id, turn, text,
                 list_filter(string_split({o.aggressive_sql('text')}, ' '), lambda x: length(x) >= 2) AS tok
          FROM {src}),
s_terms AS (SELECT tbl, id, turn,
                   unnest(list_concat(tok, list_transform(range(1, len(tok)),
                                                          lambda i: tok[i] || ' ' || tok[i + 1]))) AS term
            FROM s_tok),
s_post AS (SELECT tbl, id, turn, term, count(*) AS tf FROM s_terms GROUP BY tbl, id, turn, term),
s_raw AS (SELECT p.tbl, p.id, p.turn, p.term, (1.0 + ln(CAST(p.tf AS DOUBLE))) * i.idf AS raw
          FROM s_post p JOIN c_idf i ON p.term = i.term),
s_w AS (SELECT tbl, id, turn, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY tbl, id, turn)) AS weight
        FROM s_raw),
s_dot AS (SELECT w.tbl, w.id, w.turn, sum(w.weight * n.log_ratio) AS dot
          FROM s_w w JOIN c_nb n ON w.term = n.term GROUP BY w.tbl, w.id, w.turn),
s_score AS (SELECT t.tbl, t.id, t.turn, t.text, round(p.prior + coalesce(d.dot, 0.0), 8) AS score
            FROM s_tok t LEFT JOIN s_dot d ON t.tbl = d.tbl AND t.id = d.id AND t.turn = d.turn
            CROSS JOIN c_prior p),
s_prob AS (SELECT *, 1.0 / (1.0 + exp(-score)) AS y_prob FROM s_score)"""


UNLABELLED_SQL = """
s_in AS (SELECT 'documents' AS tbl, d.doc_id AS id, CAST(-1 AS BIGINT) AS turn, d.text
         FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
         UNION ALL SELECT 'conversations' AS tbl, conv_id AS id, turn, text FROM conversations)"""

BLANK = f"regexp_full_match(coalesce(text, ''), '[{tx.SPACE_CHARS}]*')"


@query("score_comments", o.with_(o.CORPUS, o.FEATURES, o.NB, UNLABELLED_SQL, score_sql("s_in")) + f"""
SELECT tbl, id, turn, CASE WHEN {BLANK} THEN 0.0 ELSE round(y_prob, 6) END AS y_prob,
       CASE WHEN {BLANK} THEN '{tx.BLANK_VERDICT}' WHEN y_prob >= 0.5 THEN 'TOXIC' ELSE 'NOT TOXIC' END AS verdict
FROM s_prob""")
def q_score_comments(spark, sf):
    """Unlabelled documents and conversation turns: clean -> probability -> verdict."""
    c = chain(spark, sf)
    # of all texts, so that measuring takes no join
    texts = c.table("documents").select("text").unionByName(c.table("conversations").select("text"))
    return score_comments(_unlabelled(spark, sf), KEYS, "text", c.idf, c.nb_model(), terms=c.n_terms(),
                          partitions=fe.text_partitions(texts, F.length("text")))


DOCS_SQL = "s_in AS (SELECT 'documents' AS tbl, doc_id AS id, CAST(-1 AS BIGINT) AS turn, text FROM documents)"


@query("score_batch", o.with_(o.CORPUS, o.FEATURES, o.NB, DOCS_SQL, score_sql("s_in")) + """
SELECT id AS doc_id, round(y_prob, 6) AS y_prob FROM s_prob""")
def q_score_batch(spark, sf):
    """Every document scored through the batch-UDF interface (the model is
    a ``texts -> probabilities`` callable built once per worker)."""
    c = chain(spark, sf)
    fn = nb_batch_scorer(c.idf, c.nb_model())
    docs = spread(c.table("documents"), "doc_id").select("doc_id", "text")
    return score_with_udf(docs, "text", fn).select("doc_id", F.round("y_prob", 6).alias("y_prob"))
