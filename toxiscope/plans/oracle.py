"""DuckDB SQL for the correctness gate.

Each statement is written from the operator's definition, not from the Spark
plan: plain window functions and joins over the pre-registered views
(``documents``, ``labels``, ``embeddings``, ``pages``, ``conversations`` ...).
Shared CTEs build the labelled corpus, the split, TF-IDF, Naive Bayes and
predictions; rounding of ratios is exact integer half-up as on the Spark side.
"""

from __future__ import annotations

from toxiscope.functions.text import SPACE_CHARS, TAG_PATTERN, URL_PATTERN

URL = URL_PATTERN
WS = f"[{SPACE_CHARS}]+"


def ratio(num: str, den: str, digits: int = 4, null_on_zero: bool = False) -> str:
    scale = 10 ** digits
    zero = "CAST(NULL AS DOUBLE)" if null_on_zero else "0.0"
    return (f"(CASE WHEN ({den}) = 0 THEN {zero} ELSE CAST((CAST({num} AS HUGEINT) * {2 * scale} "
            f"+ ({den})) // (CAST({den} AS HUGEINT) * 2) AS DOUBLE) / {scale}.0 END)")


def aggressive_sql(col: str) -> str:
    t = f"lower(coalesce({col}, ''))"
    t = f"regexp_replace({t}, '{URL}', '', 'g')"
    t = f"regexp_replace({t}, '{TAG_PATTERN}', '', 'g')"
    t = f"regexp_replace({t}, '[^a-z0-9]+', ' ', 'g')"
    return f"trim({t})"


def light_sql(col: str) -> str:
    t = f"coalesce({col}, '')"
    t = f"regexp_replace({t}, '{URL}', '', 'g')"
    t = f"regexp_replace({t}, '{TAG_PATTERN}', '', 'g')"
    t = f"regexp_replace({t}, '{WS}', ' ', 'g')"
    return f"trim({t})"


def quota_ctes(src: str, prefix: str, draws_sql: str, label: str = "toxic") -> str:
    """Largest-remainder allocation of ``draws`` over the classes of ``src``.

    ``draws_sql`` may reference ``n`` (rows of src).  Yields ``{prefix}_take``
    (label, cnt, take).
    """
    return f"""
{prefix}_cls AS (SELECT {label}, count(*) AS cnt FROM {src} GROUP BY {label}),
{prefix}_a AS (SELECT {label}, cnt, n, {draws_sql} AS draws
               FROM (SELECT {label}, cnt, sum(cnt) OVER () AS n FROM {prefix}_cls)),
{prefix}_b AS (SELECT *, CAST(cnt AS HUGEINT) * draws AS prod FROM {prefix}_a),
{prefix}_c AS (SELECT *, prod // n AS fl, draws - sum(prod // n) OVER () AS need,
                      row_number() OVER (ORDER BY prod % n DESC, {label}) AS rr
               FROM {prefix}_b),
{prefix}_take AS (SELECT {label}, cnt, CAST(fl AS BIGINT) + CASE WHEN rr <= need THEN 1 ELSE 0 END AS take
                  FROM {prefix}_c)"""


def hash_sql(id_col: str, seed: str = "42") -> str:
    return f"md5('{seed}:' || CAST({id_col} AS VARCHAR))"


CORPUS = f"""
c_comments AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
               FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
c_en AS (SELECT * FROM c_comments WHERE lang = 'en' AND toxic IS NOT NULL),
{quota_ctes('c_en', 'q', "n - CAST(ceil(CAST(0.2 AS DOUBLE) * n) AS BIGINT)")},
c_ranked AS (SELECT e.*, row_number() OVER (PARTITION BY e.toxic ORDER BY {hash_sql('e.doc_id')}, e.doc_id) AS rn
             FROM c_en e),
c_splits AS (
  SELECT r.doc_id, r.text, r.lang, r.source, r.n_chars, r.quality, r.toxic,
         CASE WHEN r.rn <= q.cnt - q.take THEN 'English Test (20%)' ELSE 'train' END AS split
  FROM c_ranked r JOIN q_take q ON r.toxic = q.toxic
  UNION ALL
  SELECT doc_id, text, coalesce(lang, 'und') AS lang, source, n_chars, quality, toxic, 'Multilingual Val' AS split
  FROM c_comments WHERE lang IS DISTINCT FROM 'en' AND toxic IS NOT NULL),
c_clean AS (SELECT doc_id, split, lang, toxic, {aggressive_sql('text')} AS clean FROM c_splits)"""

FEATURES = """
c_tok AS (SELECT doc_id, split, list_filter(string_split(clean, ' '), lambda x: length(x) >= 2) AS tok
          FROM c_clean),
c_terms AS (SELECT doc_id, split,
                   unnest(list_concat(tok, list_transform(range(1, len(tok)),
                                                          lambda i: tok[i] || ' ' || tok[i + 1]))) AS term
            FROM c_tok),
c_post AS (SELECT doc_id, split, term, count(*) AS tf FROM c_terms GROUP BY doc_id, split, term),
c_ntrain AS (SELECT count(*) AS n_docs FROM c_clean WHERE split = 'train'),
c_vocab AS (SELECT term, CAST(sum(tf) AS BIGINT) AS tot, count(*) AS df FROM c_post WHERE split = 'train'
            GROUP BY term ORDER BY tot DESC, term LIMIT 50000),
c_idf AS (SELECT v.term, v.tot, v.df, CAST(row_number() OVER (ORDER BY v.term) - 1 AS INTEGER) AS idx,
                 ln((CAST(n.n_docs AS DOUBLE) + 1.0) / (CAST(v.df AS DOUBLE) + 1.0)) + 1.0 AS idf
          FROM c_vocab v CROSS JOIN c_ntrain n),
c_raw AS (SELECT p.doc_id, p.split, p.term, i.idx, (1.0 + ln(CAST(p.tf AS DOUBLE))) * i.idf AS raw
          FROM c_post p JOIN c_idf i ON p.term = i.term),
c_w AS (SELECT doc_id, split, term, idx, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight
        FROM c_raw)"""


def nb_ctes(alpha: float = 0.1, suffix: str = "", model: str = "TF-IDF + Naive Bayes") -> str:
    a = f"CAST({alpha!r} AS DOUBLE)"
    s = suffix
    return f"""
c_clsw{s} AS (SELECT w.term,
                 sum(CASE WHEN c.toxic = 0 THEN w.weight ELSE 0.0 END) AS w0,
                 sum(CASE WHEN c.toxic = 1 THEN w.weight ELSE 0.0 END) AS w1
          FROM c_w w JOIN c_clean c ON w.doc_id = c.doc_id
          WHERE w.split = 'train' GROUP BY w.term),
c_nb0{s} AS (SELECT i.term, i.idx, coalesce(x.w0, 0.0) AS w0, coalesce(x.w1, 0.0) AS w1
         FROM c_idf i LEFT JOIN c_clsw{s} x ON i.term = x.term),
c_nb1{s} AS (SELECT term, idx, w0, w1,
                ln(w0 + {a}) - ln(sum(w0) OVER () + {a} * count(*) OVER ()) AS logp0,
                ln(w1 + {a}) - ln(sum(w1) OVER () + {a} * count(*) OVER ()) AS logp1
         FROM c_nb0{s}),
c_prior{s} AS (SELECT ln(CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS DOUBLE))
                  - ln(CAST(sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) AS DOUBLE)) AS prior
           FROM c_clean WHERE split = 'train'),
c_nb{s} AS (SELECT n.*, n.logp1 - n.logp0 AS log_ratio, p.prior FROM c_nb1{s} n CROSS JOIN c_prior{s} p),
c_dot{s} AS (SELECT w.doc_id, sum(w.weight * n.log_ratio) AS dot
         FROM c_w w JOIN c_nb{s} n ON w.term = n.term WHERE w.split <> 'train' GROUP BY w.doc_id),
c_pred{s} AS (SELECT '{model}' AS model, c.split, c.lang, c.doc_id, c.toxic AS y_true,
                 round(p.prior + coalesce(d.dot, 0.0), 8) AS score
          FROM c_clean c LEFT JOIN c_dot{s} d ON c.doc_id = d.doc_id CROSS JOIN c_prior{s} p
          WHERE c.split <> 'train'),
c_preds{s} AS (SELECT *, 1.0 / (1.0 + exp(-score)) AS y_prob FROM c_pred{s})"""


NB = nb_ctes()

def eval_cte(suffix: str = "") -> str:
    s = suffix
    return f"""
c_eval{s} AS (SELECT model, split, lang, doc_id, y_true, score, y_prob FROM c_preds{s}
           UNION ALL
           SELECT model, 'Val-' || lang AS split, lang, doc_id, y_true, score, y_prob
           FROM c_preds{s} WHERE split = 'Multilingual Val')"""


EVAL = eval_cte()


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p.strip().rstrip(",") for p in parts if p.strip()) + "\n"


def conf_select(src: str, groups: str, thr: str = "CAST(0.5 AS DOUBLE)", prob: str = "y_prob") -> str:
    return f"""SELECT {groups}, count(*) AS n,
       sum(CASE WHEN {prob} >= {thr} AND y_true = 1 THEN 1 ELSE 0 END) AS tp,
       sum(CASE WHEN {prob} >= {thr} AND y_true <> 1 THEN 1 ELSE 0 END) AS fp,
       sum(CASE WHEN {prob} < {thr} AND y_true = 1 THEN 1 ELSE 0 END) AS fn,
       sum(CASE WHEN {prob} < {thr} AND y_true <> 1 THEN 1 ELSE 0 END) AS tn
FROM {src} GROUP BY {groups}"""


def auc_select(src: str, groups: str, score: str = "score") -> str:
    return f"""SELECT {groups}, sum(pos) AS n_pos, sum(neg) AS n_neg,
       {ratio('sum(CAST(pos AS HUGEINT) * (2 * (cum_neg - neg) + neg))', '2 * sum(pos) * sum(neg)', null_on_zero=True)} AS auc_roc
FROM (SELECT *, sum(neg) OVER (PARTITION BY {groups} ORDER BY {score}
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg
      FROM (SELECT {groups}, {score}, sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS pos,
                   sum(CASE WHEN y_true = 1 THEN 0 ELSE 1 END) AS neg
            FROM {src} GROUP BY {groups}, {score}))
GROUP BY {groups}"""


def rates_sql() -> str:
    return (f"{ratio('2 * tp', '2 * tp + fp + fn')} AS f1, "
            f"{ratio('tp + tn', 'tp + fp + fn + tn')} AS accuracy, "
            f"{ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall")


def metrics_select(src: str, groups: list[str], thr: str = "CAST(0.5 AS DOUBLE)") -> str:
    g = ", ".join(groups)
    on = " AND ".join(f"c.{x} = a.{x}" for x in groups)
    cols = ", ".join(f"c.{x}" for x in groups)
    return f"""SELECT {cols}, c.n, {thr} AS threshold, a.auc_roc, {rates_sql()}
FROM ({conf_select(src, g, thr)}) c JOIN ({auc_select(src, g)}) a ON {on}"""


# ---------------------------------------------------------------------------
# Linear models: the minimum from its dual form
# ---------------------------------------------------------------------------

# At the minimum w is a combination of the training rows, so the whole search
# runs on one number per row: margins are K a with K = X X^T + 1 (the
# intercept is the weight of a constant 1).  Accelerated gradient steps with
# the step size of the largest row sum of K.

KERNEL = """
k_doc AS MATERIALIZED (SELECT r.doc_id, r.toxic,
         CAST((CASE WHEN r.rn - 1 >= a.a0 THEN 1 ELSE 0 END) + (CASE WHEN r.rn - 1 >= a.a0 + a.a1 THEN 1 ELSE 0 END) AS INTEGER) AS fold,
         row_number() OVER (ORDER BY r.doc_id) AS i
  FROM (SELECT t.*, row_number() OVER (PARTITION BY t.toxic ORDER BY md5('42:' || CAST(t.doc_id AS VARCHAR)), t.doc_id) AS rn
        FROM c_clean t WHERE split = 'train') r
  JOIN (SELECT toxic, floor((s + cnt + 2) / 3) - floor((s + 2) / 3) AS a0, floor((s + cnt + 1) / 3) - floor((s + 1) / 3) AS a1
        FROM (SELECT toxic, cnt, coalesce(sum(cnt) OVER (ORDER BY toxic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
              FROM (SELECT toxic, count(*) AS cnt FROM c_clean WHERE split = 'train' GROUP BY toxic))) a ON a.toxic = r.toxic),
k_x AS MATERIALIZED (SELECT d.i, w.idx, w.term, w.weight FROM k_doc d JOIN c_w w ON w.doc_id = d.doc_id),
k_dot AS (SELECT x.i, y.i AS j, sum(x.weight * y.weight) AS dot FROM k_x x JOIN k_x y ON x.idx = y.idx GROUP BY x.i, y.i),
k_row AS MATERIALIZED (SELECT d.i, d.toxic, d.fold, CASE WHEN d.toxic = 1 THEN 1.0 ELSE -1.0 END AS s,
                list(1.0 + coalesce(o.dot, 0.0) ORDER BY e.i) AS k, sum(1.0 + coalesce(o.dot, 0.0)) AS rowsum
         FROM k_doc d CROSS JOIN k_doc e LEFT JOIN k_dot o ON o.i = d.i AND o.j = e.i GROUP BY d.i, d.toxic, d.fold),
k_pos AS (SELECT avg(CAST(toxic AS DOUBLE)) AS p FROM k_doc)"""


def linear_ctes(models: list[tuple], steps: int) -> str:
    """CTEs ``l_a`` (m, i, a), ``l_coef`` (m, term, idx, coef) and ``l_b`` (m, b) of the models
    (m, loss, cost SQL over a row of k_row, bound of the loss's curvature as SQL)."""
    rows = " UNION ALL ".join(
        f"SELECT {m} AS m, '{loss}' AS loss, r.i, r.s, r.k, {cost} AS c, {bend} * max({cost}) OVER () * max(r.rowsum) OVER () AS bend "
        f"FROM k_row r CROSS JOIN k_pos" for m, loss, cost, bend in models)
    return f"""
l_row AS MATERIALIZED (SELECT *, 1.0 / (1.0 + bend) AS eta, (sqrt(1.0 + bend) - 1.0) / (sqrt(1.0 + bend) + 1.0) AS beta FROM ({rows})),
l_step(step, m, a, v) AS (
  SELECT 0, m, list(0.0::DOUBLE ORDER BY i), list(0.0::DOUBLE ORDER BY i) FROM l_row GROUP BY m
  UNION ALL
  SELECT step + 1, m, list(na ORDER BY i), list(na + beta * (na - oa) ORDER BY i)
  FROM (SELECT step, m, i, beta, oa, vi - eta * (vi + c * s * (CASE WHEN loss = 'logistic' THEN -1.0 / (1.0 + exp(z))
                                                                    ELSE -2.0 * greatest(0.0, 1.0 - z) END)) AS na
        FROM (SELECT l.step, l.m, r.i, r.c, r.s, r.eta, r.beta, r.loss, l.a[r.i] AS oa, l.v[r.i] AS vi,
                     r.s * list_dot_product(r.k, l.v) AS z FROM l_step l JOIN l_row r ON r.m = l.m WHERE l.step < {steps}))
  GROUP BY step, m),
l_a AS MATERIALIZED (SELECT m, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS a FROM l_step WHERE step = {steps}),
l_coef AS MATERIALIZED (SELECT a.m, x.term, x.idx, sum(a.a * x.weight) AS coef FROM l_a a JOIN k_x x ON x.i = a.i GROUP BY a.m, x.term, x.idx),
l_b AS MATERIALIZED (SELECT m, sum(a) AS b FROM l_a GROUP BY m)"""


def with_recursive(*parts: str) -> str:
    return with_(*parts).replace("WITH ", "WITH RECURSIVE ", 1)
