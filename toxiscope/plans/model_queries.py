"""Queries over features and models: TF-IDF, Naive Bayes, vocabularies,
encodings and the sampling operators that feed them."""

from __future__ import annotations

from pyspark.sql import functions as F

from toxiscope.functions import text as tx
from toxiscope.operators import features as fe
from toxiscope.operators import sampling as sm
from toxiscope.plans import oracle as o
from toxiscope.plans.baselines import LR_NAME, SVM_NAME, TRAIN, VAL, chain
from toxiscope.plans.catalog import query

BASE = (o.CORPUS, o.FEATURES)
TOKEN_RE = tx.WORD_CHAR + "+"


def _r8(c):
    return F.round(c, 8)


@query("tfidf_fit", o.with_(*BASE) + """
SELECT term, tot, df, idx, round(idf, 8) AS idf FROM c_idf""")
def q_tfidf_fit(spark, sf):
    return chain(spark, sf).idf.select("term", "tot", "df", "idx", _r8(F.col("idf")).alias("idf"))


@query("feature_vocabulary", o.with_(*BASE) + "SELECT term, tot, df, idx FROM c_idf")
def q_feature_vocabulary(spark, sf):
    return chain(spark, sf).idf.select("term", "tot", "df", "idx")


@query("document_frequency", o.with_(*BASE) + """
SELECT term, count(*) AS df FROM c_post WHERE split = 'train' GROUP BY term""")
def q_document_frequency(spark, sf):
    return chain(spark, sf).term_stats.select("term", "df")


@query("tfidf_transform", o.with_(*BASE) + """
SELECT doc_id, term, idx, round(weight, 8) AS weight FROM c_w""")
def q_tfidf_transform(spark, sf):
    return chain(spark, sf).weights.select("doc_id", "term", "idx", _r8(F.col("weight")).alias("weight"))


@query("vocab_lookup", o.with_(*BASE) + """
SELECT p.doc_id, p.term, p.tf FROM c_post p JOIN c_idf i ON p.term = i.term WHERE p.split <> 'train'""")
def q_vocab_lookup(spark, sf):
    """Held-out postings restricted to the fitted vocabulary (others dropped)."""
    c = chain(spark, sf)
    held = c.postings.filter(F.col("split") != TRAIN)
    return held.join(fe.small(c.idf.select("term"), fe.MAX_FEATURES), "term").select("doc_id", "term", "tf")


@query("class_term_weights", o.with_(*BASE) + """
SELECT c.toxic, w.term, round(sum(w.weight), 8) AS weight
FROM c_w w JOIN c_clean c ON w.doc_id = c.doc_id WHERE w.split = 'train' GROUP BY c.toxic, w.term""")
def q_class_term_weights(spark, sf):
    w = chain(spark, sf).weights.filter(F.col("split") == TRAIN)
    return w.groupBy("toxic", "term").agg(_r8(F.sum("weight")).alias("weight"))


@query("nb_fit", o.with_(*BASE, o.NB) + """
SELECT term, idx, round(logp0, 8) AS logp0, round(logp1, 8) AS logp1, round(log_ratio, 8) AS log_ratio
FROM c_nb""")
def q_nb_fit(spark, sf):
    m = chain(spark, sf).nb_model()
    return m.select("term", "idx", *[_r8(F.col(c)).alias(c) for c in ("logp0", "logp1", "log_ratio")])


@query("nb_predict", o.with_(*BASE, o.NB) + """
SELECT doc_id, split, score, round(y_prob, 8) AS y_prob FROM c_preds""")
def q_nb_predict(spark, sf):
    p = chain(spark, sf).nb_predictions()
    return p.select("doc_id", "split", "score", _r8(F.col("y_prob")).alias("y_prob"))


@query("top_features", o.with_(*BASE, o.NB) + """
SELECT direction, CAST(rank AS INTEGER) AS rank, term, round(weight, 4) AS weight FROM (
  SELECT 'toxic' AS direction, term, log_ratio AS weight,
         row_number() OVER (ORDER BY round(log_ratio, 8) DESC, term) AS rank FROM c_nb
  UNION ALL
  SELECT 'non_toxic' AS direction, term, log_ratio AS weight,
         row_number() OVER (ORDER BY round(log_ratio, 8), term) AS rank FROM c_nb)
WHERE rank <= 30""")
def q_top_features(spark, sf):
    from toxiscope.operators.models import top_features
    m = chain(spark, sf).nb_model().select("term", F.col("log_ratio").alias("coef"))
    return top_features(m, 30)


@query("explain_document", o.with_(*BASE, o.NB, """
ct AS (SELECT w.doc_id, w.term, round(w.weight * n.log_ratio, 8) AS contribution
       FROM c_w w JOIN c_nb n ON w.term = n.term WHERE w.split <> 'train'),
tot AS (SELECT doc_id, CAST(round(sum(CAST(contribution AS DECIMAL(18,8))), 6) AS DOUBLE) AS total FROM ct GROUP BY doc_id)""") + """
SELECT r.doc_id, CAST(r.rank AS INTEGER) AS rank, r.term, round(r.contribution, 6) AS contribution, t.total
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY contribution DESC, term) AS rank FROM ct) r
JOIN tot t ON r.doc_id = t.doc_id WHERE r.rank <= 10""")
def q_explain_document(spark, sf):
    from toxiscope.operators.compare import explain_documents
    c = chain(spark, sf)
    w = c.weights.filter(F.col("split") != TRAIN)
    coef = c.nb_model().select("term", F.col("log_ratio").alias("coef"))
    return explain_documents(w, coef, k=10, terms=c.n_terms())


# ------------------------------------------------ word vocabulary / encoding --

def light_tok(col: str) -> str:
    return f"regexp_extract_all(lower({o.light_sql(col)}), '{TOKEN_RE}')"

WV_SQL = f"""
wv0 AS (SELECT term, count(*) AS freq
        FROM (SELECT unnest({light_tok('text')}) AS term FROM c_splits WHERE split = 'train')
        GROUP BY term HAVING count(*) >= 2 ORDER BY freq DESC, term LIMIT 50000),
wv AS (SELECT term, freq, CAST(row_number() OVER (ORDER BY freq DESC, term) + 1 AS INTEGER) AS id FROM wv0),
toks AS (SELECT doc_id, {light_tok('text')} AS tok FROM c_splits),
tpos AS (SELECT doc_id, unnest(tok) AS term, generate_subscripts(tok, 1) AS pos FROM toks)"""


def _light_docs(spark, sf):
    return chain(spark, sf).light


def word_vocab(spark, sf):
    train = _light_docs(spark, sf).filter(F.col("split") == TRAIN)
    return fe.word_vocabulary(train)


@query("word_vocabulary", o.with_(o.CORPUS, WV_SQL) + "SELECT term, freq, id FROM wv")
def q_word_vocabulary(spark, sf):
    return word_vocab(spark, sf).select("term", "freq", "id")


@query("encode_sequence", o.with_(o.CORPUS, WV_SQL, """
ids AS (SELECT p.doc_id, (p.pos - 1) // 128 AS part, list(coalesce(v.id, 1) ORDER BY p.pos) AS ids
        FROM tpos p LEFT JOIN wv v ON p.term = v.term GROUP BY p.doc_id, part)""") + """
SELECT t.doc_id, CAST(coalesce(i.part, 0) AS INTEGER) AS part, array_to_string(list_concat(coalesce(i.ids, []),
         list_transform(range(128 - len(coalesce(i.ids, []))), lambda x: 0)), ' ') AS ids
FROM toks t LEFT JOIN ids i ON t.doc_id = i.doc_id""")
def q_encode_sequence(spark, sf):
    enc = fe.encode_sequences(_light_docs(spark, sf), word_vocab(spark, sf), max_len=128)
    return enc.select("doc_id", "part", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("token_id_lookup", o.with_(o.CORPUS, WV_SQL) + """
SELECT t.doc_id, CAST(count(p.term) AS BIGINT) AS n_tokens,
       CAST(count(p.term) - count(v.id) AS BIGINT) AS n_unknown
FROM toks t LEFT JOIN tpos p ON t.doc_id = p.doc_id LEFT JOIN wv v ON p.term = v.term
GROUP BY t.doc_id""")
def q_token_id_lookup(spark, sf):
    """Tokens looked up in the word vocabulary; misses map to the unknown id."""
    docs = _light_docs(spark, sf)
    toks = docs.select("doc_id", F.explode(tx.word_tokens("clean")).alias("term"))
    vocab = word_vocab(spark, sf).select("term", "id")
    looked = toks.join(fe.small(vocab, fe.WORD_VOCAB_SIZE), "term", "left").withColumn(
        "tid", F.coalesce("id", F.lit(fe.UNK_ID)))
    per = looked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"),
                                       F.sum(F.when(F.col("tid") == fe.UNK_ID, 1).otherwise(0))
                                       .cast("bigint").alias("n_unknown"))
    return (docs.select("doc_id").join(per, "doc_id", "left")
                .select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
                        F.coalesce("n_unknown", F.lit(0)).cast("bigint").alias("n_unknown")))


# ---------------------------------------------------------------- sampling --

#: Rows of the registered subsample: the operator's own size parameter.
SUBSAMPLE = 100

TRAIN_SQL = "tr AS (SELECT * FROM c_splits WHERE split = 'train')"


@query("stratified_subsample", o.with_(o.CORPUS, TRAIN_SQL,
                                       o.quota_ctes("tr", "s", "least(n, 100)")) + f"""
SELECT r.doc_id, r.toxic FROM (
  SELECT t.*, row_number() OVER (PARTITION BY t.toxic ORDER BY {o.hash_sql('t.doc_id', '42:sub')}, t.doc_id) AS rn
  FROM tr t) r JOIN s_take s ON r.toxic = s.toxic WHERE r.rn <= s.take""")
def q_stratified_subsample(spark, sf):
    tr = chain(spark, sf).splits.filter(F.col("split") == TRAIN)
    return sm.stratified_subsample(tr, SUBSAMPLE).select("doc_id", "toxic")


@query("stratified_folds", o.with_(o.CORPUS, TRAIN_SQL, """
fc AS (SELECT toxic, count(*) AS cnt FROM tr GROUP BY toxic),
fs AS (SELECT toxic, cnt, coalesce(sum(cnt) OVER (ORDER BY toxic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
       FROM fc),
fa AS (SELECT toxic, floor((s + cnt - 0 + 2) / 3) - floor((s - 0 + 2) / 3) AS a0,
              floor((s + cnt - 1 + 2) / 3) - floor((s - 1 + 2) / 3) AS a1 FROM fs)""") + f"""
SELECT r.doc_id, r.toxic,
       CAST((CASE WHEN r.rn - 1 >= a.a0 THEN 1 ELSE 0 END) + (CASE WHEN r.rn - 1 >= a.a0 + a.a1 THEN 1 ELSE 0 END) AS INTEGER) AS fold
FROM (SELECT t.*, row_number() OVER (PARTITION BY t.toxic ORDER BY {o.hash_sql('t.doc_id')}, t.doc_id) AS rn
      FROM tr t) r JOIN fa a ON r.toxic = a.toxic""")
def q_stratified_folds(spark, sf):
    tr = chain(spark, sf).splits.filter(F.col("split") == TRAIN)
    return sm.stratified_folds(tr, 3).select("doc_id", "toxic", "fold")


@query("sample_without_replacement", f"""
SELECT doc_id, lang FROM (
  SELECT doc_id, lang, row_number() OVER (ORDER BY {o.hash_sql('doc_id')}, doc_id) AS rn FROM documents)
WHERE rn <= 600""")
def q_sample_without_replacement(spark, sf):
    docs = chain(spark, sf).table("documents").select("doc_id", "lang")
    return sm.sample_rows(docs, 600, "doc_id")


@query("first_n", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 512")
def q_first_n(spark, sf):
    return sm.first_n(chain(spark, sf).table("documents").select("doc_id", "lang"), 512, "doc_id")


@query("label_slice", """
SELECT d.doc_id, CAST(length(d.text) AS INTEGER) AS text_length
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang = 'en' AND l.toxic = 1""")
def q_label_slice(spark, sf):
    c = chain(spark, sf).comments
    return c.filter((F.col("lang") == "en") & (F.col("toxic") == 1)).select(
        "doc_id", tx.text_length("text").alias("text_length"))


# -------------------------------------------------------------- embeddings --

EMB_LONG_SQL = """
el AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim,
              unnest(embedding) AS x FROM embeddings),
ef AS (SELECT vec_id, dim, CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 0.0 ELSE CAST(x AS DOUBLE) END AS value
       FROM el)"""


@query("finite_or_zero", o.with_(EMB_LONG_SQL) + "SELECT vec_id, dim, value FROM ef")
def q_finite_or_zero(spark, sf):
    from toxiscope.operators.embeddings import long_vectors
    return long_vectors(chain(spark, sf).table("embeddings"), "vec_id", "embedding")


@query("embedding_standardize", o.with_(EMB_LONG_SQL, """
st AS (SELECT dim, avg(value) AS mean,
              CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS scale FROM ef GROUP BY dim)""") + """
SELECT e.vec_id, e.dim, round((e.value - s.mean) / s.scale, 6) AS z FROM ef e JOIN st s ON e.dim = s.dim""")
def q_embedding_standardize(spark, sf):
    from toxiscope.operators.embeddings import standardize_long
    z = standardize_long(chain(spark, sf).table("embeddings"), "vec_id", "embedding")
    return z.select("vec_id", "dim", F.round("z", 6).alias("z"))


# Cyclic Jacobi rotations in tournament order: in every step each row of the
# matrix is paired with another one (the width is even), and all pairs turn at once.
PCA_SQL = """
st AS (SELECT dim, avg(value) AS mean,
              CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS scale FROM ef GROUP BY dim),
ez AS MATERIALIZED (SELECT e.vec_id, e.dim, (e.value - s.mean) / s.scale AS z FROM ef e JOIN st s ON e.dim = s.dim),
en AS (SELECT count(DISTINCT dim) AS n, count(DISTINCT vec_id) AS vecs FROM ez),
cov AS (SELECT list(c ORDER BY i, j) AS a, list(CAST(i = j AS DOUBLE) ORDER BY i, j) AS v
        FROM (SELECT x.dim AS i, y.dim AS j, avg(x.z * y.z) AS c FROM ez x JOIN ez y ON x.vec_id = y.vec_id GROUP BY x.dim, y.dim)),
jac(step, n, a, v) AS (
  SELECT 0, n, a, v FROM cov, en
  UNION ALL
  SELECT step + 1, n, list_transform(range(n * n), lambda x: c[(x // n) + 1] * b[x + 1] + s[(x // n) + 1] * b[pt[(x // n) + 1] * n + x % n + 1]),
         list_transform(range(n * n), lambda x: c[x % n + 1] * v[x + 1] + s[x % n + 1] * v[(x // n) * n + pt[x % n + 1] + 1])
  FROM (SELECT step, n, v, pt, c, s,
               list_transform(range(n * n), lambda x: c[x % n + 1] * a[x + 1] + s[x % n + 1] * a[(x // n) * n + pt[x % n + 1] + 1]) AS b
        FROM (SELECT step, n, a, v, pt, list_transform(t, lambda y: 1.0 / sqrt(1.0 + y * y)) AS c,
                     list_transform(range(n), lambda i: (CASE WHEN i < pt[i + 1] THEN -1.0 ELSE 1.0 END) * t[i + 1] / sqrt(1.0 + t[i + 1] * t[i + 1])) AS s
              FROM (SELECT step, n, a, v, pt, list_transform(tau, lambda y: CASE WHEN y IS NULL THEN 0.0
                             WHEN y >= 0 THEN 1.0 / (y + sqrt(1.0 + y * y)) ELSE 1.0 / (y - sqrt(1.0 + y * y)) END) AS t
                    FROM (SELECT step, n, a, v, pt, list_transform(range(n), lambda i:
                                   (a[greatest(i, pt[i + 1]) * (n + 1) + 1] - a[least(i, pt[i + 1]) * (n + 1) + 1])
                                   / nullif(2.0 * a[i * n + pt[i + 1] + 1], 0.0)) AS tau
                          FROM (SELECT *, list_transform(range(n), lambda i: CASE WHEN i = n - 1 THEN step % (n - 1)
                                          WHEN i = step % (n - 1) THEN n - 1 ELSE (2 * (step % (n - 1)) - i + n - 1) % (n - 1) END) AS pt
                                FROM jac WHERE step < 12 * (n - 1))))))),
axes AS (SELECT n, j, a[j * (n + 1) + 1] AS size, list_transform(range(n), lambda i: v[i * n + j + 1]) AS l
         FROM (SELECT n, a, v, unnest(range(n)) AS j FROM jac WHERE step = 12 * (n - 1))),
sorted AS (SELECT row_number() OVER (ORDER BY size DESC) - 1 AS comp, n, l FROM axes),
ranked AS (SELECT comp, unnest(range(n)) AS dim, unnest(l) AS w,
                  CASE WHEN l[list_position(list_transform(l, lambda x: abs(x)), list_max(list_transform(l, lambda x: abs(x))))] < 0
                       THEN -1.0 ELSE 1.0 END AS turn FROM sorted),
pcs AS (SELECT z.vec_id, CAST(r.comp AS INTEGER) AS comp, sum(z.z * r.w * r.turn) AS value FROM ez z JOIN ranked r ON r.dim = z.dim
        WHERE r.comp < (SELECT least(50, n, vecs - 1) FROM en) GROUP BY z.vec_id, r.comp)"""


def _four(x):
    return F.when(F.abs(x) < 5e-5, 0.0).otherwise(F.round(x, 4)).alias(x)


def _four_sql(x: str) -> str:
    return f"CASE WHEN abs({x}) < 5e-5 THEN 0.0 ELSE round({x}, 4) END"


@query("embedding_pca", o.with_recursive(EMB_LONG_SQL, PCA_SQL) + f"SELECT vec_id, comp, {_four_sql('value')} AS value FROM pcs")
def q_embedding_pca(spark, sf):
    """PCA scores (up to 50 components) of standardised embeddings."""
    from toxiscope.operators.embeddings import pca_project
    return pca_project(chain(spark, sf).table("embeddings"), "vec_id", "embedding").select("vec_id", "comp", _four("value"))


@query("embedding_map_2d", o.with_recursive(EMB_LONG_SQL, PCA_SQL) + f"""
SELECT e.vec_id, {_four_sql('x.value')} AS x, {_four_sql('y.value')} AS y, e.label
FROM embeddings e JOIN pcs x ON x.vec_id = e.vec_id AND x.comp = 0 JOIN pcs y ON y.vec_id = e.vec_id AND y.comp = 1""")
def q_embedding_map_2d(spark, sf):
    from toxiscope.operators.embeddings import embedding_map_2d
    found = embedding_map_2d(chain(spark, sf).table("embeddings"), "vec_id", "embedding", ["label"])
    return found.select("vec_id", _four("x"), _four("y"), "label")


# ----------------------------------------------------------- linear models --

LINEAR = (o.CORPUS, o.FEATURES, o.KERNEL)
LR_M, WEIGHTED_M, SVM_M = 0, 1, 9    # the SVM's folds are models 0 to 2 of their own statement
LR_SQL = o.linear_ctes([(LR_M, "logistic", "1.0", "0.25")], 300)
WEIGHTED_SQL = o.linear_ctes([(WEIGHTED_M, "logistic",
                               "CASE WHEN r.toxic = 1 THEN (1.0 - p) / greatest(p, CAST(1e-6 AS DOUBLE)) ELSE 1.0 END", "0.25")], 1500)
SVM_SQL = o.linear_ctes([(SVM_M, "squared_hinge", "1.0", "2.0")], 1500)
FOLDS_SQL = o.linear_ctes([(i, "squared_hinge", f"CASE WHEN r.fold = {i} THEN 0.0 ELSE 1.0 END", "2.0") for i in range(3)], 1500)


def _six(x: str) -> str:
    return f"CASE WHEN abs({x}) < 5e-7 THEN 0.0 ELSE round({x}, 6) END"


def _coef6():
    return F.when(F.abs("coef") < 5e-7, 0.0).otherwise(F.round("coef", 6)).alias("coef")


COEF_SQL = f"""
SELECT v.term, v.idx, {_six('coalesce(c.coef, 0.0)')} AS coef FROM c_idf v LEFT JOIN l_coef c ON c.idx = v.idx
UNION ALL SELECT NULL, -1, {_six('b')} FROM l_b"""


def margin_sql(score: str, name: str, suffix: str = "") -> str:
    """CTE of held-out predictions of single models: score and its sigmoid."""
    return f"""
l_dot{suffix} AS (SELECT w.doc_id, c.m, sum(w.weight * c.coef) AS dot FROM c_w w JOIN l_coef c ON c.idx = w.idx
          WHERE w.split <> 'train' GROUP BY w.doc_id, c.m),
l_margin{suffix} AS (SELECT d.doc_id, d.split, d.lang, d.toxic AS y_true, b.m, coalesce(x.dot, 0.0) + b.b AS margin
             FROM c_clean d CROSS JOIN l_b b LEFT JOIN l_dot{suffix} x ON x.doc_id = d.doc_id AND x.m = b.m WHERE d.split <> 'train'),
l_preds{suffix} AS (SELECT {name} AS model, split, lang, doc_id, y_true, round(margin, 8) AS score,
                   1.0 / (1.0 + exp(-round(margin, 8))) AS y_prob FROM l_margin{suffix} WHERE {score})"""


@query("lr_fit", o.with_recursive(*LINEAR, LR_SQL) + COEF_SQL)
def q_lr_fit(spark, sf):
    from toxiscope.plans import linear_baselines as lb
    c = chain(spark, sf)
    return lb.coefficient_table(c, "lr", lb.lr_fit(c)).select("term", "idx", _coef6())


@query("lr_predict", o.with_recursive(*LINEAR, LR_SQL, margin_sql("TRUE", "'lr'")) + """
SELECT doc_id, split, round(y_prob, 6) AS y_prob FROM l_preds""")
def q_lr_predict(spark, sf):
    from toxiscope.plans import linear_baselines as lb
    return lb.lr_predictions(chain(spark, sf)).select("doc_id", "split", F.round("y_prob", 6).alias("y_prob"))


@query("top_features_lr", o.with_recursive(*LINEAR, LR_SQL) + """
SELECT direction, CAST(rank AS INTEGER) AS rank, term, round(coef, 4) AS weight FROM (
  SELECT 'toxic' AS direction, term, coef, row_number() OVER (ORDER BY round(coef, 8) DESC, term) AS rank FROM l_coef
  UNION ALL
  SELECT 'non_toxic' AS direction, term, coef, row_number() OVER (ORDER BY round(coef, 8), term) AS rank FROM l_coef)
WHERE rank <= 30""")
def q_top_features_lr(spark, sf):
    """The 30 largest and smallest coefficients of the logistic regression."""
    from toxiscope.operators.models import top_features
    from toxiscope.plans import linear_baselines as lb
    c = chain(spark, sf)
    return top_features(lb.coefficient_table(c, "lr", lb.lr_fit(c)).filter("idx >= 0").select("term", "coef"), 30)


@query("weighted_lr_fit", o.with_recursive(*LINEAR, WEIGHTED_SQL) + COEF_SQL)
def q_weighted_lr_fit(spark, sf):
    """Positive rows count (1 - p) / p times in the likelihood."""
    from toxiscope.plans import linear_baselines as lb
    c = chain(spark, sf)
    return lb.coefficient_table(c, "weighted", lb.weighted_fit(c)).select("term", "idx", _coef6())


@query("svm_fit", o.with_recursive(*LINEAR, SVM_SQL) + COEF_SQL)
def q_svm_fit(spark, sf):
    from toxiscope.plans import linear_baselines as lb
    c = chain(spark, sf)
    return lb.coefficient_table(c, "svm", lb.svm_fit(c)).select("term", "idx", _coef6())


# Platt's two parameters per fold: undamped Newton steps on the held-out margins.
PLATT_SQL = margin_sql("TRUE", "'svm'") + """,
p_row AS MATERIALIZED (SELECT r.fold, list_dot_product(r.k, v.a) AS x,
           CASE WHEN r.toxic = 1 THEN (n.pos + 1.0) / (n.pos + 2.0) ELSE 1.0 / (n.neg + 2.0) END AS t
         FROM k_row r JOIN (SELECT m, list(a ORDER BY i) AS a FROM l_a GROUP BY m) v ON v.m = r.fold
         JOIN (SELECT fold, sum(toxic) AS pos, sum(1 - toxic) AS neg FROM k_row GROUP BY fold) n ON n.fold = r.fold),
p_step(step, fold, a, b) AS (
  SELECT 0, fold, 0.0::DOUBLE, ln((sum(toxic) + 1.0) / (sum(1 - toxic) + 1.0)) FROM k_row GROUP BY fold
  UNION ALL
  SELECT step + 1, fold, a - (h1 * gm - hm * g1) / (hmm * h1 - hm * hm), b - (hmm * g1 - hm * gm) / (hmm * h1 - hm * hm)
  FROM (SELECT step, fold, a, b, sum((p - t) * x) AS gm, sum(p - t) AS g1, sum(p * (1 - p) * x * x) AS hmm, sum(p * (1 - p) * x) AS hm,
               sum(p * (1 - p)) AS h1
        FROM (SELECT s.*, r.x, r.t, 1.0 / (1.0 + exp(-(s.a * r.x + s.b))) AS p FROM p_step s JOIN p_row r ON r.fold = s.fold WHERE s.step < 40)
        GROUP BY step, fold, a, b)),
svm_preds AS (SELECT m.split, m.lang, m.doc_id, m.y_true, avg(1.0 / (1.0 + exp(-(s.a * m.margin + s.b)))) AS y_prob
              FROM l_margin m JOIN p_step s ON s.fold = m.m AND s.step = 40 GROUP BY m.split, m.lang, m.doc_id, m.y_true)"""


@query("svm_calibrate", o.with_recursive(*LINEAR, FOLDS_SQL, PLATT_SQL) + """
SELECT doc_id, split, round(y_prob, 6) AS y_prob FROM svm_preds""")
def q_svm_calibrate(spark, sf):
    from toxiscope.plans import linear_baselines as lb
    return lb.svm_predictions(chain(spark, sf)).select("doc_id", "split", F.round("y_prob", 6).alias("y_prob"))


# The logistic regression is model 3 beside the SVM's folds.
COMPARISON_SQL = o.with_recursive(
    *LINEAR, o.NB, o.linear_ctes([(i, "squared_hinge", f"CASE WHEN r.fold = {i} THEN 0.0 ELSE 1.0 END", "2.0") for i in range(3)]
                                 + [(3, "logistic", "1.0", "0.25")], 1500), PLATT_SQL, f"""
a_preds AS (SELECT model, split, lang, doc_id, y_true, score, y_prob FROM c_preds
            UNION ALL SELECT '{LR_NAME}', split, lang, doc_id, y_true, round(margin, 8), 1.0 / (1.0 + exp(-round(margin, 8)))
                      FROM l_margin WHERE m = 3
            UNION ALL SELECT '{SVM_NAME}', split, lang, doc_id, y_true, round(y_prob, 8), y_prob FROM svm_preds),
a_eval AS (SELECT * FROM a_preds UNION ALL SELECT model, 'Val-' || lang, lang, doc_id, y_true, score, y_prob FROM a_preds
           WHERE split = 'Multilingual Val')""") + o.metrics_select("a_eval", ["model", "split"])


@query("model_comparison", COMPARISON_SQL)
def q_model_comparison(spark, sf):
    from toxiscope.plans import linear_baselines as lb
    return lb.comparison(chain(spark, sf))


PATH_SQL = o.with_recursive(
    *LINEAR, o.linear_ctes([(i, "logistic", repr(cost), "0.25") for i, cost in enumerate((0.1, 1.0, 10.0))], 1500),
    margin_sql("TRUE", "(CASE m WHEN 0 THEN 0.1 WHEN 1 THEN 1.0 ELSE 10.0 END)::DOUBLE"),
    "cand AS (SELECT model AS cost, auc_roc AS val_auc FROM (" +
    o.auc_select("(SELECT * FROM l_preds WHERE split = 'Multilingual Val')", "model") + "))") + """
SELECT CAST(row_number() OVER (ORDER BY cost) AS INTEGER) AS candidate, cost, val_auc,
       row_number() OVER (ORDER BY val_auc DESC NULLS LAST, cost) = 1 AS is_best FROM cand"""


@query("regularisation_path", PATH_SQL)
def q_regularisation_path(spark, sf):
    """Logistic regressions along a path of costs, each started from the one before it; the candidate with the best
    validation AUC, the earliest of equals."""
    from toxiscope.operators import evaluation as ev
    from toxiscope.operators.compare import best_candidate
    from toxiscope.plans import linear_baselines as lb
    val = lb.path_predictions(chain(spark, sf)).filter(F.col("split") == VAL)
    auc = ev.auc_table(val, ["model"]).select(
        (F.array_position(F.array(*[F.lit(x) for x in lb.COSTS]), F.col("model"))).cast("int").alias("candidate"),
        F.col("model").alias("cost"), F.col("auc_roc").alias("val_auc"))
    return best_candidate(auc, "val_auc", "candidate")
