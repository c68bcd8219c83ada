"""Queries over the comment corpus: sources, text functions, sampling, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from toxiscope.functions import text as tx
from toxiscope.operators import profile as pr
from toxiscope.plans import oracle as o
from toxiscope.plans.baselines import TEST, TRAIN, VAL, chain
from toxiscope.plans.catalog import query
from toxiscope.sources.tables import label_join, read_comments, read_table, spread


# ---------------------------------------------------------------- sources --

@query("read_comments", """
SELECT d.doc_id, d.text AS comment_text, d.lang, l.toxic, l.quality
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def q_read_comments(spark, sf):
    return read_comments(spark, sf)


@query("label_join", """
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def q_label_join(spark, sf):
    return label_join(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


# ------------------------------------------------------------------- split --

@query("stratified_split", o.with_(o.CORPUS) + """
SELECT doc_id, lang, toxic, split FROM c_splits""")
def q_stratified_split(spark, sf):
    return chain(spark, sf).splits.select("doc_id", "lang", "toxic", "split")


# ------------------------------------------------------------ text columns --

def _texts(spark, sf):
    """Every text of the corpus: documents and raw web pages (URLs, markup)."""
    d = spread(read_table(spark, sf, "documents"), "doc_id").select(
        F.lit("documents").alias("tbl"), F.col("doc_id").alias("id"), "text")
    p = spread(read_table(spark, sf, "pages"), "page_id").select(
        F.lit("pages").alias("tbl"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return d.unionByName(p)


TEXTS_SQL = """t AS (SELECT 'documents' AS tbl, doc_id AS id, text FROM documents
      UNION ALL SELECT 'pages' AS tbl, page_id AS id, html AS text FROM pages)"""


@query("aggressive_clean", o.with_(TEXTS_SQL) + f"""
SELECT tbl, id, {o.aggressive_sql('text')} AS clean FROM t""")
def q_aggressive_clean(spark, sf):
    return _texts(spark, sf).select("tbl", "id", tx.aggressive_clean("text").alias("clean"))


@query("light_clean", o.with_(TEXTS_SQL) + f"""
SELECT tbl, id, {o.light_sql('text')} AS clean FROM t""")
def q_light_clean(spark, sf):
    return _texts(spark, sf).select("tbl", "id", tx.light_clean("text").alias("clean"))


@query("no_clean", o.with_(TEXTS_SQL) + """
SELECT tbl, id, coalesce(text, '') AS clean FROM t""")
def q_no_clean(spark, sf):
    return _texts(spark, sf).select("tbl", "id", tx.no_clean("text").alias("clean"))


_TOKEN_RE = tx.WORD_CHAR + "+"


@query("cleaning_ablation", o.with_(o.CORPUS, f"""
v AS (SELECT 'aggressive' AS cleaner, lang, {o.aggressive_sql('text')} AS clean FROM c_comments
      UNION ALL SELECT 'light' AS cleaner, lang, {o.light_sql('text')} AS clean FROM c_comments
      UNION ALL SELECT 'none' AS cleaner, lang, coalesce(text, '') AS clean FROM c_comments)""") + f"""
SELECT cleaner, lang, count(*) AS n_docs, CAST(sum(length(clean)) AS BIGINT) AS n_chars,
       CAST(sum(CASE WHEN clean = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_empty,
       CAST(sum(len(regexp_extract_all(lower(clean), '{_TOKEN_RE}'))) AS BIGINT) AS n_tokens
FROM v GROUP BY cleaner, lang""")
def q_cleaning_ablation(spark, sf):
    """The same labelled corpus under each cleaner, side by side per language."""
    comments = chain(spark, sf).comments
    variants = None
    for name, fn in tx.CLEANERS.items():
        v = comments.select(F.lit(name).alias("cleaner"), "lang", fn("text").alias("clean"))
        variants = v if variants is None else variants.unionByName(v)
    return variants.groupBy("cleaner", "lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.char_length("clean")).alias("n_chars"),
        F.sum(F.when(F.col("clean") == "", 1).otherwise(0)).alias("n_empty"),
        F.sum(F.size(tx.word_tokens("clean"))).alias("n_tokens"))


@query("text_length", """
SELECT doc_id, CAST(length(text) AS INTEGER) AS text_length, n_chars FROM documents""")
def q_text_length(spark, sf):
    return read_table(spark, sf, "documents").select(
        "doc_id", tx.text_length("text").alias("text_length"), "n_chars")


@query("clip_length", """
SELECT doc_id, CAST(least(length(text), 2000) AS INTEGER) AS clipped_length FROM documents""")
def q_clip_length(spark, sf):
    return read_table(spark, sf, "documents").select(
        "doc_id", tx.clip_length(tx.text_length("text")).alias("clipped_length"))


@query("word_tokens", f"""
SELECT doc_id, CAST(len(tok) AS INTEGER) AS n_tokens, array_to_string(tok, ' ') AS tokens
FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_TOKEN_RE}') AS tok FROM documents)""")
def q_word_tokens(spark, sf):
    tok = tx.word_tokens("text")
    return spread(read_table(spark, sf, "documents"), "doc_id").select(
        "doc_id", F.size(tok).alias("n_tokens"), F.array_join(tok, " ").alias("tokens"))


@query("vector_tokens", f"""
SELECT doc_id, CAST(len(tok) AS INTEGER) AS n_tokens, array_to_string(tok, ' ') AS tokens
FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '{_TOKEN_RE}'),
                                 lambda x: length(x) >= 2) AS tok FROM documents)""")
def q_vector_tokens(spark, sf):
    tok = tx.vector_tokens("text")
    return spread(read_table(spark, sf, "documents"), "doc_id").select(
        "doc_id", F.size(tok).alias("n_tokens"), F.array_join(tok, " ").alias("tokens"))


@query("word_ngrams", o.with_(o.CORPUS, """
g AS (SELECT doc_id, tok, list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1]) AS bi
      FROM (SELECT doc_id, list_filter(string_split(clean, ' '), lambda x: length(x) >= 2) AS tok FROM c_clean))""") + """
SELECT doc_id, CAST(len(tok) AS INTEGER) AS n_unigrams, CAST(len(bi) AS INTEGER) AS n_bigrams, array_to_string(list_concat(tok, bi), '|') AS ngrams
FROM g""")
def q_word_ngrams(spark, sf):
    c = chain(spark, sf).cleaned
    tok = tx.clean_tokens("clean")
    grams = tx.word_ngrams(tok)
    return c.select("doc_id", F.size(tok).alias("n_unigrams"),
                    (F.size(grams) - F.size(tok)).alias("n_bigrams"),
                    F.array_join(grams, "|").alias("ngrams"))


# -------------------------------------------------------------- profiles --

EN_SQL = "en AS (SELECT d.doc_id, d.text, d.lang, l.toxic, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang = 'en')"
VAL_SQL = "val AS (SELECT d.doc_id, d.text, d.lang, l.toxic, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang <> 'en')"


def _en(spark, sf):
    return chain(spark, sf).comments.filter(F.col("lang") == "en")


def _val(spark, sf):
    return chain(spark, sf).comments.filter(F.col("lang") != "en")


@query("label_counts", o.with_(EN_SQL) + "SELECT toxic, count(*) AS n FROM en GROUP BY toxic")
def q_label_counts(spark, sf):
    return pr.label_counts(_en(spark, sf))


@query("toxic_ratio", o.with_(EN_SQL) + f"""
SELECT count(*) AS n, {o.ratio('sum(toxic)', 'count(*)', 6)} AS toxic_ratio FROM en""")
def q_toxic_ratio(spark, sf):
    return pr.mean_ratio(_en(spark, sf))


@query("table_shape", o.with_(o.CORPUS) + """
SELECT 'training' AS name, count(*) AS n_rows, 7 AS n_cols FROM c_comments WHERE lang = 'en'
UNION ALL SELECT 'validation', count(*), 7 FROM c_comments WHERE lang <> 'en'
UNION ALL SELECT 'split:' || split, count(*), 8 FROM c_splits GROUP BY split""")
def q_table_shape(spark, sf):
    c = chain(spark, sf)
    com = c.comments
    ncol = len(com.columns)
    parts = [com.filter(F.col("lang") == "en").agg(F.count(F.lit(1)).alias("n_rows"))
                .select(F.lit("training").alias("name"), "n_rows", F.lit(ncol).alias("n_cols")),
             com.filter(F.col("lang") != "en").agg(F.count(F.lit(1)).alias("n_rows"))
                .select(F.lit("validation").alias("name"), "n_rows", F.lit(ncol).alias("n_cols")),
             c.splits.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
                .select(F.concat(F.lit("split:"), "split").alias("name"), "n_rows",
                        F.lit(len(c.splits.columns)).alias("n_cols"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("length_summary", o.with_(EN_SQL) + """
SELECT count(len) AS count, round(avg(len), 4) AS mean, round(stddev_samp(len), 4) AS std,
       CAST(min(len) AS DOUBLE) AS min, round(quantile_cont(len, 0.25), 4) AS q25,
       round(quantile_cont(len, 0.5), 4) AS q50, round(quantile_cont(len, 0.75), 4) AS q75,
       CAST(max(len) AS DOUBLE) AS max
FROM (SELECT length(text) AS len FROM en)""")
def q_length_summary(spark, sf):
    return pr.length_summary(_en(spark, sf), tx.text_length("text"))


@query("lang_counts", o.with_(VAL_SQL) + "SELECT lang, count(*) AS n FROM val GROUP BY lang")
def q_lang_counts(spark, sf):
    return _val(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("toxic_ratio_by_lang", o.with_(VAL_SQL) + f"""
SELECT lang, count(*) AS n, {o.ratio('sum(toxic)', 'count(*)', 6)} AS toxic_ratio FROM val GROUP BY lang""")
def q_toxic_ratio_by_lang(spark, sf):
    return pr.mean_ratio(_val(spark, sf), group_cols=["lang"])


def _hist_sql(bins: int, src: str, group: str | None) -> str:
    g = f"{group}, " if group else ""
    on = f"x.{group} = r.{group}" if group else "TRUE"
    part = f"PARTITION BY {group}" if group else ""
    def edge(i):
        return f"(CASE WHEN {i} = {bins} THEN r.last ELSE CAST({i} AS DOUBLE) * r.step + r.first END)"
    return f"""
x AS (SELECT {g}CAST(least(length(text), 2000) AS DOUBLE) AS v FROM {src}),
r0 AS (SELECT {g}min(v) AS lo, max(v) AS hi FROM x {('GROUP BY ' + group) if group else ''}),
r AS (SELECT {g}CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS first,
             CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS last FROM r0),
r2 AS (SELECT *, (last - first) / {float(bins)} AS step, {float(bins)} / (last - first) AS norm FROM r),
b0 AS (SELECT {('x.' + group + ', ') if group else ''}x.v, r.*, CAST(floor((x.v - r.first) * r.norm) AS INTEGER) AS i0
       FROM x JOIN r2 r ON {on}),
b1 AS (SELECT *, CASE WHEN i0 = {bins} THEN {bins - 1} ELSE i0 END AS i1 FROM b0),
b2 AS (SELECT *, CASE WHEN v < {edge('i1').replace('r.', '')} THEN i1 - 1 ELSE i1 END AS i2 FROM b1),
b3 AS (SELECT *, CASE WHEN v >= {edge('(i2 + 1)').replace('r.', '')} AND i2 <> {bins - 1} THEN i2 + 1 ELSE i2 END AS bin FROM b2),
cnt AS (SELECT {g}bin, count(*) AS n FROM b3 GROUP BY {g}bin),
frame AS (SELECT r.*, unnest(range(0, {bins})) AS bin FROM r2 r)
SELECT {('f.' + group + ', ') if group else ''}CAST(f.bin AS INTEGER) AS bin, round({edge('f.bin').replace('r.', 'f.')}, 4) AS lo,
       round({edge('(f.bin + 1)').replace('r.', 'f.')}, 4) AS hi, coalesce(c.n, 0) AS n
FROM frame f LEFT JOIN cnt c ON f.bin = c.bin {('AND f.' + group + ' = c.' + group) if group else ''}"""


def _hist_query(bins, src_sql, group):
    body = _hist_sql(bins, src_sql.split(" AS ")[0], group)
    head, select = body.rsplit("\nSELECT ", 1)
    return "WITH " + src_sql + "," + head.strip().rstrip(",") + "\nSELECT " + select


@query("length_histogram", _hist_query(100, EN_SQL, None))
def q_length_histogram(spark, sf):
    en = _en(spark, sf).select(tx.clip_length(tx.text_length("text")).alias("len"))
    return pr.histogram(en, "len", 100)


@query("length_histogram_by_label", _hist_query(80, EN_SQL, "toxic"))
def q_length_histogram_by_label(spark, sf):
    en = _en(spark, sf).select("toxic", tx.clip_length(tx.text_length("text")).alias("len"))
    return pr.histogram(en, "len", 80, ["toxic"])


def _corr_sql(a, b):
    num = f"(CAST(count(*) AS HUGEINT) * sum({a} * {b}) - CAST(sum({a}) AS HUGEINT) * sum({b}))"
    va = f"(CAST(count(*) AS HUGEINT) * sum({a} * {a}) - CAST(sum({a}) AS HUGEINT) * sum({a}))"
    vb = f"(CAST(count(*) AS HUGEINT) * sum({b} * {b}) - CAST(sum({b}) AS HUGEINT) * sum({b}))"
    den = f"sqrt(CAST({va} AS DOUBLE) * CAST({vb} AS DOUBLE))"
    return (f"SELECT '{a}' AS col_a, '{b}' AS col_b, CASE WHEN {den} > 0 THEN "
            f"round(CAST({num} AS DOUBLE) / {den}, 4) END AS corr FROM en")


@query("label_correlation", o.with_(EN_SQL) + "\nUNION ALL ".join(
    _corr_sql(a, b) for a in ("toxic", "quality") for b in ("toxic", "quality")))
def q_label_correlation(spark, sf):
    return pr.correlation_matrix(_en(spark, sf), ["toxic", "quality"])


@query("class_weight", o.with_(o.CORPUS) + """
SELECT round(p, 6) AS pos_ratio, round((1.0 - p) / greatest(p, CAST(1e-6 AS DOUBLE)), 6) AS class_weight
FROM (SELECT avg(CAST(toxic AS DOUBLE)) AS p FROM c_splits WHERE split = 'train')""")
def q_class_weight(spark, sf):
    return pr.class_weight(chain(spark, sf).splits.filter(F.col("split") == TRAIN))
