"""Term postings, vocabularies, TF-IDF and token-id encoding.

Sparse features are long postings ``(doc_id, term, ...)``.  Everything per
document is an aggregation keyed by ``doc_id``; everything per term is an
aggregation keyed by ``term`` with map-side partial aggregation, so frequent
terms never meet in one task un-combined.  Vocabularies have a fixed upper
size (``max_features``), which is what makes them safe to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toxiscope.functions.text import clean_tokens, word_ngrams, word_tokens
from toxiscope.operators.ranges import row_numbers

MAX_FEATURES = 50_000
WORD_VOCAB_SIZE = 50_000
WORD_MIN_FREQ = 2
#: A vocabulary may be broadcast up to this bound.
BROADCAST_ROWS = 200_000
#: Characters of text whose postings a task holds.
PARTITION_CHARS = 2 << 20
PAD_ID = 0
UNK_ID = 1


def _ids(id_col) -> list[str]:
    return [id_col] if isinstance(id_col, str) else list(id_col)


def text_partitions(texts: DataFrame, chars: Column, most: int | None = None) -> int:
    """Partitions of ``most`` (else ``PARTITION_CHARS``) measured characters each, one per core at least: what a task holds of postings doesn't grow with the table."""
    total = texts.agg(F.sum(chars)).first()[0] or 0
    return max(texts.sparkSession.sparkContext.defaultParallelism, -(-total // (most or PARTITION_CHARS)))


def term_postings(docs: DataFrame, clean_col: str = "clean", id_col: str | list[str] = "doc_id",
                  keep: list[str] | None = None, tokens=clean_tokens) -> DataFrame:
    """(id..., term, tf) of uni+bigrams of cleaned text; ``tokens`` fits aggressively cleaned text
    (``vector_tokens`` fits any).

    Each document is one input row, so the partial aggregation before the
    shuffle already yields the final (doc, term) counts.
    """
    keep = list(keep or [])
    ids = _ids(id_col)
    listed = docs.select(*ids, *keep, tokens(clean_col).alias("_t"))
    terms = listed.select(*ids, *keep, F.explode(word_ngrams("_t")).alias("term"))
    return terms.groupBy(*ids, *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(postings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., term, tot, df) of (doc, term, tf) postings: term-keyed partial aggregates."""
    return postings.groupBy(*by, "term").agg(F.sum("tf").cast("bigint").alias("tot"),
                                             F.count(F.lit(1)).cast("bigint").alias("df"))


def small(table: DataFrame, rows: int | None) -> DataFrame:
    """A broadcast hint where ``rows`` bounds the table; otherwise Catalyst decides."""
    return F.broadcast(table) if rows is not None and rows <= BROADCAST_ROWS else table


def top_terms(term_stats: DataFrame, k: int | None, count_col: str, min_count: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` terms with the largest ``count_col`` (ties: term ascending), of every ``by``; None: all.

    A histogram of the counts (at most sqrt(2 * total) distinct values) gives
    the count of the k-th term; terms below it are dropped before the
    top-k sort, so the sort only sees about k rows instead of the whole
    (Zipf-tailed) term table.
    """
    by = list(by)
    stats = term_stats.filter(F.col(count_col) >= min_count)
    if k is None:
        return stats
    hist = stats.groupBy(*by, count_col).agg(F.count(F.lit(1)).alias("_terms"))
    w = Window.partitionBy(*by).orderBy(F.desc(count_col)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cutoff = (hist.withColumn("_cum", F.sum("_terms").over(w))
                  .filter(F.col("_cum") >= k)
                  .groupBy(*by).agg(F.max(count_col).alias("_cut")))
    # No row reaches k -> every term is kept (no cutoff -> min_count).
    if not by:
        cutoff = cutoff.select(F.coalesce("_cut", F.lit(min_count)).alias("_cut"))
        kept = stats.join(F.broadcast(cutoff), F.col(count_col) >= F.col("_cut")).drop("_cut")
        return kept.orderBy(F.desc(count_col), F.asc("term")).limit(int(k))
    kept = stats.join(F.broadcast(cutoff), by, "left").filter(F.col(count_col) >= F.coalesce("_cut", F.lit(min_count))).drop("_cut")
    order = Window.partitionBy(*by).orderBy(F.desc(count_col), F.asc("term"))
    return kept.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= int(k)).drop("_r")


def numbered(table: DataFrame, order: list[Column | str], out: str, rows: int | None, start: int = 0) -> DataFrame:
    """table + ``out``, its number in ``order`` from ``start``: in one task where ``rows`` bounds the table, else by ranges."""
    if rows is not None and rows <= BROADCAST_ROWS:
        number = F.row_number().over(Window.orderBy(*order)) - 1
        return table.withColumn(out, (number + start).cast("int"))
    found = row_numbers(table, order, out)
    return found.withColumn(out, (F.col(out) + start).cast("int"))


def feature_vocabulary(stats: DataFrame, max_features: int | None = MAX_FEATURES, by: Sequence[str] = ()) -> DataFrame:
    """(by..., term, tot, df, idx): top terms by total corpus count; idx in term order.

    ``stats`` is (by..., term, tot, df) over the training documents (``term_stats``).
    """
    if by:
        number = F.row_number().over(Window.partitionBy(*by).orderBy("term")) - 1
        return top_terms(stats, max_features, "tot", by=by).withColumn("idx", number.cast("int"))
    return numbered(top_terms(stats, max_features, "tot"), ["term"], "idx", max_features)


def idf_table(vocab: DataFrame, n_docs: Column) -> DataFrame:
    """Smoothed idf = ln((1 + n) / (1 + df)) + 1 for every vocabulary term."""
    return vocab.withColumn(
        "idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))


def tfidf_fit(train_stats: DataFrame, n_train_docs: DataFrame,
              max_features: int | None = MAX_FEATURES, by: Sequence[str] = ()) -> DataFrame:
    """(by..., term, tot, df, idx, idf) fitted on the training documents only.

    ``train_stats`` is (term, tot, df); ``n_train_docs`` is a one-row
    DataFrame ``(n_docs)``: documents without any term still count.
    """
    vocab = feature_vocabulary(train_stats, max_features, by)
    return idf_table(vocab.crossJoin(F.broadcast(n_train_docs)), F.col("n_docs")).drop("n_docs")


def tfidf_transform(postings: DataFrame, idf: DataFrame, id_col: str | list[str] = "doc_id",
                    max_features: int | None = MAX_FEATURES, by: Sequence[str] = ()) -> DataFrame:
    """(id, term, idx, weight): sublinear tf x idf, L2-normalised per document.

    With ``by`` (part of the id) every value has its own vocabulary, and
    ``max_features`` is for the rows of all of them.

    The vocabulary is broadcast where ``max_features`` bounds it; the
    per-document norm is a window on ``id_col``.
    """
    raw = (postings.join(small(idf.select(*by, "term", "idx", "idf"), max_features), [*by, "term"])
                   .withColumn("_raw", (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")))
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(*_ids(id_col))))
    return raw.withColumn("weight", F.col("_raw") / norm).drop("_raw", "idf")


# ---------------------------------------------------------------------------
# Word vocabulary and fixed-length encodings (sequence-model inputs)
# ---------------------------------------------------------------------------

def word_vocabulary(train_docs: DataFrame, text_col: str = "clean",
                    size: int | None = WORD_VOCAB_SIZE, min_freq: int = WORD_MIN_FREQ) -> DataFrame:
    """(term, freq, id): most frequent word tokens with freq >= min_freq.

    Ids start at 2 (0 = pad, 1 = unknown) in frequency order, ties by term.
    """
    words = train_docs.select(F.explode(word_tokens(text_col)).alias("term"))
    stats = words.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    top = top_terms(stats, size, "freq", min_count=min_freq)
    return numbered(top, [F.desc("freq"), F.asc("term")], "id", size, start=UNK_ID + 1)


def encode_sequences(docs: DataFrame, vocab: DataFrame, text_col: str = "clean",
                     id_col: str = "doc_id", max_len: int = 128,
                     size: int | None = WORD_VOCAB_SIZE) -> DataFrame:
    """(id, part, ids ARRAY<INT>): token ids of the whole text in consecutive
    parts of ``max_len`` tokens, unknown = 1, the last part padded with 0.

    Part 0 is the fixed-length input of a sequence model that reads only the
    beginning; a text without tokens has one part of padding.
    """
    toks = docs.select(id_col, F.posexplode(word_tokens(text_col)).alias("pos", "term"))
    looked = toks.join(small(vocab.select("term", "id"), size), "term", "left")
    parts = (looked.groupBy(id_col, F.floor(F.col("pos") / max_len).cast("int").alias("part"))
             .agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(UNK_ID)).alias("id"))))
                  .alias("_p")))
    rows = docs.select(id_col).join(parts, id_col, "left")
    seq = F.coalesce(F.transform("_p", lambda s: s["id"]), F.array().cast("array<int>"))
    padded = F.concat(seq, F.array_repeat(F.lit(PAD_ID), F.lit(max_len) - F.size(seq)))
    return rows.select(id_col, F.coalesce("part", F.lit(0)).alias("part"), padded.alias("ids"))
