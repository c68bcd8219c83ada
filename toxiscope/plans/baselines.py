"""The labelled-corpus chain shared by most queries.

label join -> split -> aggressive clean -> uni+bigram postings -> TF-IDF fit
on train -> weights for every split -> Naive Bayes fit -> predictions.

Roles on the driver's tables: labelled English documents are the training
corpus (split 80/20 into ``train`` and the English test split); labelled
documents in every other language form the multilingual validation split.

Partitioning: cleaned documents are hash-partitioned by ``doc_id`` once, and
their postings (with split and label) are written in buckets of that key; the
per-document norm of the weights and the sparse vectors of the linear models
use the buckets without an exchange.  Term-keyed work (vocabulary, idf, class sums) is map-side
combined and bounded by the vocabulary size before anything is broadcast.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toxiscope.functions.text import aggressive_clean
from toxiscope.operators import evaluation as ev
from toxiscope.operators import features as fe
from toxiscope.operators import naive_bayes as nb
from toxiscope.operators.sampling import stratified_split
from toxiscope.session import checkpoint_dir, settings
from toxiscope.sources.tables import labelled_comments, read_table

TRAIN = "train"
TEST = ev.TEST_SPLIT
VAL = ev.VAL_SPLIT
TRAIN_LANG = "en"
NO_LANG = "und"
NB_NAME = "TF-IDF + Naive Bayes"
LR_NAME = "TF-IDF + Logistic Regression"
SVM_NAME = "TF-IDF + SVM"
#: Characters of cleaned text in a bucket (some 150 MB of memory for each aggregate or sort of its postings).
BUCKET_CHARS = 2 << 20
#: Characters of text that a task joins with keys or labels (some 130 MB of memory for the sort).
JOIN_CHARS = 64 << 20
#: What a task that sums postings by term reads of files, or of other tasks' sums (some 100 MB of memory).
SUM_BYTES = 16 << 20
#: Buckets whose sums by term make up a partition.
SUM_BUCKETS = 4


def nb_name(alpha: float = nb.ALPHA) -> str:
    return NB_NAME if alpha == nb.ALPHA else f"{NB_NAME} (alpha={alpha})"


def split_corpus(comments: DataFrame, label: str = "toxic") -> DataFrame:
    """comments + ``split``: English rows split 80/20 by label, all others validation.

    Rows without a label aren't labelled comments and don't take part; a
    missing language is the language ``und``.  The split is decided on keys
    and labels alone and joined to the texts once.
    """
    known = comments.filter(F.col(label).isNotNull()).withColumn("lang", F.coalesce("lang", F.lit(NO_LANG)))
    en = known.filter(F.col("lang") == TRAIN_LANG).select("doc_id", label)
    split = stratified_split(en, label=label, test_name=TEST, train_name=TRAIN).select("doc_id", "split")
    return (known.join(split, "doc_id", "left")
                 .withColumn("split", F.coalesce("split", F.lit(VAL))))


@dataclass
class Chain:
    spark: SparkSession
    sf_dir: str
    partitions: int | None = None
    _memo: dict = field(default_factory=dict)
    _cached: list = field(default_factory=list)
    _tables: list = field(default_factory=list)
    _run_dir: str | None = None

    def _get(self, key, build, keep: str | None = None, schema=None, buckets: int | None = None):
        """Memoised DataFrame, optionally materialised once.

        ``keep="persist"`` -- cached (memory, spilling to disk); lost blocks
        are recomputed from a short lineage.
        ``keep="checkpoint"`` -- written as a parquet table under the shared
        folder named by ``spark.checkpoint.dir`` and read back: lineage is
        cut, plans of later queries stay small, an executor loss re-reads
        files instead of re-running the chain, and later scans prune columns.
        One write job per table.
        ``keep="bucketed"`` -- the same, as a table bucketed by ``doc_id``: later work per document needs no exchange
        (``buckets`` of them, else the chain's).
        """
        if key not in self._memo:
            df = build()
            if keep == "persist":
                df = df.persist(StorageLevel.MEMORY_AND_DISK)
                self._cached.append(df)
            elif keep == "checkpoint":
                path = self._table_path(key)
                df.write.mode("overwrite").parquet(path)
                df = self.spark.read.schema(schema or df.schema).parquet(path)
            elif keep == "bucketed":
                path = self._table_path(key)
                name = path.rstrip("/").rsplit("/", 2)[-2].replace("-", "_") + f"_{len(self._tables)}"
                (df.write.format("parquet").option("path", path).bucketBy(buckets or self.buckets, "doc_id").sortBy("doc_id")
                 .saveAsTable(name))
                self._tables.append(name)
                df = self.spark.table(name)
            self._memo[key] = df
        return self._memo[key]

    def _table_path(self, key) -> str:
        if self._run_dir is None:
            base = checkpoint_dir(self.spark).rstrip("/")
            self._run_dir = f"{base}/toxiscope-{uuid.uuid4().hex}"
        name = "_".join(str(k) for k in (key if isinstance(key, tuple) else (key,)))
        return f"{self._run_dir}/{re.sub('[^A-Za-z0-9_.-]+', '_', name)}"

    def cached(self, df: DataFrame) -> DataFrame:
        """``df`` persisted until ``release``."""
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self._cached.append(df)
        return df

    def release(self) -> None:
        """Gives up the chain's cached and written tables."""
        for df in self._cached:
            df.unpersist()
        self._cached.clear()
        self._memo.clear()
        for name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._tables.clear()
        if self._run_dir is not None:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._run_dir)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self._run_dir = None

    # -- inputs --------------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @property
    def comments(self) -> DataFrame:
        return self._get("comments", lambda: labelled_comments(self.spark, self.sf_dir))

    @property
    def join_partitions(self) -> int:
        """Partitions that documents' texts are joined in: of ``JOIN_CHARS`` of measured text each, one per core at least."""
        return self._get("join_partitions", lambda: fe.text_partitions(self.table("documents").select("text"), F.length("text"), JOIN_CHARS))

    @property
    def splits(self) -> DataFrame:
        """Texts with their labels and split, joined in ``join_partitions`` at least, however few the session shuffles into."""
        partitions = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.join_partitions)
        with settings(self.spark, {"spark.sql.shuffle.partitions": str(partitions)}):
            return self._get("splits", lambda: split_corpus(self.comments), keep="checkpoint")

    @property
    def cleaned(self) -> DataFrame:
        """(doc_id, split, lang, toxic, clean): cleaned once, kept."""
        def build():
            return self.splits.select("doc_id", "split", "lang", "toxic",
                                      aggressive_clean("text").alias("clean"))
        return self._get("cleaned", build, keep="persist")

    @property
    def light(self) -> DataFrame:
        """(doc_id, split, clean): light-cleaned texts for the sequence-model
        inputs (word vocabulary, encodings)."""
        from toxiscope.functions.text import light_clean
        return self._get("light", lambda: self.splits.select(
            "doc_id", "split", light_clean("text").alias("clean")), keep="persist")

    # -- features ------------------------------------------------------------
    @property
    def buckets(self) -> int:
        """Buckets of the tables per document: of ``BUCKET_CHARS`` of measured text each, one per core at least."""
        return self.partitions or self._get("buckets", lambda: self.buckets_for(self.cleaned, F.length("clean")))

    def buckets_for(self, texts: DataFrame, chars: Column) -> int:
        return min(fe.text_partitions(texts, chars, BUCKET_CHARS), int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))

    @property
    def postings(self) -> DataFrame:
        """(doc_id, split, toxic, term, tf), tokenised once and written.  The
        texts are hash-partitioned by ``doc_id`` first (one shuffle of text,
        several times smaller than the postings), as many partitions as
        buckets: the aggregation needs no exchange and every task writes one
        bucket.  Vocabulary, idf, weights and Naive Bayes read the table."""
        def build():
            docs = self.cleaned.select("doc_id", "split", "toxic", "clean").repartition(self.buckets, "doc_id")
            return fe.term_postings(docs, keep=["split", "toxic"])
        return self._get("postings", build, keep="bucketed")

    def sums(self, key, postings: DataFrame, buckets: int, by: Sequence[str] = ()) -> DataFrame:
        """``fe.term_stats`` of the training documents in ``postings`` (of so many buckets), made once and written.

        Sums before and after the shuffle hold the distinct terms of what a
        task reads, so that is bounded here, whatever the session's settings:
        ``SUM_BYTES`` at most, in a partition for ``SUM_BUCKETS`` buckets at least.
        """
        conf = self.spark.conf
        partitions = max(int(conf.get("spark.sql.shuffle.partitions")), -(-buckets // SUM_BUCKETS))
        held = {"spark.sql.files.maxPartitionBytes": str(SUM_BYTES), "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(SUM_BYTES),
                "spark.sql.shuffle.partitions": str(partitions)}
        with settings(self.spark, held):
            return self._get(key, lambda: fe.term_stats(postings.filter(F.col("split") == TRAIN), by), keep="checkpoint")

    @property
    def term_stats(self) -> DataFrame:
        """(term, tot, df) over the training documents."""
        return self.sums("term_stats", self.postings, self.buckets)

    @property
    def n_train(self) -> DataFrame:
        return self._get("n_train", lambda: self.cleaned.filter(F.col("split") == TRAIN)
                         .agg(F.count(F.lit(1)).alias("n_docs")))

    @property
    def idf(self) -> DataFrame:
        def build():
            return fe.tfidf_fit(self.term_stats, self.n_train)
        return self._get("idf", build, keep="checkpoint")

    def n_terms(self) -> int:
        return self._get("n_terms", lambda: self.idf.count())

    @property
    def weights(self) -> DataFrame:
        """TF-IDF weights; bucketed like the postings, so neither their norm nor vectors built from them shuffle."""
        return self._get("weights", lambda: fe.tfidf_transform(self.postings, self.idf, max_features=self.n_terms()),
                         keep="bucketed")

    # -- Naive Bayes -----------------------------------------------------------
    def nb_model(self, alpha: float = nb.ALPHA) -> DataFrame:
        def build():
            train_w = self.weights.filter(F.col("split") == TRAIN)
            train_y = self.cleaned.filter(F.col("split") == TRAIN).select("toxic")
            return nb.nb_fit(train_w, train_y, self.idf, alpha)
        return self._get(("nb", alpha), build, keep="checkpoint")

    def nb_fit_seconds(self) -> float:
        """Wall seconds of a Naive Bayes fit on the kept weights."""
        def build():
            train = self.weights.filter(F.col("split") == TRAIN)
            labels = self.cleaned.filter(F.col("split") == TRAIN).select("toxic")
            began = time.perf_counter()
            nb.nb_fit(train, labels, self.idf).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - began
        return self._get("nb_fit_seconds", build)

    def nb_predictions(self, alpha: float = nb.ALPHA, splits=(TEST, VAL)) -> DataFrame:
        """(model, split, lang, doc_id, y_true, score, y_prob)."""
        def build():
            docs = self.cleaned.filter(F.col("split").isin(*splits)).select(
                "doc_id", "split", "lang", F.col("toxic").alias("y_true"))
            w = self.weights.filter(F.col("split").isin(*splits)).select("doc_id", "term", "weight")
            scored = nb.nb_scores(w, self.nb_model(alpha), docs)
            return scored.select(F.lit(nb_name(alpha)).alias("model"), "split", "lang", "doc_id",
                                 "y_true", "score", "y_prob")
        return self._get(("nb_pred", alpha, tuple(splits)), build, keep="checkpoint")

    def nb_curve(self, alpha: float = nb.ALPHA) -> DataFrame:
        """The running counts of every evaluation group (``evaluation.cumulative`` at 0.5); AUC, curves and metrics read it."""
        def build():
            ranges = lambda df: self._get(("nb_ranges", alpha), lambda: df, keep="checkpoint")
            return ev.cumulative(ev.split_rows(self.nb_predictions(alpha)), ["model", "split"], threshold=F.lit(0.5), keep=ranges)
        return self._get(("nb_curve", alpha), build, keep="checkpoint")

    def nb_metrics(self, alpha: float = nb.ALPHA) -> DataFrame:
        """Metric rows (models x splits: a handful) -- kept for the many
        queries that read them."""
        return self._get(("nb_metrics", alpha), lambda: ev.metrics_of(self.nb_curve(alpha), ["model", "split"]),
                         keep="checkpoint")


_CHAINS: dict = {}


def _version(spark: SparkSession, sf_dir: str) -> int:
    """A number that changes when the chain's input files do (names, times, sizes)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(
        [f"{sf_dir}/{name}.parquet" for name in ("documents", "labels")])
    return files.agg(F.bit_xor(F.xxhash64("path", "modificationTime", "length"))).first()[0]


def chain(spark: SparkSession, sf_dir: str) -> Chain:
    """One ``Chain`` per (session, data directory), made anew when the files change."""
    key, version = (id(spark), sf_dir.rstrip("/")), _version(spark, sf_dir.rstrip("/"))
    kept = _CHAINS.get(key)
    if kept is not None and (kept[0] != version or kept[1].spark is not spark):
        if kept[1].spark is spark:
            kept[1].release()
        kept = None
    if kept is None:
        kept = _CHAINS[key] = (version, Chain(spark, sf_dir.rstrip("/")))
    return kept[1]
