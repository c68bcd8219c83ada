"""File sources: comment CSVs, metric tables, prediction files, run
summaries and word vectors.

Paths may be local or any Hadoop file system; listings only touch file
names on the driver, contents are read by Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toxiscope.sources.tables import MISSING_TEXT

COMMENT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("comment_text", T.StringType()),
    T.StructField("toxic", T.IntegerType()),
    T.StructField("severe_toxic", T.IntegerType()),
    T.StructField("obscene", T.IntegerType()),
    T.StructField("threat", T.IntegerType()),
    T.StructField("insult", T.IntegerType()),
    T.StructField("identity_hate", T.IntegerType()),
])

VALIDATION_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("comment_text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("toxic", T.IntegerType()),
])

METRIC_KEYS = ("model", "split", "auc_roc")
METRIC_SCHEMA = "model string, split string, auc_roc double, f1 double, accuracy double, " \
                "precision double, recall double, train_time_s double"
SUMMARY_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("adapter_size", T.LongType()),
    T.StructField("trainable_params", T.LongType()),
    T.StructField("total_params", T.LongType()),
    T.StructField("trainable_pct", T.DoubleType()),
    T.StructField("ms_per_sample", T.DoubleType()),
    T.StructField("max_len", T.LongType()),
    T.StructField("epochs", T.LongType()),
    T.StructField("threshold", T.DoubleType()),
])


def _fs_list(spark: SparkSession, directory: str, pattern: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(directory.rstrip("/") + "/" + pattern)
    fs = path.getFileSystem(conf)
    found = fs.globStatus(path)
    return sorted(str(s.getPath().toString()) for s in (found or []))


def read_comments_csv(spark: SparkSession, path: str, schema: T.StructType = COMMENT_SCHEMA,
                      text_col: str = "comment_text") -> DataFrame:
    """Comment CSV with quoted multi-line cells; missing-value literals -> NULL.

    ``doc_id`` is the file's own ``id``.
    """
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True)
               .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path))
    df = df.withColumn(text_col, F.when(F.col(text_col).isin(*MISSING_TEXT), F.lit(None))
                       .otherwise(F.col(text_col)))
    return df.withColumn("doc_id", F.col("id"))


def read_metric_tables(spark: SparkSession, directory: str,
                       combined: str = "all_results.csv") -> DataFrame:
    """All ``*_results.csv`` except the combined file, having model/split/auc_roc,
    concatenated by name (ragged columns NULL); one row per (model, split),
    the last file in name order wins."""
    frames = []
    for order, path in enumerate(_fs_list(spark, directory, "*_results.csv")):
        if path.rsplit("/", 1)[-1] == combined:
            continue
        df = spark.read.option("header", True).option("inferSchema", True).csv(path)
        if not set(METRIC_KEYS).issubset(df.columns):
            continue
        frames.append(df.withColumn("_file_order", F.lit(order)))
    if not frames:
        return spark.createDataFrame([], METRIC_SCHEMA)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    from toxiscope.operators.compare import dedupe_last
    return dedupe_last(out, ["model", "split"], "_file_order").drop("_file_order")


def read_predictions(spark: SparkSession, directory: str, split_tag: str) -> DataFrame:
    """``preds_<model>_<split_tag>.csv`` files -> (model, y_true, y_prob, lang);
    the model name comes from the file name with ``_`` -> space."""
    schema = "y_true int, y_prob double, lang string"
    paths = _fs_list(spark, directory, f"preds_*_{re.sub(r'([][{}*?\\])', r'\\\1', split_tag)}.csv")
    if not paths:
        return spark.createDataFrame([], "model string, " + schema)
    df = spark.read.option("header", True).schema(schema).csv(paths)
    # the last part of the path that is such a name: a file, or a folder that Spark wrote
    name = F.regexp_extract(F.col("_metadata.file_path"), rf"/preds_([^/]*)_{re.escape(split_tag)}\.csv(?:/[^/]*)?$", 1)
    return df.select(F.translate(name, "_", " ").alias("model"), "y_true", "y_prob", "lang")


def read_run_summaries(spark: SparkSession, directory: str) -> DataFrame:
    """``*_results.json`` files holding one JSON object each; unreadable files
    and non-objects (e.g. arrays of metric rows) are skipped.  Each file is
    read whole (summaries are a few hundred bytes)."""
    paths = _fs_list(spark, directory, "*_results.json")
    if not paths:
        return spark.createDataFrame([], SUMMARY_SCHEMA)
    raw = spark.read.option("wholetext", True).text(paths)
    obj = raw.filter(F.ltrim(F.col("value")).startswith("{"))
    parsed = obj.select(F.from_json("value", SUMMARY_SCHEMA, {"mode": "PERMISSIVE"}).alias("s"))
    return parsed.filter(F.col("s").isNotNull()).select("s.*")


def model_size_table(summaries: DataFrame) -> DataFrame:
    """Summaries with parameter counts, ascending, in millions; latency 0 when absent."""
    s = summaries.filter(F.col("trainable_params").isNotNull())
    return s.orderBy("trainable_params").select(
        "model", (F.col("trainable_params") / 1e6).alias("trainable_m"),
        F.coalesce("ms_per_sample", F.lit(0.0)).alias("ms_per_sample"))


def read_word_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(word, vec ARRAY<FLOAT>) from ``word v1 .. vD`` lines; the optional
    ``count dim`` header and lines of another width are dropped by the
    width filter."""
    parts = F.split(F.regexp_replace("value", "\\s+$", ""), " ")
    lines = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") == dim + 1)
    return lines.select(F.col("p")[0].alias("word"),
                        F.transform(F.slice("p", 2, dim), lambda x: x.cast("float")).alias("vec"))


def vector_lookup(vocab: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors of vocabulary words, and (matched, vocabulary) counts."""
    matched = vocab.select("term").join(vectors.withColumnRenamed("word", "term"), "term")
    counts = vocab.select(F.count(F.lit(1)).alias("vocabulary")).crossJoin(
        matched.select(F.count(F.lit(1)).alias("matched")))
    return matched, counts
