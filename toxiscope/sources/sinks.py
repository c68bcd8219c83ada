"""Sinks: split tables, metric rows, predictions, feature importance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toxiscope.functions.text import slug


def write_splits(splits: DataFrame, directory: str) -> None:
    """Key, cleaned text, label and language, partitioned by split."""
    (splits.write.mode("overwrite").partitionBy("split").parquet(directory))


def write_metrics(metrics: DataFrame, directory: str) -> None:
    """Metric rows as CSV (with header) and JSON lines; a handful of rows, one file each."""
    m = metrics.coalesce(1)
    m.write.mode("overwrite").option("header", True).csv(f"{directory.rstrip('/')}/csv")
    m.write.mode("overwrite").json(f"{directory.rstrip('/')}/json")


def write_predictions(preds: DataFrame, directory: str) -> None:
    """Predictions partitioned by model and split tag (file pruning by model/split)."""
    out = preds.withColumn("model_tag", slug("model")).withColumn("split_tag", slug("split"))
    out.write.mode("overwrite").partitionBy("model_tag", "split_tag").parquet(directory)


def write_feature_importance(top: DataFrame, path: str) -> None:
    """``top`` (direction, rank, term, weight) -> one JSON object
    {most_toxic: [{feature, weight}...], least_toxic: [...]} (2k rows, bounded)."""
    def side(direction):
        items = F.sort_array(F.collect_list(F.when(F.col("direction") == direction, F.struct(
            "rank", F.col("term").alias("feature"), "weight"))))
        return F.transform(items, lambda s: F.struct(s["feature"].alias("feature"),
                                                     s["weight"].alias("weight")))
    obj = top.agg(side("toxic").alias("most_toxic"), side("non_toxic").alias("least_toxic"))
    obj.coalesce(1).write.mode("overwrite").json(path)
