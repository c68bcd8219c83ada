"""Coefficient listings of fitted models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_features(coefs: DataFrame, k: int = 30, digits: int = 4) -> DataFrame:
    """(direction, rank, term, weight): the k largest and k smallest weights.

    ``coefs`` is (term, coef); two top-k selections, and only their k rows are
    ranked.  Ties by term, on weights rounded to 8 digits.
    """
    r = F.round("coef", 8)

    def listed(direction: str, order: Column) -> DataFrame:
        top = coefs.orderBy(order, "term").limit(int(k))
        return top.select(F.lit(direction).alias("direction"), F.row_number().over(Window.orderBy(order, "term")).alias("rank"),
                          "term", F.round("coef", digits).alias("weight"))
    return listed("toxic", F.desc(r)).unionByName(listed("non_toxic", r.asc()))
