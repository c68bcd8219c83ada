"""Running sums and row numbers over a whole table, without one task that sees all rows.

The rows are range-partitioned by the order, as many partitions as the session
shuffles into, and written with their partition's number; a small table of
sums per partition gives what stands before each; the ordered window runs
inside partitions.  There is no count beforehand and no limit on partitions.
The written table fixes the ranges: evaluated again, or after a lost executor,
every row is in the same one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toxiscope.session import checkpoint_dir

PART = "_part"
Keep = Callable[[DataFrame], DataFrame]


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder that ``spark.checkpoint.dir`` names."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/toxiscope-ranges-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, order: list[Column | str], keep: Keep = written) -> DataFrame:
    """df + ``_part``, the number of its range: kept, so that it doesn't change."""
    return keep(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def prefix_sums(df: DataFrame, group_cols: list[str], order_col: str, value_cols: list[str], keep: Keep = written) -> DataFrame:
    """df + ``cum_<v>`` and ``n_<v>``: running sum of v in ascending ``order_col`` per group, and the group's sum.

    ``order_col`` must be distinct within a group (aggregate first); the sum
    includes the row itself.  The sums per range are as many rows as ranges
    and groups together, so they are broadcast.
    """
    g = list(group_cols)
    rows = ranged(df, [*g, order_col], keep)
    totals = rows.groupBy(*g, PART).agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    before = Window.partitionBy(*g).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*g, PART, *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_off_{v}") for v in value_cols],
                            *[F.sum(f"_t_{v}").over(Window.partitionBy(*g)).alias(f"n_{v}") for v in value_cols])
    inside = Window.partitionBy(*g, PART).orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.join(F.broadcast(offsets), [*g, PART])
    return found.select(*df.columns, *[(F.col(f"_off_{v}") + F.sum(v).over(inside)).alias(f"cum_{v}") for v in value_cols],
                        *[f"n_{v}" for v in value_cols])


def row_numbers(df: DataFrame, order: list[Column | str], out: str, keep: Keep = written) -> DataFrame:
    """df + ``out``: its number from 0 in ``order``, which must tell all rows apart."""
    rows = ranged(df, order, keep)
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)   # a row per range
    offsets = rows.groupBy(PART).agg(F.count(F.lit(1)).alias("_n")).select(PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    number = F.col("_off") + F.row_number().over(Window.partitionBy(PART).orderBy(*order)) - 1
    return rows.join(F.broadcast(offsets), PART).withColumn(out, number).drop(PART, "_off")
