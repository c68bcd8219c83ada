"""Document-embedding operators: finite guard, standardisation, PCA, 2-D map.

Vectors are ``ARRAY<FLOAT>`` columns.  Per-dimension statistics come from a
``posexplode`` + ``groupBy(dim)`` (map-side combined, one row per dimension
-- bounded by the vector width, hence safe to broadcast back).  The PCA sums
products of vectors per Arrow batch and solves the width-sized eigenproblem.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from toxiscope.functions.numeric import finite_or_zero

PCA_MAX = 50


def long_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, dim, value DOUBLE) with non-finite values set to 0."""
    return df.select(id_col, F.posexplode(finite_or_zero(vec_col)).alias("dim", "value"))


def dimension_stats(long: DataFrame) -> DataFrame:
    """(dim, mean, scale): population std, 1.0 where the std is 0."""
    s = long.groupBy("dim").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("_std"))
    return s.select("dim", "mean", F.when(F.col("_std") == 0, F.lit(1.0))
                    .otherwise(F.col("_std")).alias("scale"))


def standardize(df: DataFrame, id_col: str, vec_col: str, out: str = "z") -> DataFrame:
    """df + ``out`` ARRAY<DOUBLE>: the standardised vector.

    The statistics become one row of two arrays as wide as a vector, which
    is broadcast; the vectors themselves aren't shuffled.
    """
    stats = dimension_stats(long_vectors(df, id_col, vec_col)).agg(
        F.sort_array(F.collect_list(F.struct("dim", "mean", "scale"))).alias("_s"))
    z = F.zip_with(finite_or_zero(vec_col), "_s", lambda x, s: (x - s["mean"]) / s["scale"])
    return df.crossJoin(F.broadcast(stats)).withColumn(out, z).drop("_s")


def standardize_long(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, dim, z): zero mean, unit variance per dimension."""
    return standardize(df, id_col, vec_col, "_z").select(id_col, F.posexplode("_z").alias("dim", "z"))


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of z z^T over a partition's vectors, as one flat array per width."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, z in rows_by_width(batch.column(0)):
            sums[z.shape[1]] = sums.get(z.shape[1], 0) + z.T @ z
    for total in sums.values():
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["g"])


def rows_by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of each width among the lists of an Arrow column without nulls."""
    starts = np.asarray(column.offsets, np.int64)
    values = np.asarray(column.values, np.float64)
    widths = np.diff(starts)
    for width in np.unique(widths[widths > 0]):
        rows = np.flatnonzero(widths == width)
        yield rows, values[starts[rows][:, None] + np.arange(width)]


def principal_axes(z: DataFrame, column: str, width: int, k: int) -> np.ndarray:
    """width x k loadings of centred vectors, the largest variance first.

    One pass sums the products within tasks and then by place (width squared
    sums reach the driver).  The sign of a loading is fixed: its entry of
    largest size is positive.
    """
    flat = z.filter(F.size(column) == width).select(column).mapInArrow(_gram, "g array<double>")
    sums = flat.select(F.posexplode("g").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    gram = np.zeros(width * width)
    for r in sums:
        gram[r["at"]] = r["x"]
    gram = gram.reshape(width, width)
    _, axes = np.linalg.eigh((gram + gram.T) / 2)
    axes = axes[:, ::-1][:, :k]
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return axes * np.where(signs == 0, 1.0, signs)


def pca_vectors(df: DataFrame, id_col: str, vec_col: str, k: int | None = None,
                keep: list[str] | None = None) -> DataFrame:
    """(id, keep..., _a): PCA scores of standardised vectors as an array,
    k = min(50, width, rows - 1) unless given, at most the width.

    The loadings travel in the task (width x k numbers); the vectors aren't
    shuffled.  A vector that is shorter than the widest has no scores.
    """
    keep = list(keep or [])
    z = standardize(df, id_col, vec_col, out="_z").select(id_col, *keep, "_z").filter(F.col("_z").isNotNull())
    width, n = df.agg(F.max(F.size(vec_col)), F.count(F.lit(1))).first()
    width = max(width or 1, 1)
    k = max(1, min(PCA_MAX, width, n - 1)) if k is None else min(k, width)
    axes = principal_axes(z, "_z", width, k)
    z = z.filter(F.size("_z") == width)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, rows = next(rows_by_width(batch.column(batch.num_columns - 1)))
            scores = pa.FixedSizeListArray.from_arrays(pa.array((rows @ axes).ravel()), axes.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names)
    schema = StructType([*z.drop("_z").schema.fields, StructField("_a", ArrayType(DoubleType()))])
    names = [f.name for f in schema.fields]
    return z.mapInArrow(project, schema)


def pca_project(df: DataFrame, id_col: str, vec_col: str, k: int | None = None) -> DataFrame:
    """(id, comp, value): PCA scores of standardised vectors."""
    return pca_vectors(df, id_col, vec_col, k).select(id_col, F.posexplode("_a").alias("comp", "value"))


def embedding_map_2d(df: DataFrame, id_col: str, vec_col: str, tags: list[str]) -> DataFrame:
    """(id, x, y, tags...): every vector on the first two principal components
    (the plotting view; ``sample_rows`` gives a smaller one)."""
    scores = pca_vectors(df, id_col, vec_col, k=2, keep=tags)
    return scores.select(id_col, F.get("_a", F.lit(0)).alias("x"), F.get("_a", F.lit(1)).alias("y"), *tags)
