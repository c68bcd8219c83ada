"""Corpus profiles: counts, ratios, length statistics, histograms, correlation.

All are single aggregations (map-side combined); histograms join one
broadcast row of range per group (the group count is the label/language
cardinality) and add empty bins from ``sequence``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toxiscope.functions.numeric import ratio_round

DIGITS = 4
QUANTILES = (0.25, 0.5, 0.75)
POS_WEIGHT_FLOOR = 1e-6


def label_counts(df: DataFrame, label: str = "toxic") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def mean_ratio(df: DataFrame, label: str = "toxic", group_cols=(), digits: int = 6) -> DataFrame:
    """(group..., n, <label>_ratio): mean of a 0/1 column, exact rounding."""
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        ratio_round(F.sum(label), F.count(F.lit(1)), digits).alias(f"{label}_ratio"))


def length_summary(df: DataFrame, value: Column | str, group_cols=(), digits: int = DIGITS,
                   exact: bool = True) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear interpolation), max.

    ``exact`` uses ``percentile`` (state = one counter per distinct value;
    lengths are integers, so bounded by the longest text);
    ``exact=False`` switches to ``percentile_approx`` for unbounded domains.
    """
    v = F.col(value) if isinstance(value, str) else value
    qs = F.percentile(v, list(QUANTILES)) if exact else F.percentile_approx(v, list(QUANTILES), 10000)
    agg = df.groupBy(*group_cols).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), qs.alias("_q"), F.max(v).alias("max"))
    return agg.select(*group_cols, "count", F.round("mean", digits).alias("mean"),
                      F.round("std", digits).alias("std"), F.col("min").cast("double").alias("min"),
                      *[F.round(F.col("_q")[i], digits).alias(f"q{int(q * 100)}")
                        for i, q in enumerate(QUANTILES)],
                      F.col("max").cast("double").alias("max"))


def histogram(df: DataFrame, value: str, bins: int, group_cols=(), digits: int = DIGITS) -> DataFrame:
    """(group..., bin, lo, hi, n): ``bins`` equal-width bins over [min, max]
    of each group, last bin closed, empty bins included.

    Bin placement follows the usual equal-width rule exactly: index from
    (x - first) * bins / (last - first), then corrected against the edges
    first + i * step, so values on an edge land where the edge list says.
    """
    g = list(group_cols)
    x = F.col(value).cast("double")
    rng = df.groupBy(*g).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    rng = (rng.withColumn("_first", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5)
                          .otherwise(F.col("_lo")))
              .withColumn("_last", F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5)
                          .otherwise(F.col("_hi")))
              .withColumn("_step", (F.col("_last") - F.col("_first")) / F.lit(float(bins)))
              .withColumn("_norm", F.lit(float(bins)) / (F.col("_last") - F.col("_first")))
              .drop("_lo", "_hi"))

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.col("_last")).otherwise(i.cast("double") * F.col("_step") + F.col("_first"))

    b = df.select(*g, x.alias("_x")).join(F.broadcast(rng), g) if g else \
        df.select(x.alias("_x")).crossJoin(F.broadcast(rng))
    b = b.withColumn("_i", F.floor((F.col("_x") - F.col("_first")) * F.col("_norm")).cast("int"))
    b = b.withColumn("_i", F.when(F.col("_i") == bins, bins - 1).otherwise(F.col("_i")))
    b = b.withColumn("_i", F.when(F.col("_x") < edge(F.col("_i")), F.col("_i") - 1).otherwise(F.col("_i")))
    b = b.withColumn("_i", F.when((F.col("_x") >= edge(F.col("_i") + 1)) & (F.col("_i") != bins - 1),
                                  F.col("_i") + 1).otherwise(F.col("_i")))
    counts = b.groupBy(*g, F.col("_i").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = rng.select(*g, "_first", "_last", "_step",
                       F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = frame.join(counts, g + ["bin"], "left")
    return out.select(*g, "bin", F.round(edge(F.col("bin")), digits).alias("lo"),
                      F.round(edge(F.col("bin") + 1), digits).alias("hi"),
                      F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def correlation_matrix(df: DataFrame, cols: list[str], digits: int = DIGITS) -> DataFrame:
    """Long Pearson matrix (col_a, col_b, corr) from one pass of moment sums.

    ``corr`` is NULL where a column is constant (undefined).  Integer-valued
    columns give exact integer moments, so the value does not depend on the
    order of summation.
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        aggs += [F.sum(F.col(c)).alias(f"_s_{c}"), F.sum(F.col(c) * F.col(c)).alias(f"_q_{c}")]
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            aggs.append(F.sum(F.col(a) * F.col(b)).alias(f"_p_{a}_{b}"))
    m = df.agg(*aggs)

    def d(name):   # exact integer moments, no BIGINT overflow
        return F.col(name).cast("decimal(38,0)")

    def var(c):
        return (d("_n") * d(f"_q_{c}") - d(f"_s_{c}") * d(f"_s_{c}")).cast("double")

    rows = []
    for a in cols:
        for b in cols:
            if a == b:
                cov = var(a)
            else:
                p = f"_p_{a}_{b}" if cols.index(a) < cols.index(b) else f"_p_{b}_{a}"
                cov = (d("_n") * d(p) - d(f"_s_{a}") * d(f"_s_{b}")).cast("double")
            den = F.sqrt(var(a) * var(b))
            r = F.when(den > 0, F.round(cov / den, digits))
            rows.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), r.alias("corr")))
    return m.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def class_weight(df: DataFrame, label: str = "toxic", digits: int = 6) -> DataFrame:
    """(pos_ratio, class_weight): (1 - p) / max(p, 1e-6), p = positive share."""
    p = F.avg(F.col(label).cast("double"))
    agg = df.agg(p.alias("_p"))
    w = (F.lit(1.0) - F.col("_p")) / F.greatest(F.col("_p"), F.lit(POS_WEIGHT_FLOOR))
    return agg.select(F.round("_p", digits).alias("pos_ratio"), F.round(w, digits).alias("class_weight"))
