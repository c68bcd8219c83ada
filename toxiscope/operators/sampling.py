"""Exact, deterministic sampling by hash order.

Every row gets a pseudo-random order key ``md5('<seed>:<id>')`` (identical in
Spark and DuckDB).  Quotas are cut points in that order inside each group
(e.g. per label).  The naive ``row_number() over (partition by label order by
hash)`` moves a whole class -- possibly most of the table -- into one task.
Instead rows are counted per (group, hash bucket); prefix sums over those at
most ``16**HEX_DIGITS`` bucket counts per group locate the bucket holding
each cut; only rows of those boundary buckets are ranked, and the rank window
is partitioned by (group, bucket).  All other rows get their segment from
small broadcast arrays, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEX_DIGITS = 4
SEED = 42
TEST_SIZE = 0.2


def hash_order(id_col: Column | str, seed: int | str = SEED) -> Column:
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), col.cast("string")).cast("binary"))


def _bucket(h: Column, digits: int) -> Column:
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("int")


def _same(cols: list[str], left: str, right: str) -> Column:
    """Null-safe equality of prefixed group columns: NULL is a group of its own."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(left + c).eqNullSafe(F.col(right + c))
    return cond


def assign_segments(df: DataFrame, group_cols: list[str], id_col: str,
                    cuts: DataFrame, seed: int | str = SEED,
                    out: str = "segment", digits: int = HEX_DIGITS) -> DataFrame:
    """Segment index of each row in hash order within its group.

    ``cuts`` holds one row per group with ``cuts ARRAY<BIGINT>`` (ascending
    ranks, 0-based).  A row of rank r gets ``#cuts <= r``; so with cuts
    [k] the first k rows of the group get 0 and the rest 1.  Groups absent
    from ``cuts`` get segment 0.
    """
    g = list(group_cols)
    keyed = (df.withColumn("_h", hash_order(id_col, seed))
               .withColumn("_b", _bucket(F.col("_h"), digits)))

    counts = keyed.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))

    cut_rows = cuts.select(*g, F.explode("cuts").alias("_cut"))
    cond = [counts[c].eqNullSafe(cut_rows[c]) for c in g]
    cond += [counts["_before"] <= cut_rows["_cut"],
             cut_rows["_cut"] < counts["_before"] + counts["_cnt"]]
    # cut_rows has (#groups x #cuts) rows: a fixed, tiny broadcast side.
    bnd = (counts.join(F.broadcast(cut_rows), cond, "inner")
                 .select(*[counts[c] for c in g], "_b", "_before"))
    found = (bnd.groupBy(*[F.col(c).alias(f"_f_{c}") for c in g])
                .agg(F.collect_list(F.struct(F.col("_b").alias("b"),
                                             F.col("_before").alias("before"))).alias("_bnd")))
    own = cuts.select(*[F.col(c).alias(f"_c_{c}") for c in g], F.col("cuts").alias("_cuts"))
    info = own.join(found, _same(g, "_c_", "_f_"), "left").drop(*[f"_f_{c}" for c in g])

    rows = keyed.join(F.broadcast(info), _same(g, "", "_c_"), "left").drop(*[f"_c_{c}" for c in g])
    bnd_arr = F.coalesce(F.col("_bnd"), F.array().cast(
        "array<struct<b:int,before:bigint>>"))
    cut_arr = F.coalesce(F.col("_cuts"), F.array().cast("array<bigint>"))
    is_boundary = F.exists(bnd_arr, lambda s: s["b"] == F.col("_b"))
    rows = (rows.withColumn("_bnd", bnd_arr).withColumn("_cuts", cut_arr)
                .withColumn("_isb", is_boundary))

    plain = (rows.filter(~F.col("_isb"))
                 .withColumn(out, F.size(F.filter("_bnd", lambda s: s["b"] < F.col("_b")))))

    rank_w = Window.partitionBy(*g, "_b").orderBy("_h", id_col)
    edge = (rows.filter(F.col("_isb"))
                .withColumn("_base", F.filter("_bnd", lambda s: s["b"] == F.col("_b"))[0]["before"])
                .withColumn("_rank", F.col("_base") + F.row_number().over(rank_w) - 1)
                .withColumn(out, F.size(F.filter("_cuts", lambda c: c <= F.col("_rank")))))

    cols = df.columns + [out]
    return plain.select(*cols).unionByName(edge.select(*cols))


def _largest_remainder(counts: DataFrame, label: str, draws: Column) -> DataFrame:
    """Per-class share of ``draws`` by the largest-remainder rule.

    ``counts`` is (label, cnt) -- one row per class, a tiny table.  Ties in
    the remainder go to the lower label first.  Integers throughout.
    """
    whole = Window.partitionBy()
    n = F.sum("cnt").over(whole)
    c = counts.withColumn("_n", n).withColumn("_draws", draws)
    wide = F.col("cnt").cast("decimal(19,0)") * F.col("_draws").cast("decimal(18,0)")
    c = c.withColumn("_cont", wide)
    c = c.withColumn("_rem", F.col("_cont") % F.col("_n").cast("decimal(19,0)"))
    c = c.withColumn("_fl", F.expr("CAST((_cont - _rem) div CAST(_n AS DECIMAL(19,0)) AS BIGINT)"))
    c = c.withColumn("_need", F.col("_draws") - F.sum("_fl").over(whole))
    c = c.withColumn("_rr", F.row_number().over(
        Window.partitionBy().orderBy(F.desc("_rem"), F.asc(label))))
    return c.withColumn("take", (F.col("_fl") + F.when(F.col("_rr") <= F.col("_need"), 1)
                                 .otherwise(0)).cast("bigint"))


def split_quotas(df: DataFrame, label: str, test_size: float = TEST_SIZE) -> DataFrame:
    """(label, cnt, n_train, n_test) of an exact stratified train/test split.

    n_test = ceil(test_size * n); the training share is allocated per class by
    largest remainder, the test share is the rest of each class.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("cnt"))
    n = F.sum("cnt").over(Window.partitionBy())
    n_train = n - F.ceil(F.lit(float(test_size)) * n)
    alloc = _largest_remainder(counts, label, n_train)
    return alloc.select(label, "cnt", F.col("take").alias("n_train"),
                        (F.col("cnt") - F.col("take")).alias("n_test"))


def stratified_split(df: DataFrame, label: str = "toxic", id_col: str = "doc_id",
                     test_size: float = TEST_SIZE, seed: int | str = SEED,
                     test_name: str = "test", train_name: str = "train",
                     out: str = "split") -> DataFrame:
    """Exact stratified split: per label the first ``n_test`` rows in hash order."""
    quotas = split_quotas(df, label, test_size)
    cuts = quotas.select(label, F.array(F.col("n_test")).alias("cuts"))
    seg = assign_segments(df, [label], id_col, cuts, seed=seed, out="_seg")
    return (seg.withColumn(out, F.when(F.col("_seg") == 0, F.lit(test_name))
                           .otherwise(F.lit(train_name)))
               .drop("_seg"))


def stratified_subsample(df: DataFrame, n_max: int, label: str = "toxic",
                         id_col: str = "doc_id", seed: int | str = f"{SEED}:sub") -> DataFrame:
    """At most ``n_max`` rows with the label shares kept; no-op when n_max >= rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("cnt"))
    n = F.sum("cnt").over(Window.partitionBy())
    draws = F.least(n, F.lit(int(n_max)))
    alloc = _largest_remainder(counts, label, draws)
    cuts = alloc.select(label, F.array(F.col("take")).alias("cuts"))
    seg = assign_segments(df, [label], id_col, cuts, seed=seed, out="_seg")
    return seg.filter(F.col("_seg") == 0).drop("_seg")


def fold_sizes(df: DataFrame, label: str = "toxic", k: int = 3) -> DataFrame:
    """Per class and fold, the size a stratified, unshuffled k-fold gives.

    Labels are sorted; fold i takes every k-th position starting at i, so a
    class occupying sorted positions [s, s+cnt) gives fold i
    #{p in [s, s+cnt) : p = i mod k} rows.  Returns (label, cuts) with the
    cumulative fold ends as cut points.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("cnt"))
    start = F.coalesce(F.sum("cnt").over(Window.partitionBy().orderBy(label)
                                         .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = counts.withColumn("_s", start)

    def below(x: Column, i: int) -> Column:   # #{p < x : p = i mod k}
        return F.floor((x - F.lit(i) + F.lit(k - 1)) / F.lit(k))

    sizes = [below(F.col("_s") + F.col("cnt"), i) - below(F.col("_s"), i) for i in range(k)]
    ends = []
    acc = None
    for s in sizes[:-1]:
        acc = s if acc is None else acc + s
        ends.append(acc.cast("bigint"))
    return c.select(label, F.array(*ends).alias("cuts"))


def stratified_folds(df: DataFrame, k: int = 3, label: str = "toxic",
                     id_col: str = "doc_id", seed: int | str = SEED,
                     out: str = "fold") -> DataFrame:
    """Fold index 0..k-1: per class, consecutive blocks in hash order."""
    cuts = fold_sizes(df, label, k)
    return assign_segments(df, [label], id_col, cuts, seed=seed, out=out)


def sample_rows(df: DataFrame, n: int, id_col: str, seed: int | str = SEED) -> DataFrame:
    """min(n, rows) rows, uniform without replacement, deterministic."""
    cuts = df.sparkSession.range(1).select(F.array(F.lit(int(n)).cast("bigint")).alias("cuts"))
    tagged = assign_segments(df.withColumn("_all", F.lit(0)), ["_all"], id_col,
                             cuts.withColumn("_all", F.lit(0)), seed=seed, out="_seg")
    return tagged.filter(F.col("_seg") == 0).drop("_seg", "_all")


def first_n(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """The first min(n, rows) rows by key (a top-k: TakeOrderedAndProject)."""
    return df.orderBy(order_col).limit(int(n))
