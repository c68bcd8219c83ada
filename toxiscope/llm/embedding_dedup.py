"""Near copies among vectors by collision counting on sorted projections.

A table of projections is a random rotation: a vector stands in the sorted
list of the direction on which its projection is largest (of one direction
each of several rotations, once the lists would get long), at the place of
that value.  Two vectors collide in a table if they stand in one list and
each lies in the other's window.  Pairs that collide in at least ``least``
tables are verified by their exact cosine; the number of tables, the window
and ``least`` are calibrated on pairs with a cosine of exactly ``LINK`` so
that ``RECALL`` of them are found whatever the data, as random rotations
treat all directions alike.

Copies don't multiply: a vector within half the link angle of the pivot of a
still finer list joins that pivot's ball.  All vectors of a ball are linked by
the triangle inequality, so lists, pairs, links and components work on balls;
two balls on the border are compared vector by vector, in blocks.

Rules: a vector that is null, empty, zero or holds null or non-finite
components links with nothing, as do vectors of different lengths; repeated
rows and ids count as vectors of their own; ``component_id`` is the smallest
id of the component, null if it has none.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toxiscope.llm.common import Scratch, keyed
from toxiscope.llm.components import components
from toxiscope.llm.words import mix

LINK = 0.9
#: Share of the pairs at cosine ``LINK`` that the calibrated count finds.
RECALL = 0.98
#: Vectors that a list of projections holds on average, at most.
LIST = 32
#: Directions of a rotation; collisions that a pair needs at least; tables tried; pairs to calibrate on.
DIRECTIONS, LEAST, TABLES, PAIRS = 64, 2, (8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256), 4000
#: Tables whose lists have pivots.
PIVOT_TABLES = 3
#: Vectors of a ball that travel together when two balls are compared.
BLOCK = 32
#: Rows that one numpy step projects.
STEP = 2048
_SEED = 20260212
_ANGLE = math.acos(LINK)
_SLACK = 1e-9


@lru_cache(maxsize=8)
def rotations(dim: int, tables: int, levels: int, first: int) -> np.ndarray:
    """(tables, levels, dim, directions) of orthonormal columns, the same on every machine."""
    wide = min(dim, DIRECTIONS)
    rng = np.random.Generator(np.random.PCG64([_SEED, dim, first, levels]))
    return np.stack([np.stack([np.linalg.qr(rng.standard_normal((dim, wide)))[0] for _ in range(levels)]) for _ in range(tables)])


def project(units: np.ndarray, tables: int, levels: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(list, value) of every unit vector in every table: int64 and float64 arrays of rows x tables."""
    n, dim = units.shape
    turn = rotations(dim, tables, levels, first)
    lists, values = np.zeros((n, tables), np.uint64), np.zeros((n, tables))
    row = np.arange(n)
    for t in range(tables):
        for level in range(levels):
            on = units @ turn[t, level]
            axis = np.abs(on).argmax(1)
            top = on[row, axis]
            lists[:, t] = lists[:, t] * np.uint64(2 * turn.shape[3]) + (2 * axis + (top < 0)).astype(np.uint64)
            if not level:
                values[:, t] = np.abs(top)
        lists[:, t] = mix(lists[:, t] * np.uint64(tables) + np.uint64(t) + (np.uint64(dim) << np.uint64(48)))
    return lists.view(np.int64), values


@dataclass(frozen=True)
class Plan:
    levels: int
    tables: int
    window: float
    least: int


@lru_cache(maxsize=64)
def calibrated(dim: int, levels: int) -> Plan:
    """The fewest tables in which ``RECALL`` of the pairs at cosine ``LINK`` collide ``LEAST`` times, and the highest
    count that so many reach in them."""
    rng = np.random.Generator(np.random.PCG64([_SEED, dim, 7]))
    x, z = (rng.standard_normal((PAIRS, dim)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if dim > 1:
        z -= (z * x).sum(1)[:, None] * x
        z /= np.linalg.norm(z, axis=1)[:, None]
        y = LINK * x + math.sqrt(1 - LINK * LINK) * z
    else:
        y = x
    window = None
    for tables in TABLES:
        (a, va), (b, vb) = project(x, tables, levels), project(y, tables, levels)
        same, apart = a == b, np.abs(va - vb)
        if window is None:
            window = float(np.quantile(apart[same], 0.98)) + _SLACK if same.any() else 1.0
        counts = np.sort((same & (apart <= window)).sum(1))
        least = int(counts[int((1 - RECALL) * PAIRS)])
        if least >= LEAST:
            break
    return Plan(levels, tables, window, max(least, 1))


def plan_for(vectors: int, dim: int) -> Plan:
    """Levels so that a list holds at most about ``LIST`` of unrelated vectors."""
    levels, lists = 1, 2 * min(dim, DIRECTIONS)
    while vectors > LIST * lists ** levels and levels < 6:
        levels += 1
    return calibrated(dim, levels)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors in double precision) of each length of the vectors of a list column without nulls."""
    starts = np.asarray(column.offsets, np.int64)
    values = np.asarray(column.values).astype(np.float64)
    lengths = np.diff(starts)
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        m = values[starts[rows][:, None] + np.arange(dim)]
        m = m / np.abs(m).max(1)[:, None]
        yield rows, m / np.linalg.norm(m, axis=1)[:, None]


def _project_all(plans: dict[int, Plan], finer: bool):
    """(list, value, id) of every vector in every table, or the lists of the pivots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for rows, units in _matrices(batch.column(1)):
                plan = plans[units.shape[1]]
                tables, levels, first = (PIVOT_TABLES, plan.levels + 1, 1) if finer else (plan.tables, plan.levels, 0)
                for at in range(0, len(rows), STEP):
                    lists, values = project(units[at:at + STEP], tables, levels, first)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lists.ravel()), pa.array(values.ravel()), pa.array(np.repeat(ids[rows[at:at + STEP]], tables))],
                        ["list", "value", "id"])
    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, cosine) of pairs (a, b, x, y); -1 for vectors of different lengths."""
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        out = np.full(batch.num_rows, -1.0)
        length = np.diff(np.asarray(x.offsets)) == np.diff(np.asarray(y.offsets))
        for rows, units in _matrices(x):
            rows, units = rows[length[rows]], units[length[rows]]
            if len(rows):
                out[rows] = np.einsum("ij,ij->i", units, next(_matrices(y.take(pa.array(rows))))[1])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["a", "b", "cosine"])


def cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, cosine) of the pairs (a, b) of rows of ``vectors`` (row, vec)."""
    x, y = (vectors.select(F.col("row").alias(n), F.col("vec").alias(v)) for n, v in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_cosines, "a long, b long, cosine double")


def _balls(vectors: DataFrame, plans: dict[int, Plan], scratch: Scratch) -> DataFrame:
    """vectors + (ball, near): a row whose vector is within half the link angle, and the cosine with it."""
    lists = scratch.keep(vectors.select("row", "vec").mapInArrow(_project_all(plans, True), "list long, value double, id long")
                         .select("list", "id"), "pivot-lists")
    pivots = lists.groupBy("list").agg(F.min("id").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    pairs = lists.join(pivots, "list").filter("id <> b").select(F.col("id").alias("a"), "b").distinct()
    half = math.cos(_ANGLE / 2 - _SLACK)
    near = cosines(pairs, vectors).filter(F.col("cosine") >= half).groupBy(F.col("a").alias("row")).agg(
        F.min(F.struct("b", "cosine")).alias("to"))
    out = scratch.keep(vectors.join(near, "row", "left").select(
        "row", "vec_id", "vec", F.coalesce("to.b", "row").alias("ball"), F.coalesce("to.cosine", F.lit(1.0)).alias("near")), "members")
    scratch.drop("pivot-lists")
    return out


def _candidates(members: DataFrame, plans: dict[int, Plan]) -> DataFrame:
    """(a, b) of balls that collide often enough, each pair once; a < b."""
    dims = F.create_map(*[F.lit(v) for dim, plan in plans.items() for v in (dim, float(plan.window))])
    least = F.create_map(*[F.lit(v) for dim, plan in plans.items() for v in (dim, plan.least)])
    dim_of = members.groupBy("ball").agg(F.first(F.size("vec")).alias("dim")) if len(plans) > 1 else None
    lists = members.select("ball", "vec").mapInArrow(_project_all(plans, False), "list long, value double, id long")
    # a ball has one place in a list, from its least to its largest value
    places = lists.groupBy("list", F.col("id").alias("ball")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    if dim_of is not None:
        places = places.join(dim_of, "ball").withColumn("window", dims[F.col("dim")]).withColumn("least", least[F.col("dim")])
    else:
        plan = next(iter(plans.values()))
        places = places.withColumn("window", F.lit(plan.window)).withColumn("least", F.lit(plan.least))
    x, y = places.alias("x"), places.alias("y")
    met = x.join(y, (F.col("x.list") == F.col("y.list")) & (F.col("x.ball") < F.col("y.ball"))
                 & (F.col("y.low") <= F.col("x.high") + F.col("x.window")) & (F.col("x.low") <= F.col("y.high") + F.col("x.window")))
    return (met.groupBy(F.col("x.ball").alias("a"), F.col("y.ball").alias("b"))
            .agg(F.count("*").alias("n"), F.min("x.least").alias("least")).filter("n >= least").select("a", "b"))


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, row, n): links of each vector of one block with those of another, where it has any."""
    for batch in batches:
        out = []
        ra, rb = (batch.column(i).to_pylist() for i in (2, 4))
        for i in range(batch.num_rows):
            x, y = (next(_matrices(batch.column(c)[i].values))[1] for c in (3, 5))
            if x.shape[1] != y.shape[1]:
                continue
            linked = x @ y.T >= LINK
            for rows, counts in ((ra[i], linked.sum(1)), (rb[i], linked.sum(0))):
                out += [(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), r, int(n)) for r, n in zip(rows, counts) if n]
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "row", "n"])


def _border(pairs: DataFrame, members: DataFrame, stats: DataFrame) -> DataFrame:
    """(a, b, row, n) of balls (a, b) of which some vectors may be linked and others not."""
    balls = pairs.select(F.col("a").alias("ball")).unionByName(pairs.select(F.col("b").alias("ball"))).distinct()
    blocks = (members.join(balls, "ball").join(stats.select("ball", "size"), "ball")
              .groupBy("ball", F.pmod(F.xxhash64("row"), F.ceil(F.col("size") / BLOCK)).alias("block"))
              .agg(F.collect_list(F.struct("row", "vec")).alias("m"))
              .select("ball", F.col("m.row").alias("rows"), F.col("m.vec").alias("vecs")))
    x, y = (blocks.select(F.col("ball").alias(n), F.col("rows").alias(f"r{n}"), F.col("vecs").alias(f"v{n}")) for n in "ab")
    return (pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "ra", "va", "rb", "vb")
            .mapInArrow(_compare_blocks, "a long, b long, row long, n long"))


def near_copies(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``."""
    scratch = Scratch(vectors.sparkSession, "embedding-dedup")
    fit = F.coalesce((F.size(vec_col) > 0) & F.forall(vec_col, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
                     & F.exists(vec_col, lambda v: v != 0), F.lit(False))
    rows = scratch.keep(keyed(vectors, F.col(id_col).alias("vec_id"), F.when(fit, F.col(vec_col)).alias("vec")), "rows")
    valid = rows.filter("vec IS NOT NULL")
    plans = {r["dim"]: plan_for(r["n"], r["dim"]) for r in valid.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()}
    alone = rows.filter("vec IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not plans:
        return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    members = _balls(valid, plans, scratch)
    stats = scratch.keep(members.groupBy("ball").agg(F.count("*").alias("size"), F.min("near").alias("near"),
                                                    F.min("vec_id").alias("first")), "balls")
    pairs = cosines(scratch.keep(_candidates(members, plans), "candidates"), valid)
    for n in "ab":
        pairs = pairs.join(stats.select(F.col("ball").alias(n), F.col("size").alias(f"size_{n}"), F.acos("near").alias(f"reach_{n}")), n)
    angle = F.acos(F.least(F.greatest(F.col("cosine"), F.lit(-1.0)), F.lit(1.0)))
    reach = F.col("reach_a") + F.col("reach_b")
    kind = (F.when(reach == 0, F.when(F.col("cosine") >= LINK, "all")).when(F.col("cosine") == -1.0, None)
            .when(angle + reach <= _ANGLE - _SLACK, "all").when(angle - reach <= _ANGLE + _SLACK, "some"))
    pairs = scratch.keep(pairs.withColumn("kind", kind).filter("kind IS NOT NULL"), "pairs")
    whole, some = pairs.filter("kind = 'all'"), pairs.filter("kind = 'some'")
    single = scratch.keep(_border(some, members, stats), "border")
    edges = whole.select("a", "b").unionByName(single.select("a", "b")).distinct()
    found = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch, "links")
    firsts = (stats.join(found, F.col("ball") == F.col("node"), "left")
              .select("ball", "size", "first", F.coalesce("component", "ball").alias("component")))
    lows = firsts.groupBy("component").agg(F.min("first").alias("component_id"))
    more = (whole.select(F.col("a").alias("ball"), F.col("size_b").alias("n"))
            .unionByName(whole.select(F.col("b").alias("ball"), F.col("size_a").alias("n")))
            .groupBy("ball").agg(F.sum("n").alias("more")))
    per_ball = firsts.join(lows, "component").join(more, "ball", "left").select(
        "ball", "component_id", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("base"))
    per_row = single.groupBy("row").agg(F.sum("n").alias("n"))
    linked = members.select("row", "vec_id", "ball").join(per_ball, "ball").join(per_row, "row", "left").select(
        "vec_id", (F.col("base") + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), "component_id")
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
