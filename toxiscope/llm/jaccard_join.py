"""N-gram Jaccard self-join as a join in the metric space of shingle sets.

Jaccard distance is a metric, and a link is a distance of at most
``1 - THRESHOLD``.  The join works on two kinds of pivots.

*Cells.*  Whole documents make poor first pivots: nearly all texts lie at
distance 1 of any of them.  The first pivots are therefore the one-shingle
sets.  A document is at distance 1 - 1/n from those it contains and at 1 from
all others; ties are broken by one order of all shingles, so its Voronoi
region is that of its first shingle.  The triangle inequality bounds how many
of its shingles a linked document can miss, floor((1 - THRESHOLD) n): it is
replicated to the regions of that many more shingles, and any two linked
documents meet in a region.  The order puts shingles that fill large regions
(more than ``HOT`` replicas, found in two rounds) last, which recursively
splits the regions of common passages and of large groups by what else their
documents hold.

*Balls.*  In every region one document is the pivot.  Each document is
compared exactly with the pivot it shares most regions with; those within
the threshold hang on it, so a group of any number of near copies costs one
comparison a document and round, never all pairs.  Documents of a region that
has more than one component left go to the next round with other pivots.
After ``ROUNDS`` rounds the regions that still hold several components
pair members across components only, and compare a pair exactly if its sizes,
the places of the common shingle and the number of regions it shares leave it
a chance, again by the triangle inequality.  Every pair that can be linked is thus compared or already
connected: components are exact.

Equal sets are one node throughout.  A shingle is known by 63 bits of a
64-bit hash, a set by the first of two 64-bit signatures; the second one is
checked, and a clash raises an error.

Defined results: a null text, or one without words, has an empty set, links
to nothing and is its own component; of repeated ids each row gets its
result; rows without an id take part, and a component's id is its smallest
non-null doc_id; other columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toxiscope.llm.common import Scratch, bit_table, in_table, text_steps, tidy
from toxiscope.llm.components import components
from toxiscope.llm.words import LOWER, SOLID, mix, shingles, span_hashes, spans

SHINGLE = 5
#: A link: PER * |intersection| >= LEAST * |union|.
LEAST, PER = 80, 100
HOT, DENSE, ROUNDS = 8, 8, 2
ORDER_BITS, NODE_BITS = 1 << 26, 1 << 24
FIRST = np.int64(-2**63)  # marks the shingles that come first in the order


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted set of 63-bit shingles of every text."""
    n = len(offsets) - 1
    data = LOWER[data]
    starts, ends, owner = spans(data, offsets, SOLID)
    hashes, at = shingles(span_hashes(data, starts, ends), owner, n, SHINGLE)
    hashes = (hashes >> np.uint64(1)).astype(np.int64)
    bounds = np.searchsorted(owner[at], np.arange(n + 1)) if len(at) else np.zeros(n + 1, np.int64)
    return [np.unique(hashes[bounds[i]:bounds[i + 1]]) for i in range(n)]


def prefix_length(n: int) -> int:
    """Regions of a set of n shingles: as many as a linked set can miss, and one."""
    return n - -(-LEAST * n // PER) + 1 if n else 0


def signature(shingles_: np.ndarray, salt: int) -> int:
    """64-bit signature of a set."""
    if not len(shingles_):
        return 0
    return int(mix(np.sum(mix(shingles_.view(np.uint64) * np.uint64(2) + np.uint64(salt)), dtype=np.uint64, keepdims=True)
                   + np.uint64(len(shingles_))).view(np.int64)[0])


def _common(docs: DataFrame) -> np.ndarray:
    """Table of common shingles: first those that more than HOT documents have
    among their first in hash order; then, of all shingles of the documents
    that have a good share of these, again those of more than HOT documents.
    """
    first = _counted(docs, None)
    return first | _counted(docs, docs.sparkSession.sparkContext.broadcast(first))


def _counted(docs: DataFrame, table) -> np.ndarray:
    """Without a table: counts the shingles in the documents' first regions; with one: all
    shingles of the documents of whose first regions one in DENSE or more is in the table."""
    def chosen(own: np.ndarray) -> np.ndarray:
        start = own[:prefix_length(len(own))] & 0x7FFFFFFF
        if table is None:
            return start
        dense = DENSE * np.count_nonzero(in_table(table.value, start)) >= max(1, len(start))
        return own & 0x7FFFFFFF if dense else start[:0]

    def count(batches):
        kept, size = [], 0

        def rows():
            slots, n = np.unique(np.concatenate(kept), return_counts=True)
            kept.clear()
            for at in range(0, len(slots), 200_000):
                part = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(slots[part]), pa.array(n[part].astype(np.int32))], ["slot", "n"])

        for batch in batches:
            for _, _, data, offsets in text_steps(batch):
                for own in shingle_sets(data, offsets):
                    kept.append(chosen(own).astype(np.int32))
                    size += len(kept[-1])
                if size > 8_000_000:
                    yield from rows()
                    size = 0
        if kept:
            yield from rows()

    slots = docs.select("text").mapInArrow(tidy(count), "slot int, n int").groupBy("slot").agg(F.sum("n").alias("n"))
    return bit_table(slots.filter(F.col("n") > HOT), "slot", ORDER_BITS)


def _ordered(shingles_: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The set as sorted numbers in which common shingles come last."""
    return np.sort(np.where(in_table(table, shingles_ & 0x7FFFFFFF), shingles_, shingles_ | FIRST))


def _sets(docs: DataFrame, table, wanted=None) -> DataFrame:
    """(doc_id, n, node, check, shingles) of every row; shingles: the regions, or, of wanted nodes, all."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            for at, end, data, offsets in text_steps(batch):
                sets = shingle_sets(data, offsets)
                nodes = np.array([signature(s, 1) for s in sets], np.int64)
                keep = np.arange(end - at)
                if wanted is None:
                    lists = [_ordered(s, table.value)[:prefix_length(len(s))] for s in sets]
                else:
                    keep = np.flatnonzero(in_table(wanted.value, nodes))
                    lists = [_ordered(sets[i], table.value) for i in keep]
                if not len(keep):
                    continue
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at + keep)), pa.array([len(sets[i]) for i in keep], pa.int32()),
                     pa.array(nodes[keep]), pa.array([signature(sets[i], 3) for i in keep], pa.int64()),
                     pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "n", "node", "check", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(
        tidy(work), f"doc_id {kind}, n int, node long, check long, shingles array<long>")


def _overlap(n: Column, m: Column) -> Column:
    """Smallest intersection of linked sets of n and m shingles."""
    return F.ceil(LEAST * (n + m) / F.lit(PER + LEAST)).cast("int")


def _sizes_fit(n: Column, m: Column) -> Column:
    return (PER * F.least(n, m)) >= (LEAST * F.greatest(n, m))


def _enough(shared: Column, n: Column, m: Column) -> Column:
    """If nodes of n and m shingles that share so many regions can be linked.

    Below the end of the shorter of both replica lists all common shingles
    are known; above it a node has at most ceil(n LEAST / PER) - 1 left.
    """
    return shared >= _overlap(n, m) - F.ceil(LEAST * F.greatest(n, m) / F.lit(PER)).cast("int") + 1


class _Known:
    """Whole sets of nodes, fetched from the texts."""

    def __init__(self, docs: DataFrame, table, scratch: Scratch):
        self.docs, self.table, self.scratch, self.sets, self.n = docs, table, scratch, None, 0

    def fetch(self, nodes: DataFrame) -> None:
        """Only the sets of ``nodes`` leave the tasks that make them."""
        if self.sets is not None:
            nodes = nodes.join(self.sets.select("node"), "node", "left_anti")
        nodes = self.scratch.keep(nodes.distinct(), f"wanted-{self.n}")
        if nodes.isEmpty():
            return
        wanted = self.docs.sparkSession.sparkContext.broadcast(bit_table(nodes, "node", NODE_BITS))
        found = (_sets(self.docs, self.table, wanted).select("node", "n", "shingles").dropDuplicates(["node"])
                 .join(nodes, "node", "left_semi"))
        found = self.scratch.keep(found, f"sets-{self.n}")
        self.sets = found if self.sets is None else self.sets.unionByName(found)
        self.n += 1
        _release(self.scratch)

    def links(self, pairs: DataFrame, name: str) -> DataFrame | None:
        """(u, v): the pairs of nodes that an exact comparison of their sets links; None if there is no pair.

        Pairs of nodes whose sets aren't known are left out.
        """
        if self.sets is None or pairs.isEmpty():
            return None
        sets = self.sets
        left = pairs.join(sets.select(F.col("node").alias("u"), "n", F.col("shingles").alias("left")), "u")
        both = left.join(sets.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col("shingles").alias("right")), "v")
        found = (both.select("u", "v", "n", "m", F.size(F.array_intersect("left", "right")).alias("both"))
                 .filter(PER * F.col("both") >= LEAST * (F.col("n") + F.col("m") - F.col("both"))).select("u", "v"))
        found = self.scratch.keep(found, f"{name}-links")
        _release(self.scratch)
        return found


def _left_over(open_: DataFrame, labels: DataFrame) -> DataFrame:
    """(u, v): pairs across components of a region that sizes and places leave.

    A pair's first common shingle is followed by all the others, so the
    smaller set has it among its first n - 8n/9; and one of the two is
    outside the region's largest component.  Joining only such rows keeps
    regions of one large component, and those of many far members, linear.
    """
    placed = open_.join(labels, "node").select("region", "node", "n", "place", "component")
    main = (placed.groupBy("region", "component").agg(F.count("*").alias("k"))
            .groupBy("region").agg(F.max(F.struct("k", "component")).alias("m")).select("region", F.col("m.component").alias("main")))
    placed = placed.join(main, "region").withColumn("main", F.col("component") == F.col("main"))
    early = placed.filter(F.col("n") - F.col("place") >= _overlap(F.col("n"), F.col("n")))

    def side(rows: DataFrame, names: str) -> DataFrame:
        node, size, place, component = names.split()
        return rows.select("region", F.col("node").alias(node), F.col("n").alias(size), F.col("place").alias(place),
                           F.col("component").alias(component))

    need = _overlap(F.col("n"), F.col("m"))
    fits = ((F.col("cu") != F.col("cv")) & (F.col("n") <= F.col("m")) & _sizes_fit(F.col("n"), F.col("m"))
            & (F.col("n") - F.col("i") >= need) & (F.col("m") - F.col("j") >= need))
    small, large = "u n i cu", "v m j cv"
    found = [side(early.filter("NOT main"), small).join(side(placed, large), "region").filter(fits),
             side(early.filter("main"), small).join(side(placed.filter("NOT main"), large), "region").filter(fits)]
    return found[0].unionByName(found[1]).select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _sharing(pairs: DataFrame, open_: DataFrame) -> DataFrame:
    """The pairs that share enough regions; those of a pair across components are all open."""
    held = open_.groupBy("node", "n").agg(F.collect_list("region").alias("regions"))
    left = pairs.join(held.select(F.col("node").alias("u"), "n", F.col("regions").alias("left")), "u")
    both = left.join(held.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col("regions").alias("right")), "v")
    return both.filter(_enough(F.size(F.array_intersect("left", "right")), F.col("n"), F.col("m"))).select("u", "v")


def _release(scratch: Scratch) -> None:
    """Lets Spark delete the shuffle files of finished steps."""
    gc.collect()
    scratch.spark._jvm.System.gc()


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard-join")
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    table = spark.sparkContext.broadcast(_common(named))
    rows = scratch.keep(_sets(named, table), "rows")
    nodes = scratch.keep(rows.filter("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("label"), F.max("n").alias("n"),
        ((F.min("check") != F.max("check")) | (F.min("n") != F.max("n"))).alias("clash")), "nodes")
    if not nodes.filter("clash").isEmpty():
        raise ValueError("two different shingle sets have the same signature")

    # members of the regions that hold more than one node
    replicas = rows.select("node", "n", F.posexplode("shingles").alias("place", "region"))
    shared = (replicas.groupBy("region").agg(F.min("node").alias("a"), F.max("node").alias("b"))
              .filter("a <> b").select("region"))
    members = scratch.keep(replicas.join(shared.hint("merge"), "region").distinct(), "members")
    _release(scratch)
    known = _Known(named, table, scratch)
    # for the rounds: nodes that share a fair part of their regions; the others' pairs wait for the last step
    known.fetch(members.groupBy("node", "n").agg(F.count("*").alias("k")).filter(30 * F.col("k") >= F.col("n")).select("node"))
    links, labels, open_ = None, members.select("node", F.col("node").alias("component")).distinct(), members
    for turn in range(ROUNDS):
        placed = open_.join(labels, "node")
        # a region's pivot: first the node that has its shingle earliest, having the fewest rarer ones; then any
        order = F.col("place").cast("long") if turn == 0 else F.xxhash64("node", F.lit(turn))
        first = F.struct(order.alias("o"), F.col("node").alias("v"), F.col("n").alias("m"), F.col("component").alias("c"))
        pivots = placed.groupBy("region").agg(F.min(first).alias("pivot"))
        best = (placed.join(pivots, "region")
                .filter((F.col("component") != F.col("pivot.c")) & _sizes_fit(F.col("n"), F.col("pivot.m")))
                .groupBy(F.col("node").alias("u"), "n", F.col("pivot.v").alias("v"), F.col("pivot.m").alias("m"))
                .agg(F.count("*").alias("shared")).filter(_enough(F.col("shared"), F.col("n"), F.col("m")))
                .groupBy("u").agg(F.max(F.struct("shared", "v")).alias("best")).select("u", F.col("best.v").alias("v")))
        new = known.links(scratch.keep(best, f"pairs-{turn}"), f"round-{turn}")
        if new is None:
            continue
        links = new if links is None else links.unionByName(new)
        whole = components(links, scratch, f"whole-{turn}")
        labels = scratch.keep(members.select("node").distinct().join(whole, "node", "left")
                              .select("node", F.coalesce("component", "node").alias("component")), f"labels-{turn}")
        open_ = scratch.keep(_unresolved(open_, labels), f"open-{turn}")
        _release(scratch)

    pairs = scratch.keep(_left_over(open_, labels), "left-over")
    pairs = scratch.keep(_sharing(pairs, open_), "pairs-last")
    known.fetch(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))))
    new = known.links(pairs, "last")
    if new is not None:
        links = new if links is None else links.unionByName(new)
    if links is None:
        links = nodes.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)
    whole = components(links, scratch, "whole")
    _release(scratch)
    named_nodes = nodes.join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named_nodes.groupBy("component").agg(F.min("label").alias("component_id"))
    ids_of = named_nodes.join(ids, "component").select("node", "component_id")
    return rows.select("doc_id", "n", "node").join(ids_of, "node", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, one document of each component: the one with the smallest id.

    Rows with the same id are one document; rows without an id stay.
    """
    own, gone_id = join(docs, doc_id, text), "__gone"
    while gone_id in docs.columns:
        gone_id += "_"
    gone = (own.groupBy(F.col("doc_id").alias(gone_id))
            .agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("all_gone")).filter("all_gone").select(gone_id))
    return docs.join(gone, docs[doc_id] == gone[gone_id], "left_anti")


def _unresolved(open_: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of regions that hold more than one component."""
    mixed = (open_.join(labels, "node").groupBy("region").agg(F.min("component").alias("a"), F.max("component").alias("b"))
             .filter("a <> b").select("region"))
    return open_.join(mixed, "region", "left_semi")
