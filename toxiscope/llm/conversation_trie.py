"""Prefix trie of conversations by burst tries.

Every distinct conversation is one suffix container entry under the trie's
root.  A container with more than ``CONTAINER`` entries bursts: the stretch
that all its entries share becomes a head of trie nodes, and the entries move
on to one container per next turn.  What is left is sorted, and one sweep
over each sorted container emits its nodes with their subtree sums; the heads
follow from one row per container.

Rules: rows without a ``conv_id`` are no conversation; a null role or text is
empty; turns stand by number, null first, and those with equal numbers
(repeated rows too) by the SHA-256 of role and text.  Two turns are the same
if role and text are (128 bits of SHA-256).  A turn's text is read once and
whole; a conversation's turns travel as 32 characters and a word count each,
so one conversation must fit in a row.  Other columns are ignored; an empty
table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toxiscope.llm.common import Scratch, crc_bucket

#: Entries (distinct conversations) of a container that isn't burst.
CONTAINER = 1024
#: Ids of a run that is hashed in one row; a multiple of runs makes up a node's list.
RUN_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string")
_SWEPT = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
                    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
                    ("ends_sha256", pa.string()), ("head", pa.string()), ("path", pa.list_(pa.string()))])


def turn_table(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, id, words) of every turn in its conversation's order."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.substring(F.sha2(whole.cast("binary"), 256), 1, 32).alias("id"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "id")
    return turns.withColumn("pos", F.row_number().over(order)).drop("turn")


def branched(turns: DataFrame, every: int = 20, shared: int = 4) -> DataFrame:
    """(conv_id, part, pos, id, words): every conversation c on the stem c - c % every.

    Its first h = crc32(c) % shared turns are the stem's (all, if it has
    fewer), then its own turns after its first h.  A stem stays as it is.  A
    conversation without a turn left keeps a row without id.
    """
    c = F.col("conv_id")
    stem, h = c - c % every, crc_bucket("conv_id", shared)
    convs = turns.select("conv_id").distinct()
    own = turns.filter((stem == c) | (F.col("pos") > h)).select("conv_id", F.lit(2).alias("part"), "pos", "id", "words")
    first = turns.filter((c % every == 0) & (F.col("pos") < shared)).select(c.alias("stem"), "pos", "id", "words")
    taken = (convs.filter(stem != c).select("conv_id", stem.alias("stem"), h.alias("h")).join(first, "stem")
             .filter("pos <= h").select("conv_id", F.lit(1).alias("part"), "pos", "id", "words"))
    return own.unionByName(taken).unionByName(_marks(convs))


def _marks(convs: DataFrame) -> DataFrame:
    """A row without id for every conversation, so that one without turns isn't lost."""
    return convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("id"),
                        F.lit(0).cast("long").alias("words"))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, words, whole) from (conv_id, part, pos, id, words); ``whole`` tells equal sequences."""
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "pos", "id", "words"))).alias("t"))
    rows = rows.select("conv_id", F.filter("t", lambda t: t["id"].isNotNull()).alias("t"))
    rows = rows.select("conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))
    return rows.withColumn("whole", F.sha2(F.array_join("ids", "").cast("binary"), 256))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(whole, ends): SHA-256 over the runs of each sequence, which arrive in order."""
    now, digest = None, None
    for batch in batches:
        names, sums = [], []
        for whole, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if whole != now:
                if now is not None:
                    names.append(now)
                    sums.append(digest.hexdigest())
                now, digest = whole, hashlib.sha256(run.encode())
            else:
                digest.update(b"," + run.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sums, pa.string())], ["whole", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], ["whole", "ends"])


def _ends(seqs: DataFrame) -> DataFrame:
    """(whole, ends): digest of the ids of the conversations that are one sequence.

    Ids are joined in runs of at most 2 ** ``RUN_BITS`` first, wherever they
    are, so that a sequence that a third of all conversations share sends a
    few long rows to the one task that hashes it, which streams them.
    """
    runs = seqs.groupBy("whole", F.shiftright("conv_id", RUN_BITS).alias("run")).agg(
        F.sort_array(F.collect_list("conv_id")).alias("at"))
    runs = runs.select("whole", "run", F.array_join(F.col("at").cast("array<string>"), ",").alias("joined"))
    ordered = runs.repartition("whole").sortWithinPartitions("whole", "run").select("whole", "joined")
    return ordered.mapInArrow(_digests, "whole string, ends string")


def distinct_sequences(seqs: DataFrame) -> DataFrame:
    """(conv_id, ids, words, n, ends): one row per sequence, under its smallest conversation."""
    groups = seqs.groupBy("whole").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).join(_ends(seqs), "whole")
    return seqs.drop("whole").join(groups.drop("whole"), "conv_id")


def _rest(column: str) -> Column:
    return F.slice(column, F.col("depth") + 1, F.greatest(F.size(column) - F.col("depth"), F.lit(0)))


def burst(entries: DataFrame, scratch: Scratch, limit: int = CONTAINER) -> tuple[int, DataFrame, DataFrame | None, DataFrame | None]:
    """(rounds, containers, heads, ended) of the distinct sequences.

    containers: entries with ``head`` (the container), ``depth`` (turns that
    all its entries share with its head) and ``path`` (heads above).  heads:
    (head, path, depth, skip, counts) of each burst container, whose entries
    share ``skip`` more turns; counts are the last turns' words of its nodes.
    ended: (path, conv_id, n, ends) of sequences that end on a head.  None if
    nothing burst.
    """
    rows = entries.select("conv_id", "ids", "words", "n", "ends", F.lit("").alias("head"), F.lit(0).alias("depth"),
                          F.array().cast("array<string>").alias("path"))
    left, heads, ended = [], [], []
    step = 0
    while True:
        over = scratch.keep(rows.groupBy("head").count().filter(F.col("count") > limit).select("head"), f"over-{step}")
        if over.isEmpty():
            left.append(rows)
            break
        left.append(rows.join(over, "head", "left_anti"))
        more = rows.join(over, "head")
        # what the first and the last entry share, all entries share
        ends = more.groupBy("head").agg(
            F.min(F.struct(_rest("ids").alias("ids"), _rest("words").alias("words"))).alias("low"), F.max(_rest("ids")).alias("high"),
            F.min("depth").alias("depth"), F.min("path").alias("path"),
            F.min(F.get("words", F.col("depth") - 1)).alias("own"))
        differ = F.array_position(F.zip_with("low.ids", "high", lambda a, b: a.eqNullSafe(b)), False)
        ends = ends.withColumn("skip", (differ - 1).cast("int")).select(
            "head", "path", "depth", "skip",
            F.concat(F.array(F.coalesce("own", F.lit(0))), F.slice("low.words", F.lit(1), F.col("skip"))).alias("counts"))
        ends = scratch.keep(ends, f"heads-{step}")
        heads.append(ends)
        shared = F.col("depth") + F.col("skip")
        moved = more.join(ends.select("head", "skip"), "head").withColumn("path", F.concat("path", F.array("head")))
        ended.append(scratch.keep(moved.filter(F.size("ids") == shared).select("path", "conv_id", "n", "ends"), f"ended-{step}"))
        step += 1
        rows = scratch.keep(moved.filter(F.size("ids") > shared).select(
            "conv_id", "ids", "words", "n", "ends",
            F.substring(F.sha2(F.concat("head", F.lit(":"), F.element_at("ids", shared + 1)).cast("binary"), 256), 1, 32).alias("head"),
            (shared + 1).alias("depth"), "path"), f"rows-{step}")

    def one(tables):
        out = None
        for t in tables:
            out = t if out is None else out.unionByName(t)
        return out
    return step, one(left), one(heads), one(ended)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers whose entries arrive sorted.

    The open nodes are one path.  A node is [depth, conv, n, children,
    leaves, saved, ends, words, finished children]; its children are emitted
    when it closes, as their parent's smallest conversation is known then.
    """
    out: list[tuple] = []

    def close(stack, node):
        depth, conv, n, children, leaves, saved, ends, words, kids = node
        for kid in kids:
            out.append((kid[0], kid[1], conv, *kid[2:], None, None))
        done = (conv, depth, n, children, leaves if children else 1, saved + (n - 1) * words, ends)
        if stack:
            up = stack[-1]
            up[1], up[2], up[3] = min(up[1], conv), up[2] + n, up[3] + 1
            up[4], up[5] = up[4] + done[4], up[5] + done[5]
            up[8].append(done)
            return None
        return done

    def finish(stack, head, path):
        while stack:
            done = close(stack, stack.pop())
        out.append((done[0], done[1], None, *done[2:], head, path))

    def batch_of():
        columns = list(zip(*out)) or [()] * len(_SWEPT)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SWEPT)], schema=_SWEPT)

    head, path, last, stack = None, None, [], []
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist()
                for c in ("head", "depth", "path", "ids", "words", "conv_id", "n", "ends")]
        for name, depth, above, ids, words, conv, n, ends in zip(*cols):
            if name != head or head is None:
                if stack:
                    finish(stack, head, path)
                head, path, last = name, above, ids
                stack = [[depth, conv, 0, 0, 0, 0, NO_ENDS, words[depth - 1] if depth else 0, []]]
                same = depth
            else:
                same, most = depth, min(len(ids), len(last))
                while same < most and ids[same] == last[same]:
                    same += 1
                while stack[-1][0] > same:
                    close(stack, stack.pop())
                last = ids
            for d in range(same, len(ids)):
                stack.append([d + 1, conv, 0, 0, 0, 0, NO_ENDS, words[d], []])
            top = stack[-1]
            top[1], top[2], top[6] = min(top[1], conv), top[2] + n, ends
            if len(out) >= 10_000:
                yield batch_of()
    if stack:
        finish(stack, head, path)
    yield batch_of()


def trie(turns: DataFrame, limit: int = CONTAINER) -> DataFrame:
    """One row per node from (conv_id, part, pos, id, words), as :func:`branched` gives them:
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch(turns.sparkSession, "conversation-trie")
    seqs = scratch.keep(sequences(turns), "sequences")
    entries = scratch.keep(distinct_sequences(seqs), "entries")
    scratch.drop("sequences")
    rounds, containers, heads, ended = burst(entries, scratch, limit)
    swept = containers.repartition("head").sortWithinPartitions("head", "ids").mapInArrow(
        _sweep, NODES + ", head string, path array<string>")
    nodes = [c.split()[0] for c in NODES.split(", ")]
    if heads is None:
        return swept.select(*nodes)
    swept = scratch.keep(swept, "swept")
    scratch.drop("entries", *[f"rows-{i + 1}" for i in range(rounds)])
    tops = swept.filter("head IS NOT NULL").withColumn("above", _above())
    upper = scratch.keep(_upper(tops, heads, ended), "upper")
    parents = upper.filter("last").select(F.col("head").alias("above"), F.col("conv_id").alias("_p"))
    tops = tops.join(parents, "above", "left").withColumn("parent_conv_id", F.col("_p"))
    return (swept.filter("head IS NULL").select(*nodes).unionByName(tops.select(*nodes))
            .unionByName(upper.select(*nodes)))


def _above() -> Column:
    """The last head above a container or head, null for the root."""
    return F.get("path", F.size("path") - 1)


def _upper(tops: DataFrame, heads: DataFrame, ended: DataFrame) -> DataFrame:
    """Nodes of the heads, from one row per container, per head and per sequence that ends on a head."""
    below = tops.select("path", "conv_id", "n_convs", "n_leaves", F.col("saved_tokens").alias("saved")).unionByName(
        ended.select("path", "conv_id", F.col("n").alias("n_convs"), F.lit(0).cast("long").alias("n_leaves"),
                     F.lit(0).cast("long").alias("saved")))
    sums = below.withColumn("head", F.explode("path")).groupBy("head").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved").alias("saved"))
    above = _above()
    kids = (tops.select("above").unionByName(heads.filter(F.size("path") > 0).select(above.alias("above")))
            .groupBy(F.col("above").alias("head")).agg(F.count("*").alias("kids")))
    own = heads.join(sums, "head").join(kids, "head").join(
        ended.select(above.alias("head"), F.col("ends")), "head", "left")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, w: a + w)
    inner = (own.select(F.explode("path").alias("head"), ((F.col("n_convs") - 1) * total).alias("inner"))
             .groupBy("head").agg(F.sum("inner").alias("inner")))
    over = sums.select(F.col("head").alias("above"), F.col("conv_id").alias("over"))
    rows = (own.join(inner, "head", "left")
            .withColumn("above", above)
            .join(over, "above", "left").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("skip")))))
    end = F.col("i") == F.col("skip")
    rest = F.aggregate(F.slice("counts", F.col("i") + 1, F.size("counts")), F.lit(0).cast("long"), lambda a, w: a + w)
    return rows.select(
        "head", end.alias("last"), "conv_id", (F.col("depth") + F.col("i")).cast("long").alias("depth"),
        F.when(F.col("i") > 0, F.col("conv_id")).otherwise(F.col("over")).alias("parent_conv_id"), "n_convs",
        F.when(end, F.col("kids")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") + F.coalesce("inner", F.lit(0)) + (F.col("n_convs") - 1) * rest).alias("saved_tokens"),
        F.when(end, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"))


def branched_trie(conversations: DataFrame, limit: int = CONTAINER) -> DataFrame:
    """The trie of the conversations put on their stems (:func:`branched`)."""
    scratch = Scratch(conversations.sparkSession, "conversation-turns")
    return trie(branched(scratch.keep(turn_table(conversations), "turns")), limit)


def whole_trie(conversations: DataFrame, limit: int = CONTAINER) -> DataFrame:
    """The trie of the conversations as they are."""
    scratch = Scratch(conversations.sparkSession, "conversation-turns")
    turns = scratch.keep(turn_table(conversations), "turns").withColumn("part", F.lit(2))
    return trie(turns.unionByName(_marks(turns.select("conv_id").distinct())), limit)


# DuckDB: every node spelled out by the ids of its turns, each subtree sum from all its nodes' ancestors.
ORACLE = """
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
                    lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS tab),
told AS (SELECT conv_id, turn, coalesce(text, '') AS text,
                sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS sha
         FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, substring(sha, 1, 32) AS id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substring(sha, 1, 32)) AS pos FROM told),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS stem,
             xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
                             lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
      FROM (SELECT DISTINCT conv_id FROM t), crc),
r AS (SELECT c.conv_id, 1 AS part, s.pos, s.id, s.words FROM c JOIN t s ON s.conv_id = c.stem AND s.pos <= c.h
      UNION ALL
      SELECT c.conv_id, 2, o.pos, o.id, o.words FROM c JOIN t o ON o.conv_id = c.conv_id AND o.pos > c.h),
p AS (SELECT conv_id, words, row_number() OVER w AS depth, array_to_string(list(id) OVER w, '') AS node
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
m AS (SELECT conv_id, words, depth, node FROM p UNION ALL SELECT conv_id, 0, 0, '' FROM c),
d AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id),
n AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS own FROM m GROUP BY depth, node),
e AS (SELECT m.node, sha256(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id)) AS ends FROM m JOIN d USING (conv_id, depth) GROUP BY m.node),
k AS (SELECT substring(node, 1, 32 * (depth - 1)) AS node, count(*) AS kids FROM n WHERE depth > 0 GROUP BY 1),
a AS (SELECT substring(node, 1, 32 * up) AS node, sum(own) AS saved, count(*) FILTER (kids IS NULL) AS leaves
      FROM (SELECT n.node, n.own, k.kids, unnest(range(0, n.depth + 1)) AS up FROM n LEFT JOIN k USING (node)) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.kids, 0) AS n_children,
       a.leaves AS n_leaves, a.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN a USING (node) LEFT JOIN k USING (node) LEFT JOIN e USING (node)
LEFT JOIN n u ON n.depth > 0 AND u.node = substring(n.node, 1, 32 * (n.depth - 1))
"""
