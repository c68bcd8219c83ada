"""Personal data: base detectors, then information-theoretic sanitisation.

Base detectors find emails, IPv4 addresses, payment cards and phone numbers.
The corpus then says which other words give a found entity away, wherever in
a document both stand: a term discloses an entity if documents that hold both
show the term (its first place) between at least ``SUPPORT`` different pairs
of neighbouring words, so that copies of one passage are one piece of
evidence, if P(entity | term) over documents is at least ``DISCLOSE``, and if
knowing the term raises the entity's probability by ``BITS`` bits or more
(pointwise mutual information).  Terms of P >=
``REMOVE`` are removed, others generalised to their shape, at all their
places in all documents.  A word that overlaps or touches a base span is a
part of it there and discloses nothing by that place.

All counts cover whole texts of the whole corpus.  No document's words are
paired with its entities before bounds that follow from the thresholds have
cut both: an entity counts if SUPPORT documents and not more than the 2^-BITS
part of all hold it; a term if it stands in as many, and if at least the
DISCLOSE part of its documents hold some entity that counts.  Entities that
stand in exactly the same documents (copied address lists) are one class.  To
keep other words out of the shuffles, tasks test words and rows against bit
tables of fixed size (``TABLE_BITS``); a false positive only costs a row that
the following exact join drops.

Defined results: a null text counts as empty; repeated rows each get their
result and count as documents of their own; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toxiscope.llm.common import Scratch, bit_table, in_table, text_steps
from toxiscope.llm.words import ALNUM, LOWER, mix, span_hashes, spans

SUPPORT, DISCLOSE, REMOVE, BITS = 3, 0.5, 0.9, 4.0
TABLE_BITS = 1 << 24
#: Terms that a task sums before it hands the sums on.
TASK_TERMS = 1 << 20
# The order of kinds and their patterns.
KINDS = ("email", "ip", "card", "phone")
#: What happens to a disclosing term; these kinds follow the base kinds.
GENERALISED, REMOVED = "generalised", "removed"
ALL_KINDS = (*KINDS, GENERALISED, REMOVED)
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, so that long runs without one cost nothing."""
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        tail = DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            yield start, tail.end()
        last = tail.end() if tail else at + 1
        at = text.find("@", last)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all base entities, in code points, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text)
                if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text)
                    if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return sorted(out)


def _entity(kind: int, value: str) -> str:
    plain = value.translate(_ASCII_LOWER) if kind == 0 else value if kind == 1 else "".join(DIGIT.findall(value))
    return f"{KINDS[kind]}:{plain}"


SPAN = "struct<start:int,kind:int,end:int>"


def detect(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, entities): base spans and the distinct entities; ``docs`` has row, doc_id, text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def find(batches):
        span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            base, entities = [], []
            for x in batch.column(batch.schema.get_field_index("text")):
                text = x.as_py() or ""
                found = base_spans(text)
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in found])
                entities.append(sorted({_entity(k, text[a:b]) for a, k, b in found}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, pa.list_(span)),
                                              pa.array(entities, pa.list_(pa.string()))], ["row", "doc_id", "base", "entities"])

    return docs.select("row", "doc_id", "text").mapInArrow(
        find, f"row long, doc_id {kind}, base array<{SPAN}>, entities array<string>")


def entity_classes(found: DataFrame, total: int) -> DataFrame:
    """(entity, class, held): entities that a term can disclose; those in exactly the same rows share a class."""
    one = found.select("row", F.explode("entities").alias("entity"))
    # sums of two hashes of the rows tell sets of rows apart; decimals can't overflow
    marks = [F.sum(F.xxhash64("row", F.lit(i)).cast("decimal(20,0)")) for i in (1, 2)]
    return (one.groupBy("entity").agg(F.count("*").alias("held"), *[m.alias(f"m{i}") for i, m in enumerate(marks)])
            .filter((F.col("held") >= SUPPORT) & (F.col("held") <= total / 2 ** BITS))
            .select("entity", F.xxhash64("held", "m0", "m1").alias("class"), "held"))


def carriers(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(row, doc_id, classes): the distinct rows that hold entities that count, with these entities' classes."""
    return (found.select("row", "doc_id", F.explode("entities").alias("entity")).join(classes, "entity")
            .groupBy("row", "doc_id").agg(F.collect_set(F.struct("class", "held")).alias("classes")))


def _step_terms(data: np.ndarray, offsets: np.ndarray, table: np.ndarray | None = None):
    """(start, end, text, term) of the words of a step, those whose bit is set; starts and ends in bytes."""
    starts, ends, owner = spans(data, offsets, ALNUM)
    terms = span_hashes(LOWER[data], starts, ends).view(np.int64)
    keep = in_table(table, terms) if table is not None else slice(None)
    return starts[keep], ends[keep], owner[keep], terms[keep]


def _once(owner: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, text, number of the term) with each term once a text."""
    own, which = np.unique(terms, return_inverse=True)
    pairs = np.unique(owner * max(1, len(own)) + which)
    return own, pairs // max(1, len(own)), pairs % max(1, len(own))


def term_counts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(term, df, carried): documents with the term, and not fewer than those of them that are among ``rows``."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(rows, "row", TABLE_BITS))

    def count(batches):
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            names, which = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
            sums = np.concatenate([v for _, v in kept], 1)
            kept[:] = [(names, np.stack([np.bincount(which, v, len(names)) for v in sums]).astype(np.int64))]

        def out():
            while kept:
                names, sums = kept.pop()
                for at in range(0, len(names), 50_000):
                    part = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[part]), pa.array(sums[0, part]), pa.array(sums[1, part])], ["term", "df", "carried"])

        for batch in batches:
            carrier = in_table(table.value, batch.column(0).to_numpy())
            for at, _, data, offsets in text_steps(batch):
                _, _, owner, terms = _step_terms(data, offsets)
                own, text, number = _once(owner, terms)
                kept.append((own, np.stack([np.bincount(number, minlength=len(own)),
                                            np.bincount(number, carrier[at + text], len(own))]).astype(np.int64)))
                if len(kept) > 16:
                    merged()
                    if len(kept[0][0]) > TASK_TERMS:
                        yield from out()
        if kept:
            merged()
            yield from out()

    return (docs.select("row", "text").mapInArrow(count, "term long, df long, carried long")
            .groupBy("term").agg(F.sum("df").alias("df"), F.sum("carried").alias("carried")))


def carried_terms(docs: DataFrame, rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, doc_id, term, beside): every document of ``rows`` with each of ``terms`` that stands apart from its base
    spans, and a hash of the two words beside the first such place."""
    context = docs.sparkSession.sparkContext
    row_table, table = context.broadcast(bit_table(rows, "row", TABLE_BITS)), context.broadcast(bit_table(terms, "term", TABLE_BITS))

    def find(batches):
        for batch in batches:
            batch = batch.filter(pa.array(in_table(row_table.value, batch.column(0).to_numpy())))
            texts = batch.column(2)
            for at, end, data, offsets in text_steps(batch):
                starts, ends, owner, found = _step_terms(data, offsets)
                keep = in_table(table.value, found)
                if not keep.any():
                    continue
                same = owner[1:] == owner[:-1]
                left, right = np.zeros(len(found), np.uint64), np.zeros(len(found), np.uint64)
                left[1:], right[:-1] = np.where(same, found[:-1], 0).view(np.uint64), np.where(same, found[1:], 0).view(np.uint64)
                beside = mix(mix(left) + right).view(np.int64)[keep]
                starts, ends, owner, found = starts[keep], ends[keep], owner[keep], found[keep]
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                apart = np.ones(len(found), bool)
                bounds = np.searchsorted(owner, np.arange(end - at + 1))
                for i in np.unique(owner):
                    base = base_spans(texts[at + int(i)].as_py() or "")
                    mine = slice(bounds[i], bounds[i + 1])
                    begin, stop = points[starts[mine]] - points[offsets[i]], points[ends[mine]] - points[offsets[i]]
                    if base:
                        # furthest end of the base spans that begin at or before a word's end
                        reach = np.maximum.accumulate([e for _, _, e in base])
                        k = np.searchsorted([b for b, _, _ in base], stop, "right")
                        apart[mine] = (k == 0) | (reach[np.maximum(k, 1) - 1] < begin)
                owner, found, beside = owner[apart], found[apart], beside[apart]
                first = np.lexsort((np.arange(len(found)), found, owner))
                o, t = owner[first], found[first]
                new = np.ones(len(first), bool)
                new[1:] = (o[1:] != o[:-1]) | (t[1:] != t[:-1])
                first = first[new]
                row = pa.array(at + owner[first])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(found[first]),
                                                  pa.array(beside[first])], ["row", "doc_id", "term", "beside"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("row", "doc_id", "text").mapInArrow(find, f"row long, doc_id {kind}, term long, beside long")


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, doc_id, start, end in code points, columns of ``terms``) of the places of ``terms`` in ``docs`` (row, doc_id, text)."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(terms, "term", TABLE_BITS))

    def find(batches):
        for batch in batches:
            for at, _, data, offsets in text_steps(batch):
                starts, ends, owner, found = _step_terms(data, offsets, table.value)
                if len(found):
                    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                    base = points[offsets[owner]]
                    row = pa.array(at + owner)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(row), batch.column(1).take(row), pa.array(found), pa.array((points[starts] - base).astype(np.int32)),
                         pa.array((points[ends] - base).astype(np.int32))], ["row", "doc_id", "term", "start", "end"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("row", "doc_id", "text")
            .mapInArrow(find, f"row long, doc_id {kind}, term long, start int, end int").join(terms, "term"))


def disclosing(found: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(term, removed): terms over the disclosure thresholds; removed or else generalised."""
    total = found.count()
    classes = entity_classes(found, total)
    rows = scratch.keep(carriers(found, classes), "carriers")
    # P(entity | term) is at most carried / df, and the bits at most those of an entity in the term's documents alone
    counts = term_counts(docs, rows).filter(
        (F.col("carried") >= SUPPORT) & (F.col("carried") >= DISCLOSE * F.col("df")) & (F.col("df") <= total / 2 ** BITS))
    terms = scratch.keep(counts.select("term", "df"), "counts")
    at_id = rows.select(F.col("row").alias("at_row"), F.col("doc_id").alias("at_id"), F.explode("classes").alias("c"))
    pairs = (carried_terms(docs, rows, terms).join(terms, "term")
             .join(at_id, (F.col("row") == F.col("at_row")) & F.col("doc_id").eqNullSafe(F.col("at_id")))
             .filter(F.col("df") * DISCLOSE <= F.col("c.held"))
             .groupBy("c.class", "c.held", "term", "df", "beside").agg(F.count("*").alias("n"))
             .groupBy("class", "held", "term", "df").agg(F.sum("n").alias("both"), F.count("*").alias("contexts")))
    given = F.col("both") / F.col("df")
    # log2(given / (held / total)) >= BITS, without the logarithm's rounding
    telling = F.col("both").cast("double") * total >= F.col("held").cast("double") * F.col("df") * 2 ** BITS
    return (pairs.filter((F.col("contexts") >= SUPPORT) & (given >= DISCLOSE) & telling)
            .groupBy("term").agg((F.max(given) >= REMOVE).alias("removed")))


def _digest(spans_: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, base, terms) for every row: base spans, and spans (start, kind, end) of disclosing terms that
    overlap none of them."""
    scratch = Scratch(docs.sparkSession, "pii")
    # a row's key comes from what it holds, so that both readings of the texts agree on it
    named = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = scratch.keep(detect(named), "found")
    terms = scratch.keep(disclosing(found, named, scratch), "terms")
    scratch.drop("carriers", "counts")
    fate = F.lit(ALL_KINDS.index(GENERALISED)) + F.col("removed").cast("int")
    places = (occurrences(named, terms).groupBy(F.col("row").alias("at_row"), F.col("doc_id").alias("at_id"))
              .agg(F.collect_set(F.struct("start", fate.alias("kind"), "end")).alias("terms")))
    apart = F.filter("terms", lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (t["end"] > b["start"])))
    none = F.array().cast(f"array<{SPAN}>")
    return (found.join(places, (F.col("row") == F.col("at_row")) & F.col("doc_id").eqNullSafe(F.col("at_id")), "left")
            .select("row", "doc_id", "base", F.coalesce(apart, none).alias("terms")))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and spans of every row of ``docs``."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return sanitise(docs, doc_id, text).select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_digest(F.col("base")), 256).alias("base_sha256"),
        _digest(F.array_sort(F.concat("base", "terms"))).alias("spans"))


def shape(word: str) -> str:
    """What a generalised word is shown as: what kind of word it was, not which."""
    if any("0" <= c <= "9" for c in word):
        return "[number]" if word.isdigit() else "[code]"
    return "[name]" if word[:1].isupper() else "[word]"


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with base entities replaced by their kind in brackets, generalised terms by their shape, and removed
    terms left out with one of the blanks around them; overlapping spans merge."""
    out, at = [], 0
    for start, end, kind in sorted(found):
        if start >= at:
            out.append(text[at:start])
            if kind != REMOVED:
                out.append(shape(text[start:end]) if kind == GENERALISED else f"[{kind}]")
            elif text[end:end + 1] == " " and text[start - 1:start] in (" ", ""):
                end += 1
        at = max(at, end)
    return "".join(out) + text[at:]


def sanitised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) of every row of ``docs`` with its entities and disclosing terms out of the text; a null text stays null."""
    kind = docs.schema[doc_id].dataType.simpleString()
    # equal rows have equal spans, so one of them is enough to join with
    spans_ = (sanitise(docs, doc_id, text).dropDuplicates(["row", "doc_id"])
              .select(F.col("row").alias("at_row"), F.col("doc_id").alias("at_id"), F.concat("base", "terms").alias("found")))
    rows = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def clean(batches):
        for batch in batches:
            texts = [t if t is None else redact(t, [(s["start"], s["end"], ALL_KINDS[s["kind"]]) for s in found])
                     for t, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return (rows.join(spans_, (F.col("row") == F.col("at_row")) & F.col("doc_id").eqNullSafe(F.col("at_id")))
            .select("doc_id", "text", "found").mapInArrow(clean, f"doc_id {kind}, text string"))
