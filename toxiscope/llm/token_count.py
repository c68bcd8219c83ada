"""Token counts by a two-tier lookup of pre-tokens, without shuffling any.

A byte-level BPE never merges across pre-tokens, so a text's count is the sum
of its pre-tokens' lengths.  Tier one is a table of the corpus' most frequent
pre-tokens and their lengths, built once and broadcast (at most ``TABLE_SIZE``
entries, whatever the corpus).  Tier two encodes the others with the library
and keeps their lengths in a cache of the worker (at most ``CACHE_SIZE``
entries, then emptied).  To find the frequent pre-tokens every task counts
its own texts whole and hands on its ``TASK_TOP`` most frequent; only these
bounded lists are added up.  What is in the table changes the speed alone,
never a result.

Texts with a special string, or with a character that the two regular
expression libraries may class differently, go to the library whole.

Defined results: a null text counts as empty (0 tokens); repeated rows each
get their result; other columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_536
TASK_TOP = 16_384
CACHE_SIZE = 500_000
RUN_CHARS = 1 << 20
LIMIT = 1024
#: Longer pre-tokens are encoded anew where they stand, neither broadcast nor cached.
PIECE_CHARS = 64

# Fixed value: the pre-token pattern of the public byte-level vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that every Unicode version and both libraries class alike: assigned before Unicode 9, no odd white space.
KNOWN = regex.compile(r"[\t\n\r\x20-\x7E\xA0-ͷ΄-ԯ‐-‧‰-⁞₠-₽ぁ-ゖァ-ヺ一-鿕가-힣]*+")

_tokenizers: dict = {}
_cache: dict[str, int] = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        _tokenizers[path] = own, [t.content for t in own.get_added_tokens_decoder().values()]
    return _tokenizers[path]


def lengths(path: str, pieces: list[str]) -> list[int]:
    """Tokens of every piece as the library gives them."""
    own, _ = _tokenizer(path)
    return [len(x.ids) for x in own.encode_batch(pieces, add_special_tokens=False)]


def split_pieces(path: str):
    """text -> its pre-tokens, or the whole text as one piece where only the library is sure."""
    _, special = _tokenizer(path)
    find, known = regex.compile(PRE_TOKEN).findall, KNOWN.fullmatch

    def pieces(text: str) -> list[str]:
        if known(text) is None or any(s in text for s in special):
            return [text]
        return find(text)
    return pieces


def _batch_texts(batch: pa.RecordBatch) -> Iterator[str]:
    for x in batch.column(batch.schema.get_field_index("text")):
        yield x.as_py() or ""


def _runs(texts: Iterator[str]) -> Iterator[list[str]]:
    """Runs of texts of about RUN_CHARS characters, which bounds what is split at once."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= RUN_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def frequent(docs: DataFrame, path: str) -> DataFrame:
    """(piece, n): the most frequent pre-tokens of at most PIECE_CHARS characters of the corpus, at most TABLE_SIZE."""
    def count(batches):
        pieces, seen = split_pieces(path), Counter()
        for batch in batches:
            for text in _batch_texts(batch):
                found = pieces(text)
                if len(found) > 1:
                    seen.update(found)
                if len(seen) > CACHE_SIZE:
                    seen = Counter(dict(seen.most_common(CACHE_SIZE // 2)))
        top = [(p, n) for p, n in seen.most_common(TASK_TOP) if len(p) <= PIECE_CHARS]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    return (docs.select("text").mapInArrow(count, "piece string, n long")
            .groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(TABLE_SIZE))


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``; ``path``: the tokenizer's file."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = [r.piece for r in frequent(named, path).select("piece").collect()]  # at most TABLE_SIZE, of PIECE_CHARS at most
    table = docs.sparkSession.sparkContext.broadcast(dict(zip(known, lengths(path, known), strict=True)))

    def measure(batches):
        pieces, first = split_pieces(path), table.value
        for batch in batches:
            counts = []
            for texts in _runs(_batch_texts(batch)):
                found = [pieces(t) for t in texts]
                missing = list({p for ps in found for p in ps if p not in first and p not in _cache})
                if len(_cache) + len(missing) > CACHE_SIZE:
                    _cache.clear()
                    missing = list({p for ps in found for p in ps if p not in first})
                own = dict(zip(missing, lengths(path, missing), strict=True))
                _cache.update((p, n) for p, n in own.items() if len(p) <= PIECE_CHARS)
                for ps in found:
                    n = 0
                    for p in ps:
                        k = first.get(p)
                        if k is None:
                            k = _cache.get(p)
                            if k is None:
                                k = own[p]
                        n += k
                    counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = named.schema["doc_id"].dataType.simpleString()
    return (named.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
            .mapInArrow(measure, f"doc_id {kind}, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
