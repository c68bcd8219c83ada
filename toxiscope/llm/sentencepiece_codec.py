"""SentencePiece encoding and decoding by suffix-array matching.

A step's texts are cut where no piece can reach across (at the mark that
stands for a space, and around characters that occur in no piece), and its
distinct stretches are concatenated and indexed by a suffix array as deep as
the longest piece.  Every piece is looked up by binary search; its range of
the array are its occurrences.  They are the edges of the stretches' lattices,
sorted by the position where they end, and are relaxed from left to right.

The public model is a byte-pair model, whose segmentation isn't a shortest
path: relaxation keeps, for every position, the one edge that can follow the
piece before it.  Two pieces can follow each other when merging their joint
characters by score gives just these two; a prefix of a segmentation is the
segmentation of the prefix, so that one edge stays at each position and the
result equals the library's.  Answers for pairs of pieces, and stretches
already encoded, are kept by the worker in caches of fixed size.

Models: byte-pair, identity normalisation, a mark before the text, byte
fallback; another kind raises an error.  Characters without a piece become
the pieces of their bytes.

Defined results: null and empty texts have no ids and decode to the empty
text; repeated rows each get their result; the mark U+2581 in a text decodes
to a space, as in the library; named other columns pass through; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toxiscope.llm.common import text_steps, tidy
from toxiscope.llm.words import mix

MARK = 0x2581
CACHED_STRETCHES, CACHED_PAIRS = 300_000, 1_000_000
#: Bytes of text encoded, and ids decoded, at once (a longer text alone).
STEP_BYTES, STEP_IDS = 1 << 20, 250_000
_ODD, _ODD_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)

_loaded: dict[str, "Vocabulary"] = {}


class Vocabulary:
    """Pieces of a model, ready for binary search, and the worker's caches."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        probe = "  a  b ﬁ\n"
        if library.decode(library.encode(probe)) != probe or library.encode("a", out_type=str)[0][:1] != chr(MARK):
            raise ValueError("only models with identity normalisation and a mark before the text are supported")
        special = [library.is_control(i) or library.is_unknown(i) or library.is_unused(i) for i in range(n)]
        names = [library.id_to_piece(i) for i in range(n)]
        self.bytes = np.full(256, -1, np.int32)
        for i in range(n):
            if library.is_byte(i):
                self.bytes[int(names[i][3:-1], 16)] = i
        normal = [i for i in range(n) if not special[i] and not library.is_byte(i)]
        self.rank = {names[i]: library.get_score(i) for i in normal}
        chars = sorted({c for i in normal for c in names[i]})
        orphans = [c for c in chars if c not in self.rank]  # only within longer pieces
        self.pieces = [names[i] for i in normal] + orphans
        self.ids = [[i] for i in normal] + [self.bytes[list(c.encode())].tolist() for c in orphans]
        self.letter = np.zeros(0x110000, np.uint16)  # place in the alphabet, 0 for characters of no piece
        self.letter[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.depth = max(map(len, self.pieces)) + 1  # so that what follows a piece still sorts
        self.length = np.array([len(p) for p in self.pieces])
        self.cut_at_mark = not any(chr(MARK) in p.lstrip(chr(MARK)) for p in self.pieces)
        codes = np.zeros((len(self.pieces), self.depth), np.uint16)
        for row, p in zip(codes, self.pieces, strict=True):
            row[:len(p)] = self.letter[[ord(c) for c in p]]
        after = codes.copy()
        after[np.arange(self.depth) >= self.length[:, None]] = 0xFFFF
        self.low, self.high = self._keys(codes), self._keys(after)
        surface = [b"" if special[i] else bytes([int(names[i][3:-1], 16)]) if library.is_byte(i)
                   else names[i].replace(chr(MARK), " ").encode() for i in range(n)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_at = np.concatenate(([0], np.cumsum([len(s) for s in surface]))).astype(np.int64)
        self.pairs, self.follow = np.zeros(0, np.int64), np.zeros(0, bool)  # sorted pairs of pieces and answers
        self.empty_cache()

    def empty_cache(self) -> None:
        self.seen = np.zeros(0, np.uint64)
        self.seen_at, self.seen_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.seen_ids = np.zeros(0, np.int32)

    @staticmethod
    def _keys(codes: np.ndarray) -> np.ndarray:
        """Byte strings that sort as the rows of alphabet places do."""
        return np.ascontiguousarray(codes.astype(">u2")).view(f"S{2 * codes.shape[1]}").ravel()

    def merged(self, text: str) -> list[str]:
        """Segmentation by merging neighbours, best score first, then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def can_follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """If each piece may stand behind the piece ``before`` (-1: at the start)."""
        pairs, which = np.unique((before + 1) * (len(self.pieces) + 1) + piece, return_inverse=True)
        at = np.minimum(np.searchsorted(self.pairs, pairs), max(0, len(self.pairs) - 1))
        new = pairs[self.pairs[at] != pairs] if len(self.pairs) else pairs
        if len(new):
            if len(self.pairs) + len(new) > CACHED_PAIRS:
                self.pairs, self.follow, new = self.pairs[:0], self.follow[:0], pairs
            told = np.empty(len(new), bool)
            for i, pair in enumerate(new.tolist()):
                a, b = divmod(pair, len(self.pieces) + 1)
                want = ([self.pieces[a - 1]] if a else []) + [self.pieces[b]]
                told[i] = self.merged("".join(want)) == want
            place = np.searchsorted(self.pairs, new)
            self.pairs, self.follow = np.insert(self.pairs, place, new), np.insert(self.follow, place, told)
            at = np.searchsorted(self.pairs, pairs)
        return self.follow[at][which]

    def edges(self, codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, piece) of all occurrences of all pieces within the stretches."""
        left = np.repeat(first + length, length) - np.arange(len(codes))  # characters to the stretch's end
        padded = np.concatenate((codes, np.zeros(self.depth, np.uint16)))
        suffixes = np.lib.stride_tricks.sliding_window_view(padded, self.depth)[:len(codes)]
        suffixes = np.where(np.arange(self.depth) < left[:, None], suffixes, 0)
        # the array: suffixes sorted by their first ``depth`` characters, four to a number
        packed = []
        for j in range(0, self.depth, 4):
            number = np.zeros(len(codes), np.uint64)
            for k in range(j, j + 4):
                number <<= np.uint64(16)
                if k < self.depth:
                    number |= suffixes[:, k].astype(np.uint64)
            packed.append(number)
        order = np.lexsort(packed[::-1])
        keys = self._keys(suffixes[order])
        low = np.searchsorted(keys, self.low, "left")
        count = np.searchsorted(keys, self.high, "left") - low
        piece = np.repeat(np.arange(len(self.pieces)), count)
        place = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + low[piece]
        return order[place], piece

    def segment(self, codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all stretches in order, count of each); ``codes`` holds the stretches one after the other."""
        at, piece = self.edges(codes, first, length)
        end = at + self.length[piece]
        owner = np.repeat(np.arange(len(first)), length)[at]
        step = end - first[owner]  # characters from the stretch's start
        order = np.argsort(step, kind="stable")
        at, piece, end, step = at[order], piece[order], end[order], step[order]
        begins = at == first[owner[order]]
        last = np.full(len(codes) + 1, -1, np.int64)  # piece that ends before each position
        bounds = np.searchsorted(step, np.arange(1, int(length.max()) + 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            before = np.where(begins[a:b], -1, last[at[a:b]])
            ok = self.can_follow(before, piece[a:b])
            last[end[a:b][ok]] = piece[a:b][ok]
        # back from the ends, all stretches at once
        found, live, here = [], np.arange(len(first)), first + length
        while len(live):
            p = last[here[live]]
            found.append((live, p))
            here[live] -= self.length[p]
            live = live[here[live] > first[live]]
        owner = np.concatenate([f[0] for f in found])
        pieces = np.concatenate([f[1] for f in found])[::-1]
        order = np.argsort(owner[::-1], kind="stable")
        return pieces[order], np.bincount(owner, minlength=len(first))


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _ragged(at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices at[i], at[i] + 1, ... count[i] of them, for all i in turn."""
    return np.arange(int(count.sum())) + np.repeat(at - (np.cumsum(count) - count), count)


def _stretch_hashes(codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    n = len(codes)
    up, down = np.full(n + 1, _ODD, np.uint64), np.full(n + 1, _ODD_INVERSE, np.uint64)
    up[0] = down[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * np.cumprod(up)[:n], out=sums[1:])
    return mix((sums[first + length] - sums[first]) * np.cumprod(down)[first] + mix(length.astype(np.uint64)))


def encode_step(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in order, count of each)."""
    n = len(offsets) - 1
    raw = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    filled = np.flatnonzero(np.diff(points))
    codes = np.insert(np.where(raw == 0x20, MARK, raw), points[filled], MARK).astype(np.uint32)
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    starts = points[filled] + np.arange(len(filled))
    letters = v.letter[codes]
    begin = np.zeros(len(codes), bool)
    begin[starts] = True
    if v.cut_at_mark:
        mark = codes == MARK
        begin[1:] |= mark[1:] & ~mark[:-1]
    unknown = letters == 0
    begin |= unknown
    begin[1:] |= unknown[:-1]
    first = np.flatnonzero(begin)
    length = np.diff(np.append(first, len(codes)))
    names, example, which = np.unique(_stretch_hashes(codes, first, length), return_index=True, return_inverse=True)
    # stretches that the worker hasn't seen
    at = np.minimum(np.searchsorted(v.seen, names), max(0, len(v.seen) - 1))
    new = np.flatnonzero(v.seen[at] != names) if len(v.seen) else np.arange(len(names))
    if len(new):
        if len(v.seen) + len(new) > CACHED_STRETCHES:
            v.empty_cache()
            new = np.arange(len(names))
        _learn(v, codes, letters, first[example[new]], length[example[new]], names[new])
        at = np.searchsorted(v.seen, names)
    count = v.seen_n[at][which]
    ids = v.seen_ids[_ragged(v.seen_at[at][which], count)]
    text = np.searchsorted(starts, first, "right") - 1
    return ids, np.bincount(filled[text], count, n).astype(np.int64)


def _learn(v: Vocabulary, codes: np.ndarray, letters: np.ndarray, first: np.ndarray, length: np.ndarray, names: np.ndarray) -> None:
    """Encodes stretches and adds them to the worker's cache."""
    known = letters[first] > 0
    ids, counts = np.zeros(0, np.int32), np.zeros(len(first), np.int64)
    parts = []
    if known.any():
        n = length[known]
        own = letters[_ragged(first[known], n)]
        pieces, per = v.segment(own, np.cumsum(n) - n, n)
        sizes = np.array([len(x) for x in v.ids])[pieces]
        flat = np.array([i for x in v.ids for i in x], np.int32)
        at = np.cumsum([0] + [len(x) for x in v.ids[:-1]])
        ids = flat[_ragged(at[pieces], sizes)]
        counts[known] = np.bincount(np.repeat(np.arange(len(per)), per), sizes, len(per)).astype(np.int64)
    at = np.zeros(len(first), np.int64)
    at[known] = np.cumsum(counts[known]) - counts[known]
    base = len(ids)
    for i in np.flatnonzero(~known):  # a single character of no piece
        own = v.bytes[list(chr(int(codes[first[i]])).encode())]
        at[i], counts[i] = base, len(own)
        parts.append(own)
        base += len(own)
    merged = np.concatenate((v.seen, names))
    order = np.argsort(merged, kind="stable")
    v.seen_at = np.concatenate((v.seen_at, at + len(v.seen_ids)))[order]
    v.seen_n = np.concatenate((v.seen_n, counts))[order]
    v.seen_ids = np.concatenate((v.seen_ids, ids, *parts))
    v.seen = merged[order]


def decode_rows(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Texts of rows of ids; without the mark before the text; bytes that aren't UTF-8 become U+FFFD."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(v.surface_at) - 1):
        raise ValueError("an id is outside the model's vocabulary")
    count = np.diff(v.surface_at)[ids]
    data = v.surface[_ragged(v.surface_at[ids], count)]
    ends = np.concatenate(([0], np.cumsum(count)))[offsets]
    begins, lengths = ends[:-1], np.diff(ends)
    lead = np.zeros(len(lengths), bool)
    some = lengths > 0
    lead[some] = data[begins[some]] == 0x20
    keep = np.ones(len(data), bool)
    keep[begins[lead]] = False
    data, new = data[keep], np.concatenate(([0], np.cumsum(lengths - lead)))
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [
        None, pa.py_buffer(new.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    try:
        return raw.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.as_py().decode("utf-8", "replace") for x in raw], pa.string())


def encode(docs: DataFrame, path: str, text: str = "text", columns: tuple[str, ...] = ("doc_id",), to: str = "ids") -> DataFrame:
    """``columns`` of ``docs`` and the ids of every row's text."""
    own = [f"c{i}" for i in range(len(columns))]

    def work(batches):
        v = vocabulary(path)
        for batch in batches:
            for at, end, data, offsets in text_steps(batch, limit=STEP_BYTES):
                ids, counts = encode_step(v, data, offsets)
                bounds = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, end - at) for c in own), lists], [*own, "ids"])

    named = docs.select(*[F.col(c).alias(o) for c, o in zip(columns, own, strict=True)], F.col(text).alias("text"))
    kinds = [f"{o} {named.schema[o].dataType.simpleString()}" for o in own]
    out = named.mapInArrow(tidy(work), ", ".join([*kinds, "ids array<int>"]))
    return out.select(*[F.col(o).alias(c) for c, o in zip(columns, own, strict=True)], F.col("ids").alias(to))


def decode(encoded: DataFrame, path: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids (null ids: the empty text)."""
    own = [f"c{i}" for i in range(len(encoded.columns))]

    def work(batches):
        v = vocabulary(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            lists = pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32())) if lists.null_count else lists
            flat, bounds = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
            bounds = bounds - bounds[0]
            at = 0
            while at < len(lists):
                end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + STEP_IDS, "right")) - 1)
                texts = decode_rows(v, flat[bounds[at]:bounds[end]], bounds[at:end + 1] - bounds[at])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, end - at) for c in own), texts], [*own, "text"])
                at = end

    named = encoded.select(*[F.col(c).alias(o) for c, o in zip(encoded.columns, own, strict=True)], F.col(ids).alias("ids"))
    kinds = [f"{o} {named.schema[o].dataType.simpleString()}" for o in own]
    out = named.mapInArrow(tidy(work), ", ".join([*kinds, "text string"]))
    return out.select(*[F.col(o).alias(c) for c, o in zip(encoded.columns, own, strict=True)], F.col("text").alias(to))


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, exact) for every row: ids, and if decoding them gives the text again."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                        F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("before"))
    back = decode(encode(named, path, columns=("doc_id", "before")), path)
    return back.select("doc_id", F.size("ids").alias("n_tokens"), "ids", (F.sha2("text", 256) == F.col("before")).alias("exact"))
