"""Jaccard join, components, decontamination, SentencePiece and the pipeline against brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from toxiscope.llm import decontamination, jaccard_join, sentencepiece_codec
from toxiscope.llm.common import Scratch, text_steps
from toxiscope.llm.components import components
from toxiscope.llm.queries import tokenizer_file


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows):
    """(n_shingles, component id) of every row, by comparing all pairs; null ids count as none."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for i, s in enumerate(sets):
        for k in range(i):
            both = len(s & sets[k])
            if s and sets[k] and 100 * both >= 80 * (len(s) + len(sets[k]) - both):
                root[find(i)] = find(k)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    return [(len(s), min((d for d in ids[find(i)] if d is not None), default=None) if s else rows[i][0]) for i, s in enumerate(sets)]


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = sorted(map(str, ((d, *e) for (d, _), e in zip(rows, expected(rows), strict=True))))
    got = sorted(map(str, (tuple(r) for r in jaccard_join.join(docs).collect())))
    assert got == want


def test_join_edges(edge, empty):
    check(edge)
    assert jaccard_join.join(empty).count() == 0
    assert jaccard_join.one_of_each(empty).count() == 0
    kept = jaccard_join.one_of_each(edge)
    assert kept.schema.simpleString() == edge.schema.simpleString()
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert {3, 6, 14} <= set(ids) and not {4, 5, 7, 8, 15} & set(ids)


def test_join_near_copies(spark):
    """Groups of edited copies around the threshold, a chain of them, short texts, and a passage shared by all."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(30)]
    rows = []
    for group in range(12):
        base = [word() for _ in range(rng.choice([8, 40, 120]))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join((passage if group % 2 else []) + copy))
    chain = [word() for _ in range(200)]
    for i in range(15):
        rows.append(" ".join(chain[i * 4:i * 4 + 120]))
    rows += [" ".join(passage + [word() for _ in range(rng.randint(0, 40))]) for _ in range(60)]
    docs = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(4)
    check(docs)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 202), (200, 202)]
    df = spark.createDataFrame(links, "u long, v long")
    got = {r.node: r.component for r in components(df, Scratch(spark, "test"), "c").collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 130)) and got[202] == got[201] == 200


def brute_leaks(docs, items):
    """Best similarity of each (document, item) over all windows of the item's size."""
    out = {}
    for d, t in docs:
        w = words(t)
        for i, it in items:
            v = words(it)
            if not v or len(v) > len(w) or (len(v) < 5 and len(v) != len(w)):
                continue
            grams = lambda x: [tuple(x[k:k + 5]) for k in range(max(1, len(x) - 4))]
            b, best = grams(v), 0
            if set(b).isdisjoint(grams(w)) and len(w) >= 5:
                continue
            for k in range(len(w) - len(v) + 1):
                a = grams(w[k:k + len(v)])
                low = sum(min(a.count(x), b.count(x)) for x in set(a))
                best = max(best, low / (len(a) + len(b) - low))
            if best >= 0.8:
                out[d, i] = round(best, 9)
    return out


def test_decontamination(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((1, 4, 5, 9, 20, 33, 34, 60, 0))] + [(50, None), (4, "")]
    docs = []
    for d in range(60):
        own = [word() for _ in range(rng.randint(0, 150))]
        i, text = items[rng.randrange(8)]
        v = text.split()
        if d % 3 == 1 and len(v) > 20:
            v[rng.randrange(5)] = word()
        if d % 3:
            at = rng.randint(0, len(own))
            own[at:at] = [x.upper() for x in v]
        docs.append((d, "\n ".join(own)))
    docs += [(100, items[1][1]), (101, items[0][1]), (102, None), (103, "")]
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                       spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got.collect()}
    want = brute_leaks(docs, items)
    exact = {k for k, s in want.items() if s == 1}
    assert exact <= set(found) <= set(want)
    assert all(found[k] == want[k] for k in found) and len(found) >= 0.9 * len(want)


def test_decontamination_of_documents_shorter_than_the_item(spark):
    """Documents that are an item without its first or last words, by comparing whole lists of shingles."""
    from collections import Counter
    rng = random.Random(31)
    items = [(i, " ".join("".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(n)))
             for i, n in enumerate((3, 5, 6, 12, 30, 60, 200))]
    docs = []
    for _, text in items:
        v = text.split()
        for a, b in ((1, 0), (0, 1), (2, 0), (1, 1), (0, 8), (15, 20)):
            docs.append((len(docs), " ".join(v[a:len(v) - b])))
    want = {}
    for d, t in docs:
        for i, it in items:
            w, v = words(t), words(it)
            if 5 <= len(w) < len(v):
                a, b = (Counter(tuple(x[k:k + 5]) for k in range(len(x) - 4)) for x in (w, v))
                s = (a & b).total() / (a | b).total()
                if s >= 0.8:
                    want[d, i] = (0, len(w), round(s, 9))
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                       spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.first_word, r.n_words, round(r.similarity, 9)) for r in got} == want
    assert len(want) > 10 and any(s < 0.85 for _, _, s in want.values())


def test_decontamination_of_long_items_at_the_threshold(spark):
    """Every item with one stretch of new words, similarity 0.80 to 0.81, is found."""
    rng = random.Random(77)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    items, docs, want = [], [], {}
    for i in range(1200):
        n = (60, 104, 204)[i % 3]
        v = [word() for _ in range(n)]
        gone = (n - 4) - -(-8 * (n - 4) // 9)
        at = rng.randint(4, n - gone)
        items.append((i, " ".join(v)))
        v[at:at + gone - 4] = [word() for _ in range(gone - 4)]
        docs.append((i, " ".join(v)))
        want[i, i] = round((n - 4 - gone) / (n - 4 + gone), 9)
    assert all(0.8 <= s < 0.81 for s in want.values())
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                       spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == want


def test_decontamination_edges(spark, edge, empty):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (None, "one")], "item_id long, text string")
    ids = {r.doc_id for r in decontamination.contaminated(edge, bench).collect()}
    assert ids == {3, 4, 5, 6, 7, 8, None}
    kept = decontamination.clean(edge, bench)
    assert kept.schema.simpleString() == edge.schema.simpleString()
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.clean(edge, none).count() == edge.count() and decontamination.clean(empty, bench).count() == 0


def test_clean_decides_by_text(spark):
    """Rows without an id, and with the same one, of which some leak."""
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    docs = [(None, "x a b c d e f g h i j y"), (None, "nothing of it in here"), (None, None), (7, "a b c d e f g h i j"), (7, "clean")]
    kept = decontamination.clean(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted([tuple(r) for r in kept], key=str) == sorted([docs[1], docs[2], docs[4]], key=str)


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**63, 300, dtype=np.uint64)
    items = decontamination.Items(np.arange(300), np.full(300, 9), prints, [], prints, np.zeros(1, np.uint8))
    near = prints.copy()
    for i in range(300):
        for b in rng.choice(64, decontamination.RADIUS, replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    window, item = decontamination._candidates(near, np.full(300, 9), items)
    assert {(i, i) for i in range(300)} <= set(zip(window.tolist(), item.tolist(), strict=True))


def test_sentencepiece_as_the_library(small):
    import sentencepiece
    path = tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    v = sentencepiece_codec.vocabulary(path)
    rng = random.Random(6)
    chars = "abcdeéüß  \n\t▁.<0xA>123你好ﬁ🙂ЖЙ한　\x00"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    texts += ["".join(rng.choice(v.pieces) for _ in range(6)).replace("▁", " ") for _ in range(1500)]
    texts += ["", " ", " " * 40, "a" * 200, "ab" * 300] + [r.text for r in small.select("text").collect()]
    got = []
    for _, _, data, offsets in text_steps(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])):
        ids, counts = sentencepiece_codec.encode_step(v, data, offsets)
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    want = library.encode(texts)
    assert got == want
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in want])))
    assert sentencepiece_codec.decode_rows(v, np.concatenate([np.array(x, np.int32) for x in want]), offsets).to_pylist() == \
        [library.decode(x) for x in want]


def test_sentencepiece_edges(edge, empty, spark):
    path = tokenizer_file("piece_bpe_32k.model")
    rows = sentencepiece_codec.round_trip(edge, path).collect()
    assert len(rows) == edge.count()
    assert all(r.exact == (r.doc_id != 23) for r in rows)  # a text with the mark itself decodes to a space
    assert sentencepiece_codec.round_trip(empty, path).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([3 + 0xC3],)], "ids array<int>")
    assert [r.text for r in sentencepiece_codec.decode(odd, path).collect()] == ["", "", "�"]


def test_pipeline(spark):
    import corpus_pipeline
    sf_small = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "jaccard_join", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    scratch, given = Scratch(spark, "test-pipeline"), docs.columns
    kept = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = kept[name] = scratch.keep(stage(spark, docs, sf_small), name)
        assert name == "sentencepiece" or docs.columns == given
    before = kept["line_dedup"].select("doc_id", "text").collect()
    want = [d for (d, _), (_, c) in zip([(r.doc_id, r.text) for r in before], expected([(r.doc_id, r.text) for r in before]),
                                        strict=True) if d == c]
    after = kept["jaccard_join"].select("doc_id", "text").collect()
    assert sorted(r.doc_id for r in after) == sorted(want)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    leaks = {d for d, _ in brute_leaks([(r.doc_id, r.text) for r in after if len(words(r.text)) < 3000], items)}
    left = {r.doc_id for r in kept["decontamination"].select("doc_id").collect()}
    assert {r.doc_id for r in after if len(words(r.text)) < 3000} - left == leaks
    out = kept["sentencepiece"].collect()
    assert {r.doc_id for r in out} == left and all(r.exact for r in out)


def test_pipeline_empty(spark, empty):
    import corpus_pipeline
    sf_small = "/root/testdata/sf0.001"
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_small)
        assert docs.count() == 0
