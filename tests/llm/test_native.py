"""Line dedup, exact dedup and licence scan against brute force, and on edge rows."""

import hashlib
import random
import re
from collections import defaultdict

from toxiscope.llm import exact_dedup, license_scan, line_dedup, passage_dedup
from toxiscope.llm.license_rules import rules


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup_edges(edge):
    rows = edge.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r.text)].append(r.doc_id)
    got = exact_dedup.dedupe(edge).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = defaultdict(int)
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_chunks_cover_the_text(spark):
    from pyspark.sql import functions as F
    texts = ["", "a" * 5000, "Sentence one. " * 600, "no end " * 900, "x" * 2048, "\n" * 3]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", F.regexp_extract_all("t", F.lit(exact_dedup.CUT), F.lit(0)).alias("c")).collect():
        assert "".join(r.c) == r.t and all(len(c) <= exact_dedup.CHUNK_MAX for c in r.c)


def cleaned(rows):
    """Brute force over (doc_id, text), ids unique: what line dedup leaves."""
    seen, out = set(), {}
    solid = {}
    for i, t in sorted(rows):
        lines = (t or "").split("\n") if t is not None else []
        solid[i] = [(k, normal(x).strip(" ")) for k, x in enumerate(lines) if normal(x).strip(" ")]
    for i, t in sorted(rows):
        gone = set()
        s = solid[i]
        for k in range(len(s) - 2):
            key = tuple(x for _, x in s[k:k + 3])
            if key in seen:
                gone |= {p for p, _ in s[k:k + 3]}
            seen.add(key)
        out[i] = t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    return out


def test_line_dedup_brute_force(edge):
    unique = edge.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    want = cleaned([(r.doc_id, r.text) for r in unique.collect()])
    got = line_dedup.dedupe_lines(unique)
    assert got.columns[:-2] == unique.columns
    rows = got.collect()
    assert {r.doc_id: r.text for r in rows} == want
    assert want[10] == "Own tail." and want[11] == "Own head." and want[12] == "x"


def test_line_dedup_edges(edge, empty):
    assert line_dedup.dedupe_lines(edge).count() == edge.count()
    kept = line_dedup.keep_cleaned(edge)
    assert kept.schema.simpleString() == edge.schema.simpleString() and kept.filter("text IS NULL").count() == 3
    assert line_dedup.keep_cleaned(empty).count() == 0


def without_passages(rows):
    """Brute force over (doc_id, text), ids unique: the words that are left."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        own = [tuple(w[k:k + 50]) for k in range(len(w) - 49)]
        gone = {p for k, x in enumerate(own) if x in seen for p in range(k, k + 50)}
        seen |= set(own)
        out[i] = [x.decode() for k, x in enumerate(w) if k not in gone]
    return out


def test_passages_anywhere(spark, edge):
    """Passages of 45 to 130 words placed mid-line, at both ends, and in documents of one line."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklé") for _ in range(5))
    passages = [[word() for _ in range(n)] for n in (45, 49, 50, 51, 60, 90, 130)]
    rows = [(r.doc_id, r.text) for r in edge.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()]
    for d in range(100, 220):
        w = [word() for _ in range(rng.choice([0, 7, 30, 200]))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            p, at = rng.choice(passages), rng.randint(0, len(w))
            w[at:at] = p[rng.choice([0, 0, 3]):]
        rows.append((d, "".join(x + rng.choice([" ", " ", " ", "\n", " \t"] if d % 3 else [" "]) for x in w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in passage_dedup.dedupe_passages(docs).collect()}
    want = without_passages(rows)
    assert {d: (r.text or "").split() for d, r in got.items()} == {d: " ".join(w).split() for d, w in want.items()}
    for d, t in rows:
        assert got[d].words_removed == len((t or "").encode().split()) - len(want[d])
        assert got[d].words_removed or got[d].text == t
    one_line = {d for d, t in rows if "\n" not in (t or "") and got[d].words_removed}
    assert len(one_line) > 10 and any(0 < len(want[d]) for d in one_line)
    both = {r.doc_id: (r.text or "").split() for r in passage_dedup.keep_cleaned(line_dedup.keep_cleaned(docs)).collect()}
    after_lines = cleaned(rows)
    left = without_passages([(d, t) for d, t in after_lines.items() if t is None or normal(t).strip(" ") or t == dict(rows)[d]])
    assert both == {d: " ".join(w).split() for d, w in left.items() if w or not (after_lines[d] or "").split()}


def test_passages_edges(edge, empty):
    got = passage_dedup.dedupe_passages(edge)
    assert got.columns[:-1] == edge.columns and got.count() == edge.count()
    kept = passage_dedup.keep_cleaned(edge)
    assert kept.schema.simpleString() == edge.schema.simpleString() and kept.filter("text IS NULL").count() == 3
    assert passage_dedup.keep_cleaned(empty).count() == 0


def test_empty_tables(empty):
    assert exact_dedup.dedupe(empty).count() == 0
    assert license_scan.scan(empty).count() == 0


PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_base(edge, small):
    for docs in (edge.select("doc_id", "text").dropDuplicates(["doc_id"]), small.select("doc_id", "text")):
        want = {r.doc_id: base(r.text) for r in docs.collect()}
        for r in license_scan.scan(docs).collect():
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want[r.doc_id]
            assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_rules(spark):
    assert len(rules()) > 300
    texts = {"Licensed under the Apache License, Version 2.0": "apache-2.0",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "General Public License as published; either version 3 of the License, or (at your option) any later version.":
             "gpl,gpl-3.0-or-later,gpl-or-later",
             "the GNU GPL version 2 or later": "gpl-2.0-or-later", "Creative Commons Attribution-ShareAlike 4.0": "cc-by-sa-4.0",
             "SPDX-License-Identifier: MIT": "mit", "nothing here": "", "the mit of it": ""}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_license_suppression(spark):
    texts = spark.createDataFrame([(1, "licensed under the apache license version 2 0 and the apache license")], "row long, norm string")
    from pyspark.sql import functions as F
    got = license_scan.detections(texts.withColumn("words", F.split("norm", " ")), license_scan.rule_table(spark)).collect()
    assert sorted((r.label, r.first, r.end) for r in got) == [("apache", 10, 12), ("apache-2.0", 0, 8)]
