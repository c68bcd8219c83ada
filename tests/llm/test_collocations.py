"""Phrase collocations against brute force and on edge rows."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from toxiscope.llm import collocations as co


def brute(rows, least, top):
    pieces = defaultdict(list)
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        pieces["und" if lang is None else lang] += [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]
    out = set()
    for lang, told in pieces.items():
        f = Counter(tuple(w[i:i + k]) for w in told for k in (1, 2, 3) for i in range(len(w) - k + 1))
        n = sum(len(w) for w in told)
        cands = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        kept = []
        for p, a in cands.items():
            if any(len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * c >= 50 * a
                   for q, c in cands.items()):
                continue
            cut = min((int(Fraction(1000000 * a * a, f[p[:k]] * f[p[k:]])), k) for k in range(1, len(p)))
            kept.append((-cut[0], -a, " ".join(p).encode(), f[p[:cut[1]]], f[p[cut[1]:]]))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, n, -s))
    return out


def texts(seed):
    rng = random.Random(seed)
    words = ["The", "the", "new", "York", "é", "日本", "x y", "a-b", "\x00", "q", "ß", "É"]
    rows = []
    for _ in range(120):
        lang = rng.choice(["en", "en", "en", "de", None, "und", ""])
        parts = [rng.choice(words + ["New York city", "of the", "long  tabbed\tphrase here"]) + rng.choice([" ", " ", "  ", ", ", ".", "\n", "\t", "! "])
                 for _ in range(rng.randrange(60))]
        rows.append((lang, "".join(parts)))
    return rows + [(None, None), ("en", ""), ("en", " .,;\n\t "), (None, "one"), rows[0], rows[0], ("fr", "rare words only")]


@pytest.mark.parametrize("least", [1, 3, 10])
def test_collocations_brute_force(spark, least, monkeypatch):
    monkeypatch.setattr(co, "SHARD_BYTES", 700)
    rows = texts(least)
    df = spark.createDataFrame([(l, t, 1, 2, "k", 3) for l, t in rows], "lang string, text string, f long, n long, phrase string, key long").repartition(4)
    got = [tuple(r) for r in co.best(co.mine(df, least), 40).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, least, 40)


def test_extensions(spark):
    df = spark.createDataFrame([("en", "a b c. a b d. a b. x a b c. z b c")], "lang string, text string")
    got = {r.phrase: (r.a, r.left, r.right) for r in co.mine(df, 1, 1000).collect()}
    assert got["a b"] == (4, 1, 2) and got["b c"] == (3, 2, None) and got["a b c"] == (2, None, None)


def test_edge_rows_and_empty_table(spark, edge, empty):
    rows = [(r.lang, r.text) for r in edge.select("lang", "text").collect()]
    got = {tuple(r) for r in co.best(co.mine(edge, 2)).collect()}
    assert got == brute_fast(rows, 2)
    assert not co.best(co.mine(empty)).collect()


def brute_fast(rows, least):
    """``brute`` for long texts: the containment test by lookup."""
    pieces = defaultdict(list)
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        pieces["und" if lang is None else lang] += [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]
    out = set()
    for lang, told in pieces.items():
        f = Counter(tuple(w[i:i + k]) for w in told for k in (1, 2, 3) for i in range(len(w) - k + 1))
        over = defaultdict(int)
        for p, c in f.items():
            if len(p) == 3 and c >= least:
                for q in (p[:2], p[1:]):
                    over[q] = max(over[q], c)
        kept = []
        for p, a in f.items():
            if len(p) > 1 and a >= least and not (p in over and 100 * over[p] >= 50 * a):
                s, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(kept)[:co.TOP], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, sum(len(w) for w in told), -s))
    return out


def test_index_intervals():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 5, 400)
    s[0] = s[-1] = 0
    index = co.Index(s, 5)
    a, b, count, place = index.pairs()
    want = Counter((int(x), int(y)) for x, y in zip(s, s[1:]) if x and y)
    assert {(int(x), int(y)): int(n) for x, y, n in zip(a, b, count)} == want
    pattern, c, found = index.right(count, place)
    triples = Counter((int(x), int(y), int(z)) for x, y, z in zip(s, s[1:], s[2:]) if x and y and z)
    assert {(int(a[p]), int(b[p]), int(z)): int(n) for p, z, n in zip(pattern, c, found)} == triples
