"""Conversation trie against brute force and on edge rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from toxiscope.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, depth long, n long, head string"


def ordered(rows):
    """conv -> [(role, text)] in the operator's order."""
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            turns[conv].append(((turn is not None, turn or 0, sha), (role, text)))
    return {c: [t for _, t in sorted(v)] for c, v in turns.items()}


def rebuilt(convs, every=20, shared=4):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % shared
        stem = c - (abs(c) % every) * (1 if c >= 0 else -1)
        out[c] = convs.get(stem, [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    words = {n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0 for n in members}
    kids = defaultdict(list)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) if kids[n] else 1
        saved[n] = (len(members[n]) - 1) * words[n] + sum(saved[k] for k in kids[n])
    return {(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n],
             hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items()}


def found(df):
    rows = [tuple(r) for r in df.select(*[c.split()[0] for c in ct.NODES.split(", ")]).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def talk(seed):
    """Conversations with a common opening, long shared stretches, copies, prefixes, ties, nulls and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for c in range(140):
        shape = rng.randrange(6)
        say = [f"opening {i}" for i in range(9)] if shape < 3 else []
        if shape == 1:
            say = say[:rng.randrange(10)]
        say = say + [rng.choice("ab c") for _ in range(rng.randrange(5))] if shape not in (2, 4) else say + ["one", "two  words"]
        for t, text in enumerate(say):
            rows.append((c, t if rng.random() < 0.97 else None, rng.choice(["user", "user", "user", None]), text if text != " " else None, 1, 2, "x"))
    for _ in range(10):
        rows.append(rng.choice(rows))
    return rows + [(-7, 1, "user", "opening 0", 1, 2, "x"), (2**40 + 3, 5, "user", "late", 1, 2, "x"), (None, 1, "user", "no id", 1, 2, "x"),
                   (None, None, None, None, None, None, None)]


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_trie_brute_force(spark, limit):
    rows = talk(limit)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(ct.branched_trie(df, limit)) == brute(rebuilt(ordered(rows)))
    assert found(ct.whole_trie(df, limit)) == brute(ordered(rows))


def test_many_copies_and_long_conversations(spark):
    rows = [(c, t, "user", f"turn {t}") + (1, 2, "x") for c in range(0, 9000, 20) for t in range(3)]
    rows += [(c, t, "user", f"long {t}", 1, 2, "x") for c in (20_000, 20_020) for t in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(ct.branched_trie(df, 1)) == brute(rebuilt(ordered(rows)))


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(ct.branched_trie(empty)) == set() and found(ct.whole_trie(empty)) == set()
    alone = spark.createDataFrame([(None, 1, "user", "x", 1, 1, "x")], SCHEMA)
    assert found(ct.branched_trie(alone)) == set()


def test_turnless_conversation_is_a_member_of_the_root(spark):
    gone = [c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20][:2]
    rows = [(c, 0, "user", "only", 1, 1, "x") for c in gone]
    got = found(ct.branched_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rebuilt(ordered(rows))) and {(r[1], r[3]) for r in got} == {(0, 2)}
