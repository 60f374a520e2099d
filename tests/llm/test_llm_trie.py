"""The conversation prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tallymill.llm import op12_prefix_trie as op12

CONVERSATIONS = "conv_id long, turn long, role string, text string, depth string, key long, n int"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, digest, role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = turns.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, cs in members.items():
        own = (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += children[p] == 0
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if len(rebuilt[c]) == len(p)).encode()).hexdigest()
    return sorted((cs[0], len(p), members[p[:-1]][0] if p else -1, len(cs), children[p], leaves[p], saved[p], sha(p)) for p, cs in members.items())


def built(spark, rows, segment, parts=3):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], CONVERSATIONS).repartition(parts)
    out = op12.prefix_trie(df, segment)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None and i == 2 else v for i, v in enumerate(r)) for r in out.collect())


def talks(seed, n, longest, words):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]), f"é{r.randrange(words)}") for c in range(n) for t in range(r.randrange(1, longest + 1))]


ODD = [
    (None, 1, "user", "lost"), (7001, None, None, None), (7001, None, "user", ""), (7001, 3, "user", "x" * 70_000), (7001, 3, "user", "y"), (7001, 3, "user", "y"), (-3, 1, "a", "b"), (-4, 2, "a", "b"), (2**62, 1, "", "1:"), (2**62, 2, "1:", ""),
]


@pytest.mark.parametrize("segment", [1, 2, 3, 64])
def test_trie(spark, segment):
    rows = talks(segment, 60, 12, 2) + ODD
    assert built(spark, rows, segment) == brute(rows)


def test_copies_of_one_conversation_span_ranges(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 900, 5) for t in range(9)] + [(c, t, "user", "same 0" if t == 0 else f"{c % 3} {t}") for c in range(1, 200) for t in range(11)]
    assert built(spark, rows, 4) == brute(rows)


def test_one_long_conversation(spark):
    rows = [(0, t, "user", str(t // 7)) for t in range(700)] + [(5, t, "user", str(t // 7)) for t in range(650)] + talks(1, 4, 3, 3)
    assert built(spark, rows, 16) == brute(rows)


def test_trie_without_conversations(spark):
    assert built(spark, [], 64) == [] and built(spark, [(None, 1, "a", "b")], 64) == []


def test_turnless_conversations_are_members_of_the_root(spark):
    short = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    for rows in ([(short, 0, "user", "a")], [(short, 0, "user", "a"), (short + 5000, 0, "user", "b"), (short + 5000, 1, "user", "c")]):
        assert built(spark, rows, 64) == brute(rows)
    assert built(spark, [(short, 0, "user", "a")], 64) == [(short, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]
