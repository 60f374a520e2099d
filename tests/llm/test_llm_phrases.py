"""Phrase mining against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallymill.llm import op13_phrases as op13

DOCS = "doc_id long, text string, lang string, score double, rank int, n string"


def brute(rows, least, top=2000, longest=5):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, min(longest, len(w) - i) + 1):
                    counts[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and b >= a and inside(q) for q, b in candidates.items()):
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, None, 3, "x") for i, (g, t) in enumerate(rows)], DOCS)


def mined(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


ODD = [(None, None), ("en", ""), ("en", " \t\n"), (None, "A b\tc. a B c, A b c"), ("und", "a b c\x85d é É"), ("de", "...;;!"), ("en", "x" * 50_000), ("en", "a\x0bb\x0ca\rb a b")]


@pytest.mark.parametrize("batch", [10_000, 7])
def test_phrases(spark, batch):
    """Small blocks put most prefixes on block edges, where their counts are stitched."""
    r = random.Random(3)
    rows = [(r.choice(["en", "de", None]), " ".join(r.choice(["the", "of", "The", "cat", "sat.", "on,", "mat", "é", f"w{r.randrange(60)}"]) for _ in range(r.randrange(60)))) for _ in range(300)]
    rows += [("en", "hot words " * 400)] * 2 + ODD
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = mined(op13.mine_phrases(table(spark, rows).repartition(5), min_count=6))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute(rows, 6) and len({g[0] for g in got}) == 3


def test_phrases_of_every_length_and_the_cut(spark):
    rows = [("en", "a b c d e f g")] * 5 + ODD
    for least, top, longest in ((5, 2000, 5), (2, 3, 5), (1, 50, 3), (100, 5, 5)):
        assert mined(op13.mine_phrases(table(spark, rows), min_count=least, top=top, longest=longest)) == brute(rows, least, top, longest)
    assert mined(op13.mine_phrases(table(spark, []))) == []


def test_blocks_of_pointers_add_up():
    r = random.Random(5)
    rows = sorted(tuple(([r.randrange(1, 4) for _ in range(r.randrange(3, 6))] + [0, 0])[:5]) for _ in range(500))
    for size in (1, 3, 50, 500):
        got = Counter()
        for i in range(0, len(rows), size):
            part = np.array(rows[i : i + size])
            for p, f in op13.grow(part, np.ones(len(part), np.int64), 4):
                got[p] += f
        want = Counter(row[:m] for row in rows for m in (3, 4, 5) if 0 not in row[:m])
        assert {p: f for p, f in got.items() if f >= 4} == {p: f for p, f in want.items() if f >= 4}


def test_bit_set_has_no_false_negatives(spark):
    values = [r * 0x9E3779B97F4A7C15 % 2**64 - 2**63 for r in range(1, 3000)]
    cells = op13.bit_set(spark.createDataFrame([(v,) for v in values], "h long"), "h", len(values))
    assert op13.may_hold(cells, np.array(values, np.int64).view(np.uint64)).all()
    assert op13.may_hold(cells, np.random.default_rng(1).integers(0, 2**63, 10_000).astype(np.uint64)).mean() < 0.1


def test_a_shared_hash_starts_anew(spark, monkeypatch):
    real = op13._Ids.__missing__
    monkeypatch.setattr(op13._Ids, "__missing__", lambda self, word: 77 if self.seed == 0 and word in (b"b", b"c") else real(self, word))
    seeds = []
    count = op13.count_words
    monkeypatch.setattr(op13, "count_words", lambda texts, seed: seeds.append(seed) or count(texts, seed))
    rows = [("en", "a b c")] * 9
    got = mined(op13.mine_phrases(table(spark, rows), min_count=2))
    assert got == brute(rows, 2) and seeds == [0, 1]
