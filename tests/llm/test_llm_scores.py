"""Context-tree weighting against its definition, and the unigram base against a count."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallymill.llm import op11_lm_score as op11

DOCS = "doc_id long, text string, lang string, g int, score double, n long"
ODD = [None, "", " \n\t\x0b", "É ß 日本", "x" * 3000, "a b " * 900, "\x00\x7f|", "A\x85b"]


class Tree:
    """One decision's weighted tree, by recursion over the whole counts."""

    def __init__(self, depth):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])

    def see(self, context, bit):
        for d in range(self.depth + 1):
            self.counts[context[self.depth - d :]][bit] += 1

    def own(self, s):
        a, b = self.counts.get(s, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, s=b""):
        if s not in self.counts:
            return 0.0
        if len(s) == self.depth:
            return self.own(s)
        below = sum(self.weighted(bytes([x]) + s) for x in range(256) if bytes([x]) + s in self.counts)
        own = self.own(s)
        top = max(own, below)
        return math.log(0.5) + top + math.log(math.exp(own - top) + math.exp(below - top))

    def cost(self, context, bit):
        """ln of what one more bit costs: the whole tree with it over the whole tree without."""
        before = self.weighted()
        saved = {context[self.depth - d :]: list(self.counts[context[self.depth - d :]]) if context[self.depth - d :] in self.counts else None for d in range(self.depth + 1)}
        self.see(context, bit)
        after = self.weighted()
        for s, old in saved.items():
            if old is None:
                del self.counts[s]
            else:
                self.counts[s] = old
        return after - before


def decisions(text, depth):
    data = bytes(depth) + (text or "").encode() + b"\0"
    for i in range(depth, len(data)):
        for j in range(8):
            yield 1 << j | data[i] >> (8 - j), data[i - depth : i], data[i] >> (7 - j) & 1


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def scored(spark, rows, **options):
    df = spark.createDataFrame([(i, t, None, 3, None, 4) for i, t in rows], DOCS).repartition(3)
    out = op11.score_texts(df, **options)
    assert out.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return out.collect()


@pytest.mark.parametrize("depth", [0, 2, 3])
def test_score_is_the_ratio_of_weighted_trees(spark, depth):
    r = random.Random(depth)
    rows = [(i, "".join(r.choice("ab c") for _ in range(r.randrange(12)))) for i in range(24)] + [(None, None), (2**60 + 1, "é")]
    trees = defaultdict(lambda: Tree(depth))
    for i, t in rows:
        if not held(i):
            for node, context, bit in decisions(t, depth):
                trees[node].see(context, bit)
    want = Counter((i, round(sum(trees[node].cost(c, b) for node, c, b in decisions(t, depth)) / math.log(10), 7)) for i, t in rows)
    got = scored(spark, rows, depth=depth, group_bytes=200)
    assert Counter((x.doc_id, round(x.score, 7)) for x in got) == want
    for x in got:
        assert math.isclose(x.bits_per_byte, -x.score * math.log2(10) / (x.n_bytes + 1))


def test_base_score_and_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(ODD * 4)] + [(None, "a é"), (3, ODD[3]), (3, ODD[3])] + [(100 + i, f"The cat No{i} sat") for i in range(40)]
    count = Counter()
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    for i, t in rows:
        if not held(i):
            count.update(split(t))
    n, v = sum(count.values()), len(count)
    want = Counter((i, held(i), len(split(t)), sum(count[w] > 0 for w in split(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in split(t)), 6)) for i, t in rows)
    for size in (1, 5000, 1 << 20):
        got = scored(spark, rows, group_bytes=size)
        assert Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == want
        assert all(x.score < 0 and x.n_bytes == len((dict(rows)[x.doc_id] or "").encode()) for x in got)


def test_scores_know_text_like_the_corpus(spark):
    r = random.Random(1)
    prose = lambda: " ".join(r.choice(["the", "cat", "sat", "on", "mat"]) for _ in range(60))
    noise = lambda: "".join(r.choice("qwxzjkv ") for _ in range(200))
    rows = [(i, prose()) for i in range(80)] + [(i, noise()) for i in range(1000, 1400) if held(i)]
    got = scored(spark, rows)
    like = [x.bits_per_byte for x in got if x.doc_id < 80 and x.held_out]
    unlike = [x.bits_per_byte for x in got if x.doc_id >= 1000]
    assert like and unlike and max(like) < 2 < 4 < min(unlike)


def test_no_training_rows_and_no_rows(spark):
    out = [i for i in range(100) if held(i)][:3]
    for x in scored(spark, [(i, "ab") for i in out]):
        assert (x.train_tokens, x.n_known, x.base_score) == (0, 0, 0.0) and math.isclose(x.score, 3 * math.log10(1 / 256))
    assert scored(spark, []) == []


def test_values_are_summed_over_several_texts_at_once(monkeypatch):
    """Texts longer than a piece, more of them than a number's bits tell apart, and each looked up in order."""
    r = random.Random(2)
    texts = [bytes(r.choices(b"abc \xff\x00", k=r.choice((0, 1, 7, 90)))) for _ in range(20)]
    for depth in (0, 5, 6):
        plain = [Counter(g for some in op11.grams(t, depth) for g in some.tolist()) for t in texts]
        at = np.array(sorted(set().union(*plain)))
        value = -np.arange(1.0, len(at) + 1)
        price = dict(zip(at.tolist(), value.tolist(), strict=True))
        want = [sum(price[g] * n for g, n in grams.items()) for grams in plain]
        calls, search = [], np.searchsorted
        monkeypatch.setattr(np, "searchsorted", lambda a, v: calls.append(bool((v[1:] >= v[:-1]).all())) or search(a, v))
        for piece in (1, 50, 1 << 18):
            for name in ("_PIECE", "_COUNTED", "_HELD"):
                monkeypatch.setattr(op11, name, piece)
            assert op11.summed(texts * 5, depth, at, value).tolist() == want * 5
            found = op11._GramCounts()
            for i, t in enumerate(texts):
                for some in op11.grams(t, depth):
                    found.add(some, i % 2)
            values, n = found.counts()
            trained = sum(plain[1::2], Counter())
            assert values.tolist() == at.tolist() and n.tolist() == [trained[g] for g in at.tolist()]
        monkeypatch.undo()
        assert all(calls) and len(calls) >= 3
