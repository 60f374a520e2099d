"""Licence scan, quality, decontamination, near duplicates and token counts against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.llm import op1_license_scan as op1
from tallymill.llm import op2_quality as op2
from tallymill.llm import op4_decontamination as op4
from tallymill.llm import op7_near_dedup as op7
from tallymill.llm import op8_token_counts as op8
from tallymill.llm.license_rules import rules
from tallymill.llm.words import normalized, shingle_hashes, word_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " \n\t", "É ß 日本", "x" * 70_000, "a b " * 20_000, "\x00\x7f|"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, shard int"


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def table(spark, texts, ids=None):
    """Documents with further columns whose names clash with results, and nulls in them."""
    return spark.createDataFrame([(i, t, None, None, None, 7, None, 3) for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.mark.parametrize("t", ODD + ["Ab-C1 d'É_9"])
def test_words_are_the_contract_words(t):
    assert normalized(t).decode().split() == words(t)


def test_shingle_hashes_depend_on_words_only():
    a, b = normalized("x y z one two three four"), normalized("One, two; three")
    assert shingle_hashes(a, 3)[3] == shingle_hashes(b, 3)[0]
    long = normalized(prose(1, 300_000))
    h = shingle_hashes(long, 5)
    assert len(h) == 300_000 - 4
    for i in (0, 1000, 150_000, len(h) - 1):
        s, e = word_spans(long)
        assert h[i] == shingle_hashes(long[s[i] : e[i + 4]], 5)[0]


def test_license_base_places(spark):
    texts = ODD + ["CC-BY cc by, CC BY", "the GNU General Public License, version 3. All rights reserved", "cc", "general public\nlicense " * 3000]
    got = op1.scan_licenses(table(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        w = words(texts[r.doc_id])
        places, labels = [], set()
        for p, label in op1.BASE.items():
            hits = [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
            places += hits
            labels |= {label} if hits else set()
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert r.base_labels == ",".join(sorted(labels))
        assert labels <= set(r.labels.split(",")) | {""} and r.labels == ",".join(sorted(r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_license_rules_and_suppression():
    found = rules()
    assert len(found) > 200
    scan = op1.Scanner().scan
    labels = lambda t: set(scan(t)[5].split(","))
    assert labels("SPDX-License-Identifier: Apache-2.0") == {"apache-2.0"}
    assert labels("Licensed under the MIT License") == {"mit"}
    assert labels("CC BY-NC 4.0") == {"cc-by", "cc-by-nc-4.0"}  # the base label stays, the shorter rule's detection goes
    assert labels("GNU Lesser General Public License v3") == {"gpl", "lgpl-3.0"}
    assert labels("permitted by the admitting party") == {""}
    for r in found:  # every rule's keyword is one of its words, so the gate lets it run
        assert r.keyword in r.pattern.pattern, r


def spellings(pattern):
    """Every text that a parsed pattern can match, digits all being 1."""
    out = [""]
    for kind, v in pattern:
        kind = str(kind)
        if kind == "LITERAL":
            some = [chr(v)]
        elif kind == "IN":
            some = [chr(x) if str(k) == "LITERAL" else "1" for k, x in v]
        elif kind == "BRANCH":
            some = [t for p in v[1] for t in spellings(p)]
        elif kind == "SUBPATTERN":
            some = spellings(v[3])
        elif kind == "MAX_REPEAT":
            one = spellings(v[2])
            some = ["".join(p) for n in range(v[0], min(v[1], v[0] + 2) + 1) for p in itertools.product(one, repeat=n)]
        else:
            assert kind in ("ASSERT", "ASSERT_NOT"), kind
            some = [""]
        out = [a + b for a in out for b in some]
    return out


def test_license_gates_let_every_spelling_pass():
    for r in rules():
        for t in spellings(re._parser.parse(r.pattern.pattern)):
            assert r.pattern.fullmatch(t) and f" {r.keyword} " in f" {t} ", (r, t)
    labels = lambda t: set(op1.Scanner().scan(t)[5].split(","))
    for v in "23":
        for t in (f"GPLv{v} or later", f"GPL{v} or later", f"GPL v{v}.0 or later", f"GPLv{v}.0 or later"):
            assert f"gpl-{v}.0-or-later" in labels(t), t
    assert labels("BigScience OpenRAILM license") == labels("OpenRAIL-M") == {"openrail"}


def test_copies_of_a_benchmark_row_count_once(spark):
    one = spark.createDataFrame([("a", "some words " * 20), ("b", None)], "item_id string, text string")
    many = one.unionAll(one.crossJoin(spark.range(50)).drop("id"))
    blocks = op4._blocks(many, "item_id", "text", 1000)
    assert sorted(map(tuple, blocks[0].collect())) == sorted(map(tuple, op4._blocks(one, "item_id", "text", 1000)[0].collect())) and len(blocks) == 1


def test_resolve_keeps_overlaps_that_do_not_nest():
    kept = op1.resolve([(3, 0, 10, 0, "a"), (1, 2, 5, 1, "b"), (2, 8, 14, 2, "c"), (2, 9, 12, 3, "d"), (4, 0, 10, 4, "e")])
    assert [d[4] for d in kept] == ["a", "b", "c"]
    for seed in range(50):
        r = random.Random(seed)
        some = [(r.randint(1, 3), s, s + r.randint(1, 9), i, "x") for i, s in enumerate(r.choices(range(30), k=12))]
        want = []
        for d in sorted(some, key=lambda d: (d[0], d[1] - d[2], d[3], d[1])):
            if not any(k[1] <= d[1] and d[2] <= k[2] for k in want):
                want.append(d)
        assert op1.resolve(some) == sorted(want, key=lambda d: (d[1], d[2], d[3]))


def test_quality_held_out_accuracy(spark, data):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = op2.classify(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()


@pytest.mark.parametrize("quality", [0, 1])
def test_keep_good_decides_as_classify_where_labels_are_of_one_kind(spark, quality):
    docs = table(spark, ODD)
    labels = spark.createDataFrame([(i, quality, 0) for i in range(len(ODD))], "doc_id long, quality int, toxic int")
    assert op2.keep_good(docs, labels).count() == op2.classify(docs, labels).filter("predicted = 1").count() == quality * len(ODD)


def test_quality_edge_cases(spark):
    texts = ODD + ["Fine words stand here in a row. " * 5, "JUNK!! ### $$$ " * 9] * 30
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, int("JUNK" not in (t or "")), 0) for i, t in enumerate(texts)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in op2.classify(docs, labels).collect()}
    assert len(got) == len(texts)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([r.predicted == (texts[i] is None or "JUNK" not in texts[i]) for i, r in got.items()]) > 0.9
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    none = op2.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert op2.keep_good(docs, labels.limit(0)).count() == len(texts)
    assert op2.classify(docs.limit(0), labels).count() == 0
    kept = op2.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < len(texts)
    twice = table(spark, ["a b c"] * 3, [None, 1, 1])
    assert op2.classify(twice, labels).count() == 3


def brute_contamination(text, items, window=13):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        iw = words(item)
        n = min(window, len(iw))
        if not n:
            continue
        for i in range(len(iw) - n + 1):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == iw[i : i + n]:
                    hit |= set(range(at, at + n))
                    found.add(str(name) if name is not None else "null")
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block_bytes", [op4.BLOCK_BYTES, 300])
def test_contamination(spark, block_bytes):
    items = [(1, prose(1, 40)), (2, prose(2, 13)), (3, "one two"), (4, "solo"), (5, None), (6, ""), (None, prose(3, 20)), (2, prose(2, 13)), (7, "a " * 30), (11, prose(1, 40))]
    texts = [None, "", prose(1, 40), "x " + prose(1, 40)[:90].upper() + " y", prose(9, 50) + " " + prose(2, 13), "One, Two three", "SOLO", prose(3, 20) * 2, "a " * 60, prose(5, 3000) + " one two", prose(2, 12)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, texts)
    got = op4.contamination(docs, benchmark, block_bytes=block_bytes).select("doc_id", "__contamination.*").collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_contamination(texts[r.doc_id], items), texts[r.doc_id]
    kept = op4.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.contaminated}


def test_contamination_without_rows(spark):
    docs, benchmark = table(spark, ODD), spark.createDataFrame([], "item_id long, text string")
    assert op4.decontaminate(docs, benchmark).count() == len(ODD)
    assert op4.decontaminate(docs.limit(0), spark.createDataFrame([(1, "a")], benchmark.schema)).count() == 0


def similarity(a, b):
    def bag(t):
        w = words(t)
        k = min(5, len(w))
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_signatures_estimate_weighted_similarity():
    m, r = 4096, random.Random(3)
    for a_weights, b_weights in (((1, 1, 1, 5, 9), (1, 1, 2, 3, 20)), ((100, 1, 3, 8, 2), (37, 1, 3, 64, 1))):
        values = np.array([r.getrandbits(64) for _ in range(5)], np.uint64)
        x = op7.signatures(np.repeat([0, 1], 5), np.concatenate([values, values]), np.array(a_weights + b_weights), 2, m)
        want = sum(map(min, a_weights, b_weights)) / sum(map(max, a_weights, b_weights))
        assert abs((x[0] == x[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / m)


def near_copies():
    r, texts = random.Random(7), []
    for g in range(12):
        base = prose(100 + g, 150, 5000).split()
        texts.append(" ".join(base))
        for _ in range(8):
            v = list(base)
            for _ in range(r.randint(0, 5)):
                v[r.randrange(len(v))] = f"new{r.random()}"
            texts.append(" ".join(v).upper() if r.random() < 0.3 else " ".join(v))
    return texts + [prose(500 + i, 60, 5000) for i in range(60)] + ["", None, "One two", "one, two", "a b c d e f", "tok " * 500, "tok " * 450, "tok " * 200]


def test_near_duplicates_equal_brute_force(spark):
    texts = near_copies()
    got = op7.near_duplicates(table(spark, texts)).collect()
    assert len(got) == len(texts)
    above = list(range(len(texts)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if words(texts[i]) == words(texts[j]) or similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                above[b] = a
    want = {i: top(i) for i in range(len(texts))}
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_near_duplicates_of_odd_rows(spark):
    texts, ids = ODD + ["same words here and there again"] * 5, [None, 5, 5, 5, None, 9, 10, 3, 3, None, 4, 4]
    docs = table(spark, texts, ids)
    got = op7.near_duplicates(docs).collect()
    assert len(got) == len(texts) and sum(r.kept for r in got) == len({tuple(words(t)) for t in texts})
    kept = op7.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert [r.doc_id for r in kept.filter(F.col("text").startswith("same")).collect()] == [3]
    assert op7.near_duplicates(docs.limit(0)).count() == 0
    assert op7.near_duplicates(table(spark, [prose(1, 50), prose(2, 50)])).select("class_id").distinct().count() == 2


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (300, 16), (2000, 64)])
def test_spliced_counts_equal_whole_encodings(chunk, overlap):
    counter, r = op8.SplicingCounter(chunk_bytes=chunk, overlap_bytes=overlap), random.Random(chunk)
    alphabets = ["ab c\n", "日本語 é", "a", "  x\t", "abcdefghij ", "▁ <s></s>", "\U0001f600 ñ", "the of and "]
    texts = ["".join(r.choice(r.choice(alphabets)) for _ in range(r.randint(0, 3000))) for _ in range(60)]
    texts += ["".join(r.choice(a) for _ in range(2500)) for a in alphabets] + ["x" * 5000, " " * 5000, ""]
    assert counter.counts(texts) == [len(counter.sp.encode(t)) for t in texts]
    assert counter.widened > 0


def test_token_count_query(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=op8.model_path(op8.MODEL))
    got = op8.count_tokens(table(spark, ODD, [None] + list(range(len(ODD) - 1)))).collect()
    want = sorted((len((t or "").encode()), len(sp.encode(t or ""))) for t in ODD)
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert op8.count_tokens(table(spark, ODD).limit(0)).count() == 0


def _leaf(g, h, a, b):
    return sum(g[a:b]) / (sum(h[a:b]) + 1.0)


def _brute_tree(g, h, splits):
    """The tree by trying every cut of every leaf, one after another, with sums written out."""
    worth = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + 1.0)
    leaves = [(0, len(g))]
    for _ in range(splits):
        tried = [(worth(a, c) + worth(c, b) - worth(a, b), a, c, b) for a, b in leaves for c in range(a + 1, b)]
        if not tried or max(t[0] for t in tried) <= 1e-9:
            break
        _, a, c, b = max(tried, key=lambda t: t[0])
        leaves.remove((a, b))
        leaves += [(a, c), (c, b)]
    return [next(_leaf(g, h, a, b) for a, b in leaves if a <= i < b) for i in range(len(g))]


@pytest.mark.parametrize("seed", range(6))
def test_tree_steps_are_the_best_cuts(seed):
    r = np.random.default_rng(seed)
    for n in (1, 2, 5, 12):
        g, h = r.standard_normal(n), r.random(n)
        for splits in (1, 3):
            assert op2._tree_step(g, h, splits) == pytest.approx(_brute_tree(g.tolist(), h.tolist(), splits))
    assert op2._tree_step(np.zeros(4), np.ones(4)).tolist() == [0.0] * 4
    g, h = r.standard_normal((4, 5)), r.random((4, 5))
    rows = _brute_tree(g.sum(1).tolist(), h.sum(1).tolist(), 1)
    cut = next((i + 1 for i in range(3) if rows[i] != rows[i + 1]), 4)
    want = [_brute_tree(part.sum(0).tolist(), hh.sum(0).tolist(), 1) for part, hh in ((g[:cut], h[:cut]), (g[cut:], h[cut:])) for _ in range(len(part))]
    assert op2._tree_step_2d(g, h) == pytest.approx(np.array(want))


def test_scores_are_sums_of_looked_up_bins(spark):
    """Every score is the logistic of the intercept and one cell a feature and a pair, looked up one by one."""
    r = np.random.default_rng(2)
    x = r.standard_normal((300, 3)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = op2.AdditiveModel().fit(x, y)
    place = lambda edges, v: sum(v >= e for e in edges)
    for row, got in zip(x, m.score(x)):
        total = m.intercept + sum(t[place(e, v)] for e, t, v in zip(m.edges, m.tables, row))
        total += sum(t[place(m.pair_edges[a], row[a]), place(m.pair_edges[b], row[b])] for (a, b), t in zip(m.pairs, m.pair_tables))
        assert got == pytest.approx(1 / (1 + np.exp(-total)))
    # the product of two signs is in no single feature; the pairs' tables have it
    right = lambda model: np.mean((model.score(x) > 0.5) == (y == 1))
    with_pairs = right(m)
    m.pairs, m.pair_tables = [], []
    assert with_pairs > right(m) + 0.1
    texts = ["one two. three", None, "x" * 50, "A b C d!"]
    model = op2.AdditiveModel().fit(np.array([op2.features(t) for t in texts * 5]), np.array([1.0, 0, 0, 1] * 5))
    got = table(spark, texts).coalesce(1).select(op2.scorer(model)(F.col("text")).alias("s")).collect()
    assert [g.s for g in got] == pytest.approx([float(model.score(np.array([op2.features(t)]))[0]) for t in texts])
