"""URL filter, sharding, mixing, nearest neighbours and line deduplication against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.llm import op3_url_filter as op3
from tallymill.llm import op5_sharding as op5
from tallymill.llm import op6_mixing as op6
from tallymill.llm import op9_ann as op9
from tallymill.llm import op10_line_dedup as op10

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, slot long, rid long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, 5, None, 1) for i, t, s in rows], DOCS)


def judge(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else "allow"


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "https://www.example.com/EN/", "http://example.com/en/a?b#c", "http://a.b.example.com/en/", "http://example.com", "http://example.com?x=/en/",
    "ftp://x.net/es/1", "http://net/fr/", "http://xnet/fr/", "http://a.net/fr", "http://u:p@h.net:80/es/", "http://.com/", "http://com/", "a://b://c.com/d", "http://" + "a." * 3000 + "com/", "http://é.com/\n?x",
]


@pytest.mark.parametrize("most", [op3.BROADCAST_RULES, 0])
def test_url_rules(spark, most, monkeypatch):
    monkeypatch.setattr(op3, "BROADCAST_RULES", most)
    more = op3.RULES + [("b.example.com", "/e", "block"), ("com", "/en/x/y", "block"), ("c.com", "", "block")]
    for rules in (op3.RULES, more):
        rows = [(i, u, 1) for i, u in enumerate(URLS)] + [(None, URLS[4], 2), (4, URLS[4], 3)]
        pages = spark.createDataFrame(rows, "page_id long, url string, rule int")
        got = op3.filter_urls(pages, op3.rules_frame(spark, rules)).collect()
        assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter((i, *judge(u, rules)) for i, u, _ in rows)
    assert op3.filter_urls(pages, op3.rules_frame(spark).limit(0)).filter("rule is not null").count() == 0
    assert op3.filter_urls(pages.limit(0), op3.rules_frame(spark)).count() == 0


def jump(key, n):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 40, 500])
def test_jump_hash(spark, shards):
    keys = list(range(200)) + [-1, -7, 2**63 - 1, -(2**63), 10**15]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: (r.s.kept, r.s.b) for r in df.select("k", op5.jump_shards(F.col("k"), shards).alias("s")).collect()}
    assert got == {k: (jump(k, shards), jump(k, shards + 1)) for k in keys}


def test_shards(spark):
    rows = [(i, "é" * (i % 7), "s") for i in range(2000)] + [(None, None, None)] * 900 + [(5, "same", "s")] * 300
    got = op5.shard_documents(table(spark, rows), 40).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = defaultdict(list)
    for r in got:
        assert r.shard == jump(-1 if r.doc_id is None else r.doc_id, 40) and r.grown_shard in (r.shard, 40) and r.law == "key"
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(Counter(jump(i, 40) for i in range(2000)).values()) < 2 * 50
    assert op5.shard_documents(table(spark, []), 40).count() == 0


def targets(sizes):
    """Budget by weights, capped at twice a source, the excess reshared until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randint(0, 30), s) for i, s in enumerate(r.choices(["b", "a", "é", "c", None, "empty"], [50, 5, 5, 10, 5, 0], k=1500))]
    rows += [(i, None, "empty") for i in range(3)] + [(9, "one\x0btwo\x1cthree\u00a0x", "a")] * 4
    want = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (_, t, _) in enumerate(rows)}
    sizes = Counter()
    for i, (_, _, s) in enumerate(rows):
        sizes[s] += want[i]
    goal = targets(sizes)
    docs = table(spark, rows)
    mix = op6.mix_sources(docs, carry=("source",)).collect()
    assert Counter((x.doc_id, x.size, x.source) for x in mix) == Counter((i, want[n], s) for n, (i, _, s) in enumerate(rows))
    taken, largest = Counter(), Counter()
    for x in mix:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(goal[x.source])
        assert x.taken in (0, x.size, 2 * x.size)
        taken[x.source] += x.taken
        largest[x.source] = max(largest[x.source], x.size)
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in sizes)
    again = op6.mix_sources(docs.repartition(7), carry=("source",)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, mix))
    out = op6.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(x.source for x in out.collect()) == Counter({s: sum(x.copies for x in mix if x.source == s) for s in sizes if sum(x.copies for x in mix if x.source == s)})
    assert op6.mix_sources(table(spark, [])).count() == 0
    assert op6.mixed_documents(table(spark, [(1, None, None)])).count() == 0


def test_nearest(spark):
    r = np.random.default_rng(4)
    v = r.standard_normal((900, 16)).astype(np.float32)
    v[100:160] = v[100]  # a large group of equal vectors
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(901, None, 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [None] * 16, 1), (905, [float("inf")] + [1.0] * 15, 1), (906, [], 1), (100, v[7].tolist(), 1), (950, [1.0, 2.0], 1), (1000, [2.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for x in sorted(op9.nearest(df, block_rows=300).collect(), key=lambda x: (x.query_id, x.rank)):
        got[x.query_id].append((x.vec_id, x.score, x.rank))
    assert [g[0] for g in got.pop(1000)] == [950]
    assert [g[0] for g in got.pop(950)] == [1000]
    hits = total = 0
    for q in range(0, 900, 50):
        if q == 100:
            assert [g[0] for g in got[q]][:0] == []
            continue
        s = (v.astype(float) * v[q].astype(float)).sum(1) / (np.linalg.norm(v.astype(float), axis=1) * np.linalg.norm(v[q].astype(float)))
        s[q] = -9
        best = np.lexsort((np.arange(900), -s))[:5]
        hits += len(set(best) & {g[0] for g in got[q]})
        total += 5
        assert [g[2] for g in got[q]] == [1, 2, 3, 4, 5]
        for i, score, _ in got[q]:
            assert score == pytest.approx(s[i] if i != 100 else max(s[100], score), abs=1e-12)
    assert hits >= 0.9 * total
    assert op9.nearest(df.limit(0)).count() == 0
    assert op9.nearest(df.filter("vec_id in (50, 7)")).select("vec_id").first().vec_id == 7


def test_cells_part_all_of_space_and_are_found_by_their_distance():
    r = np.random.default_rng(9)
    points = r.standard_normal((2000, 4))
    points[:700] = points[0]  # a third are one point
    tree = op9.Cells(points, 16)
    assert 8 <= tree.count <= 16
    more = np.concatenate([points, 5 * r.standard_normal((500, 4))])
    own = tree.of(more)
    assert set(own) == set(range(tree.count))
    assert len(set(own[:700])) == 1
    who, where = tree.within(more, np.full(len(more), 0.7))
    found = set(zip(who.tolist(), where.tolist(), strict=True))
    assert all((i, c) in found for i, c in enumerate(own))
    near = ((more[:, None, :] - more[None, ::7, :]) ** 2).sum(2) <= 0.7
    for i, j in zip(*np.nonzero(near), strict=True):  # the cell of a point so near is never missed
        assert (int(i), int(own[::7][j])) in found
    assert len(found) < 0.8 * len(more) * tree.count
    assert len(tree.within(points[:3], np.full(3, np.inf))[0]) == 3 * tree.count
    assert op9.Cells(np.ones((9, 4)), 8).count == op9.Cells(np.zeros((0, 4)), 8).count == 1


def test_nearest_across_cells_of_clustered_vectors(spark):
    r = np.random.default_rng(8)
    centres = r.standard_normal((40, 24))
    v = np.repeat(centres, 100, axis=0) + 0.15 * r.standard_normal((4000, 24))
    v[1000:2300] = v[1000]  # a third of the rows are equal and go to several blocks
    order = r.permutation(4000)
    v = v[order]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for x in sorted(op9.nearest(df, block_rows=400).collect(), key=lambda x: (x.query_id, x.rank)):
        got[x.query_id].append(x.vec_id)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    hits = 0
    for q in range(0, 4000, 50):
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        best = np.lexsort((np.arange(4000), -s))[:5]
        hits += len(set(best) & set(got[q]))
        if s[best[4]] == 1:
            assert got[q] == best.tolist()
    assert sorted(got) == list(range(0, 4000, 50))
    assert hits >= 0.9 * 400


def test_equal_vectors_go_by_id():
    v = np.ones((40, 8))
    found, _ = op9.search_block(v, np.arange(40)[::-1].copy(), np.arange(40), v[:1], np.array([39]), 5, 8, 0.98, 5)
    assert found[0][0].tolist() == [1, 2, 3, 4, 5]  # row 39 has id 0 and is the query itself


def test_chi_square():
    assert op9.chi_square_point(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert op9.chi_square_point(0.98, 2) == pytest.approx(7.824, abs=1e-3)


def line_keys(norm):
    """The SimHash, and the keys that a line stands under: two of four blocks, two of four parts of the sampled words."""
    import xxhash

    w = [x for x in (x.strip(" \t\r.,;:!?\"'()[]|-") for x in norm.split(" ")) if x]
    hs = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in w]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    votes = [h for h, x in zip(hs, w, strict=True) if len(x) > 4] if re.search(r"[^ \t\r.,;:!?\"'()\[\]|-]{5}", norm) else hs
    ties = max(votes, key=signed), min(votes, key=signed)
    code = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in votes) + (ties[i % 2] >> i & 1) > len(votes))
    keys = {("block", i, code & ~(0xFFFF << 16 * i)) for i in range(4)}
    n, scale = norm.count(" ") + 1, 1
    while scale * 16 <= n:
        scale *= 2
    for scale in (scale, 2 * scale) if n * 5 >= scale * 2 * 32 else (scale,):  # noqa: B020
        parts, held = [0] * 4, [set() for _ in range(4)]
        for h in hs:
            part = h >> 40 & 4 * scale - 1
            if part < 4:
                parts[part] += h & 0x7FFFFFFF
                held[part].add(h & 15)
        least = 3 if len(hs) > 8 else 2
        keys |= {("part", scale, i, j, parts[i], parts[j]) for i in range(4) for j in range(i + 1, 4) if len(held[i]) + len(held[j]) >= least}
    return code, keys


def normal(line):
    return line.lower().strip(" \t\r.,;:!?\"'()[]|-")


def edits(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def brute_lines(rows):
    first, above = {}, {}
    lines = [(k, p, normal(x)) for k, (_, t, _) in enumerate(rows) if t is not None for p, x in enumerate(t.split("\n"))]
    names = list(dict.fromkeys(n for _, _, n in lines if n))
    names = [n for n in names if n.strip(" -")]
    codes = {n: line_keys(n) for n in names}
    above = {n: n for n in names}

    def top(n):
        while above[n] != n:
            n = above[n]
        return n

    for i, a in enumerate(names):
        for b in names[:i]:
            most = int(max(len(a), len(b)) * 0.2 + 1e-9)
            if (codes[a][0] ^ codes[b][0]).bit_count() <= op10.BITS_APART and codes[a][1] & codes[b][1] and edits(a, b) <= most:
                above[top(a)] = top(b)
    out = {k: None if t is None else [] for k, (_, t, _) in enumerate(rows)}
    for k, p, n in lines:
        if not n or first.setdefault(top(n), (k, p)) == (k, p):
            out[k].append(rows[k][1].split("\n")[p])
    return [None if v is None else "\n".join(v) for v in out.values()]


def test_lines(spark):
    r = random.Random(6)
    bases = [" ".join(f"{r.choice('bdfgklmnpr')}{r.choice('aeiou')}{r.choice('stvz')}{r.choice('aeiou')}{r.randrange(99)}n" for _ in range(r.randint(3, 40))) for _ in range(40)]
    rows = []
    for i in range(120):
        some = []
        for _ in range(r.randint(1, 6)):
            w = r.choice(bases).split(" ")
            if r.random() < 0.5:
                w[r.randrange(len(w))] = r.choice(["alpha", "x", "zeta9"])
            some.append(" ".join(w).title() + r.choice(["", ".", " !"]))
        rows.append((i, "\n".join([*some, "", " -- "]), "s"))
    rows += [(500, None, "s"), (501, "", "s"), (502, "Page 3 of 10\nPAGE 3 of 10.", "s"), (503, "\n\n", "s"), (504, "é " * 40_000, "s"), (505, "é " * 40_000, "s"), (506, "ab cd\nab cd", "s")]
    docs = table(spark, rows).withColumns({"at": F.lit(3).cast("long"), "nr": F.monotonically_increasing_id()})
    got = {x.doc_id: x for x in op10.dedup_lines(docs, row=("at", "nr")).collect()}
    assert len(got) == len(rows)
    for (i, t, _), want in zip(rows, brute_lines(rows), strict=True):
        x = got[i]
        assert x.text == want, i
        assert x.n_lines == (0 if t is None else t.count("\n") + 1)
        assert x.n_lines - x.n_dropped == (0 if t is None else len(want.split("\n")) if want or x.n_dropped < x.n_lines else 0)


def test_lines_of_odd_tables(spark):
    assert op10.dedup_lines(table(spark, [])).isEmpty()
    same = op10.dedup_lines(table(spark, [(None, "one line here", None)] * 3 + [(4, "one line here", None)])).collect()
    assert sorted((x.doc_id is None, x.text) for x in same) == [(False, "one line here"), (True, ""), (True, ""), (True, "")]


def test_long_near_lines_go(spark):
    long = " ".join(f"word{i}x" for i in range(2000))
    rows = [(1, long, "s"), (2, long.replace("word1000x", "word1000x other"), "s"), (3, long[::-1], "s"), (4, "put before it " * 20 + long, "s")]
    got = {x.doc_id: x.n_dropped for x in op10.dedup_lines(table(spark, rows)).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1}


@pytest.mark.parametrize("n_words", [6, 12, 33, 70, 300])
def test_lines_with_a_replaced_word_are_found(spark, n_words):
    """Held against edit similarity alone, on both sides of every size that the method knows."""
    r = random.Random(n_words)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.choice((2, 3, 5, 7, 9)))) for _ in range(600)]
    rows, near = [], 0
    for i in range(60):
        w = r.choices(vocabulary, k=n_words)
        other = list(w)
        other[r.randrange(n_words)] = r.choice(vocabulary)
        a, b = " ".join(w), " ".join(other)
        if a != b and edits(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9):
            near += 1
            rows.append((i, f"{a}\n{b}", "s"))
    got = sum(x.n_dropped for x in op10.dedup_lines(table(spark, rows)).collect())
    assert near > 25 and got >= (0.9 if n_words > 8 else 0.6) * near


def test_a_document_of_many_dropped_lines(spark):
    lines = [f"the same {i % 50} line here" for i in range(30_000)] + ["", "last one stays"]
    got = op10.dedup_lines(table(spark, [(1, "\n".join(lines), "s")])).first()
    assert got.text.endswith("\n\nlast one stays") and got.n_lines == 30_002 and got.n_lines - got.n_dropped == len(got.text.split("\n"))


def test_long_lines_with_shifted_segments(spark):
    """One insertion shifts every later segment; the edit distance decides."""
    r = random.Random(3)
    long = " ".join("".join(r.choices("abcdefghijklmnop", k=7)) for _ in range(1200))
    pairs = [(long, "x" * 251 + long, True), (long, long[:4000] + "y" * 900 + long[4000:], True), (long, "z" * 2600 + long, False), (long, long[::-1], False)]
    df = spark.createDataFrame([(a, b, want) for a, b, want in pairs], "a string, b string, want boolean")
    got = df.select("want", op10._near(F.col("a"), F.col("b"), 0.8).alias("near")).collect()
    assert [x.near for x in got] == [x.want for x in got]


def test_block_keys_of_one_bit_apart(spark):
    r = random.Random(1)
    pairs = []
    for _ in range(200):
        a = r.getrandbits(64)
        b = a
        for i in r.sample(range(64), 1):
            b ^= 1 << i
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long")
    assert df.filter(~F.arrays_overlap(op10.block_keys(F.col("a")), op10.block_keys(F.col("b")))).count() == 0


@pytest.mark.parametrize("power", [-700, 700])
def test_tiny_and_huge_vectors_are_found_as_others_are(spark, power):
    """Their squares are 0 or infinite; cosines are those of the same vectors at another size, to the bit."""
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((60, 16))
    rows = lambda v: spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    found = lambda v: sorted((r.query_id, r.rank, r.vec_id, r.score) for r in op9.nearest(rows(v), every=10).collect())
    mixed = vectors.copy()
    mixed[::3] = np.ldexp(vectors[::3], power)
    want = found(vectors)
    assert len(want) == 30 and found(np.ldexp(vectors, power)) == want == found(mixed)
