"""Fuzzy pairs, their clusters, the written term index and drift over reference quantiles."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallymill.functions.text import tokenize
from tallymill.operators import clusters, privacy, resolve
from tallymill.operators import evaluation as ev
from tallymill.operators import retrieval as r

NAMES = "id long, name string, brand string"


def names(seed, n):
    rnd = random.Random(seed)
    base = ["acme holdings", "acme holding", "Zebra & Co 1234", "aaaaaaaaaaaa", "aaaaaaa", "", "x", "ÉCOLE bleue"]
    out = []
    for i in range(n):
        s = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(s) + 1)
            s[at : at + rnd.randrange(2)] = rnd.choice("abz1 É&")
        out.append((i, "".join(s), rnd.choice(["p", "q"])))
    return out + [(n, None, "p"), (n + 1, "acme holdings", "p")]


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.85, 0.97])
def test_the_bound_drops_no_pair(spark, threshold, monkeypatch):
    monkeypatch.setattr(resolve, "CHUNK", 17)
    rows = names(int(threshold * 100), 150)
    got = {(x.left_id, x.right_id): x.similarity for x in resolve.similar_pairs(spark.createDataFrame(rows, NAMES), "id", "name", F.col("brand"), threshold).collect()}
    least = {}
    for i, n, b in rows:
        if n is not None:
            least[b, n] = min(i, least.get((b, n), i))
    known = [(i, n, b) for (b, n), i in least.items()]
    want = {(i, j): round(resolve.jaro_winkler(n, m), 6) for i, n, b in known for j, m, c in known if b == c and i < j and resolve.jaro_winkler(n, m) >= threshold}
    assert got == pytest.approx(want, abs=1e-6)


def test_golden_ids(spark):
    rows = [(1, "john smith", "p"), (2, "john smyth", "p"), (3, "john smyths", "p"), (4, "zoe", "p"), (5, "john smith", "q"), (6, "john smith", "p"), (7, None, "p"), (6, "john smith", "p")]
    got = sorted(tuple(x) for x in resolve.golden_ids(spark.createDataFrame(rows, NAMES), "id", "name", F.col("brand"), 0.9).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 1), (6, 1)]
    assert resolve.golden_ids(spark.createDataFrame([], NAMES), "id", "name", F.col("brand")).count() == 0


def test_one_brand_of_a_third_of_all_names(spark):
    """Its names spread over chunks and tasks, and few of the pairs are scored."""
    some = spark.range(9000).select("id", F.sha2(F.col("id").cast("string"), 256).substr(F.lit(1), F.lit(14)).alias("name"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 2000).cast("string")).alias("brand"))
    got = resolve.similar_pairs(some, "id", "name", F.col("brand"), 0.93)
    assert got.filter((F.col("left_id") >= F.col("right_id")) | (F.col("similarity") < 0.93)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_clusters(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(1, 50)] + [(7, None), (500, 500), (9, 8), (9, 8)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        if b is not None:
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    df = spark.createDataFrame(pairs, "left_id long, right_id long")
    assert {x.id: x.cluster_id for x in clusters.clusters(df).collect()} == {x: find(x) for x in list(top)}
    assert clusters.clusters(df.limit(0)).count() == 0


def test_index_reads_asked_buckets_only(spark, tmp_path, capsys):
    texts = [(1, "red fox"), (2, "red red dog"), (3, None), (4, ""), (5, "fox"), (6, "blue whale")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    index = r.TermIndex(spark, str(tmp_path), 32)
    index.add(docs.filter("doc_id < 4"), "a")
    index.add(docs.filter("doc_id >= 4"), "b")
    index.add(docs.filter("doc_id >= 4"), "b")
    whole = {x.doc_id: round(x.score, 6) for x in r.bm25_scores(docs, "red red whale zebra", "doc_id", "text").collect()}
    assert {x.doc_id: round(x.score, 6) for x in index.scores("red red whale zebra").collect()} == whole and len(whole) == 6 and whole[2] > whole[1] > 0 == whole[5]
    assert {x.doc_id for x in index.scores("fox", every=False).collect()} == {1, 5}
    index.postings(["fox"]).explain("formatted")
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = ", capsys.readouterr().out)
    assert index.postings(["fox"]).select(F.input_file_name()).distinct().count() == 2
    assert {x.score for x in index.scores("").collect()} == {0.0} and index.scores(" ", every=False).count() == 0
    third = spark.createDataFrame([(9, "zebra fox")], "doc_id long, text string")
    index.add(third, "c")
    both = r.bm25_scores(docs.union(third), "zebra fox", "doc_id", "text")
    assert {x.doc_id: round(x.score, 6) for x in index.scores("zebra fox").collect()} == {x.doc_id: round(x.score, 6) for x in both.collect()}
    assert docs.select(tokenize(F.col("text")).alias("w")).count() == 6


def test_reference_quantiles_and_empty_samples(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"), (F.col("id") % 2).cast("int").alias("k"))
    edges = privacy.reference_edges(df, "v", "k", 4, 1e-4)
    assert len(edges) == 3 and all(abs(e - w) <= 2 for e, w in zip(edges, (250, 500, 750)))
    assert privacy.psi_alert(df, "v", "k", edges).first().alert is False
    moved = df.withColumn("v", F.col("v") + F.col("k") * 400)
    assert privacy.psi_alert(moved, "v", "k", edges).first().alert is True
    one = privacy.psi_alert(df.filter("k = 0"), "v", "k", edges).first()
    assert (one.psi, one.alert) == (None, None)
    none = privacy.psi_alert(df.limit(0), "v", "k", edges).first()
    assert (none.psi, none.alert) == (None, None) and privacy.reference_edges(df.filter("k = 1"), "v", "k") == []
    assert privacy.psi(df.withColumn("v", F.lit(None).cast("double")), "v", "k", [1.0]).count() == 0


def test_alert_is_above_the_limit(spark):
    df = spark.createDataFrame([(0.0, 0), (2.0, 0), (0.0, 1), (2.0, 1), (2.0, 1)], "v double, k int")
    index = privacy.psi_alert(df, "v", "k", [1.0]).first().psi
    assert privacy.psi_alert(df, "v", "k", [1.0], index).first().alert is False


def test_reranked_hits(spark):
    hits = spark.createDataFrame([(1, "aa"), (2, "a"), (3, None), (4, "bb")], "doc_id long, content string")
    assert {x.confidence_score for x in r.rerank(hits).collect()} == {0.5} and r.rerank(hits, k=2).count() == 2
    assert [x.doc_id for x in r.rerank(hits, lambda h: F.length(h["content"]) / 10).collect()] == [1, 4, 2, 3]
    assert [x.doc_id for x in r.rerank(hits, lambda h: F.length(h["content"]) / 10, 1).collect()] == [1]


def test_evaluation_with_a_query_builder_and_lookup(spark):
    cases = spark.createDataFrame([(1, "x", "POCAMLA Section 1"), (2, "y", "CBK Section 2"), (3, "y", "FRC")], "case_id long, category string, target string")
    corpus = spark.createDataFrame([("pocamla section 1",), ("cbk section 9",)], "content string")

    def retrieve(queries):
        return queries.join(corpus, F.lower(F.split("query", " ")[0]) == F.split("content", " ")[0]).select("case_id", F.lit(1).alias("rank"), "content")

    by = {x.case_id: x for x in ev.evaluate(cases, retrieve, lambda c: c["target"]).collect()}
    assert (by[1].precision_at_1, by[2].precision_at_1, by[3].precision_at_1) == (1.0, 0.0, 0.0) and by[1].citation_match and by[2].citation_similarity == pytest.approx(1 / 3)
    assert all(x.precision_at_5 == 0 for x in ev.evaluate(cases, retrieve).collect())
    assert ev.lookup(cases, "case_id", 2)["target"] == "CBK Section 2"
    for value in (9, None):
        with pytest.raises(KeyError, match="no row"):
            ev.lookup(cases, "case_id", value)
    with pytest.raises(KeyError, match="several"):
        ev.lookup(cases, "category", "y")
