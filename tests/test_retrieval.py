import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymill.functions import text
from tallymill.operators import evaluation as ev
from tallymill.operators import retrieval as r
from tallymill.operators.resolve import jaro_winkler, similar_pairs
from tallymill.sources import external


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def scores(spark, query, *texts):
    return {x.doc_id: x.score for x in r.bm25_scores(docs(spark, *texts), query, "doc_id", "text").collect()}


def test_tokenize(spark):
    got = spark.createDataFrame([("Héllo,  wörld!\n-- a1_b",)], "t string").select(text.tokenize(F.col("t")).alias("w")).first().w
    assert got == ["héllo", "wörld", "a1b"]


def test_bm25(spark):
    import math

    once = scores(spark, "cat", "cat dog", "dog", "")
    assert once[1] == once[2] == 0.0
    idf = math.log((3 - 1 + 0.5) / (1 + 0.5) + 1)
    assert once[0] == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 1)), abs=1e-6)
    assert scores(spark, "cat cat", "cat dog", "dog", "")[0] == pytest.approx(2 * once[0], abs=1e-6)
    assert set(scores(spark, "bird", "cat", "dog").values()) == {0.0}


def test_term_stats_of_repeated_ids_and_their_plan(spark, tmp_path):
    """Rows of one id, or without one, are one document to a term, but all rows count; terms are shuffled, not pairs of document and term."""
    from oracle import duck, spark_rows
    from tallymill.plans import registry

    some = [(1, "a b a"), (1, "b c"), (2, "a"), (None, "c d"), (None, "d"), (3, None), (4, "")]
    spark.createDataFrame(some, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["bm25_term_stats"](spark, str(tmp_path))
    assert {x.term: x.df for x in got.collect()} == {"a": 2, "b": 1, "c": 2, "d": 1}
    assert spark_rows(got) == duck(registry.ORACLES["bm25_term_stats"], str(tmp_path))
    once = r.document_frequencies(docs(spark, "a b a", "b"), "doc_id", "text")
    assert {x.term: x.df for x in once.collect()} == {"a": 1, "b": 2}
    assert "doc_id" not in "".join(x for x in once._jdf.queryExecution().executedPlan().toString().splitlines() if "HashAggregate" in x or "Exchange" in x)


def test_index_replaces_whole_batches_and_adds_up_rows_of_one_id(spark, tmp_path):
    """A bucket that a batch no longer has goes with the old batch; rows without an id, and of one id and length, count as in the SQL."""
    from oracle import duck, spark_rows
    from tallymill.plans import registry

    index = r.TermIndex(spark, f"{tmp_path}-index", 32)
    index.add(docs(spark, "fox dog cat cow hen", "fox"), "a b/c")
    index.add(docs(spark, "owl owl", ""), "a b/c")
    assert index.postings(["fox", "dog", "cat", "cow", "hen"]).count() == 0
    assert [(x.term, x.tf, x.doc_len) for x in index.postings(["owl"]).collect()] == [("owl", 2, 2)]
    assert {x.doc_id for x in index.scores("owl").collect()} == {0, 1}
    some = [(1, "the and x"), (1, "the the y"), (2, "the"), (2, "ouer la"), (None, "the que"), (-3, "der"), (4, "")]
    spark.createDataFrame(some, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert spark_rows(registry.QUERIES["bm25_index_topk"](spark, str(tmp_path))) == duck(registry.ORACLES["bm25_index_topk"], str(tmp_path))


def test_term_counts(spark):
    got = spark.createDataFrame([(["b", "a", "b"],), ([],), (None,)], "w array<string>").select(r.term_counts(F.col("w")).alias("c")).collect()
    assert [x.c and [(y.term, y.tf) for y in x.c] for x in got] == [[("a", 1), ("b", 2)], [], None]


def test_top_k_fills_up_and_breaks_ties_by_id(spark):
    top = r.top_k(r.bm25_scores(docs(spark, "a", "b", "c"), "zzz", "doc_id", "text"), 2)
    assert [x.doc_id for x in top.collect()] == [0, 1]


def test_fusion(spark):
    dense = spark.createDataFrame([(1, 1), (2, 2)], "doc_id long, rank long")
    sparse = spark.createDataFrame([(2, 1), (3, 2)], "doc_id long, rank long")
    assert [x.doc_id for x in r.hybrid_merge(dense, sparse, 3).collect()] == [1, 2, 3]
    assert [x.doc_id for x in r.hybrid_merge(dense, sparse, 2).collect()] == [1, 2]
    assert r.hybrid_rrf(dense, sparse, 3).first().doc_id == 2


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 2.0], "b"), (3, [0.0, 0.0], "a")], "id long, v array<float>, l string")
    assert [x.doc_id for x in r.vector_top_k(v, [1.0, 0.1], 2, "id", "v").collect()] == [1, 3]
    assert r.vector_top_k(v, [0.0, 1.0], 1, "id", "v", "cosine").first().doc_id == 2
    assert [x.doc_id for x in r.vector_top_k(v, [0.0, 1.0], 5, "id", "v", where=F.col("l") == "a").collect()] == [3, 1]


def test_similarity_at_the_threshold(spark):
    """Seven shared of ten terms are 0.7: relevant, but no citation match."""
    shared = "cbk frc pocamla dpa section 1 section 2 section 3"
    case = spark.createDataFrame([("c", "k")], "case_id string, category string")
    hit = spark.createDataFrame([("c", "k", shared + " section 7 section 8", 1, shared + " section 9")], "case_id string, category string, target string, rank int, content string")
    assert ev.judged(hit).first().similarity == pytest.approx(0.7)
    one = ev.per_case(hit, case).first()
    assert one.precision_at_1 == 1.0 and one.citation_match is False
    none = ev.per_case(hit.limit(0), case).first()
    assert (none.precision_at_5, none.reciprocal_rank, none.citation_similarity) == (0.0, 0.0, 0.0)


def test_precision_divides_by_what_came(spark):
    case = spark.createDataFrame([("c", "k")], "case_id string, category string")
    hits = spark.createDataFrame([("c", "k", "cbk", i, t) for i, t in enumerate(["frc", "cbk"], 1)], "case_id string, category string, target string, rank int, content string")
    one = ev.per_case(hits, case).first()
    assert (one.precision_at_1, one.precision_at_5, one.reciprocal_rank) == (0.0, 0.5, 0.5)


@given(st.text(alphabet="ab \n", max_size=400), st.integers(20, 60))
def test_chunks_are_bounded_and_lose_nothing(s, size):
    parts = text.recursive_chunks(s, size, size // 4)
    assert all(0 < len(p) <= size for p in parts)
    assert {w for p in parts for w in p.split() if len(w) < 3} >= {w for w in s.split() if len(w) < 3} or size < 3 or any(len(w) > size for w in s.split())


def test_jaro_winkler():
    assert jaro_winkler("john smith", "john smyth") == pytest.approx(0.96)
    assert jaro_winkler("", "") == 1.0 and jaro_winkler("a", "") == 0.0
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)


@pytest.mark.parametrize("threshold", [0.6, 0.72, 0.85, 0.95])
def test_similar_pairs_of_unlike_lengths(spark, threshold):
    names = ["acme", "acme holdings", "abcd", "abcdefghijkl", "abcdefghijklmnop", "abcdefghijklmnopqrst", "a", "ab", "xa", "acme holding"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = {(r.left_id, r.right_id): r.similarity for r in similar_pairs(df, "id", "name", F.lit(1), threshold).collect()}
    scores = {(i, j): jaro_winkler(a, b) for j, b in enumerate(names) for i, a in enumerate(names[:j])}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in scores.items() if v >= threshold}
    assert threshold != 0.85 or {(0, 1), (2, 3)} <= set(got)


def test_json_corpus(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"documents": [{"id": "a", "document": "x", "metadata": {"source": "s", "version": "2"}}]}))
    (tmp_path / "e.json").write_text(json.dumps({"documents": []}))
    got = external.json_corpus(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].metadata.source_origin == "s"
    want = spark.range(1).select(F.sha2(F.lit("x|s|None|2"), 256).alias("h")).first().h
    assert got[0].metadata.metadata_hash == want


def test_context(spark):
    hits = spark.createDataFrame([(2, "b", "B", 0.5), (1, "a", "A", 0.5)], "rank long, source_id string, content string, confidence_score double")
    assert r.context(hits).first().context.startswith("[1] Source: a\nContent: A\nConfidence: 0.500\n\n[2]")


def test_embedding_hook(spark):
    out = external.embed(docs(spark, "aa", "b"), "text", lambda some: [[float(len(t))] for t in some], batch=1)
    assert sorted(x.embedding[0] for x in out.collect()) == [1.0, 2.0]
