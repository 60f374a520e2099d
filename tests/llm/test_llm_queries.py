"""The registered queries against their SQL, and the pipeline stage by stage."""

import importlib
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tallymill.llm import op2_quality, op4_decontamination, queries
from tallymill.llm.linking import components, connect

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, data, name):
    from oracle import duck, spark_rows

    assert spark_rows(queries.QUERIES[name](spark, data)) == duck(queries.ORACLES[name], data)


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(1, 9), (9, 4), (50, 51)]
    got = {r.v: r.c for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 1: 1, 9: 1, 4: 1, 50: 50, 51: 50}


def test_connect_finds_groups_that_hubs_alone_miss(spark):
    """In one bucket the hub links to half the members; the others link among themselves."""
    members = spark.createDataFrame([(1, v) for v in range(20)], "key long, v long")
    same = lambda pairs: pairs.filter(F.col("a") % 3 == F.col("b") % 3)
    got = {r.v: r.c for r in connect(members, same).collect()}
    assert len({got[v] for v in range(0, 20, 3)}) == 1
    assert len({got.get(v, v) for v in range(1, 20, 3)}) == 1
    none = connect(members, lambda pairs: pairs.limit(0))
    assert none.count() == 0


@pytest.mark.parametrize("rounds", [3, 1])
def test_connect_settles_hot_buckets_of_many_small_classes(spark, rounds):
    """Each vertex has three true partners among 120 in a bucket, and hubs are hardly ever partners."""
    rows = [(k, v) for k in (1, 2) for v in range(180) if v // 60 in (0, k)]
    same = lambda pairs: pairs.filter(F.col("a") % 30 == F.col("b") % 30)
    got = {r.v: r.c for r in connect(spark.createDataFrame(rows, "key long, v long"), same, rounds=rounds).collect()}
    assert got == {v: v % 30 for v in range(180)}


@pytest.mark.parametrize("rounds", [3, 1])
def test_connect_follows_a_chain_within_one_bucket(spark, rounds):
    members = spark.createDataFrame([(7, v) for v in range(60)] * 2, "key long, v long")
    got = connect(members, lambda pairs: pairs.filter(F.col("b") - F.col("a") == 1), rounds=rounds).collect()
    assert {(r.v, r.c) for r in got} == {(v, 0) for v in range(60)} and len(got) == 60


def test_connect_tests_no_pair_that_cannot_be_a_link(spark):
    members = spark.createDataFrame([(1, v) for v in range(50)], "key long, v long")
    about = spark.createDataFrame([(v, v % 5) for v in range(50)], "v long, x long")
    seen = []

    def verify(pairs):
        seen.append(pairs.filter(F.col("xa") != F.col("xb")).count())
        return pairs.select("a", "b")

    got = {r.v: r.c for r in connect(members, verify, about, lambda p, q: p == q).collect()}
    assert got == {v: v % 5 for v in range(50)} and not any(seen)


def test_pipeline_stages(spark, data):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    kept = docs
    counts = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, data).cache()
        assert kept.columns == docs.columns, name
        counts.append(kept.count())
        if name == "quality":
            labels = spark.read.parquet(f"{data}/labels.parquet")
            good = op2_quality.classify(docs, labels).filter("predicted = 1")
            assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in good.collect()}
        if name == "decontamination":
            judged = op4_decontamination.contamination(kept, spark.read.parquet(f"{data}/benchmark.parquet"))
            assert judged.filter("__contamination.contaminated").count() == 0
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    assert pipeline.STAGES[-1][1](spark, kept, data).count() == counts[4]


def test_the_rest_stands_without_this_part(tmp_path):
    code = "import sys; sys.modules['tallymill.llm'] = None; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; assert 'gold_features' in e.queries() and 'pipeline' not in e.queries() and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code, ROOT], check=True, cwd=tmp_path)


ODD_ROWS = [
    (1, "a clean text of some words that stands alone", "en", "s", 1), (2, None, None, None, None), (None, "", "en", "s", 2), (3, "long " * 30_000, "en", None, 3), (4, "the same words in every copy of this one text here", "en", "s", 4),
    (4, "the same words in every copy of this one text here", "en", "s", 4), (5, "the same words in every copy of this one text here", "de", "t", 5), (6, "one two three four five six seven eight nine ten eleven twelve thirteen", "en", "t", 6), (2**60, "é ß \x00", "fr", "t", 7),
]


@pytest.mark.parametrize("case", ["odd", "no labels", "empty"])
def test_pipeline_on_odd_tables(spark, tmp_path, case):
    """Nulls in every column, empty and long texts, repeated rows, ties, columns with clashing names, empty tables."""
    pipeline = importlib.import_module("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [] if case == "empty" else ODD_ROWS
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit(7) for c in ("__row", "__file", "score", "size", "shard", "label", "quality", "key", "c", "v")})
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [] if case != "odd" else [(1, 1, 0), (3, 0, 0), (4, 1, None), (None, 1, 0), (6, None, 1), (6, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    items = [] if case == "empty" else [(1, "One two three four five six seven eight nine ten eleven twelve thirteen"), (2, None), (None, ""), (1, "x")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = kept.columns
    for name, stage in pipeline.STAGES[:-1]:
        kept.write.parquet(str(tmp_path / f"in-{name}"))
        kept = stage(spark, spark.read.parquet(str(tmp_path / f"in-{name}")), str(tmp_path))
        assert kept.columns == columns, name
    out = pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert ids <= {r[0] for r in rows} and all(r.shard is not None and 0 <= r.shard < 40 for r in out)
    if case == "no labels":
        assert 6 not in ids and len([r for r in out if r.doc_id in (4, 5)]) <= 2
    if case == "empty":
        assert out == []
