"""Quality of retrieval: citations, ranks, reasoning, decisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tallymill.functions.text import citation_similarity

# Precision counts a similarity of 0.7, a citation match needs more than that.
RELEVANT, MATCH = 0.7, 0.7


def judged(retrieved: DataFrame) -> DataFrame:
    """From (case_id, category, target, rank, content) add the similarity."""
    return retrieved.withColumn("similarity", citation_similarity(F.col("target"), F.col("content")))


def per_case(retrieved: DataFrame, cases: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """Precision at each k (over what was retrieved up to k), reciprocal rank, best similarity and match, one row a case; 0 where nothing was retrieved."""
    j = judged(retrieved)
    good = F.col("similarity") >= RELEVANT
    aggs = [F.try_divide(F.count_if((F.col("rank") <= k) & good), F.count_if(F.col("rank") <= k)).alias(f"precision_at_{k}") for k in ks]
    first = F.min(F.when(good, F.col("rank")))
    by = j.groupBy("case_id").agg(*aggs, F.try_divide(F.lit(1.0), first).alias("reciprocal_rank"), F.max("similarity").alias("citation_similarity"))
    names = [f"precision_at_{k}" for k in ks] + ["reciprocal_rank", "citation_similarity"]
    out = cases.select("case_id", "category").join(by, "case_id", "left")
    return out.select("case_id", "category", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names]).withColumn("citation_match", F.col("citation_similarity") > MATCH)


def overall(cases: DataFrame, metrics: list[str]) -> DataFrame:
    return cases.agg(F.count(F.lit(1)).alias("total_cases"), *[F.round(F.avg(F.col(m).cast("double")), 6).alias(m) for m in metrics])


def per_category(cases: DataFrame, metrics: list[str]) -> DataFrame:
    return cases.groupBy("category").agg(*[F.round(F.avg(F.col(m).cast("double")), 6).alias(m) for m in metrics])


def alignment(expected: Column, actual: Column) -> Column:
    """Share of expected steps of which some word stands within some actual step; of no expected steps 1 if there are no actual ones, else 0."""
    low = F.transform(actual, lambda a: F.lower(a))
    covered = F.filter(expected, lambda e: F.exists(low, lambda a: F.exists(F.filter(F.split(F.lower(e), r"\s+"), lambda w: w != ""), lambda w: F.contains(a, w))))
    return F.when(F.size(expected) == 0, (F.size(actual) == 0).cast("double")).otherwise(F.size(covered) / F.size(expected))


def evaluate(cases: DataFrame, retrieve: Callable[[DataFrame], DataFrame], query_builder: Callable[[DataFrame], Column] | None = None, ks=(1, 3, 5)) -> DataFrame:
    """``per_case`` of what ``retrieve`` finds for each case's query.

    ``query_builder`` makes the query's column from the cases (by default the
    category and the target); ``retrieve`` takes (case_id, query) and returns (case_id, rank, content).
    """
    build = query_builder or (lambda c: F.concat_ws(" ", c["category"], c["target"]))
    found = retrieve(cases.select("case_id", build(cases).alias("query")))
    return per_case(cases.select("case_id", "category", "target").join(found.select("case_id", "rank", "content"), "case_id"), cases, ks)


def lookup(df: DataFrame, key: str, value) -> Row:
    """The one row whose ``key`` is ``value``; KeyError where there is none or several."""
    found = df.filter(F.col(key) == F.lit(value)).limit(2).collect()
    if len(found) != 1:
        raise KeyError(f"{key} = {value!r} has {'no row' if not found else 'several rows'}")
    return found[0]
