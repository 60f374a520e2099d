"""Privacy budget, noise and the fidelity of synthetic amounts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.operators.scan import running_sums

# The yearly privacy budget and the significance of the fidelity test.
ANNUAL_EPSILON, SIGNIFICANCE = 1.0, 0.05


def dp_budget(dataset_size: Column, queries_per_year: Column, query_type: Column) -> tuple[Column, Column]:
    """(epsilon, delta) of one query; a query of high sensitivity gets half."""
    epsilon = F.lit(ANNUAL_EPSILON) / queries_per_year
    return F.when(query_type == "high_sensitivity", epsilon / 2).otherwise(epsilon), F.lit(1.0) / (dataset_size * 10)


def clip(c: Column, bound: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(bound)))


def laplace_amount(c: Column, bound: float, epsilon: float, seed: int) -> Column:
    """Clipped, with Laplace noise of scale (bound / 100) / epsilon, at least 1.

    The scale is a hundredth of what a sensitivity of ``bound`` needs for
    epsilon-privacy; it is the pipeline's documented trade for utility.
    """
    u = F.rand(seed) - 0.5
    noise = -F.lit(bound / 100 / epsilon) * F.signum(u) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(1e-300)))
    return F.when(c.isNotNull(), F.greatest(clip(c, bound) + noise, F.lit(1.0)))


def ks_two_sample(df: DataFrame, value: str, sample: str) -> DataFrame:
    """n1, n2, ks_statistic of the two samples that the 0/1 column ``sample`` tells apart; null statistic if one is empty.

    Values are counted before they are ordered; the running counts go over
    ranges of values, so no task sees all of them.
    """
    known = df.filter(F.col(value).isNotNull() & F.col(sample).isNotNull())
    counts = known.groupBy(F.col(value).alias("x")).agg(F.count_if(F.col(sample) == 0).alias("a"), F.count_if(F.col(sample) != 0).alias("b"))
    run = running_sums(counts, "x", ["a", "b"])
    both = run.crossJoin(F.broadcast(run.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n1"), F.coalesce(F.sum("b"), F.lit(0)).alias("n2"))))
    gap = F.max(F.abs(F.try_divide("cum_a", "n1") - F.try_divide("cum_b", "n2")))
    return both.agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"), gap.alias("ks_statistic"))


def kolmogorov_p(statistic: float, n1: int, n2: int) -> float:
    """Asymptotic two-sided p-value."""
    if not n1 or not n2:
        return 0.0
    x = statistic * math.sqrt(n1 * n2 / (n1 + n2))
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101))))


def fidelity(df: DataFrame, value: str, sample: str) -> dict:
    """The report of one comparison: PASS where equality is not rejected; empty samples FAIL."""
    row = ks_two_sample(df, value, sample).first()
    if not row or not row["n1"] or not row["n2"]:
        return {"fidelity_status": "FAIL", "reason": "Empty dataset"}
    p = kolmogorov_p(row["ks_statistic"], row["n1"], row["n2"])
    return {"ks_statistic": row["ks_statistic"], "p_value": p, "is_aligned": p > SIGNIFICANCE, "fidelity_status": "PASS" if p > SIGNIFICANCE else "FAIL"}


def reference_edges(df: DataFrame, value: str, sample: str, buckets: int = 10, error: float = 1e-4) -> list[float]:
    """Edges that cut the reference (``sample`` 0) into ``buckets`` of equal counts, from one quantile sketch merged over all partitions.

    The rank of an edge is off by at most ``error`` times the rows. Equal edges
    are one; without a reference there are none.
    """
    at = [i / buckets for i in range(1, buckets)]
    reference = F.when(F.col(sample) == 0, F.col(value))
    row = df.agg(F.percentile_approx(reference, at, round(1 / error)).alias("edges")).first()
    return sorted(set(row["edges"] or []))


def psi(df: DataFrame, value: str, sample: str, edges: list[float]) -> DataFrame:
    """Population stability index over fixed buckets: bucket, expected, actual, part.

    Rows without a value are in no bucket. The share of a sample without rows, and with it the part, is null.
    """
    bucket = F.lit(0)
    for e in edges:
        bucket = bucket + (F.col(value) > e).cast("int")
    known = df.filter(F.col(value).isNotNull())
    counts = known.groupBy(bucket.alias("bucket")).agg(F.count_if(F.col(sample) == 0).alias("a"), F.count_if(F.col(sample) != 0).alias("b"))
    total = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p = counts.crossJoin(F.broadcast(total)).select("bucket", F.try_divide("a", "ta").alias("expected"), F.try_divide("b", "tb").alias("actual"))
    low = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(1e-6)))
    return p.withColumn("part", (low("actual") - low("expected")) * F.log(low("actual") / low("expected")))


# Fixed value: the index above which a drifted feature raises an alert.
PSI_ALERT = 0.15


def psi_alert(df: DataFrame, value: str, sample: str, edges: list[float], above: float = PSI_ALERT) -> DataFrame:
    """One row: the index, summed over the buckets, and whether it is more than ``above``; both null where a sample has no rows."""
    total = psi(df, value, sample, edges).agg(F.sum("part").alias("psi"))
    return total.withColumn("alert", F.col("psi") > above)
