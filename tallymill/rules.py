"""Data-quality rules as boolean columns, applied in one pass over one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``holds`` builds the condition from the column; where it is null the row passes."""

    name: str
    column: str
    holds: Callable[[Column], Column]
    severity: str = "quarantine"


def not_null(column: str, **more) -> Rule:
    return Rule(f"{column}_not_null", column, lambda c: c.isNotNull(), **more)


def at_least(column: str, low: float, **more) -> Rule:
    return Rule(f"{column}_at_least", column, lambda c: c >= low, **more)


def one_of(column: str, values: Sequence, **more) -> Rule:
    return Rule(f"{column}_in_set", column, lambda c: c.isin(*values), **more)


DEFAULT_SUITE = (not_null("customer_id"), not_null("tax_id"), at_least("amount", 0))
FEATURE_SUITE = (one_of("high_risk_amount", (0, 1), severity="warn"), not_null("transaction_velocity", severity="warn"))


def with_violations(df: DataFrame, suite: Sequence[Rule], out: str = "violations") -> DataFrame:
    """Add the names of the rules that a row breaks; a rule whose column is absent breaks for every row."""
    broken = [
        F.when(~F.coalesce(r.holds(F.col(r.column)), F.lit(True)), F.lit(r.name)) if r.column in df.columns else F.lit(r.name)
        for r in suite
    ]
    return df.withColumn(out, F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))


def split(df: DataFrame, suite: Sequence[Rule] = DEFAULT_SUITE) -> tuple[DataFrame, DataFrame]:
    """(good, bad): every row is in exactly one; bad rows keep their ``violations``."""
    marked = with_violations(df, suite)
    return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)


def report(df: DataFrame, suite: Sequence[Rule] = DEFAULT_SUITE) -> DataFrame:
    """rule, failed, checked: one row a rule, also for rules that nothing breaks."""
    failed = [F.count_if(F.array_contains("violations", r.name)).alias(r.name) for r in suite]
    counts = with_violations(df, suite).agg(F.count(F.lit(1)).alias("checked"), *failed)
    pairs = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(r.name).alias("failed")) for r in suite])
    return counts.select("checked", F.inline(pairs)).select("rule", "failed", "checked")
