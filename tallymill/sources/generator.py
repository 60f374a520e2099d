"""Synthetic transactions: distributions, not the random stream, are what runs share with other generators."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymill.operators.privacy import laplace_amount
from tallymill.operators.scan import running_sums

DOMAINS = ("example.com", "example.net", "example.org")


# The defaults of a profile.
@dataclass(frozen=True)
class Profile:
    transaction_type_probs: dict = field(default_factory=lambda: {"P2P": 0.6, "C2B": 0.3, "B2C": 0.1})
    amount_mean: float = 5.0
    amount_std: float = 1.0
    velocity_lambda: float = 10.0
    dataset_size: int = 500_000
    total_queries_per_year: int = 10
    query_type: str = "standard"
    clipping_bound: float = 10_000.0
    seed: int = 42

    @property
    def epsilon(self) -> float:
        return 1.0 / self.total_queries_per_year / (2 if self.query_type == "high_sensitivity" else 1)


def users(spark: SparkSession, n: int, p: Profile) -> DataFrame:
    """Users with unique (tax_id, email) and log-normal opening balances."""
    i = F.col("id")
    domain = F.element_at(F.array(*map(F.lit, DOMAINS)), (F.pmod(i, F.lit(len(DOMAINS))) + 1).cast("int"))
    return spark.range(n).select(
        F.concat(F.lit("user_"), i).alias("sender_id"),
        F.concat(F.lit("TAX-"), (i + 100_000_000).cast("string")).alias("tax_id"),
        F.concat(F.lit("user_"), i, F.lit("@"), domain).alias("email"),
        F.exp(F.lit(p.amount_mean + 5) + F.lit(p.amount_std) * F.randn(p.seed)).alias("balance"),
    )


def attempts(spark: SparkSession, n: int, num_users: int, p: Profile) -> DataFrame:
    """Candidate transactions with noisy amounts, channels and a clock of exponential gaps."""
    s, channel, reached = p.seed, F.lit(None).cast("string"), 0.0
    draw = F.col("__channel")
    for name, share in p.transaction_type_probs.items():
        reached += share
        channel = F.coalesce(channel, F.when(draw < reached, F.lit(name)))
    channel = F.coalesce(channel, F.lit(list(p.transaction_type_probs)[-1]))
    raw = spark.range(n).select(
        "id",
        F.floor(F.rand(s + 1) * num_users).cast("long").alias("__user"),
        F.exp(F.lit(p.amount_mean) + F.lit(p.amount_std) * F.randn(s + 2)).alias("__amount"),
        F.rand(s + 3).alias("__channel"),
        (-F.log(1 - F.rand(s + 4)) * p.velocity_lambda * 60).alias("gap"),
    )
    timed = running_sums(raw, "id", ["gap"])
    return timed.select(
        "id",
        F.concat(F.lit("txn_"), "id").alias("transaction_id"),
        F.concat(F.lit("user_"), "__user").alias("sender_id"),
        F.round(laplace_amount(F.col("__amount"), p.clipping_bound, p.epsilon, s + 5), 2).alias("transaction_amount"),
        F.expr("timestampadd(SECOND, cast(floor(cum_gap) AS int), TIMESTAMP_NTZ '2024-01-01 00:00:00')").alias("timestamp"),
        channel.alias("channel_type"),
    )


def generate(spark: SparkSession, n: int, num_users: int = 1000, profile: Profile = Profile()) -> DataFrame:  # noqa: B008
    """Attempts that their sender's opening balance covers, running sums of a sender's attempts in order.

    Set-based: an attempt that overdraws is left out and still counts, where a
    sequential run would look for another sender. ``generate_sequential`` does
    that for batches that fit one task.
    """
    a = attempts(spark, n, num_users, profile).join(users(spark, num_users, profile), "sender_id")
    spent = F.sum("transaction_amount").over(Window.partitionBy("sender_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return a.withColumn("__spent", spent).filter(F.col("__spent") <= F.col("balance")).drop("__spent", "balance", "id")


def generate_sequential(spark: SparkSession, n: int, num_users: int = 1000, profile: Profile = Profile(), most: int = 1_000_000) -> DataFrame:  # noqa: B008
    """In order, each attempt debits its sender, else a random user that can pay, else is left out: one task, so at most ``most`` rows."""
    if n > most:
        raise ValueError(f"{n} rows are more than one task may hold; use generate()")
    import numpy as np

    people = users(spark, num_users, profile).toPandas()
    balances = people["balance"].to_numpy(copy=True)
    index = {u: i for i, u in enumerate(people["sender_id"])}
    seed = profile.seed

    def run(left: pd.DataFrame) -> pd.DataFrame:
        rng, keep, rest, left = np.random.default_rng(seed), [], balances.copy(), left.sort_values("id")
        for row in left.itertuples(index=False):
            who = index[row.sender_id]
            if rest[who] < row.transaction_amount:
                able = np.flatnonzero(rest >= row.transaction_amount)
                if not len(able):
                    continue
                who = int(rng.choice(able))
            rest[who] -= row.transaction_amount
            keep.append((row.id, who))
        out = left.merge(pd.DataFrame(keep, columns=["id", "who"]), on="id")
        for c in ("sender_id", "tax_id", "email"):
            out[c] = people[c].to_numpy()[out["who"].to_numpy(dtype=int)]
        return out[["transaction_id", "sender_id", "transaction_amount", "timestamp", "channel_type", "tax_id", "email"]]

    schema = "transaction_id string, sender_id string, transaction_amount double, timestamp timestamp_ntz, channel_type string, tax_id string, email string"
    return attempts(spark, n, num_users, profile).groupBy(F.lit(1).alias("all")).applyInPandas(run, schema)


def arrivals_rate(p: Profile) -> float:
    """Expected rows an hour."""
    return 60 / p.velocity_lambda if p.velocity_lambda else math.inf
