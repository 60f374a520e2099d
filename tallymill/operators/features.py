"""Per-customer running features (the second feature set, under its own names)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.operators.gold import exact_sum

DESCRIPTIONS = {
    "velocity_rolling3": "Sum of the customer's last three amounts.",
    "clv_cumulative": "Customer's amounts summed up to this transaction.",
    "mean_amount": "Mean of the customer's amounts.",
    "customer_zscore": "Standard deviations from the customer's mean; more than 3 is anomalous.",
}

def _ordered(key: str, ts: str, tiebreak: str | None):
    w = Window.partitionBy(key).orderBy(F.col(ts))
    return Window.partitionBy(key).orderBy(F.col(ts), F.col(tiebreak)) if tiebreak else w

def rolling_velocity(df: DataFrame, key="customer_id", amount="amount", ts="timestamp", tiebreak=None, rows: int = 3) -> DataFrame:
    w = _ordered(key, ts, tiebreak).rowsBetween(1 - rows, 0)
    return df.withColumn("velocity_rolling3", F.sum(F.col(amount).cast("decimal(18,2)")).over(w).cast("double"))

def cumulative_clv(df: DataFrame, key="customer_id", amount="amount", ts="timestamp", tiebreak=None) -> DataFrame:
    """A row without an amount has no running sum."""
    w = _ordered(key, ts, tiebreak).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("clv_cumulative", F.when(F.col(amount).isNotNull(), F.sum(F.col(amount).cast("decimal(18,2)")).over(w).cast("double")))

def customer_zscore(df: DataFrame, key="customer_id", amount="amount") -> DataFrame:
    """Mean, sample deviation and z-score within the customer; z is 0 where the deviation is null or 0."""
    stats = df.groupBy(F.col(key).alias("__key")).agg((exact_sum(F.col(amount)) / F.count(amount)).alias("mean_amount"), F.stddev_samp(amount).alias("std_amount"))
    z = F.when(F.col("std_amount") > 0, (F.col(amount) - F.col("mean_amount")) / F.col("std_amount")).otherwise(F.lit(0.0))
    return df.join(stats, F.col(key).eqNullSafe(F.col("__key"))).drop("__key").withColumn("customer_zscore", z)

def described(df: DataFrame) -> DataFrame:
    """With descriptions in the column metadata, which Spark keeps in Parquet footers."""
    return df.select(*[F.col(c).alias(c, metadata={"description": DESCRIPTIONS[c]}) if c in DESCRIPTIONS else F.col(c) for c in df.columns])
