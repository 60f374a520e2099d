"""Running sums over a global order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.session import materialize


def running_sums(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Add cum_<column> by ``order``: rows are dealt by range, summed within ranges, and shifted by the ranges before."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("__part").agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = totals.select("__part", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in columns])
    within = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(F.broadcast(offsets), "__part")  # as many rows as shuffle partitions
    return joined.select(*df.columns, *[(F.sum(c).over(within) + F.col(f"__{c}")).alias(f"cum_{c}") for c in columns])
