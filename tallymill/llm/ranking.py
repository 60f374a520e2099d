"""Gapless ranks within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.session import materialize

_POS = (1 << 33) - 1


def gapless_rank(rows: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Add ``out``: the rank from 0 of each row within ``group`` by ``order``.

    Rows are dealt by ranges of (group, order, row), so a group or an order
    value that holds a third of all rows spreads over many tasks. A row's rank
    is its place in its range less the place where its group begins there,
    plus the rows of the group in earlier ranges. ``rows`` must be stable
    (materialized); repeated rows get successive ranks.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group), *map(F.col, order), F.col("__tie")]
    placed = (
        rows.withColumn("__tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("__at", F.monotonically_increasing_id())
        .select("*", F.shiftright("__at", 33).alias("__part"), F.col("__at").bitwiseAND(_POS).alias("__pos"))
        .drop("__at", "__tie")
    )
    placed = materialize(placed, "ranked")
    spans = placed.groupBy("__part", group).agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("__part", F.col(group).alias("__group"), "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    same = (placed["__part"] == spans["__part"]) & placed[group].eqNullSafe(spans["__group"])
    return placed.join(spans, same).withColumn(out, placed["__pos"] - F.col("__first") + F.col("__off")).select(*rows.columns, out)
